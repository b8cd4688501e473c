"""The queries of this subpackage and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .ann import ORACLE as ANN_SQL
from .ann import op10_ann
from .bpe import op7_bpe
from .decontaminate import op9_decontaminate
from .html import op3_html
from .lm import ORACLE as LM_SQL
from .lm import op5_lm_score
from .minhash import op6_minhash
from .quality import op8_quality
from .secrets import op2_secrets
from .suffix import op1_suffix_dedup
from .toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_secrets": op2_secrets,
    "op3_html": op3_html,
    "op4_toxicity": op4_toxicity,
    "op5_lm_score": op5_lm_score,
    "op6_minhash": op6_minhash,
    "op7_bpe": op7_bpe,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_ann": op10_ann,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": oracles.SUFFIX,
    "op2_secrets": oracles.SECRETS,
    "op3_html": oracles.MAIN_TEXT,
    "op5_lm_score": LM_SQL,
    "op6_minhash": oracles.MINHASH,
    "op9_decontaminate": oracles.TILES,
    "op10_ann": ANN_SQL,
}

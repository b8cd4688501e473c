"""Secret scans by an incremental blob ledger.

Every version of every path is content-addressed (SHA-256). The ledger holds one row for each blob and rule version that
was scanned, with the spans found, empty ones included. It is a folder of Parquet files that each run appends to: a scan looks
only at the pairs the ledger lacks, and the findings of all pairs, old and new, are then joined back to every path that holds
the blob. LEDGER names the session setting with the folder that runs share; without it a run starts a ledger of its own in the
cluster's shared folder.

Only digests and ids are grouped and joined. The text of an unseen blob is fetched once, from the version with the
smallest id, by a hash join that builds on the ids, so no text is sorted and copies are never scanned twice.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    """A pattern, its version, the group whose length counts, the least length, and words one of which a match must hold."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds, in the order in which ties are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 8, 2, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 16, needs=("AKIA",)),
    Rule("hex", r"[0-9a-f]+", 32),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
)
RULES = BASE + MORE
# A private key with its body: up to the END line of its name or, where that is missing, over the headers and base64 lines
# that follow. Masking takes this version; the findings list the BEGIN line, as their SQL does.
_BREAK = r"(?:\s|\\[nr])"
PEM = (
    r"-----BEGIN ([A-Z ]{0,32})PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_BREAK}++(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_BREAK}++[A-Za-z0-9+/]{{40,}}+={{0,2}})++(?:{_BREAK}++[A-Za-z0-9+/]{{1,39}}+={{0,2}}(?=[\s\\\"']|\Z))?|)"
)
MASKED = BASE + (Rule("pem", PEM, needs=("PRIVATE KEY-----",), version=2), MORE[1])
SPANS = "array<struct<kind:string,start:int,stop:int>>"
ENTRY = f"blob string, rule string, spans {SPANS}"
LEDGER = "spark.bytequarry.secrets.ledger"


@lru_cache
def _compiled(rule: Rule) -> re.Pattern:
    pattern = rule.pattern
    if pattern == r"[0-9a-f]+":  # the same runs, without a match for each short one
        pattern = rf"[0-9a-f]{{{rule.least},}}"
    return re.compile(pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0))


def scan_text(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points, leftmost non-overlapping for each kind, by start and then by rule order."""
    found, folded = [], None
    for order, rule in enumerate(rules):
        if rule.needs:
            if rule.any_case and folded is None:
                folded = text.lower()
            if not any(x in (folded if rule.any_case else text) for x in rule.needs):
                continue
        found += [(m.start(), order, rule.kind, m.end()) for m in _compiled(rule).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def _scan(rules: tuple[Rule, ...]):
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            blobs, keys, spans = [], [], []
            for blob, text, todo in zip(batch.column("blob").to_pylist(), batch.column("content"), batch.column("todo").to_pylist(), strict=True):
                own = tuple(by_key[k] for k in todo)
                found = scan_text(text.as_py() or "", own)
                for rule in own:
                    blobs.append(blob)
                    keys.append(rule.key)
                    spans.append([{"kind": k, "start": a, "stop": b} for k, a, b in found if k == rule.kind])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(keys, pa.string()), pa.array(spans, out_type)], ["blob", "rule", "spans"])

    return run


def address(versions: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Version id and the SHA-256 of its content; null content is empty."""
    return versions.select(F.col(id_col).alias("version_id"), F.sha2(F.coalesce(F.col(content_col), F.lit("")).cast("binary"), 256).alias("blob"))


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, spans) for the pairs of blob and rule version that the ledger lacks.

    versions may hold further columns of any name, null ids and contents (null is empty), and repeated rows; a row that is
    repeated with its id and content may be scanned as often. Texts of any length are scanned whole."""
    all_rules = F.array(*[F.lit(r.key) for r in rules])
    blobs = address(versions, id_col, content_col).groupBy("blob").agg(F.min("version_id").alias("version_id"))
    if ledger is None:
        todo = blobs.withColumn("todo", all_rules)
    else:
        seen = ledger.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").filter(F.size("todo") > 0)
    texts = versions.select(F.col(id_col).alias("version_id"), F.col(content_col).alias("content"))
    # A repeated id may hold other contents: the blob is matched as well.
    texts = texts.withColumn("blob", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    todo = todo.select(F.col("version_id").alias("first_id"), F.col("blob").alias("first_blob"), "todo")
    same = F.col("version_id").eqNullSafe(F.col("first_id")) & (F.col("blob") == F.col("first_blob"))
    fetched = texts.join(todo.hint("shuffle_hash"), same).select("blob", "content", "todo")
    return fetched.mapInArrow(common.lean(_scan(rules)), ENTRY)


def new_folder(spark: SparkSession) -> str:
    """The folder that the session names, else one of this run's own, which goes when the application ends."""
    named = spark.conf.get(LEDGER, None)
    if named:
        return named
    path = f"{common.shared_dir(spark)}/secrets-ledger-{uuid.uuid4().hex}"
    common.delete_on_exit(spark, path)
    return path


def open_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    return spark.read.schema(ENTRY).parquet(folder) if common.exists(spark, folder) else None


def extend(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """Scans the pairs that the ledger at folder lacks, appends them to it and returns the whole ledger.

    An entry that two runs add at the same time does no harm: findings take each span once."""
    spark = versions.sparkSession
    scan_new(versions, open_ledger(spark, folder), rules, id_col, content_col).write.option("compression", "zstd").mode("append").parquet(folder)
    return open_ledger(spark, folder)


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", content_col: str = "text") -> DataFrame:
    """One row for each version: its id, blob and all spans by start, then rule order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0)).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    ranked = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return address(versions, id_col, content_col).join(current, "blob", "left").select(F.col("version_id").alias(id_col), "blob", F.coalesce(F.array_distinct(ranked), F.array().cast("array<struct<start:int,rank:int,kind:string,stop:int>>")).alias("spans"))


MASK = "[secret]"


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with each maximal union of spans (start, end) replaced by MASK."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _mask(text: int, count: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, columns = batch.column(batch.num_columns - 1).to_pylist(), list(batch.columns[:-1])
            hit = [i for i, s in enumerate(spans) if s]
            if hit:
                texts = columns[text].to_pylist()
                for i in hit:
                    texts[i] = mask(texts[i], [(s["start"], s["stop"]) for s in spans[i]])
                columns[text] = pa.array(texts, columns[text].type)
                if count is not None:
                    numbers = columns[count].to_pylist()
                    for i in hit:
                        numbers[i] = len(texts[i])
                    columns[count] = pa.array(numbers, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return run


def masked(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = MASKED, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with what the ledger holds under these rules masked in its texts and, where there is such a column, its count of
    characters set anew; all other columns and rows as they are, whatever their names. Null texts stay null."""
    blob, found = common.fresh("blob", docs.columns), common.fresh("spans", docs.columns)
    current = ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    spans = current.groupBy(F.col("blob").alias(blob)).agg(F.flatten(F.collect_list("spans")).alias(found))
    addressed = docs.withColumn(blob, F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    joined = addressed.join(spans.hint("shuffle_hash"), blob, "left").select(*[F.col(f"`{c}`") for c in docs.columns], found)
    return common.map_rows(joined, _mask(docs.columns.index(text_col), docs.columns.index(count_col) if count_col in docs.columns else None), drop=1)


def stage_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; what the scan finds in it is masked."""
    return masked(docs, extend(docs, new_folder(spark), MASKED))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = findings(documents, extend(documents, new_folder(spark)))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def digest(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of one text, for tests."""
    spans = [s for s in scan_text(text or "", BASE)]
    return (*(sum(k == r.kind for k, _, _ in spans) for r in BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())

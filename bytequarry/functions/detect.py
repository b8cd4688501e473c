"""Content detection as one CASE over the first 8192 bytes; only the entropy of what is neither known nor text needs Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = 8192
"""Fixed value: bytes that detection looks at."""
HIGH_ENTROPY = 7.5

# First bytes by type, in the order in which they are tried.
MAGICS = (
    ("NativeArchive", ("46495401",)),
    ("ZipArchive", ("504B0304", "504B0506")),
    ("SevenZipArchive", ("377ABCAF271C",)),
    ("GzipArchive", ("1F8B",)),
    ("Bzip2Archive", ("425A68",)),
    ("XzArchive", ("FD377A585A00",)),
    ("ZstdArchive", ("28B52FFD",)),
)
LATER_MAGICS = (("JpegImage", "FFD8FF"), ("PngImage", "89504E470D0A1A0A"))
CONTAINERS = ("NativeArchive", "ZipArchive", "SevenZipArchive", "TarArchive", "GzipArchive", "Bzip2Archive", "XzArchive", "ZstdArchive")


def entropy_of(data: bytes) -> float:
    """Shannon entropy of the bytes in bits; 0 for none."""
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return float(max(0.0, -(p * np.log2(p)).sum()))


def _entropy(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(entropy_of, na_action="ignore").astype("float64")


def entropy(content: Column) -> Column:
    """Bits per byte of a binary column, null for null."""
    return F.pandas_udf(_entropy, "double")(content)


def known_type(content: Column) -> Column:
    """The type by magic bytes or as text; null where only the entropy can tell."""
    head = F.substring(content, 1, PROBE)
    n = F.octet_length(content)
    starts = lambda *magics: F.expr("false") if not magics else _any([F.startswith(head, F.unhex(F.lit(m))) for m in magics])
    at = lambda place, size: F.substring(head, place, size)
    out = F.when(n == 0, "UnknownBinary")
    for name, magics in MAGICS:
        out = out.when(starts(*magics), name)
    out = out.when((F.least(n, F.lit(PROBE)) > 262) & (at(258, 5) == F.unhex(F.lit("7573746172"))), "TarArchive")
    for name, magic in LATER_MAGICS:
        out = out.when(starts(magic), name)
    out = out.when((n >= 12) & (at(5, 4) == F.unhex(F.lit("66747970"))), "Mp4Video").when(starts("255044462D"), "PdfDocument")
    text = F.regexp_replace(F.try_validate_utf8(head), "^\\p{IsWhite_Space}+", "")
    kind = F.when(text.startswith("{") | text.startswith("["), 'StructuredText("JSON")').when(text.startswith("<"), 'StructuredText("XML/HTML")').otherwise('StructuredText("Text/SourceCode/Logs")')
    return out.when(F.is_valid_utf8(head), kind)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _by_entropy(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for known, head in batches:
        yield pd.Series([k if k is not None else (None if h is None else "HighEntropyBinary" if entropy_of(h) > HIGH_ENTROPY else "UnknownBinary") for k, h in zip(known, head, strict=True)], dtype="object")


def detected_type(content: Column) -> Column:
    """One of the sixteen types, null for null. Bytes of known types and of text are not sent to Python."""
    known = known_type(content)
    rest = F.when(known.isNull(), F.substring(content, 1, PROBE))
    return F.pandas_udf(_by_entropy, "string")(known, rest)


def is_container(kind: Column) -> Column:
    return kind.isin(*CONTAINERS)

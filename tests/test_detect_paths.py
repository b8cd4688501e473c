"""Detection, paths, limits, flags and texts as Column expressions."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import columns, detect
from bytequarry.operators import dedup, security
from bytequarry.plans import reports
from bytequarry.sources import packages

h = bytes.fromhex
TAR = b"x" * 257 + b"ustar"
TYPES = [
    (b"", "UnknownBinary"), (h("46495401") + b"\0\1", "NativeArchive"), (b"PK\3\4", "ZipArchive"), (b"PK\5\6", "ZipArchive"), (h("377ABCAF271C"), "SevenZipArchive"), (h("1F8B08"), "GzipArchive"), (b"BZh9 text", "Bzip2Archive"),
    (h("FD377A585A00"), "XzArchive"), (h("28B52FFD"), "ZstdArchive"), (TAR, 'StructuredText("Text/SourceCode/Logs")'), (TAR + b"0", "TarArchive"), (h("FFD8FFE0"), "JpegImage"), (h("89504E470D0A1A0A"), "PngImage"),
    (b"\0\0\0\x18ftypmp42", "Mp4Video"), (b"\0\0\0\x18ftyp", "StructuredText(\"Text/SourceCode/Logs\")"), (b"%PDF-1.7", "PdfDocument"), (b' \n{"a":1}', 'StructuredText("JSON")'), (b"[1]", 'StructuredText("JSON")'), (" {".encode(), 'StructuredText("JSON")'),
    (b"<html>", 'StructuredText("XML/HTML")'), (b"   ", 'StructuredText("Text/SourceCode/Logs")'), (bytes(range(256)) * 8, "HighEntropyBinary"), (b"\xff\xfe" * 50, "UnknownBinary"),
    (b"a" * 8191 + "é".encode(), "UnknownBinary"), (b"a" * 8190 + "é".encode(), 'StructuredText("Text/SourceCode/Logs")'),
]


def test_types(spark):
    rows = spark.createDataFrame([(i, bytearray(b)) for i, (b, _) in enumerate(TYPES)] + [(-1, None)], "id int, content binary")
    got = {r["id"]: r["t"] for r in rows.select("id", detect.detected_type(F.col("content")).alias("t")).collect()}
    assert [got[i] for i in range(len(TYPES))] == [t for _, t in TYPES]
    assert got[-1] is None


def test_entropy(spark):
    rows = spark.createDataFrame([(0, bytearray(1000)), (1, bytearray(bytes(range(256)) * 4)), (2, bytearray()), (3, None)], "id int, content binary")
    got = {r["id"]: r["e"] for r in rows.select("id", detect.entropy(F.col("content")).alias("e")).collect()}
    assert got[0] == 0.0 and got[1] == pytest.approx(8.0) and got[2] == 0.0 and got[3] is None


def test_paths(spark):
    given = ["../../etc/passwd", "subfolder/file.txt", "./a", "a/../b", "/a", "C:\\a", "a//b/./c", "", None, "a\\b"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(given)], "i int, path string")
    got = [r["s"] for r in rows.select("i", security.sanitized(F.col("path")).alias("s")).orderBy("i").collect()]
    assert got == [None, "subfolder/file.txt", "a", None, None, None, "a/b/c", "", None, "a/b"]
    with pytest.raises(Exception, match="unsafe path"):
        security.with_safe_path(rows, fail=True).collect()


def test_limits_are_strict(spark):
    rows = spark.createDataFrame([(1, 5, 32), (2, 5, 33), (3, 1, 1)], "i int, size long, depth int")
    got = {r["i"]: r["error"] for r in security.within_limits(rows, "i", "size", "depth", max_bytes=10).collect()}
    assert got == {1: None, 2: "depth", 3: "bytes"}


def test_native_byte_functions(spark):
    data = [bytes(range(256)), b"", b"a", None, b"\xff\x00\x80" * 5]
    rows = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in enumerate(data)], "i int, c binary")
    values = columns.byte_array(F.col("c"))
    out = rows.select("i", "c", columns.pack(values).alias("same"), columns.pack(columns.undelta(columns.delta(values))).alias("back")).orderBy("i").collect()
    assert [r["same"] for r in out] == [r["c"] for r in out] == [r["back"] for r in out]


def test_format_bytes(spark):
    given = {0: "0 B", 1: "1 B", 1023: "1023 B", 1024: "1 KB", 1536: "1.5 KB", 1 << 20: "1 MB", 5 * (1 << 30) + (1 << 29): "5.5 GB", 3 << 40: "3 TB", 7 << 50: "7168 TB"}
    rows = spark.createDataFrame([(n,) for n in given], "n long")
    assert {r["n"]: r["s"] for r in rows.select("n", columns.format_bytes(F.col("n")).alias("s")).collect()} == given


def test_progress_sums(spark):
    for sizes in ([], [0, 0], [5, 0, 7, 1] * 50):
        rows = spark.createDataFrame(list(enumerate(sizes)), "i long, n long")
        got = {r["i"]: (r["bytes_processed"], r["percent_complete"]) for r in reports.progress(rows, "i", "n", buckets=7).collect()}
        total = sum(sizes)
        assert got == {i: (sum(sizes[:i]), pytest.approx(100.0 * sum(sizes[:i]) / total if total else 100.0)) for i in range(len(sizes))}


def test_dedup_index_and_lists(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y"), (4, "x")], "seq int, path string")
    got = {r["seq"]: r["already_present"] for r in dedup.index(rows, "path", ["seq"]).collect()}
    assert got == {1: False, 2: False, 3: True, 4: True}
    assert sorted(r["seq"] for r in dedup.stage(rows, removed=rows.filter("seq = 2")).collect()) == [1]
    assert [r["seq"] for r in dedup.upsert_latest(rows, "path", "seq").collect()] == [4, 2]


def _zip(members):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return sink.getvalue()


def test_packages(spark):
    inner = _zip([("deep.txt", b"deep")])
    rows = spark.createDataFrame([("p", bytearray(_zip([("a/", b""), ("a/b.txt", b"hello"), ("in.zip", inner)]))), ("bad", bytearray(b"PK\3\4 broken")), ("text", bytearray(b"plain")), ("none", None)], "id string, c binary")
    got = packages.members(rows, "id", "c", contents=True).collect()
    assert {(r["package"], r["path"], r["is_dir"], r["size"]) for r in got if not r["error"]} == {("p", "a/", True, 0), ("p", "a/b.txt", False, 5), ("p", "in.zip", False, len(inner))}
    assert {r["package"] for r in got if r["error"]} == {"bad", "text"}
    with pytest.raises(Exception, match="more than 3 bytes"):
        packages.members(rows.filter("id = 'p'"), "id", "c", max_bytes=3, fail=True).collect()
    tree = {(r["path"], r["depth"], r["is_container"]) for r in packages.nested(rows.filter("id = 'p'"), "id", "c").collect()}
    assert tree == {("", 0, True), ("a/b.txt", 1, False), ("in.zip", 1, True), ("in.zip/deep.txt", 2, False)}
    with pytest.raises(Exception, match="nested"):
        packages.nested(rows.filter("id = 'p'"), "id", "c", max_depth=0)

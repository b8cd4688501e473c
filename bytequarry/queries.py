"""Catalogue of the library's queries: each takes (spark, sf_dir) and returns a DataFrame; ORACLE_SQL has DuckDB's form."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns, detect, udfs
from .operators import crypto, dedup, parity, security, tournament
from .plans import archive, relational, reports, shared, stores
from .plans.spread import spread
from .schema import Options
from .sources import container, files, packages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, content) of a table of texts."""
    return table(spark, sf_dir, name).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("content"))


def coded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, spread over the cores for what costs far more than moving it."""
    return spread(documents(spark, sf_dir))


def rows_of(spark: SparkSession, sf_dir: str, name: str = "documents", id_col: str = "doc_id") -> DataFrame:
    return relational.byte_rows(spread(documents(spark, sf_dir, name, id_col)), "id", F.col("content"))


BYTES = """h AS (SELECT {id} AS id, hex(encode(text)) AS hx, octet_length(encode(text))::BIGINT AS n FROM {table}),
bt AS (SELECT id, n, i AS pos, ('0x' || substr(hx, 2 * i + 1, 2))::INT AS b FROM h, unnest(range(n)) u(i))"""
DOCS = "WITH " + BYTES.format(id="doc_id", table="documents")
ITEMS = "WITH " + BYTES.format(id="item_id", table="benchmark")


def every(sql: str, column: str, empty: str) -> str:
    """A row for each document: null where its text is, and the value of an empty text where the SQL has no row for it."""
    return f"SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(r.{column}, {empty}) END AS {column} FROM documents d LEFT JOIN ({sql}) r ON r.doc_id = d.doc_id"


def _every(spark: SparkSession, sf_dir: str, found: DataFrame, column: str, empty) -> DataFrame:
    """The same for a plan over byte rows, of which empty texts have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").isNotNull().alias("there"))
    return docs.join(found.select("doc_id", column), "doc_id", "left").select("doc_id", F.when(F.col("there"), F.coalesce(column, F.lit(empty))).alias(column))


# --- scans and statistics -----------------------------------------------------------------------------------------------


@query("entry_scan", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS sha256 FROM documents")
def _entry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(content).cast("long").alias("n_bytes"), F.sha2(content, 256).alias("sha256"))


@query("byte_histogram", DOCS + " SELECT b::BIGINT AS b, count(*) AS n FROM bt GROUP BY b")
def _byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, sf_dir).groupBy(F.col("b").cast("long").alias("b")).agg(F.count("*").alias("n"))


ENTROPY = ", c AS (SELECT id, b, count(*) AS c FROM bt GROUP BY id, b), t AS (SELECT id, sum(c) AS t FROM c GROUP BY id)"


@query("entropy", every(DOCS + ENTROPY + " SELECT id AS doc_id, round(-sum(c / t.t * log2(c / t.t)) + 0.0, 6) AS entropy FROM c JOIN t USING (id) GROUP BY id", "entropy", "0.0::DOUBLE"))
def _entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.round(detect.entropy(F.col("content")), 6).alias("entropy"))


@query("entropy_relational", ORACLE_SQL["entropy"])
def _entropy_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.entropy(rows_of(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.round("entropy", 6).alias("entropy"))
    return _every(spark, sf_dir, found, "entropy", 0.0)


_TEXT = "CASE WHEN regexp_matches({t}, '^\\s*[\\{{\\[]') THEN 'StructuredText(\"JSON\")' WHEN regexp_matches({t}, '^\\s*<') THEN 'StructuredText(\"XML/HTML\")' ELSE 'StructuredText(\"Text/SourceCode/Logs\")' END"


def _detect_sql(name: str, key: str, text: str) -> str:
    e = f"encode({text})"
    cut = f"octet_length({e}) > 8192 AND substr(hex({e}), 16385, 2) BETWEEN '80' AND 'BF'"
    known = f"WHEN octet_length({e}) = 0 THEN 'UnknownBinary' WHEN {text} LIKE 'BZh%' THEN 'Bzip2Archive' WHEN octet_length({e}) >= 12 AND substr(hex({e}), 9, 8) = '66747970' THEN 'Mp4Video' WHEN {text} LIKE '%PDF-%' AND left({text}, 5) = '%PDF-' THEN 'PdfDocument'"
    return f"SELECT {key}, CASE {known} WHEN {cut} THEN 'UnknownBinary' ELSE {_TEXT.format(t=text)} END AS detected_type FROM {name}"


def _detect(name: str, key: str, text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, name).select(key, detect.detected_type(F.col(text).cast("binary")).alias("detected_type"))

    return run


for _name, _key, _text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("events", "event_id", "props")):
    query(f"detect_{_name}", _detect_sql(_name, _key, _text))(_detect(_name, _key, _text))


_INFO = """WITH h AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS size, substr(hex(encode(html)), 1, 16384) AS hx FROM pages),
b AS (SELECT page_id, substr(hx, 2 * i + 1, 2) AS b FROM h, unnest(range(length(hx) // 2)) u(i)),
c AS (SELECT page_id, b, count(*) AS c FROM b GROUP BY page_id, b), t AS (SELECT page_id, sum(c) AS t FROM c GROUP BY page_id),
e AS (SELECT page_id, round(-sum(c / t.t * log2(c / t.t)) + 0.0, 6) AS entropy FROM c JOIN t USING (page_id) GROUP BY page_id),
d AS (""" + _detect_sql("pages", "page_id", "html") + """)
SELECT h.url AS path, list_last(string_split(h.url, '/')) AS name, h.size, false AS is_dir, d.detected_type, e.entropy FROM h JOIN e USING (page_id) JOIN d USING (page_id)"""


@query("file_info", _INFO)
def _file_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("url", F.col("html").cast("binary").alias("content"))
    return reports.file_info(pages, "url", "content").withColumn("entropy", F.round("entropy", 6))


@query("container_types", "WITH t AS (SELECT unnest(['NativeArchive', 'ZipArchive', 'SevenZipArchive', 'TarArchive', 'GzipArchive', 'Bzip2Archive', 'XzArchive', 'ZstdArchive', 'IsoImage', 'JpegImage', 'PdfDocument']) AS kind) SELECT kind, kind NOT IN ('IsoImage', 'JpegImage', 'PdfDocument') AS is_container FROM t")
def _container_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = spark.createDataFrame([(k,) for k in (*detect.CONTAINERS, "IsoImage", "JpegImage", "PdfDocument")], "kind string")
    return kinds.select("kind", detect.is_container(F.col("kind")).alias("is_container"))


@query("system_info")
def _system_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.system_info(spark)


@query("scan_files", "SELECT lang || '/' || doc_id || '.txt' AS path, false AS is_dir, octet_length(encode(coalesce(text, '')))::BIGINT AS size, 420 AS mode, sha256(coalesce(text, '')) AS sha256 FROM documents")
def _scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written as a file of the shared folder, and the folder scanned with its subfolders."""
    root = shared.new_folder(spark, "files")
    docs = table(spark, sf_dir, "documents").select(F.format_string("%s/%d.txt", "lang", "doc_id").alias("safe_path"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    archive.write_files(docs, root.removeprefix("file:"))
    return files.scan(spark, root.removeprefix("file:")).select("path", "is_dir", "size", "mode", F.sha2("content", 256).alias("sha256"))


# --- transforms ---------------------------------------------------------------------------------------------------------

_HEX = " SELECT id AS doc_id, string_agg(printf('%02X', r), '' ORDER BY pos) AS hex FROM r GROUP BY id"
_DELTA = DOCS + ", r AS (SELECT id, pos, ((b - lag(b, 1, 0) OVER (PARTITION BY id ORDER BY pos) + 256) % 256)::INT AS r FROM bt)" + _HEX
_PREDICT = DOCS + ", p AS (SELECT id, pos, b, lag(b, 1, 0) OVER (PARTITION BY id ORDER BY pos) AS p FROM bt), r AS (SELECT id, pos, ((b - lag(b, 1, 0) OVER (PARTITION BY id, p ORDER BY pos) + 256) % 256)::INT AS r FROM p)" + _HEX
_RLE = DOCS + """, g AS (SELECT id, pos, b, pos - row_number() OVER (PARTITION BY id, b ORDER BY pos) AS g FROM bt),
k AS (SELECT id, pos, b, g, (row_number() OVER (PARTITION BY id, b, g ORDER BY pos) - 1) // 255 AS k FROM g),
q AS (SELECT id, b, min(pos) AS pos, count(*) AS n FROM k GROUP BY id, b, g, k)
SELECT id AS doc_id, string_agg(printf('%02X%02X', n, b), '' ORDER BY pos) AS hex FROM q GROUP BY id"""


def _hexed(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.hex(udfs.forward(name, F.col("content"))).alias("hex"))

    return run


for _name, _sql, _plan in (("delta", _DELTA, relational.delta), ("predict", _PREDICT, relational.predict), ("rle", _RLE, relational.rle)):
    query(_name, every(_sql, "hex", "''"))(_hexed(_name))
    query(f"{_name}_relational", every(_sql, "hex", "''"))(lambda spark, sf_dir, plan=_plan: _every(spark, sf_dir, plan(rows_of(spark, sf_dir)).withColumnRenamed("id", "doc_id"), "hex", ""))


@query("delta_native", every(_DELTA, "hex", "''"))
def _delta_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without shuffle and without Python: array functions only."""
    return spread(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), columns.hex_of(columns.delta(columns.byte_array(F.col("content")))).alias("hex"))


_TEXT_HEX = "SELECT doc_id, hex(encode(text)) AS hex FROM documents"


@query("undelta_relational", _TEXT_HEX)
def _undelta_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the native delta: without Python on either way."""
    coded = spread(documents(spark, sf_dir)).select("id", F.unhex(columns.hex_of(columns.delta(columns.byte_array(F.col("content"))))).alias("content"))
    found = relational.undelta(relational.byte_rows(coded, "id", F.col("content"))).withColumnRenamed("id", "doc_id")
    return _every(spark, sf_dir, found, "hex", "")


@query("unrle_native", _TEXT_HEX)
def _unrle_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the relational run lengths: without Python on either way."""
    coded = relational.rle(rows_of(spark, sf_dir)).select(F.col("id").alias("doc_id"), columns.byte_array(F.unhex("hex")).alias("pairs"))
    return _every(spark, sf_dir, coded.select("doc_id", columns.hex_of(columns.unrle(F.col("pairs"))).alias("hex")), "hex", "")


_BWT = ITEMS + """, k AS (SELECT bt.id, pos, bt.n, hx, row_number() OVER (PARTITION BY bt.id ORDER BY substr(hx || hx, 2 * pos + 1, 2 * bt.n), pos) - 1 AS k FROM bt JOIN h USING (id))
SELECT id AS item_id, min(CASE WHEN pos = 0 THEN k END)::BIGINT AS row, string_agg(substr(hx || hx, 2 * (pos + n - 1) + 1, 2), '' ORDER BY k) AS hex FROM k GROUP BY id"""


@query("bwt_relational", _BWT)
def _bwt_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = relational.bwt(documents(spark, sf_dir, "benchmark", "item_id"), "id", F.col("content"))
    return out.select(F.col("id").alias("item_id"), F.col("row").cast("long").alias("row"), "hex")


@query("bwt", _BWT)
def _bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = documents(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("item_id"), udfs.forward("bwt_mtf", F.col("content")).alias("c"))
    row = F.conv(F.hex(F.substring("c", 1, 4)), 16, 10).cast("long")
    return coded.select("item_id", row.alias("row"), F.hex(udfs.inverse("mtf", F.expr("substring(c, 5)"))).alias("hex"))


_MTF = ITEMS + """, p AS (SELECT id, pos, b, lag(pos) OVER (PARTITION BY id, b ORDER BY pos) AS last FROM bt),
r AS (SELECT p.id, p.pos, CASE WHEN p.last IS NULL THEN p.b + count(DISTINCT CASE WHEN q.b > p.b THEN q.b END) ELSE count(DISTINCT CASE WHEN q.pos > p.last THEN q.b END) END::INT AS r
  FROM p LEFT JOIN bt q ON q.id = p.id AND q.pos < p.pos GROUP BY p.id, p.pos, p.b, p.last)
SELECT id AS item_id, string_agg(printf('%02X', r), '' ORDER BY pos) AS hex FROM r GROUP BY id"""


@query("mtf_relational", _MTF)
def _mtf_relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.mtf(rows_of(spark, sf_dir, "benchmark", "item_id")).withColumnRenamed("id", "item_id")


@query("mtf", _MTF)
def _mtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("item_id"), F.hex(udfs.forward("mtf", F.col("content"))).alias("hex"))


@query("bwt_mtf_documents")
def _bwt_mtf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row and coded bytes of every document, as the relational forms are quadratic (bwt) or slow (mtf) on long texts."""
    coded = coded_documents(spark, sf_dir).select(F.col("id").alias("doc_id"), udfs.forward("bwt_mtf", F.col("content")).alias("c"))
    return coded.select("doc_id", F.conv(F.hex(F.substring("c", 1, 4)), 16, 10).cast("long").alias("row"), F.hex(F.expr("substring(c, 5)")).alias("hex"))


# --- coders and the tournament ------------------------------------------------------------------------------------------

_HUFFMAN = """WITH RECURSIVE """ + BYTES.format(id="doc_id", table="documents") + """, c AS (SELECT id, b, count(*)::BIGINT AS c FROM bt GROUP BY id, b),
f AS (SELECT id, list_sort(list(c)) AS f, 0::BIGINT AS k FROM c GROUP BY id),
m AS (SELECT id, f, k, len(f) AS syms FROM f UNION ALL SELECT id, list_sort(list_append(f[3:], f[1] + f[2])), k + f[1] + f[2], syms FROM m WHERE len(f) > 1)
SELECT id AS doc_id, CASE WHEN syms = 1 THEN 5 ELSE 1028 + (k + 7) // 8 END::BIGINT AS size FROM m WHERE len(f) = 1"""


@query("huffman_size", every(_HUFFMAN, "size", "0::BIGINT"))
def _huffman_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.huffman_size(rows_of(spark, sf_dir)).select(F.col("id").alias("doc_id"), F.col("size").cast("long").alias("size"))
    return _every(spark, sf_dir, found, "size", 0)


@query("huffman_coded_size", every(_HUFFMAN, "size", "0::BIGINT"))
def _huffman_coded_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.octet_length(udfs.forward("huffman", F.col("content"))).cast("long").alias("size"))


_SAME = "SELECT doc_id, sha256(text) AS sha256, true AS lossless FROM documents"


def _same(df: DataFrame, back: Column) -> DataFrame:
    """(doc_id, sha256, lossless) of what came back."""
    return df.withColumn("back", back).select(F.col("id").alias("doc_id"), F.sha2("back", 256).alias("sha256"), (F.col("back") == F.col("content")).alias("lossless"))


def _roundtrip(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        coded = coded_documents(spark, sf_dir).withColumn("coded", udfs.forward(name, F.col("content")))
        return _same(coded, udfs.inverse(name, F.col("coded")))

    return run


for _name in udfs.CODED:
    query(f"roundtrip_{_name}", _SAME)(_roundtrip(_name))


def _method(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        there = udfs.bytes_udf(lambda x: tournament.encode(method, x))
        back = udfs.bytes_udf(lambda x: tournament.decode(method, x))
        return _same(coded_documents(spark, sf_dir).withColumn("coded", there(F.col("content"))), back(F.col("coded")))

    return run


for _letter, _name in zip("ABCD", tournament.METHODS[1:5], strict=True):
    query(f"roundtrip_pipeline_{_letter}", _SAME)(_method(_name))


@query("lz77_tokens", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents WHERE octet_length(encode(text)) > 0")
def _lz77_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens as rows; their lengths add up to the text."""
    tokens = coded_documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(udfs.lz_tokens(F.col("content"))).alias("t"))
    return tokens.groupBy("doc_id").agg(F.sum(F.when(F.col("t.is_match"), F.col("t.length")).otherwise(1)).cast("long").alias("n_bytes"))


# Longest common extensions are runs along a diagonal of equal bytes: those end where the next pair differs, or the text does.
_LZ77 = "WITH RECURSIVE " + BYTES.format(id="item_id", table="benchmark") + """,
p AS (SELECT a.id, b.pos, b.pos - a.pos AS d, a.n FROM bt a JOIN bt b ON a.id = b.id AND a.b = b.b AND b.pos > a.pos AND b.pos - a.pos <= 32768),
g AS (SELECT id, pos, d, n, pos - row_number() OVER (PARTITION BY id, d ORDER BY pos) AS g FROM p),
x AS (SELECT id, pos, d, least(258, max(pos) OVER (PARTITION BY id, d, g) - pos + 1) AS len FROM g),
m AS (SELECT id, pos, max(len) AS len, min(d) FILTER (WHERE len = most) AS d FROM (SELECT *, max(len) OVER (PARTITION BY id, pos) AS most FROM x) GROUP BY id, pos HAVING max(len) >= 3),
t AS (SELECT bt.id, bt.pos, bt.n, bt.b, m.len, m.d FROM bt LEFT JOIN m ON m.id = bt.id AND m.pos = bt.pos),
r AS (SELECT id, pos, n, b, len, d FROM t WHERE pos = 0 UNION ALL SELECT t.id, t.pos, t.n, t.b, t.len, t.d FROM r JOIN t ON t.id = r.id AND t.pos = r.pos + coalesce(r.len, 1))
SELECT b.item_id, coalesce(string_agg(CASE WHEN r.len IS NULL THEN r.b::VARCHAR ELSE r.d || '/' || r.len END, ' ' ORDER BY r.pos), '') AS tokens FROM benchmark b LEFT JOIN r ON r.id = b.item_id GROUP BY b.item_id"""


@query("lz77_parse", _LZ77)
def _lz77_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of the benchmark items: a byte, or distance/length of the longest and then nearest earlier match."""
    tokens = F.transform(udfs.lz_tokens(F.col("content")), lambda t: F.when(t["is_match"], F.concat_ws("/", t["distance"].cast("string"), t["length"].cast("string"))).otherwise(t["literal"].cast("string")))
    return documents(spark, sf_dir, "benchmark", "item_id").select(F.col("id").alias("item_id"), F.array_join(tokens, " ").alias("tokens"))


@query("tournament", "SELECT doc_id, sha256(text) AS sha256, true AS lossless, true AS not_larger FROM documents")
def _tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = coded_documents(spark, sf_dir).withColumn("c", archive.encode(F.col("content")))
    back = coded.withColumn("back", archive.decode(F.col("c.method"), F.col("c.payload")))
    return back.select(F.col("id").alias("doc_id"), F.sha2("back.content", 256).alias("sha256"), (F.col("back.content") == F.col("content")).alias("lossless"), (F.octet_length("c.payload") <= F.octet_length("content")).alias("not_larger"))


@query("tournament_sizes")
def _tournament_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of every item and document in full, and the winner chosen by array functions: verified, smallest, ties by
    method."""
    kind = "array<struct<method:string,size:bigint,verified:boolean>>"
    all_ = F.pandas_udf(_all_sizes, kind)(F.col("content"))
    rank = F.create_map(*[x for i, m in enumerate(tournament.METHODS) for x in (F.lit(m), F.lit(i))])
    sound = F.filter("candidates", lambda c: c["verified"])
    best = F.array_min(F.transform(sound, lambda c: F.struct(c["size"].alias("size"), rank[c["method"]].alias("rank"), c["method"].alias("method"))))
    out = documents(spark, sf_dir, "benchmark", "item_id").unionByName(coded_documents(spark, sf_dir)).withColumn("candidates", all_)
    return out.select("id", F.octet_length("content").cast("long").alias("n_bytes"), best["method"].alias("method"), best["size"].alias("size"))


def _all_sizes(s: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else [{"method": m, "size": n, "verified": ok} for m, n, ok in tournament.sizes(bytes(x))] for x in s], dtype="object")


@query("tournament_report")
def _tournament_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").cast("binary").alias("content"))
    return reports.by_method(docs, "content", group=F.col("lang"))


FLAGSHIP = _tournament_report


@query("raw_floor", "SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes, 'Raw' AS method FROM documents WHERE octet_length(encode(text)) <= 1029")
def _raw_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = documents(spark, sf_dir).filter(F.octet_length("content") <= tournament.RAW_FLOOR)
    return short.select(F.col("id").alias("doc_id"), F.octet_length("content").cast("long").alias("n_bytes"), archive.encode(F.col("content"))["method"].alias("method"))


@query("level_gate", "SELECT doc_id, n_chars * 1000 AS size, l.level, (l.level IN ('Extreme', 'Research') OR n_chars * 1000 <= 1048576) AS with_bwt FROM documents, (SELECT unnest(['Fast', 'Balanced', 'High', 'Ultra', 'Extreme', 'Research']) AS level) l")
def _level_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.explode(F.array(*[F.lit(x) for x in tournament.LEVELS])).alias("level")
    sized = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") * 1000).alias("size"), levels)
    return sized.withColumn("with_bwt", F.col("level").isin(*tournament.RESEARCH_LEVELS) | (F.col("size") <= tournament.BWT_MOST))


# --- chunks and dedup ---------------------------------------------------------------------------------------------------

_SUM14 = " + ".join(f"lag(b, {j}, 0) OVER w * {1 << j}" for j in range(14))
_CDC = "WITH RECURSIVE " + BYTES.format(id="doc_id", table="documents") + f""",
s AS (SELECT id, pos, {_SUM14} AS s FROM bt WINDOW w AS (PARTITION BY id ORDER BY pos)),
cand AS (SELECT id, list(pos ORDER BY pos) AS ps FROM s WHERE s % 16384 = 0 GROUP BY id),
bl AS (SELECT id, n, list(b ORDER BY pos) AS bl FROM bt GROUP BY id, n),
d AS (SELECT bl.id, n, bl, coalesce(ps, []) AS ps FROM bl LEFT JOIN cand ON cand.id = bl.id),
r AS (
  SELECT id, 0::BIGINT AS st FROM d
  UNION ALL
  SELECT id, nxt FROM (
    SELECT d.id, d.n, coalesce(
      r.st + 4096 + 1 + list_filter(range(0, least(13, d.n - r.st - 4096)), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: bl[r.st + 4096 + k - j + 1] * (1 << j))) % 16384 = 0)[1],
      1 + list_filter(ps, lambda p: p >= r.st + 4096 + 13 AND p < least(r.st + 65536, d.n))[1],
      least(r.st + 65536, d.n))::BIGINT AS nxt
    FROM r JOIN d ON d.id = r.id WHERE r.st + 4096 < d.n) WHERE nxt < n
),
c AS (SELECT r.id AS doc_id, row_number() OVER (PARTITION BY r.id ORDER BY st) - 1 AS chunk_no, st AS "offset", lead(st, 1, n) OVER (PARTITION BY r.id ORDER BY st) - st AS length FROM r JOIN d ON d.id = r.id),
cs AS (SELECT doc_id, chunk_no::BIGINT AS chunk_no, "offset"::BIGINT AS "offset", length::BIGINT AS length, sha256(unhex(substr(hx, 2 * "offset" + 1, 2 * length))) AS sha256 FROM c JOIN h ON h.id = c.doc_id)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup.chunks(documents(spark, sf_dir), "id", "content")
    return cut.select(F.col("id").alias("doc_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "offset", "length", "sha256")


query("cdc_chunks", _CDC + " SELECT * FROM cs")(_chunks)


@query("cdc_udtf", _CDC + ' SELECT doc_id, "offset", length FROM cs')
def _cdc_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    udfs.register(spark)
    documents(spark, sf_dir).createOrReplaceTempView("bytequarry_documents")
    return spark.sql("SELECT id AS doc_id, c.offset, c.length FROM bytequarry_documents, LATERAL cdc_rows(content) c")


@query("chunk_dedup", _CDC + " SELECT doc_id, chunk_no, length, sha256, row_number() OVER (PARTITION BY sha256 ORDER BY doc_id, chunk_no) > 1 AS already_present FROM cs")
def _chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.index(_chunks(spark, sf_dir), "sha256", ["doc_id", "chunk_no"]).select("doc_id", "chunk_no", "length", "sha256", "already_present")


@query("dedup_documents", "SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS already_present FROM documents")
def _dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.sha2("content", 256).alias("sha256"))
    return dedup.index(digests, "sha256", ["doc_id"]).select("doc_id", "sha256", "already_present")


@query("dedup_lookup", "WITH s AS (SELECT sha256(text) AS sha256, min(doc_id) AS stored FROM documents GROUP BY 1) SELECT d.doc_id, s.stored FROM documents d LEFT JOIN s ON s.sha256 = sha256(d.text)")
def _dedup_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.sha2("content", 256).alias("sha256"))
    store = dedup.stored(digests, "sha256", ["doc_id"]).select("sha256", F.col("doc_id").alias("stored"))
    return dedup.lookup(digests, store).select("doc_id", "stored")


# --- integrity, parity, sealing -----------------------------------------------------------------------------------------


def _checksum_sql() -> str:
    """CRC-32 and XXH64 (seed 0) by their definitions, folded over lists of bytes; 64-bit words wrap in 128-bit numbers."""
    word = "18446744073709551616::UHUGEINT"
    # The polynomial of the one and the primes of the other.
    poly = 0xEDB88320
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

    def bit(k: int) -> int:
        c = 1 << k
        for _ in range(8):
            c = c >> 1 ^ poly if c & 1 else c >> 1
        return c

    crc = "c >> 8"
    for k in range(8):
        crc = f"xor({crc}, ((xor(c, x) >> {k}) & 1) * {bit(k)})"

    def turn(a: str, r: int) -> str:
        return f"(({a} % {1 << (64 - r)}::UHUGEINT) * {1 << r}::UHUGEINT + {a} // {1 << (64 - r)}::UHUGEINT)"

    def little(q: str, k: int) -> str:
        return "(" + " + ".join(f"(b[{q} + {i + 1}] << {8 * i})" for i in range(k)) + ")::UHUGEINT"

    def mixed(acc: str, x: str) -> str:
        return f"({turn(f'(({acc} + {x} * {p2} % {word}) % {word})', 31)} * {p1} % {word})"

    starts = (f"({p1} + {p2}) % {word}", p2, "0::UHUGEINT", f"{word} - {p1}")
    lanes = ", ".join(f"list_reduce(list_prepend({s}, list_transform(range(n // 32), lambda i: {little(f'32 * i + {8 * j}', 8)})), lambda a, x: {mixed('a', 'x')}) AS v{j}" for j, s in enumerate(starts))
    merged = "".join(f"m{j + 1} AS (SELECT * EXCLUDE (h), CASE WHEN n < 32 THEN h ELSE (xor(h, {mixed('0::UHUGEINT', f'v{j}')}) * {p1} + {p4}) % {word} END AS h FROM m{j}),\n" for j in range(4))
    return f"""
WITH b AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT) AS b FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: {crc}), 4294967295::UBIGINT)::BIGINT AS crc32 FROM b),
l AS (SELECT doc_id, n, b, {lanes} FROM b),
m0 AS (SELECT *, CASE WHEN n < 32 THEN {p5} ELSE ({turn('v0', 1)} + {turn('v1', 7)} + {turn('v2', 12)} + {turn('v3', 18)}) % {word} END AS h FROM l),
{merged}e0 AS (SELECT doc_id, n, b, (h + n::UHUGEINT) % {word} AS h, n // 32 * 32 AS q FROM m4),
e1 AS (SELECT doc_id, n, b, list_reduce(list_prepend(h, list_transform(range((n - q) // 8), lambda i: {mixed('0::UHUGEINT', little('q + 8 * i', 8))})), lambda a, k: ({turn('xor(a, k)', 27)} * {p1} + {p4}) % {word}) AS h, n // 8 * 8 AS q FROM e0),
e2 AS (SELECT doc_id, n, b, CASE WHEN n - q >= 4 THEN ({turn(f'xor(h, {little("q", 4)} * {p1} % {word})', 23)} * {p2} + {p3}) % {word} ELSE h END AS h, n // 4 * 4 AS q FROM e1),
e3 AS (SELECT doc_id, list_reduce(list_prepend(h, list_transform(range(n - q), lambda i: b[q + i + 1]::UHUGEINT * {p5} % {word})), lambda a, k: {turn('xor(a, k)', 11)} * {p1} % {word}) AS h FROM e2),
f1 AS (SELECT doc_id, xor(h, h // {1 << 33}::UHUGEINT) * {p2} % {word} AS h FROM e3),
f2 AS (SELECT doc_id, xor(h, h // {1 << 29}::UHUGEINT) * {p3} % {word} AS h FROM f1),
f3 AS (SELECT doc_id, xor(h, h // {1 << 32}::UHUGEINT) AS h FROM f2)
SELECT d.doc_id, c.crc32, (CASE WHEN f3.h >= 9223372036854775808::UHUGEINT THEN f3.h::HUGEINT - 18446744073709551616::HUGEINT ELSE f3.h::HUGEINT END)::BIGINT AS xxhash64
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN f3 ON f3.doc_id = d.doc_id"""


@query("checksums", _checksum_sql())
def _checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.crc32("content").alias("crc32"), udfs.xxh64(F.col("content")).alias("xxhash64"))


@query("parity_geometry", "SELECT doc_id, p.pct, CASE WHEN n > 0 THEN 10 ELSE 0 END::BIGINT AS data_shards, CASE WHEN n > 0 THEN greatest(1, 10 * p.pct // 100) ELSE 0 END::BIGINT AS parity_shards, ((n + 9) // 10)::BIGINT AS shard_len FROM (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents), (SELECT unnest([5::BIGINT, 10, 20, 50]) AS pct) p")
def _parity_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("content")
    sized = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in (5, 10, 20, 50)])).alias("pct"), n.alias("n"))
    on = lambda c: F.when(F.col("n") > 0, c).otherwise(0).cast("long")
    return sized.select("doc_id", "pct", on(F.lit(parity.DATA_SHARDS)).alias("data_shards"), on(F.greatest(F.lit(1), F.floor(F.lit(parity.DATA_SHARDS) * F.col("pct") / 100))).alias("parity_shards"), F.ceil(F.col("n") / parity.DATA_SHARDS).cast("long").alias("shard_len"))


def _with_losses(data: bytes) -> bytes:
    """Loses as many shards as 20 % parity can restore: the third and the last of the data."""
    shards = [x.tobytes() for x in parity.split(data)] if data else []
    made = parity.encode(data, 20)
    return parity.reconstruct([None if i in (2, len(shards) - 1) else s for i, s in enumerate(shards)], list(made), len(data)) if data else b""


@query("roundtrip_parity", _SAME)
def _roundtrip_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(coded_documents(spark, sf_dir), udfs.bytes_udf(_with_losses)(F.col("content")))


def _sealed(data: bytes) -> bytes:
    key, nonce = b"k" * crypto.KEY_BYTES, crypto.new_nonce()
    return crypto.open_sealed(key, nonce, crypto.seal(key, nonce, data))


@query("roundtrip_seal", _SAME)
def _roundtrip_seal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _same(coded_documents(spark, sf_dir), udfs.bytes_udf(_sealed)(F.col("content")))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A container of one entry for each row, sealed for every fourth, damaged and repaired, then extracted."""
    import hashlib

    key = b"k" * crypto.KEY_BYTES
    for batch in batches:
        out = []
        for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = content.as_py()
            method, coded = tournament.best(data)
            entry = {"entry_id": 0, "path": f"{number}.txt", "size": len(data), "sha256": hashlib.sha256(data).hexdigest(), "chunk_indices": [0]}
            own = key if number % 4 == 0 else None
            packed = container.write([entry], [{"chunk_id": 0, "original_size": len(data), "method": method, "payload": coded}], password="p" if own else None, recovery_percent=20, created=0, key=own, salt=bytes(16))
            at = container.Archive(packed, "p", own).start + 40
            if len(coded) > 100 and not own:
                packed = container.Archive(packed[:at] + bytes([packed[at] ^ 255]) + packed[at + 1 :], "p", own).repaired()
            back = container.Archive(packed, "p", own).extract()[0]["content"]
            out.append((number, hashlib.sha256(back).hexdigest(), back == data))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.bool_()), strict=True)] if out else [pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.bool_())], ["doc_id", "sha256", "lossless"])


@query("roundtrip_container", _SAME)
def _roundtrip_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_documents(spark, sf_dir).mapInArrow(_containers, "doc_id bigint, sha256 string, lossless boolean")


@query("flags_bits", "SELECT i AS bits, (i & 1) <> 0 AS is_solid, (i & 2) <> 0 AS is_encrypted, (i & 4) <> 0 AS has_deduplication, (i & 8) <> 0 AS has_recovery, (i & 16) <> 0 AS is_multi_volume, i % 32 AS packed FROM range(64) t(i)")
def _flags_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = spark.range(64).select(F.col("id").alias("bits"), columns.unpack_flags(F.col("id")).alias("f"))
    return bits.select("bits", "f.*", columns.pack_flags(**{n: F.col(f"f.{n}") for n in columns.FLAGS}).cast("long").alias("packed"))


@query("header_hex", "SELECT o_orderkey, '46495401' || printf('%04X', 1) || printf('%08X', o_custkey % 32) || printf('%016X', epoch(o_orderdate)::BIGINT) || printf('%08X', o_custkey) || printf('%08X', o_orderkey) || printf('%016X', o_orderkey * 42) || printf('%016X', 0) AS hex FROM orders")
def _header_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    head = columns.header(F.lit(1), F.col("o_custkey") % 32, F.unix_timestamp("o_orderdate"), F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey") * 42, F.lit(0))
    return o.select("o_orderkey", F.hex(head).alias("hex"))


# --- paths, limits, lists -----------------------------------------------------------------------------------------------

_PATHS = "CASE page_id % 6 WHEN 0 THEN '../' || url WHEN 1 THEN '/' || url WHEN 2 THEN './a/' || page_id || '.html' WHEN 3 THEN 'C:\\\\' || page_id WHEN 4 THEN 'a//b/./' || page_id ELSE 'a/../' || page_id END"


@query("sanitize_path", f"WITH p AS (SELECT page_id, {_PATHS.replace(chr(92) * 2, chr(92))} AS path FROM pages) SELECT page_id, path, CASE WHEN starts_with(path, '/') OR regexp_matches(path, '^[A-Za-z]:') OR list_contains(string_split(path, '/'), '..') THEN NULL ELSE array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') END AS safe_path FROM p")
def _sanitize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "pages").select("page_id", F.expr(_PATHS).alias("path"))
    return paths.withColumn("safe_path", security.sanitized(F.col("path")))


@query("bomb_limits", "WITH s AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) SELECT source, doc_id, running::BIGINT AS running_bytes, CASE WHEN n_chars % 40 > 32 THEN 'depth' WHEN running > 50000 THEN 'bytes' END AS error FROM s")
def _bomb_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (F.col("n_chars") % 40).alias("depth"))
    return security.within_limits(entries, "doc_id", "n_chars", "depth", ("source",), max_bytes=50000).select("source", "doc_id", "running_bytes", "error")


@query("listing", "SELECT url AS path, octet_length(encode(html))::BIGINT AS size, false AS is_dir FROM pages WHERE contains(lower(url), 'example.com')")
def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size"), F.lit(False).alias("is_dir"))
    return reports.listing(entries, "Example.COM")


@query("listing_text", "SELECT printf('f %12d %s', octet_length(encode(html)), url) AS line FROM pages")
def _listing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size"), F.lit(False).alias("is_dir"))
    return reports.as_text(entries)


@query("listing_json", "SELECT '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"size\":' || octet_length(encode(text)) || '}' AS line FROM documents")
def _listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.as_json(table(spark, sf_dir, "documents").select("doc_id", "lang", F.octet_length("text").alias("size")))


@query("stage_list", "SELECT min(event_id) AS seq, user_id AS path FROM events GROUP BY user_id HAVING min(event_id) % 10 <> 0")
def _stage_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("path"))
    return dedup.stage(events, "path", "seq", events.filter("seq % 10 = 0"))


@query("history_upsert", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _history_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.upsert_latest(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("settings", "WITH s AS (SELECT unnest(['Fast', 'Ultra', 'fast', 'x', NULL]) AS name, unnest(['Solid', 'Non-Solid', 'Auto', 'x', NULL]) AS mode, unnest(['', '  ', 'p', ' q', NULL]) AS pass) SELECT name, CASE WHEN name IN ('Fast', 'Balanced', 'High', 'Ultra', 'Extreme', 'Research') THEN name ELSE 'Balanced' END AS level, CASE mode WHEN 'Solid' THEN 'Solid' WHEN 'Non-Solid' THEN 'NonSolid' ELSE 'Auto' END AS solid, CASE WHEN trim(pass) <> '' THEN pass END AS password FROM s")
def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("Fast", "Solid", ""), ("Ultra", "Non-Solid", "  "), ("fast", "Auto", "p"), ("x", "x", " q"), (None, None, None)]
    given = spark.createDataFrame(rows, "name string, mode string, pass string")
    return given.select("name", columns.level(F.col("name")).alias("level"), columns.solid_mode(F.col("mode")).alias("solid"), columns.password(F.col("pass")).alias("password"))


@query("format_bytes", """WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 0 ELSE o_orderkey * (o_custkey % 7 + 1) * CASE WHEN o_custkey % 3 = 0 THEN 1000003 ELSE 1 END END AS n FROM orders),
p AS (SELECT o_orderkey, n, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS p FROM n)
SELECT o_orderkey, CASE WHEN n = 0 THEN '0 B' ELSE regexp_replace(regexp_replace(printf('%.2f', round(n / power(1024.0, p), 2)), '0+$', ''), '\\.$', '') || ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[p + 1] END AS shown FROM p""")
def _format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.when(F.col("o_orderkey") % 100 == 0, 0).otherwise(F.col("o_orderkey") * (F.col("o_custkey") % 7 + 1) * F.when(F.col("o_custkey") % 3 == 0, 1000003).otherwise(1))
    return table(spark, sf_dir, "orders").select("o_orderkey", n.alias("n")).select("o_orderkey", columns.format_bytes(F.col("n")).alias("shown"))


# --- archives and reports -----------------------------------------------------------------------------------------------


@query("progress", "WITH n AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents), t AS (SELECT sum(n) AS t FROM n) SELECT doc_id, 'Compressing' AS phase, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bytes_processed, t::BIGINT AS total_bytes, round(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 100.0 / t, 6) AS percent_complete FROM n, t")
def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return reports.progress(sized, "doc_id", "n").withColumn("percent_complete", F.round("percent_complete", 6))


@query("staged_bytes", "SELECT lang, sum(octet_length(encode(text)))::BIGINT AS total_bytes, count(*) AS files FROM documents GROUP BY lang")
def _staged_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text").cast("long")).alias("total_bytes"), F.count("*").alias("files"))


@query("coded_report", "WITH z AS (" + _HUFFMAN + "), n AS (SELECT doc_id, lang, octet_length(encode(text))::BIGINT AS n FROM documents) SELECT lang, count(*) AS docs, sum(n)::BIGINT AS original_bytes, sum(least(n, size))::BIGINT AS coded_bytes, round(sum(n) / sum(least(n, size)), 6) AS ratio, round((sum(n) - sum(least(n, size))) * 100.0 / sum(n), 6) AS saved_percent FROM (SELECT n.*, coalesce(z.size, 0) AS size FROM n LEFT JOIN z ON z.doc_id = n.doc_id WHERE n.n IS NOT NULL) GROUP BY lang")
def _coded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the better of raw and Huffman coding, from byte counts alone: no bit is written."""
    size = F.pandas_udf(_huffman_sizes, "bigint")(F.col("content"))
    sized = table(spark, sf_dir, "documents").select("lang", F.col("text").cast("binary").alias("content")).filter("content is not null")
    out = sized.select("lang", F.octet_length("content").cast("long").alias("n"), size.alias("size")).groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n").alias("original_bytes"), F.sum(F.least("n", "size")).alias("coded_bytes"))
    return out.withColumn("ratio", F.round(columns.ratio(F.col("original_bytes"), F.col("coded_bytes")), 6)).withColumn("saved_percent", F.round(columns.saved_percent(F.col("original_bytes"), F.col("coded_bytes")), 6))


def _huffman_sizes(s: pd.Series) -> pd.Series:
    from .operators.coders import huffman_size

    return pd.Series([None if x is None else huffman_size(bytes(x)) for x in s], dtype="Int64")


def _folder(spark: SparkSession) -> str:
    return shared.new_folder(spark, "archive")


def _packed(spark: SparkSession, sf_dir: str, options: Options) -> str:
    docs = table(spark, sf_dir, "documents").select(F.format_string("%s/%d.txt", "lang", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
    path = _folder(spark)
    archive.pack(docs, path, options)
    return path


_EXTRACTED = "SELECT lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, sha256(text) AS sha256, true AS sound FROM documents"


def _extracted(spark: SparkSession, path: str, password: str | None = None) -> DataFrame:
    out = archive.extract(spark, path, password)
    return out.select("path", "size", F.sha2("content", 256).alias("sha256"), F.col("error").isNull().alias("sound"))


@query("archive_roundtrip", _EXTRACTED)
def _archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, _packed(spark, sf_dir, Options(recovery_percent=0)))


@query("archive_sealed_blocks", _EXTRACTED)
def _archive_sealed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, _packed(spark, sf_dir, Options(recovery_percent=0, password="secret", block_size=4096, dedup=False)), "secret")


@query("archive_list", "SELECT lang || '/' || doc_id || '.txt' AS path, octet_length(encode(text))::BIGINT AS size, false AS is_dir FROM documents WHERE lang = 'de'")
def _archive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.listing(archive.entries(spark, _packed(spark, sf_dir, Options(recovery_percent=0))), "DE/")


@query("archive_test", "SELECT true AS ok, count(*) AS entries, 0::BIGINT AS errors FROM documents")
def _archive_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.test(spark, _packed(spark, sf_dir, Options(recovery_percent=0)), deep=True)


@query("archive_repair", _EXTRACTED)
def _archive_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chunk loses a byte; the repaired dataset extracts whole."""
    path = _packed(spark, sf_dir, Options(recovery_percent=10))
    chunks = spark.read.parquet(f"{path}/chunks")
    flipped = F.concat(F.expr("substring(payload, 1, 7)"), F.unhex(F.hex(F.conv(F.hex(F.expr("substring(payload, 8, 1)")), 16, 10).cast("long").bitwiseXOR(F.lit(255)))), F.expr("substring(payload, 9)"))
    hurt = (F.octet_length("payload") > 8) & (F.crc32("chunk_id") % 3 == 0) & (F.octet_length(flipped) == F.octet_length("payload"))
    damaged = _folder(spark)
    chunks.withColumn("payload", F.when(hurt, flipped).otherwise(F.col("payload"))).write.parquet(f"{damaged}/chunks")
    for name in ("entries", "archive", "parity"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{damaged}/{name}")
    mended = _folder(spark)
    archive.repair(spark, damaged, mended)
    return _extracted(spark, mended)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.format_string("%s/%d.txt", "lang", "doc_id").alias("path"), F.col("text").cast("binary").alias("content"))


def _restored(out: DataFrame) -> DataFrame:
    return out.select("path", "size", F.sha2("content", 256).alias("sha256"), F.col("error").isNull().alias("sound"))


@query("chunk_store", _EXTRACTED)
def _chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    stores.store_chunks(_texts(spark, sf_dir), path)
    return _restored(stores.restore_chunks(spark, path))


@query("solid_blocks", _EXTRACTED)
def _solid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    stores.pack_solid(_texts(spark, sf_dir), path, limit=1 << 16)
    return _restored(stores.extract_solid(spark, path))


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row as a ZIP (even ids) or a TAR (odd ids) of its text in two members."""
    for batch in batches:
        made = []
        for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, sink = content.as_py() or b"", io.BytesIO()
            half = len(data) // 2
            parts = ((f"{number}/a.txt", data[:half]), (f"{number}/b.txt", data[half:]))
            if number % 2 == 0:
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, part in parts:
                        z.writestr(name, part)
            else:
                with tarfile.open(fileobj=sink, mode="w") as t:
                    for name, part in parts:
                        info = tarfile.TarInfo(name)
                        info.size = len(part)
                        t.addfile(info, io.BytesIO(part))
            made.append(sink.getvalue())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "content"])


_MEMBERS = "WITH h AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text))::BIGINT AS n FROM documents), m AS (SELECT doc_id, 'a' AS m, n // 2 AS size, substr(hx, 1, 2 * (n // 2)) AS hx FROM h UNION ALL SELECT doc_id, 'b', n - n // 2, substr(hx, 2 * (n // 2) + 1) FROM h) SELECT doc_id::VARCHAR AS package, doc_id || '/' || m || '.txt' AS path, size, sha256(unhex(hx)) AS sha256, NULL::VARCHAR AS error FROM m"


@query("package_members", _MEMBERS)
def _package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = documents(spark, sf_dir).mapInArrow(_packages, "id bigint, content binary")
    found = packages.members(packed, "id", "content", contents=True)
    return found.select("package", "path", "size", F.sha2("content", 256).alias("sha256"), "error")


@query("package_nested", "WITH h AS (SELECT doc_id, octet_length(encode(text))::BIGINT AS n FROM documents) SELECT doc_id::VARCHAR AS root, doc_id || '/' || m AS path, 1 AS depth, CASE WHEN m = 'a.txt' THEN n // 2 ELSE n - n // 2 END AS size, false AS is_container, NULL::VARCHAR AS error FROM h, (SELECT unnest(['a.txt', 'b.txt']) AS m) UNION ALL SELECT doc_id::VARCHAR, '', 0, NULL, true, NULL FROM h")
def _package_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = documents(spark, sf_dir).mapInArrow(_packages, "id bigint, content binary")
    found = packages.nested(packed, "id", "content")
    return found.select("root", "path", "depth", F.when(F.col("depth") > 0, F.col("size")).alias("size"), "is_container", "error")


@query("package_convert", "WITH m AS (" + _MEMBERS + ") SELECT package || '/' || path AS path, size, sha256, true AS sound FROM m")
def _package_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = documents(spark, sf_dir).mapInArrow(_packages, "id bigint, content binary").withColumnRenamed("id", "path")
    path = _folder(spark)
    archive.convert(packed, path, Options(recovery_percent=0))
    return _extracted(spark, path)

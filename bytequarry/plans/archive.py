"""Archives as datasets of Parquet: entries, chunks and parity, written and read by all tasks at once.

Coding works on distinct contents: digests are grouped first, each is coded once, and entries refer to chunks by id. A chunk's id
is the digest of its content and its block, so that different contents cannot share one; an entry's id is that of its row, so
that repeated rows stay apart. Payloads travel through one exchange at most; parity and seals are made chunk by chunk, so
nothing needs the archive in one place."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import crypto, parity, security, tournament
from ..schema import FILE_MODE, Options
from ..sources import container

_CODED = "method string, payload binary"


def _encode(research: bool, key: bytes | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for x in s:
                if x is None:
                    rows.append((None, None))
                    continue
                method, coded = tournament.best(bytes(x), research)
                if key is not None:
                    nonce = crypto.new_nonce()
                    coded = nonce + crypto.seal(key, nonce, coded)
                rows.append((method, coded))
            yield pd.DataFrame(rows, columns=["method", "payload"], index=s.index)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, _CODED)


def encode(content: F.Column, research: bool = False, key: bytes | None = None) -> F.Column:
    """struct(method, payload): the smallest verified coding, sealed if there is a key."""
    return _encode(research, key)(content)


def _decode(key: bytes | None):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for methods, payloads in batches:
            rows = []
            for m, p in zip(methods, payloads, strict=True):
                try:
                    raw = None if p is None else bytes(p)
                    if raw is not None and key is not None:
                        raw = crypto.open_sealed(key, raw[: crypto.NONCE_BYTES], raw[crypto.NONCE_BYTES :])
                    rows.append((None if raw is None else tournament.decode(m, raw), None))
                except Exception as x:
                    rows.append((None, str(x) or type(x).__name__))
            yield pd.DataFrame(rows, columns=["content", "error"], index=methods.index)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "content binary, error string")


def decode(method: F.Column, payload: F.Column, key: bytes | None = None) -> F.Column:
    """struct(content, error)."""
    return _decode(key)(method, payload)


def coded_chunks(contents: DataFrame, options: Options = Options(), key: bytes | None = None) -> DataFrame:
    """Chunk rows of (chunk_id, content); each row is coded once, whatever reads the columns."""
    coded = contents.select("chunk_id", F.octet_length("content").cast("long").alias("original_size"), encode(F.col("content"), options.research, key).alias("c"))
    payload = F.col("c.payload")
    return coded.select("chunk_id", "original_size", F.octet_length(payload).cast("long").alias("compressed_size"), F.col("c.method").alias("method"), F.crc32(payload).alias("crc32"), udfs.xxh64(payload).alias("xxhash64"), payload.alias("payload"))


def _shards(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made = parity.encode(payload.as_py() or b"", percent)
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(made), pa.string()), pa.array(range(len(made)), pa.int32()), pa.array(made, pa.binary())], ["chunk_id", "shard_no", "shard"])

    return run


def parity_shards(chunks: DataFrame, percent: int) -> DataFrame:
    """(chunk_id, shard_no, shard) of every chunk's payload."""
    return chunks.select("chunk_id", "payload").mapInArrow(_shards(percent), "chunk_id string, shard_no int, shard binary")


def one_of_each(rows: DataFrame, listed: DataFrame, key: str, places: list[str]) -> DataFrame:
    """One row of rows for each key. listed holds the key and places of the same rows without their payloads.

    Keys and places are grouped; the row at a key's least place is then met by a hash join that streams the payloads. Only rows
    that repeat both key and place are grouped with their payload."""
    counted = listed.groupBy(key, *places).agg(F.count("*").alias("times"))
    least = counted.groupBy(F.col(key).alias("first_key")).agg(F.min(F.struct(*places, "times")).alias("first"))
    same = F.col(key) == F.col("first_key")
    for p in places:
        same &= F.col(p).eqNullSafe(F.col(f"first.{p}"))
    met = rows.join(least.hint("shuffle_hash"), same)
    once = met.filter("first.times = 1").select(rows.columns)
    return once.union(met.filter("first.times > 1").select(rows.columns).dropDuplicates([key]))


def _blocks(contents: DataFrame, block_size: int) -> DataFrame:
    """(chunk_id, content) with contents over block_size cut."""
    if not block_size:
        return contents.select(F.concat_ws(":", "content_key", F.lit(0)).alias("chunk_id"), "content")
    n = F.greatest(F.ceil(F.octet_length("content") / block_size).cast("int"), F.lit(1))
    cut = contents.select("content_key", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return cut.select(F.concat_ws(":", "content_key", "block").alias("chunk_id"), F.expr(f"substring(content, block * {block_size} + 1, {block_size})").alias("content"))


def pack(files: DataFrame, path: str, options: Options = Options(), path_col: str = "path", content_col: str = "content") -> dict:
    """Writes files (path, content and, where there are such columns, the entry metadata) as the dataset at path; what it is
    made of and its true size. Null contents are empty; repeated paths and repeated rows are all kept."""
    spark = files.sparkSession
    salt = crypto.new_salt() if options.password else None
    key = crypto.derive_scrypt(options.password, salt) if options.password else None
    content = F.coalesce(F.col(content_col), F.lit(b"").cast("binary"))
    meta = {c: F.col(c) if c in files.columns else F.lit(d).cast(t) for c, d, t in (("is_dir", False, "boolean"), ("created_at", 0, "bigint"), ("modified_at", 0, "bigint"), ("mode", FILE_MODE, "int"), ("is_symlink", False, "boolean"), ("symlink_target", None, "string"))}
    own_path = F.col(path_col).cast("string")
    # Without dedup a chunk belongs to a path.
    content_key = F.sha2(content, 256) if options.dedup else F.concat_ws("/", F.sha2(content, 256), F.sha2(F.coalesce(own_path, F.lit("")), 256))
    listed = files.select(F.monotonically_increasing_id().alias("entry_id"), own_path.alias("path"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"), *[c.alias(n) for n, c in meta.items()], content_key.alias("content_key"))
    n = F.greatest(F.ceil(F.col("size") / options.block_size).cast("int"), F.lit(1)) if options.block_size else F.lit(1)
    ids = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.concat_ws(":", "content_key", b))
    listed.withColumn("chunk_indices", ids).drop("content_key").write.mode("overwrite").parquet(f"{path}/entries")
    kept = spark.read.parquet(f"{path}/entries").select("path", F.regexp_replace(F.col("chunk_indices")[0], ":0$", "").alias("content_key"))
    rows = files.select(own_path.alias("path"), content_key.alias("content_key"), content.alias("content"))
    keyed = _blocks(one_of_each(rows, kept, "content_key", ["path"]), options.block_size)
    coded_chunks(keyed, options, key).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    if options.recovery_percent:
        parity_shards(chunks, options.recovery_percent).write.mode("overwrite").parquet(f"{path}/parity")
    sums = spark.read.parquet(f"{path}/entries").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("original")).first()
    stored = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed")).first()
    row = {"version": container.VERSION, "is_solid": options.solid == "Solid", "is_encrypted": key is not None, "has_deduplication": options.dedup, "has_recovery": options.recovery_percent > 0, "is_multi_volume": False, "created_timestamp": int(time.time()), "entry_count": sums["entries"], "chunk_count": stored["chunks"], "recovery_percent": options.recovery_percent, "block_size": options.block_size, "salt": salt, "original_bytes": sums["original"], "compressed_bytes": stored["compressed"]}
    schema = "version int, is_solid boolean, is_encrypted boolean, has_deduplication boolean, has_recovery boolean, is_multi_volume boolean, created_timestamp bigint, entry_count bigint, chunk_count bigint, recovery_percent int, block_size int, salt binary, original_bytes bigint, compressed_bytes bigint"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/archive")
    return row


def append(files: DataFrame, path: str, batch: int, options: Options = Options(recovery_percent=0), path_col: str = "path", content_col: str = "content") -> None:
    """Adds a numbered batch of files to the dataset at path, which it begins if need be: its entries and the chunks of contents
    that other batches lack, in folders of the batch's own. Running a batch again replaces them. Not for sealed archives."""
    spark = files.sparkSession
    if options.password:
        raise ValueError("appending to a sealed archive is not supported")
    part = f"{path}/parts/batch={batch}"
    pack(files, part, options, path_col, content_col)
    system = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    have = lambda p: system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p))
    chunks = spark.read.parquet(f"{part}/chunks")
    if have(f"{path}/chunks"):
        held = spark.read.option("basePath", f"{path}/chunks").parquet(f"{path}/chunks")
        if "batch" in held.columns:
            chunks = chunks.join(held.filter(F.col("batch") != batch).select("chunk_id"), "chunk_id", "left_anti")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/batch={batch}")
    own = F.col("entry_id").bitwiseOR(F.lit(batch) * F.lit(1 << 44).cast("long")).alias("entry_id")
    listed = spark.read.parquet(f"{part}/entries")
    listed.select(own, *[c for c in listed.columns if c != "entry_id"]).write.mode("overwrite").parquet(f"{path}/entries/batch={batch}")
    if options.recovery_percent:
        spark.read.parquet(f"{part}/parity").join(spark.read.parquet(f"{path}/chunks/batch={batch}").select("chunk_id"), "chunk_id", "left_semi").write.mode("overwrite").parquet(f"{path}/parity/batch={batch}")
    if not have(f"{path}/archive"):
        spark.read.parquet(f"{part}/archive").write.mode("overwrite").parquet(f"{path}/archive")
    system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part), True)


def _key_of(spark: SparkSession, path: str, password: str | None) -> bytes | None:
    head = spark.read.parquet(f"{path}/archive").first()
    if not head["is_encrypted"]:
        return None
    if password is None:
        from ..errors import PasswordError

        raise PasswordError("the archive needs a password")
    return crypto.derive_scrypt(password, bytes(head["salt"]))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The listing; chunks are not touched."""
    return spark.read.parquet(f"{path}/entries")


def extract(spark: SparkSession, path: str, password: str | None = None, fail: bool = False) -> DataFrame:
    """(path, safe_path, size, content, error) of every entry: chunks decoded once each, joined in order, digests compared.

    A damaged or missing chunk and an unsafe path give an error; with fail the first one stops the query."""
    key = _key_of(spark, path, password)
    decoded = spark.read.parquet(f"{path}/chunks").select("chunk_id", decode(F.col("method"), F.col("payload"), key).alias("d")).select("chunk_id", "d.content", F.col("d.error").alias("chunk_error"))
    if spark.read.parquet(f"{path}/archive").first()["block_size"]:
        wanted = entries(spark, path).select("entry_id", "path", "size", "sha256", F.posexplode("chunk_indices").alias("place", "chunk_id"))
        parts = wanted.join(decoded, "chunk_id", "left")
        whole = parts.groupBy("entry_id", "path", "size", "sha256").agg(F.array_sort(F.collect_list(F.struct("place", "content"))).alias("parts"), F.max("chunk_error").alias("chunk_error"), F.count(F.when(F.col("content").isNull(), 1)).alias("missing"))
        joined = F.aggregate(F.transform("parts", lambda p: p["content"]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
        out = whole.select("path", "size", "sha256", F.when(F.col("missing") == 0, joined).alias("content"), "chunk_error", "missing")
    else:  # an entry is one chunk: nothing to group
        wanted = entries(spark, path).select("path", "size", "sha256", F.col("chunk_indices")[0].alias("chunk_id"))
        out = wanted.join(decoded, "chunk_id", "left").select("path", "size", "sha256", "content", "chunk_error", F.col("content").isNull().cast("int").alias("missing"))
    error = F.when(F.col("missing") > 0, F.coalesce("chunk_error", F.lit("a chunk is missing"))).when(F.sha2("content", 256) != F.col("sha256"), "sha256 differs")
    safe = security.sanitized(F.col("path"))
    out = out.withColumn("error", F.coalesce(error, F.when(safe.isNull(), "unsafe path"))).withColumn("safe_path", safe)
    if fail:
        out = out.withColumn("content", F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("binary")))
    else:
        out = out.withColumn("content", F.when(F.col("error").isNull(), F.col("content")))
    return out.select("path", "safe_path", "size", "content", "error")


def test(spark: SparkSession, path: str, deep: bool = False, password: str | None = None) -> DataFrame:
    """One row (ok, entries, errors). Shallow: the listing is there and not empty. Deep: checksums and digests hold too."""
    listed = entries(spark, path).agg(F.count("*").alias("entries"))
    if not deep:
        return listed.select((F.col("entries") > 0).alias("ok"), "entries", F.lit(0).cast("long").alias("errors"))
    checked = spark.read.parquet(f"{path}/chunks").select((F.crc32("payload") == F.col("crc32")) & (udfs.xxh64(F.col("payload")) == F.col("xxhash64")))
    bad_chunks = checked.toDF("ok").agg(F.count(F.when(~F.col("ok"), 1)).alias("bad"))
    bad = extract(spark, path, password).agg(F.count(F.when(F.col("error").isNotNull(), 1)).alias("errors"))
    return listed.crossJoin(bad).crossJoin(bad_chunks).select(((F.col("entries") > 0) & (F.col("errors") + F.col("bad") == 0)).alias("ok"), "entries", (F.col("errors") + F.col("bad")).alias("errors"))


def _mend(rows: pd.DataFrame) -> pd.DataFrame:
    import zlib

    first = rows.iloc[0]
    payload = bytes(first["payload"])
    if zlib.crc32(payload) != first["crc32"]:
        shards = [bytes(x) for x in rows.sort_values("shard_no")["shard"]]
        own = [x.tobytes() for x in parity.split(payload.ljust(int(first["compressed_size"]), b"\0")[: int(first["compressed_size"])])]
        from itertools import combinations

        for lost in (c for k in range(1, len(shards) + 1) for c in combinations(range(len(own)), k)):
            whole = parity.reconstruct([None if i in lost else s for i, s in enumerate(own)], shards, int(first["compressed_size"]))
            if zlib.crc32(whole) == first["crc32"]:
                return pd.DataFrame({"chunk_id": [first["chunk_id"]], "payload": [whole], "mended": [True]})
        return pd.DataFrame({"chunk_id": [first["chunk_id"]], "payload": [payload], "mended": [False]})
    return pd.DataFrame({"chunk_id": [first["chunk_id"]], "payload": [payload], "mended": [False]})


def repair(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Writes the dataset at out with damaged chunks rebuilt from their parity; (chunk_id, mended) of the damaged ones."""
    chunks = spark.read.parquet(f"{path}/chunks")
    bad = chunks.filter(F.crc32("payload") != F.col("crc32"))
    shards = spark.read.parquet(f"{path}/parity")
    joined = bad.select("chunk_id", "payload", "crc32", "compressed_size").join(shards, "chunk_id")
    mended = joined.groupBy("chunk_id").applyInPandas(_mend, "chunk_id string, payload binary, mended boolean")
    mended.write.mode("overwrite").parquet(f"{out}/mended")
    done = spark.read.parquet(f"{out}/mended")
    new = done.select("chunk_id", F.col("payload").alias("rebuilt"))
    chunks.join(new, "chunk_id", "left").withColumn("payload", F.coalesce("rebuilt", "payload")).drop("rebuilt").write.mode("overwrite").parquet(f"{out}/chunks")
    for table in ("entries", "archive", "parity"):
        spark.read.parquet(f"{path}/{table}").write.mode("overwrite").parquet(f"{out}/{table}")
    return done.select("chunk_id", "mended")


def write_files(extracted: DataFrame, root: str) -> None:
    """Writes extracted contents below root, a folder that all executors reach; rows with an error are left out."""

    def save(rows) -> None:
        import os

        for r in rows:
            target = os.path.join(root, r["safe_path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(bytes(r["content"] or b""))

    extracted.filter("error is null").select("safe_path", "content").foreachPartition(save)


def export(spark: SparkSession, path: str, password: str | None = None, recovery_percent: int = 0, key: bytes | None = None) -> bytes:
    """The dataset as one single-file container. That file is one sequence of bytes, so the driver assembles it: for archives
    that fit its memory."""
    listed = entries(spark, path).orderBy("path").collect()
    stored = {r["chunk_id"]: r.asDict() for r in spark.read.parquet(f"{path}/chunks").collect()}
    number = {c: i for i, c in enumerate(dict.fromkeys(i for e in listed for i in e["chunk_indices"]))}
    rows = [e.asDict() | {"entry_id": k, "chunk_indices": [number[i] for i in e["chunk_indices"]]} for k, e in enumerate(listed)]
    chunks = [stored[c] | {"chunk_id": i, "payload": bytes(stored[c]["payload"])} for c, i in number.items()]
    return container.write(rows, chunks, password=password, recovery_percent=recovery_percent, key=key)


def convert(packages: DataFrame, path: str, options: Options = Options(), id_col: str = "path", content_col: str = "content") -> dict:
    """Packs what foreign packages hold: members become entries below their package's path. Unreadable packages stop it."""
    from ..sources import packages as foreign

    opened = foreign.members(packages, id_col, content_col, contents=True, fail=True).filter("not is_dir")
    safe = security.sanitized(F.col("path"))
    named = opened.withColumn("path", F.concat_ws("/", "package", F.when(safe.isNotNull(), safe).otherwise(F.raise_error(F.concat(F.lit("unsafe path: "), F.col("path"))))))
    return pack(named.select("path", "content"), path, options)

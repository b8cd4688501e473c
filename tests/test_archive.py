"""Datasets packed, listed, tested, damaged, repaired, sealed, exported and extracted; files, the data source and streams."""

import os

import pytest
from pyspark.sql import functions as F

from bytequarry.functions import udfs
from bytequarry.operators import dedup
from bytequarry.plans import archive, reports, stores
from bytequarry.schema import Options
from bytequarry.sources import container, files
from bytequarry.streaming import files as stream

CONTENTS = {"a.log": b"user logged in\n" * 200, "b/c.bin": bytes(range(256)) * 5, "copy.log": b"user logged in\n" * 200, "empty": b"", "null": None}
LOG = b"2026-01-01 service started, listening on port 8080, all checks passed ok\n" * 100


@pytest.fixture
def table(spark):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in CONTENTS.items()], "path string, content binary")


@pytest.mark.parametrize("how", [{}, {"dedup": False}, {"block_size": 1000}, {"password": "p", "block_size": 700, "recovery_percent": 0}, {"level": "Research", "recovery_percent": 50}])
def test_roundtrip(spark, table, tmp_path, how):
    path = str(tmp_path / "x")
    report = archive.pack(table, path, Options(**how))
    assert report["entry_count"] == 5 and report["original_bytes"] == sum(len(c or b"") for c in CONTENTS.values())
    got = {r["path"]: (r["content"], r["error"]) for r in archive.extract(spark, path, how.get("password")).collect()}
    assert got == {p: (bytearray(c or b""), None) for p, c in CONTENTS.items()}
    ok = archive.test(spark, path, deep=True, password=how.get("password")).first()
    assert ok["ok"] and ok["entries"] == 5
    if not how:
        assert report["chunk_count"] == 3 and report["compressed_bytes"] < report["original_bytes"]
        back = container.Archive(archive.export(spark, path, recovery_percent=10)).extract()
        assert {x["path"]: x["content"] for x in back} == {p: c or b"" for p, c in CONTENTS.items()}


@pytest.mark.parametrize("how", [{}, {"dedup": False}, {"block_size": 1000, "dedup": False}, {"block_size": 700}])
def test_repeated_rows_are_all_kept(spark, tmp_path, how):
    """Repeated paths, contents, and both; null paths and contents."""
    rows = [("a", b"hello" * 400), ("a", b"hello" * 400), ("a", b"other"), ("b", b"hello" * 400), ("b", b""), ("b", b""), ("c", None), (None, b"x"), (None, b"x"), (None, None)]
    table = spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in rows], "path string, content binary").repartition(3)
    path = str(tmp_path / "x")
    assert archive.pack(table, path, Options(recovery_percent=0, **how))["entry_count"] == len(rows)
    got = sorted((r["path"] or "", r["error"] or bytes(r["content"])) for r in archive.extract(spark, path).collect())
    assert got == sorted((p or "", "unsafe path" if p is None else c or b"") for p, c in rows)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    assert archive.entries(spark, path).select("entry_id").distinct().count() == len(rows)
    if not how:
        stores.store_chunks(table, str(tmp_path / "s"))
        got = sorted((r["path"] or "", bytes(r["content"])) for r in stores.restore_chunks(spark, str(tmp_path / "s")).collect())
        assert got == sorted((p or "", c or b"") for p, c in rows)
        assert spark.read.parquet(str(tmp_path / "s/chunks")).count() == 3


def test_dedup_index_keeps_null_digests(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, None, "x"), (2, "a", "z")], "id long, sha256 string, first_digest string")
    got = sorted((r["id"], r["sha256"], r["first_digest"], r["already_present"]) for r in dedup.index(rows, "sha256", ["id"]).collect() if r["sha256"])
    assert got == [(1, "a", "x", False), (2, "a", "y", True), (2, "a", "z", True)]
    assert sorted(r["id"] for r in dedup.stored(rows, "sha256", ["id"]).collect()) == [1, 3, 4]
    assert dedup.index(rows, "sha256", ["id"]).count() == 5


def test_empty_table(spark, table, tmp_path):
    path = str(tmp_path / "x")
    assert archive.pack(table.limit(0), path)["entry_count"] == 0
    assert archive.extract(spark, path).count() == 0
    assert not archive.test(spark, path).first()["ok"]


def test_wrong_password(spark, table, tmp_path):
    path = str(tmp_path / "x")
    archive.pack(table, path, Options(password="right", recovery_percent=0))
    assert all(r["error"] for r in archive.extract(spark, path, "wrong").collect())
    with pytest.raises(Exception, match="password"):
        archive.extract(spark, path)


def test_damage_is_reported_and_repaired(spark, table, tmp_path):
    path, bad, mended = (str(tmp_path / x) for x in "abc")
    archive.pack(table, path, Options(recovery_percent=10))
    chunks = spark.read.parquet(f"{path}/chunks")
    hurt = F.concat(F.expr("substring(payload, 1, 500)"), F.lit(b"!!").cast("binary"), F.expr("substring(payload, 503)"))
    chunks.withColumn("payload", F.when(F.octet_length("payload") > 1000, hurt).otherwise(F.col("payload"))).write.parquet(f"{bad}/chunks")
    for name in ("entries", "archive", "parity"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{bad}/{name}")
    assert archive.test(spark, bad).first()["ok"] and not archive.test(spark, bad, deep=True).first()["ok"]
    assert {r["path"] for r in archive.extract(spark, bad).filter("error is not null").collect()} >= {"b/c.bin"}
    with pytest.raises(Exception):
        archive.extract(spark, bad, fail=True).collect()
    assert archive.repair(spark, bad, mended).filter("not mended").count() == 0
    assert archive.test(spark, mended, deep=True).first()["ok"]


def test_missing_chunk(spark, table, tmp_path):
    path, bad = str(tmp_path / "a"), str(tmp_path / "b")
    archive.pack(table, path, Options(recovery_percent=0))
    spark.read.parquet(f"{path}/chunks").filter("original_size = 0").write.parquet(f"{bad}/chunks")
    for name in ("entries", "archive"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{bad}/{name}")
    assert {r["path"]: r["error"] for r in archive.extract(spark, bad).filter("error is not null").collect()}.keys() == {"a.log", "copy.log", "b/c.bin"}


def test_files_out_and_in(spark, table, tmp_path):
    path, out = str(tmp_path / "x"), str(tmp_path / "out")
    archive.pack(table, path, Options(recovery_percent=0))
    archive.write_files(archive.extract(spark, path), out)
    again = {r["path"]: r["content"] for r in files.scan(spark, out).collect()}
    assert again == {p: bytearray(c or b"") for p, c in CONTENTS.items()}
    assert files.scan(spark, f"{out}/a.log").first()["path"] == "a.log"


def test_unsafe_entries_are_not_written(spark, tmp_path):
    rows = spark.createDataFrame([("../up", bytearray(b"x")), ("ok", bytearray(b"y"))], "path string, content binary")
    archive.pack(rows, str(tmp_path / "x"), Options(recovery_percent=0))
    got = {r["path"]: r["error"] for r in archive.extract(spark, str(tmp_path / "x")).collect()}
    assert got["../up"] == "unsafe path" and got["ok"] is None


def test_data_source(spark, table, tmp_path):
    path = str(tmp_path / "x")
    archive.pack(table, path, Options(recovery_percent=0))
    (tmp_path / "one.bin").write_bytes(archive.export(spark, path))
    import pyarrow.fs

    with pyarrow.fs.LocalFileSystem().open_input_file(str(tmp_path / "one.bin")) as f:
        ranges = container.Ranges(f)
        assert len(container.Archive(ranges).entries()) == 5 and ranges.taken < 700 < len(ranges)
    spark.dataSource.register(container.ContainerSource)
    listed = spark.read.format("byte_container").load(str(tmp_path / "*.bin"))
    assert {r["path"]: r["size"] for r in listed.collect()} == {p: len(c or b"") for p, c in CONTENTS.items()}
    assert spark.read.format("byte_container").option("table", "chunks").load(str(tmp_path / "one.bin")).count() == 3


def test_chunk_store(spark, table, tmp_path):
    big = os.urandom(70_000)
    rows = table.union(spark.createDataFrame([("big", bytearray(big)), ("again", bytearray(b"head" + big))], "path string, content binary"))
    stores.store_chunks(rows, str(tmp_path / "x"))
    got = {r["path"]: (r["content"], r["error"]) for r in stores.restore_chunks(spark, str(tmp_path / "x")).collect()}
    want = {p: c or b"" for p, c in CONTENTS.items()} | {"big": big, "again": b"head" + big}
    assert got == {p: (bytearray(c), None) for p, c in want.items()}
    chunks = spark.read.parquet(str(tmp_path / "x/chunks"))
    assert chunks.count() == chunks.select("sha256").distinct().count()
    assert chunks.agg(F.sum("original_size")).first()[0] < sum(map(len, want.values()))


def test_scan_of_many_small_files(spark, tmp_path):
    """Opening a file counts little when files are dealt to tasks, and only empty ones are visited from Python."""
    want = {f"{i % 3}/{i}.txt": b"x" * (i % 50) for i in range(600)}
    for name, data in want.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    os.utime(tmp_path / "0/0.txt", (1_000_000, 1_000_000))
    (tmp_path / "_hidden").write_bytes(b"")
    shuffles, cost = (spark.conf.get(f"spark.sql.{k}") for k in ("shuffle.partitions", "files.openCostInBytes"))
    found = files.scan(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() <= 20
    rows = found.select("path", "size", "content", "modified_at").collect()
    assert {r["path"]: bytes(r["content"]) for r in rows} == want and len(rows) == len(want) and all(r["size"] == len(r["content"]) for r in rows)
    assert {r["modified_at"] for r in rows if r["path"] == "0/0.txt"} == {1_000_000}
    assert files.scan(spark, str(tmp_path), "1*.txt").count() == sum(1 for n, d in want.items() if n[2] == "1" and d)
    assert found.groupBy("size").count().count() == 50
    assert (shuffles, cost) == tuple(spark.conf.get(f"spark.sql.{k}") for k in ("shuffle.partitions", "files.openCostInBytes")) and found.sparkSession is spark


@pytest.mark.parametrize("limit", [1, 2000, 1 << 20])
def test_solid_blocks(spark, table, tmp_path, limit):
    stores.pack_solid(table, str(tmp_path / "x"), limit, partitions=1)
    got = {r["path"]: (r["content"], r["error"]) for r in stores.extract_solid(spark, str(tmp_path / "x")).collect()}
    assert got == {p: (bytearray(c or b""), None) for p, c in CONTENTS.items()}
    if limit == 1 << 20:
        assert spark.read.parquet(str(tmp_path / "x/blocks")).count() == 1


def test_data_source_writes(spark, table, tmp_path):
    spark.dataSource.register(container.ContainerSource)
    out = tmp_path / "packed"
    table.repartition(2).write.format("byte_container").option("recovery_percent", 10).mode("append").save(str(out))
    made = sorted(p.name for p in out.iterdir())
    assert made and all(n.startswith("part-") for n in made)
    back = {x["path"]: x["content"] for n in made for x in container.Archive((out / n).read_bytes()).extract()}
    assert back == {p: c or b"" for p, c in CONTENTS.items()}
    assert spark.read.format("byte_container").load(f"{out}/*.bin").count() == 5


def test_reports(spark, table):
    rows = table.filter("content is not null")
    out = reports.by_method(rows, "content").collect()
    assert sum(r["files"] for r in out) == 4 and sum(r["original_bytes"] for r in out) == sum(len(c or b"") for c in CONTENTS.values())
    b = reports.benchmark(rows, "content")
    assert b["lossless"] and b["ratio"] > 1
    info = {r["name"]: r["detected_type"] for r in reports.file_info(rows, "path", "content").collect()}
    assert info["c.bin"] == "HighEntropyBinary"
    e = rows.select("path", F.octet_length("content").cast("long").alias("size"), F.lit(False).alias("is_dir"))
    assert {r["path"] for r in reports.listing(e, " LOG ").collect()} == {"a.log", "copy.log"} and reports.listing(e, "  ").count() == 4
    assert reports.as_text(e).first()["line"].startswith("f ")


def test_sql_functions(spark):
    udfs.register(spark)
    row = spark.sql("SELECT hex(byte_delta(X'0A0C0F')) AS d, byte_undelta(byte_delta(X'0A0CFF')) = X'0A0CFF' AS same, byte_xxh64(cast('' as binary)) AS x, size(byte_cdc(X'00')) AS n").first()
    assert row["d"] == "0A0203" and row["same"] and row["x"] == -1205034819632174695 and row["n"] == 1


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    os.makedirs(src)
    for name, data in (("a", LOG), ("b", LOG), ("c", b"other")):
        (src / name).write_bytes(data)
    for name, more in ((None, None), ("d", b"later"), ("e", LOG)):
        if more:
            (src / name).write_bytes(more)
        stream.store(stream.arriving(spark, str(src)), out, str(tmp_path / "ck")).awaitTermination(120)
    sizes = sorted(r["original_size"] for r in spark.read.parquet(f"{out}/chunks").collect())
    assert sizes == [5, 5, len(LOG)]
    got = {os.path.basename(r["path"]): (bytes(r["content"]), r["error"]) for r in archive.extract(spark, out).collect()}
    assert got == {n: (c, None) for n, c in {"a": LOG, "b": LOG, "c": b"other", "d": b"later", "e": LOG}.items()}
    assert spark.read.parquet(f"{out}/entries").select("entry_id").distinct().count() == 5


def test_options_are_checked():
    for wrong in ({"level": "Best"}, {"solid": "x"}, {"recovery_percent": 51}):
        with pytest.raises(ValueError):
            Options(**wrong)

"""The commands, end to end on files."""

import zipfile

import pytest

from bytequarry import api
from bytequarry.errors import ByteError, IntegrityError
from bytequarry.schema import Options
from bytequarry.sources import packages

LINE = b"2026-01-01 request served in 12 ms by worker 7 of pool a, status ok\n"


def test_commands(spark, tmp_path):
    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    files = {"log.txt": LINE * 100, "sub/data.bin": bytes(range(256)) * 8, "sub/empty": b""}
    for name, data in files.items():
        (src / name).write_bytes(data)
    packed, out = str(tmp_path / "packed"), tmp_path / "out"
    report = api.compress(spark, [str(src), str(tmp_path / "missing")], packed, Options(recovery_percent=10))
    assert report["entry_count"] == 3 and report["ratio"] > 1 and 0 < report["saved_percent"] < 100
    assert api.extract(spark, packed, str(out)) == 3
    assert {n: (out / n).read_bytes() for n in files} == files
    assert {r["path"] for r in api.list_entries(spark, packed, "SUB").collect()} == {"sub/data.bin", "sub/empty"}
    assert api.test(spark, packed) and api.test(spark, packed, deep=True)
    assert api.repair(spark, packed, str(tmp_path / "mended")) == 0
    assert api.benchmark(spark, str(src / "log.txt"))["lossless"]
    assert api.detect_type(spark, str(src / "log.txt")) == 'StructuredText("Text/SourceCode/Logs")'
    assert {r["name"]: r["size"] for r in api.info(spark, str(src)).collect()} == {n.split("/")[-1]: len(d) for n, d in files.items()}
    with pytest.raises(FileNotFoundError):
        api.compress(spark, [str(tmp_path / "missing")], packed)


def test_convert_and_nested(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a/b.txt", LINE * 40)
    report = api.convert(spark, str(tmp_path / "p.zip"), str(tmp_path / "packed"))
    assert report["entry_count"] == 1 and [r["path"] for r in api.list_entries(spark, str(tmp_path / "packed")).collect()] == ["p.zip/a/b.txt"]
    assert {(r["path"], r["depth"]) for r in api.inspect_nested(spark, str(tmp_path / "p.zip")).collect()} == {("", 0), ("a/b.txt", 1)}


def test_extract_package(spark, tmp_path):
    for name, member in (("good.zip", "a/b.txt"), ("bad.zip", "../up.txt")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(member, LINE)
    assert api.extract_package(spark, str(tmp_path / "good.zip"), str(tmp_path / "out")) == 1
    assert (tmp_path / "out/a/b.txt").read_bytes() == LINE
    with pytest.raises(ByteError, match="unsafe"):
        api.extract_package(spark, str(tmp_path / "bad.zip"), str(tmp_path / "out2"))


def test_own_package_type(spark, monkeypatch):
    monkeypatch.setattr(packages, "READERS", list(packages.READERS))
    monkeypatch.setattr(packages, "OWN_MAGICS", [])
    packages.register("Lines", lambda data: iter([(f"{i}", False, len(x), lambda x=x: x) for i, x in enumerate(data.split(b"\n")[1:])]), b"LINES")
    rows = spark.createDataFrame([("p", bytearray(b"LINES\none\ntwo")), ("q", bytearray(b"text"))], "id string, c binary")
    got = packages.members(rows, "id", "c", contents=True).collect()
    assert sorted((r["package"], r["path"], r["content"]) for r in got if not r["error"]) == [("p", "0", bytearray(b"one")), ("p", "1", bytearray(b"two"))]
    assert [r["package"] for r in got if r["error"]] == ["q"]


def test_a_wrong_password_writes_nothing(spark, tmp_path):
    (tmp_path / "f").write_bytes(LINE)
    api.compress(spark, [str(tmp_path / "f")], str(tmp_path / "packed"), Options(password="a", recovery_percent=0))
    with pytest.raises(IntegrityError):
        api.extract(spark, str(tmp_path / "packed"), str(tmp_path / "out"), "b")
    assert not (tmp_path / "out").exists()

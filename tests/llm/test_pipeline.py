"""The corpus pipeline against its stages' rules, applied one by one in plain Python."""

import base64
import re
from fractions import Fraction

import public_tokenizers
import tiktoken

from .test_pairs import slow_components, slow_contaminated
from .test_texts import slow_quality

import __spark_entry__
import corpus_pipeline
from bytequarry.llm import labels, quality

TOKEN = " token = 'abcdef0123456789abcdef0123456789'"


def slow_mask(text):
    """Every span of the base kinds, by patterns of this test's own, joined where they overlap."""
    assign = r"""(?ia:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([a-z0-9+/_.=-]+)"""
    found = [m.span() for m in re.finditer(assign, text, re.I | re.A) if len(m[1]) >= 8]
    found += [m.span() for p, least in (("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)) for m in re.finditer(p, text) if len(m[0]) >= least]
    hidden = {k for a, b in found for k in range(a, b)}
    return "".join("[secret]" if k in hidden and (k - 1) not in hidden else "" if k in hidden else c for k, c in enumerate(text))


def rows_of(words):
    clean = [(i, words(60, 1000 + i)) for i in range(60)]
    junk = [(100 + i, " | ".join(x + "$$$" for x in words(60, 2000 + i).split())) for i in range(30)]
    near = [(200 + i, clean[i][1].replace(" ", "  ", 3)) for i in range(10)] + [(220 + i, clean[i][1] + " extra") for i in range(5)]
    leaks = [(300 + i, words(20, 3000 + i) + " " + words(30, 500 + i) + " " + words(15, 4000 + i)) for i in range(4)]
    hidden = [(400 + i, words(50, 5000 + i) + TOKEN) for i in range(5)]
    return clean + junk + near + leaks + hidden + [(500, ""), (501, None)]


def test_pipeline(spark, documents, words, tmp_path):
    rows = rows_of(words)
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 100 <= i < 130)) for i, _ in rows[:90]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, words(30, 500 + i)) for i in range(4)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    read = lambda n: spark.read.parquet(str(tmp_path / f"{n}.parquet"))
    net = quality.train(labels.sample(read("documents"), read("labels"), "quality", labels.fold("doc_id", 4) != 2))
    kept = [(i, t) for i, t in rows if slow_quality(net, t or "") >= 0.5]
    component = slow_components(kept, 5, Fraction(4, 5))
    kept = [(i, t) for i, t in kept if component[i][1] == i]
    leaked = {i for i, *_ in slow_contaminated(kept, [(i, words(30, 500 + i)) for i in range(4)])}
    assert leaked == {300, 301, 302, 303}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    tokens = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kept = [(i, slow_mask(t or "")) for i, t in kept if i not in leaked]
    assert {i: r["ids"] for i, r in got.items()} == {i: tokens.encode_ordinary(t) for i, t in kept}
    assert all(r["lang"] == "en" and r["n_chars"] == len(dict(kept)[i]) for i, r in got.items() if r["n_chars"] is not None)
    assert {i for i, _ in rows if i < 60} <= got.keys() and not {i for i, _ in rows if 100 <= i < 300} & got.keys()
    assert not any("abcdef0123456789" in tokens.decode(r["ids"]) for r in got.values())


def test_stages_keep_the_columns(spark, documents, words, tmp_path):
    docs = documents(rows_of(words)).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_entry_lists_all():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert len(corpus_pipeline.STAGES) == 5

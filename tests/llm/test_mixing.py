import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyrack.llm import mixing
from tests.llm.common import ODD, documents, prose


def test_targets():
    got = mixing.targets({"b": 100, "a": 1000, None: 50, "c": 10})
    # a 5, b 2, c 1, null 5 of 1160 words; c stops at 30, null at 150
    assert got["c"] == 30 and got[None] == 150
    assert sum(got.values()) == pytest.approx(1160)
    assert 2 * got["a"] == pytest.approx(5 * got["b"]) and all(got[s] <= 3 * n for s, n in {"a": 1000, "b": 100}.items())
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0}


def test_targets_when_all_hit_the_cap_but_one():
    sizes = {"a": 1, "b": 1, "c": 10_000}
    got = mixing.targets(sizes)
    assert got["a"] == got["b"] == 3 and got["c"] == pytest.approx(9996)


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5, 2**63):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, dtype=np.uint64))
            assert sorted(out.tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(500), np.full(500, 500), np.full(500, k, dtype=np.uint64)) for k in (1, 2))
    assert (a == b).mean() < 0.1 and (a == np.arange(500)).mean() < 0.1


def rows(n=400):
    return [(i, prose(i, 5 + i % 300), "en", ["hot", "hot", "s1", "s2", "s3", None][i % 6]) for i in range(n)]


def test_accounts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 16)
    monkeypatch.setattr(mixing, "BLOCK", 32)
    data = rows()
    df = documents(spark, data)
    mixed, accounts = mixing.mix_sources(df)
    got = {r["doc_id"]: r for r in accounts.collect()}
    sizes = Counter()
    for i, text, _, source in data:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        assert got[i]["size"] == n and got[i]["taken"] <= 3 * n
        sizes[source] += n
    goal = mixing.targets(sizes)
    taken = defaultdict(int)
    for i, _, _, source in data:
        assert got[i]["source_size"] == sizes[source] and got[i]["target"] == pytest.approx(goal[source])
        taken[source] += got[i]["taken"]
    for source, n in taken.items():
        assert abs(n - goal[source]) <= 3 * 32 + 0.02 * goal[source]
    slots = mixed.collect()
    assert Counter({r["doc_id"]: 0 for r in slots}) | sum_of(slots) == Counter({i: r["taken"] for i, r in got.items() if r["taken"]})
    filled = defaultdict(set)
    for r in slots:
        filled[r["shard"]].add((r["sid"], r["block"]))
    assert len(filled) > 3 and all(len({s for s, _ in f}) > 1 for f in filled.values())
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(df.repartition(5))[1].collect()}
    assert again == {i: r["taken"] for i, r in got.items()}


def sum_of(slots):
    out = Counter()
    for r in slots:
        out[r["doc_id"]] += r["words"]
    return out


def test_words_are_counted_as_the_pattern_says(spark):
    texts = [None, "", "  ", "a", " a\tb\nc\x0bd\x0ce\rf ", "é x y", "a​b \x00 c", "\x1c\x85 x"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", mixing.words_of(F.col("text")).alias("n"))
    assert {r["text"]: r["n"] for r in df.collect()} == {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts}


def test_odd_rows(spark):
    got = mixing.mix_sources(documents(spark, ODD))[1].collect()
    assert len(got) == len(ODD) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(r["taken"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert mixing.mix_sources(documents(spark, []))[1].count() == 0
    assert [r["taken"] for r in mixing.mix_sources(documents(spark, [(1, None), (2, "")]))[1].collect()] == [0, 0]


@pytest.mark.parametrize("words", [7, 100, 400, 3000])
def test_small_sources_come_near_their_targets(spark, words):
    """Sources of few words, with blocks of the real size."""
    texts = {"a": words, "b": words, "c": words, None: words // 7}
    docs = documents(spark, [(i * 100 + j, prose(i * 100 + j, n // 7), "en", s) for i, (s, n) in enumerate(texts.items()) for j in range(7)])
    got = mixing.mix_sources(docs)[1].withColumn("source", F.floor(F.col("doc_id") / 100)).groupBy("source")
    for r in got.agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert abs(r["taken"] - r["target"]) <= max(1, 0.03 * r["target"]) and r["over"] <= 0


def test_mix_rows_add_up_to_the_accounts(spark):
    """Every row of the mix is a stretch of a document, and their words are what the accounts say."""
    docs = documents(spark, rows(120))
    mixed, accounts = mixing.mix_sources(docs)
    taken, size = Counter(), {r["doc_id"]: r["size"] for r in accounts.collect()}
    for r in mixed.collect():
        assert 0 <= r["doc_start"] and r["words"] > 0 and r["doc_start"] + r["words"] <= size[r["doc_id"]]
        taken[r["doc_id"]] += r["words"]
    assert {r["doc_id"]: r["taken"] for r in accounts.collect() if r["taken"]} == dict(taken)

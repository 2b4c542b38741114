"""Importance resampling against a plain version, and the quickselect against sorting."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyrack.llm import common, resample
from tests.llm.common import ODD, documents, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    words = WORD.findall((text or "").translate(SMALL))
    return [zlib.crc32(f.encode()) % 10000 for f in [*words, *map(" ".join, zip(words, words[1:]))]]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for text in docs:
        for b in buckets(text[1]):
            s[b] += 1
    for text in target:
        for b in buckets(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    rows = []
    for i, text, *_ in docs:
        b = buckets(text)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=repr)


def corpus():
    rng = random.Random(4)
    texts = ["Ärger MIT dem Größten é日本語 x9-y9_z", "a" * 200 + " b " + "c" * 70 + " C" * 30, "İI ǅ K 0Aa", "x " * 300]
    rows = [(i, prose(i, rng.choice([5, 19, 20, 21, 80]))) for i in range(300)]
    rows += [(400 + i, t) for i, t in enumerate(texts)] + rows[:20] + [(7, prose(900, 40)), (None, prose(901, 40)), (None, prose(901, 40))]
    return rows + ODD


@pytest.mark.parametrize("chunk", [common.CHUNK, 512])
def test_against_a_plain_version(spark, monkeypatch, chunk):
    monkeypatch.setattr(resample, "CHUNK", chunk)
    docs = corpus()
    target = [prose(i, 60) for i in range(250, 270)] + [None, "", "LAMP"]
    frame = spark.createDataFrame([(t,) for t in target], "text string").withColumn("n", F.lit("clash"))
    rows = documents(spark, docs).withColumn("rank", F.lit("clash")).withColumn("down", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = resample.resample(rows, frame).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, target)


def test_empty_tables(spark):
    docs, none = documents(spark, [(1, prose(1, 30)), (2, prose(2, 30))]), spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), none).count() == 0
    assert [r["rank"] for r in resample.resample(docs, none).collect()] == [None, None]  # a quarter of two is none
    one = resample.resample(docs, none, percent=50, least_words=0).filter("rank = 1")
    assert one.count() == 1


def test_features_joined_over_any_length():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab0é") for _ in range(rng.randint(1, 90))).encode() for _ in range(2))
        import numpy as np

        data = np.frombuffer(a + b" " + b, dtype=np.uint8)
        assert sorted(resample.features(data, np.array([0, len(data)]))[0]) == sorted(zlib.crc32(x) % 10000 for x in (a, b, a + b" " + b))


@pytest.mark.parametrize("pivots", [1, 4, 15])
def test_quickselect(spark, pivots):
    rng = random.Random(pivots)
    keys = [(rng.choice([-5, 0, 0, 0, 7, rng.randint(-9, 9)]), i % 2 == 0, rng.randint(0, 3), i) for i in range(500)]
    rows = spark.createDataFrame(keys, "a bigint, b boolean, c bigint, d bigint").repartition(4).cache()
    order = sorted(keys)
    for k in (1, 2, 250, 499, 500):
        assert resample.kth_key(rows, ["a", "b", "c", "d"], k, pivots) == order[k - 1]
    assert resample.kth_key(rows, ["a", "b", "c", "d"], 501, pivots) is None
    assert resample.kth_key(rows, ["a", "b", "c", "d"], 0, pivots) is None
    assert resample.kth_key(rows.limit(0), ["a", "b", "c", "d"], 1, pivots) is None

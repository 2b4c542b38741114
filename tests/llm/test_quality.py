import numpy as np
import pyarrow as pa

from tallyrack.llm import quality
from tests.llm.common import ODD, documents, prose


def bad(i):
    words = prose(i, 30 + i % 50).split()
    return ["!! ".join(words).upper(), " | ".join(words), "".join(w + "%$#& " for w in words), " ".join([words[0]] * 40)][i % 4]


def labelled(spark, n=300, start=0):
    rows = [(i, bad(i) if i % 3 == 0 else prose(i, 30 + i % 70)) for i in range(start, start + n)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = labelled(spark)
    model = quality.train(documents(spark, rows), labels)
    new, _ = labelled(spark, 90, 5000)
    got = {r["doc_id"]: r["score"] for r in quality.score(documents(spark, new), model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == (i % 3 != 0) for i in got) >= 88


def test_pairs_learn_what_no_single_feature_tells():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (0, 2) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    model = quality.fit(x, (x[:, 0] + x[:, 1] ** 2 > 0.8).astype(float))
    for row, score in zip(x[:50], model.score(x[:50])):
        total = model.base + sum(t[sum(v >= c for c in cut)] for v, cut, t in zip(row, model.cuts, model.tables))
        total += sum(t[sum(row[i] >= c for c in model.coarse[i]), sum(row[j] >= c for c in model.coarse[j])] for (i, j), t in model.pairs.items())
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-12


def test_features_by_hand():
    (row,) = quality.features(pa.array(["Aa b | b\nb 12!!"]))
    got = dict(zip(quality.FEATURES, row))
    assert got["log_words"] == np.log1p(6) and got["pipe"] == 1 / 6 and got["exclaim"] == 2 / 6 and got["digit"] == 2 / 10
    assert got["upper"] == 1 / 5 and got["distinct_words"] == 4 / 6 and got["top_word"] == 3 / 6 and got["log_lines"] == np.log1p(1)


def test_odd_rows(spark):
    rows, labels = labelled(spark, 60)
    model = quality.train(documents(spark, rows), labels)
    got = quality.score(documents(spark, ODD), model, ["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(documents(spark, []), model, ["doc_id"]).count() == 0
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id bigint, quality int")
    assert quality.train(documents(spark, ODD), none) is None
    assert quality.score(documents(spark, ODD), None, ["doc_id"]).first()["score"] == 0.5
    same = spark.createDataFrame([(i, 1) for i, _ in rows] + [(0, 1)], "doc_id bigint, quality int")
    assert quality.train(documents(spark, rows), same).base > 5


def test_training_bound(spark):
    rows, labels = labelled(spark)
    seen = []
    real = quality.fit
    quality.fit = lambda x, y: seen.append(len(x)) or real(x, y)
    try:
        quality.train(documents(spark, rows), labels, rows=100)
    finally:
        quality.fit = real
    assert 60 <= seen[0] <= 140

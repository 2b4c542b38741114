import math
import random
from collections import Counter, defaultdict

import numpy as np

from tallyrack.llm import language
from tests.llm.common import ODD, documents

VOWELS = {"aa": "rastlino", "bb": "zgkeupmw"}


def sample(lang: str, seed: int, n: int = 40) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(VOWELS[lang] + "aei") for _ in range(rng.randrange(2, 7))) for _ in range(n))


class Plain:
    """The same model, symbol by symbol."""

    def __init__(self, texts):
        self.nodes = defaultdict(Counter)
        for text in texts:
            data = b"   " + text.lower().encode()
            for i in range(3, len(data)):
                for k in range(4):
                    self.nodes[data[i - k : i]][data[i]] += 1

    def bits(self, text):
        data, total = b"   " + text.lower().encode(), 0.0
        for i in range(3, len(data)):
            gone = set()
            for k in (3, 2, 1, 0):
                node = self.nodes.get(data[i - k : i])
                if node is None:
                    continue
                left = {s: c for s, c in node.items() if s not in gone}
                if left:
                    n = sum(left.values()) + len(left)
                    if data[i] in left:
                        total -= math.log2(left[data[i]] / n)
                        break
                    total -= math.log2(len(left) / n)
                gone |= set(node)
            else:
                total += math.log2(256 - len(gone))
        return total


def trained(spark):
    rows = [(i, sample(lang, i), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    return rows, language.train(documents(spark, rows + [(900, "no label", None), (901, None, "aa")]))


def test_exact_code_lengths(spark):
    rows, model = trained(spark)
    plain = [Plain([t for _, t, g in rows if g == lang]) for lang in ("aa", "bb")]
    texts = [sample("aa", 77), "Ünknown Ç bytes 123 \U0001f600", "z", sample("bb", 5, 200), ""]
    raw = [t.lower().encode() for t in texts]
    bits = model.lengths(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
    assert model.languages == ["aa", "bb"]
    assert np.allclose(bits, [[p.bits(t) for p in plain] for t in texts], rtol=1e-5)
    whole = np.frombuffer(raw[3], np.uint8)
    assert np.allclose(language._long(model, whole, 37)[0], bits[3], rtol=1e-5)


def test_held_out_accuracy_and_odd_rows(spark):
    _, model = trained(spark)
    new = [(100 + i, sample(lang, 500 + i, 25), lang) for i, lang in enumerate(["aa", "bb"] * 15)]
    rows = {r["doc_id"]: r for r in language.identify(documents(spark, new), model, ["doc_id", "lang"]).collect()}
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in rows.values())
    odd = language.identify(documents(spark, ODD + [(11, "123 ...")]), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) + 1
    for r in odd:
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 11))


def test_ties_go_to_the_smaller_name(spark):
    model = language.train(documents(spark, [(1, "same text", "b"), (2, "same text", "a")]))
    (row,) = language.identify(documents(spark, [(3, "same")]), model, ["doc_id"]).collect()
    assert row["lang_pred"] == "a" and row["score"] == 0.5


def test_nothing_to_learn_from(spark):
    model = language.train(documents(spark, []))
    assert model is None
    (row,) = language.identify(documents(spark, [(3, "same")]), model, ["doc_id"]).collect()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert language.identify(documents(spark, []), model, ["doc_id"]).count() == 0


def test_pairs_are_forgotten_when_they_become_many(spark, monkeypatch):
    _, model = trained(spark)
    texts = [b"qqxx1", b"qqxx1 new 77 pairs", b"qqxx1"]
    wide = [model.lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in texts]
    core = len(model.core[0])
    monkeypatch.setattr(language, "MOST_PAIRS", core)
    again = [model.lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for t in [*texts, b"zz9"]]
    assert np.allclose(again[:3], wide) and core < len(model.keys) < core + 10  # only the last text's pairs are kept


def test_columns_of_any_name_are_kept(spark):
    from pyspark.sql import functions as F

    docs = documents(spark, [(i, text, lang) for i, (text, lang) in enumerate([("the lamp is on", "en"), ("die Lampe ist an", "de")] * 8)])
    odd = docs.withColumn("my col", F.lit(1)).withColumn("a.b", F.lit("x")).withColumn("c`d", F.lit(2.0)).withColumn("e:f", F.array(F.lit(1)))
    packed = odd.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in odd.columns]).alias("doc"), "text")
    got = language.identify(packed, language.train(odd), ["doc"])
    assert got.select("doc.*").columns == odd.columns and got.count() == 16

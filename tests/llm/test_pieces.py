"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallyrack.llm import pieces, queries
from tests.llm.common import ODD, documents, prose

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def own():
    return pieces.pieces()


def same(own, library, texts):
    assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)


CHARACTERS = [
    " ", "  ", "▁", "a", "b", "e", "t", "th", "in", "x", "\n", "1", "2", "é", "日", "本", "\U0001f600", "\0", "=", "-", "ab", "aa",
    "The", "<s>", "</s>", "<unk>", "<0x0A>", "\t", "က", "￿", chr(0x10FFFF), "\r\n", "ß", "́",
]


@pytest.mark.parametrize("kind", ["any", "spaces", "letters", "repeats"])
def test_random_texts(own, library, kind):
    rng = random.Random(kind)
    make = {
        "any": lambda: "".join(rng.choice(CHARACTERS) for _ in range(rng.choice([0, 1, 2, 3, 5, 20, 80, 300]))),
        "spaces": lambda: " " * rng.randint(0, 200) + rng.choice(["", "a", "th", "\n"]) + " " * rng.randint(0, 60) + rng.choice(CHARACTERS),
        "letters": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([5, 20, 100, 1000]))),
        "repeats": lambda: "".join(rng.choice(["a", "b", "ab", "e", "in"]) for _ in range(rng.choice([5, 20, 100, 1000]))),
    }[kind]
    for _ in range(30):
        same(own, library, [make() for _ in range(30)])


def test_long_texts(own, library, monkeypatch):
    rng = random.Random(5)
    same(own, library, ["x" * 300_000, " " * 100_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), "é" * 5000 + " " + prose(3, 20_000)])
    monkeypatch.setattr(pieces, "CHUNK", 64)  # texts in many parts
    texts = ["".join(rng.choice(CHARACTERS) for _ in range(n)) for n in (0, 10, 200, 1000, 5000)]
    same(own, library, [*texts, "a" + " " * 1000 + "b", "x" * 1000, prose(1, 500), " " * 500])


def test_decoding_any_ids(own, library):
    rng = random.Random(2)
    ids = [[rng.choice([0, 1, 2, 3, 13, 195, 200, 229, 230, 242, 259, 260, 263, rng.randrange(32000)]) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    assert [own.decode(x) for x in ids] == [library.decode(x) for x in ids]
    with pytest.raises(ValueError):
        own.decode([own.size])


def test_an_other_kind_of_model_is_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Pieces(str(tmp_path / "other.model"))


def test_odd_rows(spark, library):
    docs = documents(spark, ODD).withColumn("ids", F.lit("clash")).withColumn("a.b c", F.lit(1))
    made = pieces.encode(docs.drop("ids"), ["doc_id", "`a.b c`"]).collect()
    want = sorted((str(i), library.encode(t or "")) for i, t, *_ in ODD)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in made) == want
    back = pieces.decode(pieces.encode(docs, ["doc_id"]), ["doc_id"]).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in back) == sorted((str(i), t or "") for i, t, *_ in ODD)
    assert pieces.round_trip(docs.limit(0), ["doc_id"]).count() == 0


def test_query_against_the_library(spark, library):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.QUERIES["op11_pieces"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(rows[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyrack.llm import ngram_join
from tallyrack.llm.common import gram_hashes, word_hashes
from tests.llm.common import ODD, documents, prose


def shingles(text):
    words = (text or "").lower().split()
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    near = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    links = {i: {j for j in sets if j != i and near(sets[i], sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        same = [j for j in sets if sets[j] and sets[j] == sets[i]] or [i]
        out[i] = (min(same), len(same), len(links[i]), min(seen))
    return out


def edited(text, rng, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def got(df):
    return {r["doc_id"]: (r["class_id"], r["class_size"], r["n_links"], r["group_id"]) for r in df.collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 7)  # several blocks in a group
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randrange(3, 90))) for i in range(60)]
    base = prose(1000, 120)
    rows += [(100 + i, edited(base, rng, rng.randrange(0, 4))) for i in range(60)]
    rows += [(200 + i, edited(base, rng, rng.randrange(3, 6))) for i in range(20)]
    rows += [(300 + i, rows[i % 5][1]) for i in range(15)]
    df = documents(spark, rows)
    assert got(ngram_join.ngram_join(df)) == brute(rows)


def test_chain_of_copies_is_one_group(spark):
    words = prose(5, 400).split()
    rows = [(i, " ".join(words[8 * i : 8 * i + 200])) for i in range(20)]
    want = brute(rows)
    assert {v[3] for v in want.values()} == {0} and max(v[2] for v in want.values()) < 19
    assert got(ngram_join.ngram_join(documents(spark, rows))) == want


def test_odd_rows(spark):
    rows = [r for r in ODD]
    found = got(ngram_join.ngram_join(documents(spark, rows)))
    plain = {i: t for i, t in rows if i is not None}
    assert found == brute(list(plain.items()))


def test_another_text_under_the_same_id(spark):
    one, two = prose(1, 80), prose(2, 80)
    kept = max([one, two], key=lambda t: ngram_join.digest(next(ngram_join.gram_sets(pa.array([t])))))
    rows = [(1, one), (1, two), (2, edited(kept, random.Random(1), 1))]
    assert got(ngram_join.ngram_join(documents(spark, rows))) == {1: (1, 1, 1, 1), 2: (2, 1, 1, 1)}


def test_no_rows(spark):
    assert ngram_join.ngram_join(documents(spark, [])).count() == 0
    assert got(ngram_join.ngram_join(documents(spark, [(1, None), (2, "")]))) == {1: (1, 1, 0, 1), 2: (2, 1, 0, 2)}


@pytest.mark.parametrize("n", [1, 5])
def test_word_hashes_tell_words_apart(n):
    texts = ["a b c d e f", "a  b\tc\nd e f", "", "ab c d e f", "f e d c b a"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(x) for x in raw])
    words, at = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offsets)
    own = [tuple(gram_hashes(words[at[i] : at[i + 1]], n)) for i in range(5)]
    assert own[0] == own[1] and own[2] == () and own[0] != own[3] and own[0] != own[4]
    assert [at[i + 1] - at[i] for i in range(5)] == [6, 6, 0, 5, 6]


def test_hash_of_a_word_is_the_same_in_long_texts():
    text = prose(9, 600_000)
    data = np.frombuffer(text.encode(), np.uint8)
    words, _ = word_hashes(data, np.array([0, len(data)]))
    names = text.split()
    assert len(words) == len(names) and len(set(zip(names, words.tolist()))) == len(Counter(names)) == len(set(words.tolist()))


def test_bands_miss_little_at_the_threshold():
    assert (1 - 0.8**ngram_join.ROWS) ** ngram_join.BANDS < 4e-7
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(60):
        both, one, two = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (80, 10, 10))
        sets = [np.unique(np.r_[both, one]), np.unique(np.r_[both, two])]
        bands = ngram_join.signatures(np.concatenate(sets), np.array([0, len(sets[0])]))
        hits += bool((bands[0] == bands[1]).any())
    assert hits == 60


def test_sets_of_a_batch():
    column = pa.array(["a b c d e f", None, "a b"])
    assert [len(s) for s in ngram_join.gram_sets(column)] == [2, 0, 1]

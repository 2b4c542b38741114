import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrack.llm import decontaminate
from tests.llm.common import ODD, documents, prose


def plain_alignment(a, b):
    """Best local score by the textbook recursion, cell by cell."""
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_is_smith_waterman(a, b):
    score, matched, first, last = decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))
    assert score == plain_alignment(a, b)
    if score:
        assert 0 <= first < last <= len(b) and 0 < matched <= last - first and b[last - 1] in a
        assert plain_alignment(a, b[first:last]) == score


ITEMS = [(i, prose(700 + i, 24)) for i in range(12)]


def bench(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def edited(text, rng, kinds):
    words = text.split()
    for k in kinds:
        at = rng.randrange(len(words))
        if k == "change":
            words[at] = "other"
        elif k == "drop":
            del words[at]
        else:
            words.insert(at, "added")
    return " ".join(words)


def brute(docs, items):
    """All pairs, whole texts: the best score of each that counts."""
    out = {}
    for i, text in docs:
        for item, wanted in items:
            a, b = wanted.lower().split(), (text or "").lower().split()
            ids = {w: k for k, w in enumerate(set(a) | set(b))}
            score, matched, _, _ = decontaminate.align(np.array([ids[w] for w in a]), np.array([ids[w] for w in b]))
            if a and score >= 0.5 * 2 * len(a) and matched >= 8:
                out[i, item] = score
    return out


def test_edited_copies_are_found_and_nothing_else(spark):
    rng = random.Random(1)
    docs = [(i, prose(i, 150)) for i in range(20)]
    for i, (item, text) in enumerate(ITEMS):
        copy = edited(text, rng, rng.choices(["change", "drop", "add"], k=i % 5))
        docs.append((100 + i, f"{prose(50 + i, 40)} {copy.upper()} {prose(90 + i, 30)}"))
        docs.append((200 + i, copy))
    docs.append((300, " ".join(t for _, t in ITEMS)))
    docs.append((301, " ".join([ITEMS[0][1]] * 30)))
    docs.append((302, prose(1, 20) + " " + " ".join(ITEMS[3][1].split()[:15])))
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(documents(spark, docs), bench(spark)).collect()}
    assert found == brute(docs, ITEMS)
    assert {(100 + i, i) for i in range(12)} <= set(found) and all(d >= 100 for d, _ in found)


def test_blocks_give_the_same(spark, monkeypatch):
    docs = documents(spark, [(i, ITEMS[i % 12][1] + " " + prose(i, 20)) for i in range(30)])
    whole = sorted(decontaminate.matches(docs, bench(spark)).collect())
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (50,))
    assert sorted(decontaminate.matches(docs, bench(spark)).collect()) == whole and whole


def test_odd_rows(spark):
    items = bench(spark, ITEMS[:3] + [(None, prose(1, 20)), (50, None), (51, ""), (52, "lamp"), (53, prose(2, 60)), (53, prose(2, 60))])
    rows = decontaminate.matches(documents(spark, ODD), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(4, 52), (5, 53), (6, 53), (10, 52)]  # one word: whole texts only
    assert all(r["share"] == 1 for r in rows)


def test_no_rows(spark):
    assert decontaminate.matches(documents(spark, ODD), bench(spark, [])).count() == 0
    assert decontaminate.matches(documents(spark, []), bench(spark)).count() == 0


def test_long_text_with_a_copy_deep_inside(spark):
    text = prose(1, 300_000) + " " + ITEMS[5][1] + " " + prose(2, 1000)
    (row,) = decontaminate.matches(documents(spark, [(1, text)]), bench(spark)).collect()
    assert (row["item_id"], row["first_word"], row["last_word"]) == (5, 300_000, 300_024)


def test_every_run_of_words_holds_a_seed():
    block = decontaminate._block([{"item_id": 1, "text": prose(4, 40)}])
    counts = {int(g): int(n) for g, n in zip(block.grams.view(np.int64), np.random.default_rng(1).integers(0, 50, len(block.grams)))}
    seed = decontaminate.seeds(block, counts)
    places = set(block.place[seed].tolist())
    assert all(places & set(range(k, k + decontaminate.WINDOW)) for k in range(38 - decontaminate.WINDOW + 1))
    assert len(places) < 38


def test_copies_edited_all_over_are_found(spark):
    """One word in three to six replaced, dropped or followed by another, also where exact copies make the intact grams common."""
    rng = random.Random(8)
    items = [(i, prose(3000 + i, rng.randrange(15, 40))) for i in range(30)]
    docs = []
    for _, text in items:
        for step in (3, 4, 5, 6):
            for kind in ("change", "drop", "add"):
                words = text.split()
                for k in range(len(words) - step + rng.randrange(step), -1, -step):
                    words[k : k + 1] = {"change": ["other"], "drop": [], "add": [words[k], "added"]}[kind]
                docs.append((len(docs), f"{prose(rng.randrange(9999), 30)} {' '.join(words)} {prose(rng.randrange(9999), 30)}"))
        docs.append((len(docs), " added ".join(text.split())))
    docs += [(len(docs) + i, text) for i, (_, text) in enumerate(items[:15])]
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.matches(documents(spark, docs), bench(spark, items)).collect()}
    wanted = brute(docs, items)
    assert found == wanted and len(wanted) > 350


def test_short_items_inside_longer_texts(spark):
    items = [(i, prose(4000 + i, n)) for i, n in enumerate([2, 3, 5, 7, 8, 9, 10])]
    words = [t.split() for _, t in items]
    around = lambda i, text: (i, f"{prose(100 + i, 30)} {' '.join(text)} {prose(200 + i, 30)}")
    docs = [around(i, w) for i, w in enumerate(words)]
    docs += [around(10, [*words[4][:3], "other", *words[4][4:]]), around(11, [*words[5][:2], "other", *words[5][3:6], "other", *words[5][7:]])]
    docs += [around(12, [*words[6][:2], "other", *words[6][3:5], "other", *words[6][6:8], "other", *words[6][9:]])]
    docs += [around(20, [*words[3][:3], "other", *words[3][4:]]), around(21, [*words[2][:2], "added", *words[2][2:]]), around(22, words[1][:2])]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(documents(spark, docs), bench(spark, items)).collect()}
    assert found == {(i, i) for i in range(7)} | {(10, 4), (11, 5), (12, 6)}

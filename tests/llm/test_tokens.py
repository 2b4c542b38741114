import random

import numpy as np

from tallyrack.llm import tokens
from tests.llm.common import ODD, documents, prose


def brute(text):
    """Section of each token by walking the characters."""
    encoding, _ = tokens.encoder(tokens.VOCABULARY)
    text = text or ""
    sections = text.split("\n")
    if len(sections) > 1 and sections[-1] == "":
        sections.pop()
    section_of, number = [], 0
    for char in text:
        section_of += [number] * len(char.encode())
        number += char == "\n"
    n, crossing, at = [0] * len(sections), [0] * len(sections), 0
    for token in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(token))
        n[section_of[at]] += 1
        crossing[section_of[at]] += section_of[at + size - 1] != section_of[at]
        at += size
    assert at == len(text.encode())
    chars = [len(s) + 1 for s in sections]
    chars[-1] = len(text) - sum(chars[:-1])
    return [(i, chars[i], n[i], crossing[i], sum(n)) for i in range(len(sections))]


def got(spark, rows):
    out = {}
    for r in tokens.count_tokens(documents(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append((r["section"], r["n_chars"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]))
    return {k: sorted(v) for k, v in out.items()}


def test_against_walking(spark):
    rng = random.Random(1)
    odd = ["\n", "\n\n\n a", "a\n", "end\n\n", " \n \n", "\U0001f600\n\U0001f9ff é\n", "<|endoftext|>\nx", "def f():\n    pass\n\n\n\n  x", "漢字\nかな"]
    rows = list(enumerate(odd)) + [(100 + i, "\n".join(prose(i + j, rng.randrange(0, 20)) for j in range(6))) for i in range(20)]
    found = got(spark, rows)
    assert found == {i: brute(t) for i, t in rows}
    assert any(c for v in found.values() for _, _, _, c, _ in v)  # some tokens do cross a boundary


def test_odd_rows(spark):
    rows = [r for r in ODD if r[0] not in (6, 8)] + [(8, "x" * 20_000)]
    assert got(spark, rows) == {i: brute(t) for i, t in rows}
    assert got(spark, [(6, "a\nb"), (6, "a\nb")]) == {6: sorted(brute("a\nb") * 2)}
    assert got(spark, []) == {}


def test_spans_cover_the_text():
    first, last = tokens.token_starts("one é two\n\U0001f600")
    assert first[0] == 0 and last[-1] == len("one é two\n\U0001f600".encode()) and np.array_equal(first[1:], last[:-1])

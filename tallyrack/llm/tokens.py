"""Token counts by section: documents are encoded whole, token spans meet section spans.

A document's sections are its lines, the line feed being the end of its line. A token belongs to
the section in which its first character lies: so a token that crosses a boundary counts once, and
the sections' counts add up to the document's. A token that begins inside a character (byte-level
vocabularies split some) belongs to that character.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyrack.llm.common import small_batches, strings, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level vocabularies of this kind cut a text before they merge: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoding and the number of bytes of each token id. ``path``: a file of base64 tokens and ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), size


def token_starts(text: str, path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Byte offset of every token's first and last + 1 byte; control strings are ordinary text."""
    encoding, size = encoder(path)
    ends = np.cumsum(size[np.asarray(encoding.encode_ordinary(text), dtype=np.int64)])
    return np.r_[0, ends[:-1]][: len(ends)], ends


def sections(data: np.ndarray) -> np.ndarray:
    """Byte offset at which each line begins; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10) + 1
    return np.r_[0, breaks[breaks < len(data)]]


def count_tokens(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per section: doc_id, section, n_chars, n_tokens, n_crossing, doc_tokens.

    ``section`` counts from 0; ``n_crossing`` counts those of its tokens that go on beyond its end;
    ``doc_tokens`` is the count of the whole document. A null or empty text is one section of
    0 tokens. Repeated rows give repeated rows; a null doc_id stays null.
    """
    small_batches(docs.sparkSession, 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            texts = strings(batch.column("text"))
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                begin = sections(data)
                end = np.r_[begin[1:], len(data)]
                first, last = token_starts(text, path)
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                # a byte inside a character stands for the character's first byte
                lead = first
                inside = np.flatnonzero((data[first] & 0xC0) == 0x80) if len(first) else []
                if len(inside):
                    starts = np.flatnonzero((data & 0xC0) != 0x80)
                    lead = first.copy()
                    lead[inside] = starts[np.searchsorted(starts, first[inside], "right") - 1]
                home = np.searchsorted(begin, lead, "right") - 1
                n = np.bincount(home, minlength=len(begin))
                crossing = np.bincount(home[last > end[home]], minlength=len(begin))
                for column, values in zip(out, (np.full(len(begin), i), np.arange(len(begin)), chars[end] - chars[begin], n, crossing, np.full(len(begin), len(first)))):
                    column.append(values)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            yield pa.record_batch(
                [batch.column("doc_id").take(pa.array(flat[0]))] + [pa.array(x.astype(np.int64)) for x in flat[1:]],
                names=["doc_id", "section", "n_chars", "n_tokens", "n_crossing", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, section bigint, n_chars bigint, n_tokens bigint, n_crossing bigint, doc_tokens bigint"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(count, schema)

"""Encoding and decoding with a SentencePiece BPE model, in vectorised merge rounds.

A batch of texts is one flat array of code points. It is cut between two characters that stand side
by side in no piece of the vocabulary (so no merge can reach across), and equal parts, here called
words, are worked on once. The symbols of all words lie in one flat array. Each round finds the
best pair of every word, merges all its occurrences from the left at the same time, and
compacts the array; a word whose pairs have no merge left drops out.

Merging one pair at a time, best first and leftmost among equals, is what defines the result. A
round does several of those steps at once, as long as a merge makes no pair that would have come
before the next occurrence; from there on the occurrences wait for the next round. Between the
symbols of a long word the test for a cut is made again as they grow, so it falls into short ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tallyrack.llm.common import small_batches, strings, text_of

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The mark that stands for a space in pieces: a fixed value.
SPACE = "▁"
_END = chr(0x10FFFF)
#: Code points that one pass of numpy holds, about, and texts: the more, the more words repeat.
CHUNK, TEXTS = 1 << 21, 1024
#: Symbols from which a word is cut again between rounds.
LONG = 64
_NONE = np.int64(1) << 40
_SHIFT = np.int64(32)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … (sizes[0] numbers), starts[1], …"""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class _Table:
    """Rows found by 64-bit keys: hash tables, each for the keys that found their slot taken in the one before."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.levels = []
        left = np.arange(len(keys))
        while len(left):
            step = _STEPS[len(self.levels)]
            shift = np.uint64(64 - max(4, int(len(left)).bit_length() + 3))
            slot = self._slot(keys[left], step, shift)
            table = np.full(1 << (64 - int(shift)), -1, dtype=np.int32)
            table[slot] = left
            self.levels.append((step, shift, table))
            left = left[table[slot] != left]

    @staticmethod
    def _slot(keys: np.ndarray, step: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * step) >> shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it is not there."""
        out = np.full(len(wanted), -1, dtype=np.int32)
        todo: np.ndarray | None = None
        for step, shift, table in self.levels:
            keys = wanted if todo is None else wanted[todo]
            row = table[self._slot(keys, step, shift)]
            right = (row >= 0) & (self.keys[row] == keys)
            if todo is None:
                out = np.where(right, row, out)
            else:
                out[todo] = np.where(right, row, -1)
            other = np.flatnonzero((row >= 0) & ~right)
            todo = other if todo is None else todo[other]
            if not len(todo):
                break
        return out


_STEPS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Pieces:
    """Tables of one model. Symbols are numbers: a piece's id, or ``unknown`` + code point for a character outside the vocabulary."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or plain.precompiled_charsmap or plain.remove_extra_whitespaces or not plain.add_dummy_prefix:
            raise ValueError(f"{path}: only BPE models that keep texts as they are, with a leading space, are known")
        if not proto.trainer_spec.byte_fallback or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError(f"{path}: only models with byte fallback and without pieces of the user are known")
        self.size = len(proto.pieces)
        normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        score = {i: p.score for i, p in enumerate(proto.pieces)}
        self.bytes_of: list[bytes] = [b""] * self.size
        self.is_byte = np.zeros(self.size, dtype=bool)
        first_byte = {}
        for i, p in enumerate(proto.pieces):
            if p.type == kind.NORMAL:
                self.bytes_of[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == kind.BYTE:
                self.bytes_of[i], self.is_byte[i] = bytes([int(p.piece[3:5], 16)]), True
                first_byte[self.bytes_of[i][0]] = i
            elif p.type == kind.UNKNOWN:
                self.bytes_of[i] = proto.trainer_spec.unk_surface.encode()
        self.byte_n = np.array([len(b) for b in self.bytes_of])
        self.byte_at = np.cumsum(self.byte_n) - self.byte_n
        self.flat_bytes = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.byte_ids = np.array([first_byte[b] for b in range(256)], dtype=np.int64)
        self.spaced = np.array([p.piece.startswith(SPACE) and p.type == kind.NORMAL for p in proto.pieces])
        # characters
        self.unknown = np.int64(self.size)
        self.symbol_of = np.arange(0x110000, dtype=np.int64) + self.unknown
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol_of[ord(p)] = i
        # characters that stand side by side in a piece: numbered, 0 for those that do so in none
        beside = {(ord(a), ord(b)) for p in normal for a, b in zip(p, p[1:])}
        known = sorted({c for pair in beside for c in pair})
        self.number_of = np.zeros(0x110000, dtype=np.int16)
        self.number_of[known] = np.arange(1, len(known) + 1)
        self.apart = np.ones((len(known) + 1,) * 2, dtype=bool)
        for a, b in beside:
            self.apart[self.number_of[a], self.number_of[b]] = False
        # merges: best score first
        ranks = {s: r for r, s in enumerate(sorted({score[i] for p, i in normal.items()}, reverse=True))}
        pairs = []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, i, ranks[score[i]]))
        pair_keys, pair_ids, pair_ranks = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        self.pair_table = _Table(pair_keys)
        self.pair_ids, self.pair_ranks = np.r_[pair_ids, -1], np.r_[pair_ranks, _NONE]
        # pieces with which a pair begins or ends that is as good as the piece itself, or better
        own = np.full(self.size, -1, dtype=np.int64)
        own[list(normal.values())] = [ranks[score[i]] for i in normal.values()]
        left, right = pair_keys >> _SHIFT, pair_keys & 0xFFFFFFFF
        self.hasty = np.zeros(self.size, dtype=bool)
        self.hasty[left[pair_ranks <= own[left]]] = True
        self.hasty[right[pair_ranks <= own[right]]] = True
        self.names = np.array([str(i) for i in range(self.size)], dtype=object)
        self._text = {i: p for p, i in normal.items()}
        self._all = "\n".join(normal)
        self._open: dict[int, bool] = {}
        # a run of spaces goes in parts of this length, if the model does so
        longest = max((len(p) for p in normal if not p.strip(SPACE)), default=1)
        run = self._words(np.full(4 * longest, ord(SPACE), dtype=np.uint32), np.array([0, 4 * longest]))[0]
        self.spaces = longest if longest > 1 and run.tolist() == [normal[SPACE * longest]] * 4 else 0

    # -- cutting

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Offsets at which words begin, but for the first."""
        number = self.number_of[points]
        apart = self.apart[number[:-1], number[1:]]
        if self.spaces:  # whole parts of a run of spaces, where one space at least is left
            space = points == ord(SPACE)
            edge = np.flatnonzero(np.diff(np.r_[False, space, False].astype(np.int8)))
            starts, sizes = edge[::2], edge[1::2] - edge[::2]
            long = sizes > self.spaces
            if long.any():
                n = (sizes[long] - 1) // self.spaces
                at = np.repeat(starts[long], n) + self.spaces * (_ranges(np.zeros(len(n), np.int64), n) + 1)
                apart[at - 1] = True
        return np.flatnonzero(apart) + 1

    def _whole(self, a: int, b: int) -> bool:
        """Whether two symbols side by side are part of some piece."""
        key = int(a) << 32 | int(b)
        if key not in self._open:
            if len(self._open) > 1 << 18:
                self._open.clear()
            self._open[key] = a in self._text and b in self._text and self._text[a] + self._text[b] in self._all
        return self._open[key]

    # -- merging

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece (-1: none) and rank of the pairs (a, b)."""
        at = self.pair_table.find(a << _SHIFT | b)
        return self.pair_ids[at], self.pair_ranks[at]

    def _words(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words (``points`` cut at ``offsets``), and how many each word has."""
        sizes = np.diff(offsets)
        symbols = self.symbol_of[points]
        at = np.arange(len(points))  # a symbol's place is that of its first character: the results are put in order by it
        last = np.zeros(len(points), dtype=bool)  # a word's last symbol
        last[offsets[1:] - 1] = True
        merged, rank = self._pairs(symbols, np.r_[symbols[1:], 0])
        rank[last] = _NONE
        long = len(sizes) > 0 and sizes.max() >= LONG
        done_at, done = [], []
        while len(symbols):
            ends = np.flatnonzero(last)
            first = np.r_[0, ends[:-1] + 1]
            best = np.minimum.reduceat(rank, first)
            ready = best == _NONE
            if ready.any():
                over = np.repeat(ready, ends + 1 - first)
                done_at.append(at[over]), done.append(symbols[over])
                stays = np.flatnonzero(~over)
                symbols, at, last, rank, merged = (x[stays] for x in (symbols, at, last, rank, merged))
                if not len(symbols):
                    break
                best, size = best[~ready], (ends + 1 - first)[~ready]
            else:
                size = ends + 1 - first
            hit = self._leftmost(np.flatnonzero(rank == np.repeat(best, size)))
            hit = self._safe(hit, symbols, merged, rank, last)
            symbols[hit] = merged[hit]
            last[hit] = last[hit + 1]
            stays = np.ones(len(symbols), dtype=bool)
            stays[hit + 1] = False
            stays = np.flatnonzero(stays)
            symbols, at, last, rank, merged = (x[stays] for x in (symbols, at, last, rank, merged))
            # the pairs that the merged symbols are part of
            new = hit - np.arange(len(hit))
            new = np.concatenate([new, new[(new > 0)] - 1])
            new = new[~last[new]]
            merged[new], rank[new] = self._pairs(symbols[new], symbols[new + 1])
            rank[last] = _NONE
            if long:
                self._cut_long(symbols, last, rank)
        flat_at = np.concatenate(done_at) if done_at else np.zeros(0, np.int64)
        flat = np.concatenate(done) if done else np.zeros(0, np.int64)
        order = np.argsort(flat_at, kind="stable")
        return flat[order], np.diff(np.r_[np.searchsorted(flat_at[order], offsets[:-1]), len(flat)])

    @staticmethod
    def _leftmost(hit: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences, those that a pass from the left takes: every second one of a chain."""
        start = np.r_[True, np.diff(hit) > 1]
        at = np.arange(len(hit))
        return hit[(at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0]

    def _safe(self, hit: np.ndarray, symbols: np.ndarray, merged: np.ndarray, rank: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The occurrences of each word up to the first merge that makes a pair as good as this one, or better."""
        new = merged[hit]
        if not self.hasty[new].any():
            return hit
        word = np.cumsum(last)[hit] - last[hit]
        goal = rank[hit]
        left = np.maximum(hit - 1, 0)
        beside = np.r_[False, (hit[1:] == hit[:-1] + 2) & (word[1:] == word[:-1])]
        has_left = (hit > 0) & ~last[left]
        before = np.where(beside, np.r_[0, new[:-1]], symbols[left])
        after = symbols[np.minimum(hit + 2, len(symbols) - 1)]
        early = (has_left & (self._pairs(before, new)[1] <= goal)) | (~last[hit + 1] & (self._pairs(new, after)[1] <= goal))
        if not early.any():
            return hit
        first = np.r_[True, word[1:] != word[:-1]]
        count = np.cumsum(early) - early  # such merges before this one
        base = np.maximum.accumulate(np.where(first, count, 0))
        return hit[count == base]

    def _cut_long(self, symbols: np.ndarray, last: np.ndarray, rank: np.ndarray) -> None:
        """End a long word between two symbols that are side by side in no piece."""
        ends = np.flatnonzero(last)
        size = np.diff(np.r_[-1, ends])
        inner = np.flatnonzero(np.repeat(size >= LONG, size) & ~last & (rank == _NONE))
        if len(inner):
            pairs, back = np.unique(symbols[inner] << _SHIFT | symbols[inner + 1], return_inverse=True)
            whole = np.array([self._whole(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in pairs])
            last[inner[~whole[back]]] = True

    # -- whole texts

    def encode_points(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all code points, and the offset in ``points`` at which each word begins with the id at which it does."""
        starts = np.r_[0, self.cuts(points)] if len(points) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[starts, len(points)])
        # equal words once: told apart as strings
        ends = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8), out=ends[1:])
        data = points.astype("<u4", copy=False).tobytes().decode("utf-32-le").encode()
        texts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.r_[ends[starts], ends[-1]].astype(np.int32).tobytes()), pa.py_buffer(data))
        coded = texts.dictionary_encode()
        kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # one example of each word
        example = np.zeros(len(coded.dictionary), dtype=np.int64)
        example[kind[::-1]] = np.arange(len(kind))[::-1]
        flat, counts = self._words(points[_ranges(starts[example], sizes[example])], np.r_[0, np.cumsum(sizes[example])])
        flat, counts = self._fall_back(flat, counts)
        begin = np.cumsum(counts) - counts
        return flat[_ranges(begin[kind], counts[kind])], np.stack([starts, np.cumsum(counts[kind]) - counts[kind]])

    def _fall_back(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(flat >= self.unknown)
        if not len(odd):
            return flat, counts
        points, back = np.unique(flat[odd] - self.unknown, return_inverse=True)
        coded = [np.frombuffer(chr(p).encode(), dtype=np.uint8) for p in points]
        n = np.array([len(c) for c in coded])
        table, begin = self.byte_ids[np.concatenate(coded)], np.cumsum(n) - n
        size = np.ones(len(flat), dtype=np.int64)
        size[odd] = n[back]
        out = np.repeat(flat, size)
        where = np.repeat(np.isin(np.arange(len(flat)), odd), size)
        out[where] = table[_ranges(begin[back], n[back])]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(owner, weights=size, minlength=len(counts)).astype(np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, the same as the sentencepiece library's. Texts go together up to ``CHUNK`` code points; a longer one is cut between words."""
        out: list[np.ndarray] = []
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text) > CHUNK:
                out += self._group(group)
                group, held = [], 0
            if len(text) > 2 * CHUNK:
                out.append(self._long_text(text))
            else:
                group.append(text)
                held += len(text) + 1
        return out + (self._group(group) if group else [])

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        # after each text a character that no piece holds: a word of its own, which falls back to four bytes
        points = np.frombuffer("".join(m + _END for m in marked).encode("utf-32-le"), dtype="<u4")
        ids, words = self.encode_points(points)
        ends = np.cumsum([len(m) + 1 for m in marked]) - 1
        at = words[1][np.searchsorted(words[0], ends)]
        return [ids[low:high] for low, high in zip(np.r_[0, at[:-1] + 4], at)]

    def _long_text(self, text: str) -> np.ndarray:
        """One long text: pieces of it that end where a word ends."""
        parts, low, window = [], 0, CHUNK
        while low < len(text):
            part = text[low : low + window].replace(" ", SPACE)
            points = np.frombuffer(((SPACE if low == 0 else "") + part).encode("utf-32-le"), dtype="<u4")
            if low + window < len(text):
                cut = self.cuts(points)
                # a run of spaces is cut by its length from its start: not inside one that began earlier
                cut = cut[points[cut - 1] != ord(SPACE)]
                if not len(cut):
                    window *= 2
                    continue
                points = points[: cut[-1]]
            parts.append(self.encode_points(points)[0])
            low += len(points) - (low == 0)
            window = CHUNK
        return np.concatenate(parts)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row of ids, whatever they are; the space that encoding puts in front goes."""
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("id beyond the vocabulary")
        # the first piece that gives text loses its leading space
        gives = np.flatnonzero(self.byte_n[ids] > 0)
        spaced = len(gives) > 0 and bool(self.spaced[ids[gives[0]]])
        raw = self.flat_bytes[_ranges(self.byte_at[ids], self.byte_n[ids])].tobytes()
        try:
            return raw[spaced:].decode()
        except UnicodeDecodeError:
            return "".join(self._lenient([self.bytes_of[i] for i in ids.tolist()], self.is_byte[ids]))[spaced:]

    @staticmethod
    def _lenient(parts: list[bytes], is_byte: np.ndarray) -> Iterator[str]:
        """Bytes that are no character give one replacement mark each."""
        k = 0
        while k < len(parts):
            if not is_byte[k]:
                yield parts[k].decode()
                k += 1
                continue
            end = k
            while end < len(parts) and is_byte[end]:
                end += 1
            run, at = b"".join(parts[k:end]), 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        yield run[at : at + n].decode()
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    yield "�"
                    at += 1
            k = end


@lru_cache(maxsize=2)
def pieces(path: str = MODEL) -> Pieces:
    return Pieces(path)


def _result(docs: DataFrame, keep: list[str], *columns: StructField) -> StructType:
    return StructType([docs.select(*keep).schema[i] for i in range(len(keep))] + list(columns))


def _numbered(docs: DataFrame, keep: list[str], value: Column) -> DataFrame:
    """The columns to keep and ``value``, under names that no column name gets in the way of."""
    return docs.select(*[F.col(name).alias(f"c{i}") for i, name in enumerate(keep)], value.alias("value"))


def encode(docs: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """``keep`` columns of every row with ``ids``, the whole text's token ids; a null or empty text has none.

    Rows are treated one by one, so repeated rows repeat. ``path`` must be readable by every executor.
    """
    small_batches(docs.sparkSession, TEXTS)
    rows = _numbered(docs, keep, text_of())
    schema = _result(docs, keep, StructField("ids", ArrayType(IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pieces(path).encode(strings(batch.column(len(keep))).to_pylist())
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], column], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """``keep`` columns of every row with ``decoded``, the text of its ``ids``; null ids count as none, as do null entries."""
    small_batches(rows.sparkSession, TEXTS)
    schema = _result(rows, keep, StructField("decoded", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [pieces(path).decode([i for i in ids or [] if i is not None]) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=schema.names)

    return _numbered(rows, keep, F.col("ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, keep: list[str], path: str = MODEL) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded and decoded in one pass, so ids don't travel."""
    small_batches(docs.sparkSession, TEXTS)
    rows = _numbered(docs, keep, text_of())
    schema = _result(docs, keep, StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pieces(path)
            all_ids = own.encode(strings(batch.column(len(keep))).to_pylist())
            n = pa.array([len(ids) for ids in all_ids], pa.int64())
            said = pa.array([hashlib.sha256(",".join(own.names[ids].tolist()).encode()).hexdigest() for ids in all_ids], pa.string())
            back = pa.array([hashlib.sha256(own.decode(ids).encode()).hexdigest() for ids in all_ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n, said, back], names=schema.names)

    return rows.mapInArrow(run, schema)

"""Byte-pair encoding of a whole corpus with numpy matrices.

Texts are split by the vocabulary's pattern; the distinct words of a batch go into matrices padded to the length of
their bucket. In each round every row merges its leftmost pair of minimum rank; rows without a pair left are finished
and taken out. The rank of a pair comes from an open-addressing hash table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before the merges (a fixed value of the public vocabulary).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Byte lengths of the matrices' buckets; the last bucket doubles on.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128, 256)
#: A longer row merges all occurrences of its minimum pair in a round where that cannot change the result.
LONG_ROW = 256
#: Words remembered by one task; beyond it the memory starts afresh.
CACHE_WORDS = 200_000
#: Characters encoded at a time, so that memory does not grow with the batch.
CHUNK_CHARS = 2_000_000
NO_PAIR = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Byte ids, and the hash table from pair (left << 32 | right) to merged id; `plain[id]`: see encode_long."""

    byte_ids: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    shift: int
    plain: np.ndarray
    tokens: tuple[bytes, ...]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of pairs, NO_PAIR where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat = key.ravel()
        out = np.full(flat.shape, NO_PAIR, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        slot = (flat * _MULTIPLIER) >> np.uint64(self.shift)
        todo = None
        while True:
            found = self.keys[slot]
            hit = found == flat
            if todo is None:
                out[hit] = self.ranks[slot[hit]]
                todo = np.arange(len(flat))
            else:
                out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != _EMPTY)
            if not go.any():
                return out.reshape(key.shape)
            todo, flat, slot = todo[go], flat[go], (slot[go] + np.uint64(1)) & mask


_EMPTY = np.uint64(2**64 - 1)


def read_ranks(path: str = DEFAULT_RANK_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def build_vocabulary(rank_file: bytes) -> Vocabulary:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
    size = max(ranks.values()) + 1
    byte_ids = np.zeros(256, np.int32)
    for b in range(256):
        byte_ids[b] = ranks[bytes([b])]
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a), right.append(b), merged.append(rank)
    left, right, merged = (np.array(x, np.int64) for x in (left, right, merged))
    bits = max(4, int(np.ceil(np.log2(len(left) * 3 + 1))))
    keys, values, shift = np.full(1 << bits, _EMPTY), np.full(1 << bits, NO_PAIR, np.int32), 64 - bits
    pair = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
    slot = (pair * _MULTIPLIER) >> np.uint64(shift)
    rest = np.arange(len(pair))
    while len(rest):  # those who meet at a slot: the first gets it, the others move on
        free = keys[slot[rest]] == _EMPTY
        takes = rest[free]
        _, first = np.unique(slot[takes], return_index=True)
        takes = takes[first]
        keys[slot[takes]], values[slot[takes]] = pair[takes], merged[takes]
        rest = np.setdiff1d(rest, takes, assume_unique=True)
        rest = rest[np.argsort(rest)]
        slot[rest] = (slot[rest] + np.uint64(1)) & np.uint64((1 << bits) - 1)
    plain = np.ones(size, bool)
    plain[left[merged < left]] = False
    plain[right[merged < right]] = False
    tokens = [b""] * size
    for token, rank in ranks.items():
        tokens[rank] = token
    return Vocabulary(byte_ids, keys, values, shift, plain, tuple(tokens))


def encode_matrix(vocabulary: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The tokens of each row of a matrix of byte ids; row i has lengths[i] of them, the rest is padding (-1)."""
    out: list[np.ndarray] = [None] * len(ids)
    rows = np.arange(len(ids))
    ids, lengths = ids.copy(), lengths.copy()
    width = ids.shape[1]
    columns = np.arange(width)
    pairs = np.full((len(ids), max(width - 1, 1)), NO_PAIR, np.int32)
    if width > 1:
        there = columns[1:][None, :] < lengths[:, None]
        pairs[there] = vocabulary.lookup(ids[:, :-1][there], ids[:, 1:][there])
    while len(rows):
        at = pairs.argmin(axis=1)
        best = pairs[np.arange(len(rows)), at]
        done = best == NO_PAIR
        if done.any():
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i, : lengths[i]].copy()
            keep = ~done
            longest = lengths[keep].max(initial=1)
            rows, at, best, lengths = rows[keep], at[keep], best[keep], lengths[keep]
            ids, pairs = ids[keep][:, :longest], pairs[keep][:, : max(longest - 1, 1)]
            if not len(rows):
                break
        n = np.arange(len(rows))
        cols = np.arange(ids.shape[1])
        ids = np.take_along_axis(ids, np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1), 1)
        cols = np.arange(pairs.shape[1])
        source = cols + (cols > at[:, None])
        pairs = np.where(source < pairs.shape[1], np.take_along_axis(pairs, np.minimum(source, pairs.shape[1] - 1), 1), NO_PAIR)
        ids[n, at] = best
        lengths = lengths - 1
        pairs[n[at >= lengths - 1], np.minimum(at, pairs.shape[1] - 1)[at >= lengths - 1]] = NO_PAIR
        has = at > 0
        pairs[n[has], at[has] - 1] = vocabulary.lookup(ids[n[has], at[has] - 1], ids[n[has], at[has]])
        has = at < lengths - 1
        pairs[n[has], at[has]] = vocabulary.lookup(ids[n[has], at[has]], ids[n[has], at[has] + 1])
    return out


def encode_long(vocabulary: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """One long row. All occurrences of the minimum pair are merged at once if the merged token is in no pair of lower
    rank (`plain`): then none of the pairs that arise could have come first. Otherwise only the leftmost."""
    ids = ids.copy()
    pairs = vocabulary.lookup(ids[:-1], ids[1:])
    while len(pairs):
        best = pairs.min()
        if best == NO_PAIR:
            break
        if not vocabulary.plain[best]:
            at = np.array([pairs.argmin()])
        else:
            at = np.flatnonzero(pairs == best)
            start = np.concatenate(([True], np.diff(at) > 1))
            run = np.arange(len(at)) - np.flatnonzero(start)[np.cumsum(start) - 1]
            at = at[run % 2 == 0]
        ids[at] = best
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))
        ids = ids[keep]
        pairs = pairs[keep[1:]] if len(ids) == len(pairs[keep[1:]]) + 1 else pairs[keep[1:]][: len(ids) - 1]
        touched = np.unique(np.concatenate((new - 1, new)))
        touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
        pairs[touched] = vocabulary.lookup(ids[touched], ids[touched + 1])
    return ids


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The tokens of each word, by length bucket."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    low = 0
    for width in BUCKETS:
        chosen = np.flatnonzero((lengths > low) & (lengths <= width))
        low = width
        for part in np.array_split(chosen, max(1, -(-len(chosen) * width // 4_000_000))):
            if len(part):
                n = lengths[part]
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width)[None, :] < n[:, None]] = vocabulary.byte_ids[
                    np.frombuffer(b"".join(words[i] for i in part), np.uint8)
                ]
                for i, tokens in zip(part, encode_matrix(vocabulary, ids, n), strict=True):
                    out[i] = tokens
    for i in np.flatnonzero(lengths > low):
        out[i] = encode_long(vocabulary, vocabulary.byte_ids[np.frombuffer(words[i], np.uint8)])
    return out


class Encoder:
    """Encodes texts, remembering the words of this task."""

    def __init__(self, rank_file: bytes):
        self.vocabulary = build_vocabulary(rank_file)
        self.split = regex.compile(WORD_PATTERN)
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        tokens = encode_words(self.vocabulary, [w.encode("utf-8", "surrogatepass") for w in new])
        lengths = np.fromiter((len(t) for t in tokens), np.int64, len(tokens))
        first = len(self.flat)
        self.starts = np.concatenate((self.starts, first + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.flat = np.concatenate((self.flat, *tokens)) if tokens else self.flat

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, and each text's number of them; null and empty texts have none."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
            self.flat, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        words: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        known, new = self.known, []
        for i, text in enumerate(texts):
            if text:
                before = len(words)
                for word in self.split.findall(text):
                    k = known.get(word)
                    if k is None:
                        k = known[word] = len(known)
                        new.append(word)
                    words.append(k)
                counts[i] = len(words) - before
        if new:
            self._learn(new)
        which = np.array(words, np.int64)
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.starts[which] - (ends - lengths), lengths) + np.arange(total)]
        sums = np.concatenate(([0], ends))
        bounds = np.cumsum(counts)
        return flat, sums[bounds] - sums[bounds - counts]


def _chunks(texts: list[str | None]) -> Iterator[slice]:
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_corpus(
    docs: DataFrame, doc_id: Column, text: Column, rank_file: bytes, counts_only: bool = False
) -> DataFrame:
    """(doc_id, ids array<int>), or (doc_id, n_tokens bigint) with counts_only, one row for each row of `docs`.

    Null and empty texts have an empty list (0 tokens); blank ones have the tokens of their spaces. Repeated rows and
    ids stay as they are; texts of any length are encoded whole; an empty table gives an empty table. No shuffle is
    needed: a row depends on nothing but its text. `rank_file` is the content of a rank file, about 1 MB, and is
    broadcast once.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(rank_file)
    kind = "n_tokens bigint" if counts_only else "ids array<int>"
    rows = docs.select(doc_id.alias("doc_id"), text.cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _chunks(texts):
                tokens, counts = encoder.encode(texts[part])
                if counts_only:
                    second = pa.array(counts, pa.int64())
                else:
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    second = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part.start : part.stop], second], ["doc_id", "n_tokens" if counts_only else "ids"]
                )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kind}")

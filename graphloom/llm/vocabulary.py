"""A byte-level BPE vocabulary as lookup tables, and pre-tokens of many texts."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from graphloom.llm.common import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before merging: contractions, words, numbers, marks, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SLICE = 3 << 19


class Table:
    """64-bit keys (never 0) to numbers, in numpy arrays with open addressing; -1 where a key is absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(len(keys) * 4 - 1).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        left = np.arange(len(keys))
        slot = mix(keys) & self.mask
        while len(left):
            free = self.keys[slot[left]] == 0
            claim = left[free]
            self.keys[slot[claim]] = keys[claim]  # of several claims on a slot, the last stands
            self.values[slot[claim]] = values[claim]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = mix(keys) & self.mask
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (there != 0)]
        return out


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1)


def merged(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain BPE with the merges of rank less than ``below``: the lowest-ranked pair first, the leftmost of these."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while True:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], below)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return parts
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


class Vocabulary:
    """bytes_of[token]; ranks; left, right: the two tokens that make a token up, or -1 for a byte; byte_token."""

    def __init__(self, ranks: dict[bytes, int]):
        n = max(ranks.values()) + 1
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * n
        for data, rank in ranks.items():
            self.bytes_of[rank] = data
        self.length = np.array([len(x) for x in self.bytes_of], np.int32)
        self.byte_token = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        keys, values = [], []
        for data, rank in ranks.items():
            if len(data) > 1:
                parts = merged(data, ranks, rank)
                if len(parts) == 2:
                    self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
            for i in range(1, len(data)):
                a, b = ranks.get(data[:i]), ranks.get(data[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.joined = dict(zip(keys, values))  # any two tokens whose bytes together are a token
        self.join = Table(np.array(keys, np.uint64) + np.uint64(1), np.array(values, np.int32))

    @functools.cached_property
    def halves(self) -> tuple[list[int], list[int]]:
        return self.left.tolist(), self.right.tolist()

    @functools.cached_property
    def trie(self) -> tuple[Table, np.ndarray]:
        """(node and byte to node, token of a node or -1); the root is 0."""
        child: dict[tuple[int, int], int] = {}
        token = [-1]
        for data, rank in self.ranks.items():
            node = 0
            for b in data:
                nxt = child.get((node, b))
                if nxt is None:
                    nxt = child[node, b] = len(token)
                    token.append(-1)
                node = nxt
            token[node] = rank
        keys = np.array([(n << 8 | b) + 1 for n, b in child], np.uint64)
        return Table(keys, np.array(list(child.values()), np.int32)), np.array(token, np.int32)


@functools.cache
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary in a file of "token in base 64, rank" lines; read once in a process."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


@functools.cache
def cutter(pattern: str = PATTERN) -> regex.Pattern:
    return regex.compile(pattern)


def pretokens(texts: pa.Array, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(offsets, ids, distinct pre-tokens): text i is cut into the pre-tokens ids[offsets[i]:offsets[i + 1]]."""
    find, number = cutter(pattern).findall, {}
    parts, lengths = [], [0]
    for text in texts.to_pylist():
        found = find(text) if text else []
        lengths.append(len(found))
        parts.append(np.fromiter((number.setdefault(x, len(number)) for x in found), np.int32, len(found)))
    return np.cumsum(lengths), np.concatenate(parts) if parts else np.zeros(0, np.int32), list(number)


def flat_bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the words, one after another."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    return np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)]), np.frombuffer(b"".join(data), np.uint8)


def gathered(offsets: np.ndarray, values: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the ragged rows ``picks`` of a ragged array, in that order."""
    lengths = np.diff(offsets)[picks]
    to = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(to[-1]) - np.repeat(to[:-1] - offsets[:-1][picks], lengths)
    return to, values[index]


Batches = Iterator[pa.RecordBatch]

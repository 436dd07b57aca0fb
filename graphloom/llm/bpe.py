"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

Of the tokens that a byte string's prefix can end with, exactly one is the last token of the prefix's encoding. The
table of these last tokens determines every prefix's encoding: follow it backwards. A token t that ends at i is the
one if and only if the prefix before t encodes to nothing, or its last token and t don't merge when put together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import col, new_name, slices
from graphloom.llm.vocabulary import PATTERN, SLICE, VOCABULARY, Batches, Vocabulary, cutter, flat_bytes, gathered, pair_key, pretokens, vocabulary

FREE = np.int64(2**40)


def compatible(a: np.ndarray, b: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Which pairs of tokens (a, b) stay two tokens when their bytes are encoded together.

    Encoding makes a and b by merges in the order of rank. The pair that touches across the border at any moment is
    found by undoing the later one of the two sides' merges; if it is a token of its own with a lower rank than the
    merge that was undone last, the border would have been merged away.
    """
    n = len(a)
    good = np.ones(n, bool)
    left, right = a.astype(np.int64), b.astype(np.int64)
    limit = np.full(n, FREE)  # ranks below it were already decided when left and right stood side by side
    live = np.arange(n)
    while len(live):
        x, y = left[live], right[live]
        joined = v.join.get(pair_key(x, y)).astype(np.int64)
        bad = (joined >= 0) & (joined < limit[live])
        good[live[bad]] = False
        live, x, y = live[~bad], x[~bad], y[~bad]
        # A merge within the left side wins a tie against the border's, one within the right side loses it.
        can_x, can_y = v.left[x] >= 0, v.left[y] >= 0
        rank_x, rank_y = np.where(can_x, x, -1), np.where(can_y, y, -1)
        undo_x = can_x & (rank_x > rank_y)
        undo_y = can_y & ~undo_x
        limit[live] = np.where(undo_x, x, y + 1)
        left[live] = np.where(undo_x, v.right[x], x)
        right[live] = np.where(undo_y, v.left[y], y)
        live = live[undo_x | undo_y]
    return good


def compatible_one(a: int, b: int, v: Vocabulary) -> bool:
    """compatible() of one pair."""
    limit = int(FREE)
    joins, (lefts, rights) = v.joined, v.halves
    while True:
        joined = joins.get(a << 32 | b)
        if joined is not None and joined < limit:
            return False
        x, y = (a if lefts[a] >= 0 else -1), (b if lefts[b] >= 0 else -1)
        if x > y:
            limit, a = x, rights[a]
        elif y >= 0:
            limit, b = y + 1, lefts[b]
        else:
            return True


def last_tokens(words: list[str], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, last): last[offsets[i] + j] is the last token of the encoding of the first j + 1 bytes of word i."""
    offsets, data = flat_bytes(words)
    n = len(data)
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    child, token = v.trie
    starts, tokens = [], []
    at, node = np.arange(n), np.zeros(n, np.int64)
    step = 0
    while len(at):  # all tokens that occur anywhere: one trie step for all starting points at once
        node = child.get((node.astype(np.uint64) << np.uint64(8) | data[at + step].astype(np.uint64)) + np.uint64(1)).astype(np.int64)
        alive = node >= 0
        at, node = at[alive], node[alive]
        found = token[node]
        whole = found >= 0
        starts.append(at[whole])
        tokens.append(found[whole])
        step += 1
        inside = at + step < owner_end[at]
        at, node = at[inside], node[inside]
    start, tok = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, tokens))
    end = start + v.length[tok] - 1
    depth = end - begin[start]
    order = np.argsort(depth, kind="stable")
    start, tok, end = start[order], tok[order], end[order]
    cuts = np.concatenate([[0], np.cumsum(np.bincount(depth))]) if len(depth) else np.zeros(1, np.int64)
    last = np.full(n, -1, np.int32)
    first = start == begin[start]
    for a, b in zip(cuts[:-1], cuts[1:]):  # prefixes by length: of all words at once
        s, t, e, f = start[a:b], tok[a:b], end[a:b], first[a:b]
        last[e[f]] = t[f]
        rest = ~f
        s, t, e = s[rest], t[rest], e[rest]
        if len(s) <= 24:  # few words are this long: arrays don't pay
            for i, x, j in zip(s.tolist(), t.tolist(), e.tolist()):
                if compatible_one(int(last[i - 1]), x, v):
                    last[j] = x
            continue
        ok = compatible(last[s - 1], t, v)
        last[e[ok]] = t[ok]
    return offsets, last


def followed(offsets: np.ndarray, last: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, tokens) of the words' encodings, read off the table from the words' ends."""
    n = len(offsets) - 1
    at, live = offsets[1:] - 1, np.arange(n)
    live = live[np.diff(offsets) > 0]
    owners, tokens = [], []
    while len(live):
        t = last[at[live]]
        owners.append(live)
        tokens.append(t)
        at[live] -= v.length[t]
        live = live[at[live] >= offsets[live]]
    if not owners:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.int32)
    owner, token = np.concatenate(owners)[::-1], np.concatenate(tokens)[::-1]
    order = np.argsort(owner, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), token[order].astype(np.int32)


def encoded(texts: pa.Array, v: Vocabulary, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, tokens) of the texts."""
    at, ids, words = pretokens(texts, pattern)
    if not len(ids):
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
    each, tokens = followed(*last_tokens(words, v), v)
    to, tokens = gathered(each, tokens, ids)
    return to[at], tokens


def decoded(tokens, v: Vocabulary) -> str:
    return b"".join([v.bytes_of[t] for t in tokens]).decode("utf-8", "replace")


def token_lists(texts: pa.Array, v: Vocabulary, pattern: str = PATTERN) -> pa.ListArray:
    """The texts' token ids; null for null."""
    at, found = encoded(texts, v, pattern)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(found.astype(np.int32)), mask=texts.is_null())


def decoded_texts(lists: pa.ListArray, v: Vocabulary) -> pa.Array:
    """decoded() of each list of tokens; null for null. Tokens become Python numbers one text at a time."""
    return pa.array((decoded(x.values.to_numpy(zero_copy_only=False).tolist(), v) if x.is_valid else None for x in lists), pa.string())


class Prefixes:
    """The table of last tokens of one byte string, that can be appended to and edited."""

    def __init__(self, v: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = v, bytearray(), []
        self.longest = int(v.length.max())
        self.append(data)

    def _token(self, i: int) -> int:
        """Last token of the first i + 1 bytes, from those of shorter prefixes."""
        for size in range(min(self.longest, i + 1), 0, -1):
            t = self.v.ranks.get(bytes(self.data[i + 1 - size : i + 1]))
            if t is not None and (size == i + 1 or compatible_one(self.last[i - size], t, self.v)):
                return t
        raise AssertionError("every byte is a token")

    def append(self, data: bytes) -> None:
        """Extend by data: what the table holds stays."""
        for b in data:
            self.data.append(b)
            self.last.append(self._token(len(self.data) - 1))

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Put data in the place of bytes start to end. Returns how many prefixes' tokens were computed.

        Prefixes before the edit stay. Behind it computing stops once as many tokens in a row as the longest token
        has bytes are what they were: the later ones depend on nothing else.
        """
        tail, old = bytes(self.data[end:]), self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(data)
        done, same = len(data), 0
        for i, b in enumerate(tail):
            if same >= self.longest:
                self.data += tail[i:]
                self.last += old[i:]
                break
            self.append(bytes([b]))
            done += 1
            same = same + 1 if self.last[-1] == old[i] and self.v.length[old[i]] <= i + 1 else 0
        return done

    def tokens(self, length: int | None = None) -> list[int]:
        """The encoding of the first ``length`` bytes, by default of all."""
        out, i = [], len(self.data) if length is None else length
        while i > 0:
            out.append(self.last[i - 1])
            i -= int(self.v.length[out[-1]])
        return out[::-1]


class TextEncoding:
    """A text's pre-tokens with their encodings, that can be appended to and edited."""

    def __init__(self, v: Vocabulary, text: str = "", pattern: str = PATTERN):
        self.v, self.cut, self.text = v, cutter(pattern), text
        self.parts = [(m.start(), m.end(), Prefixes(v, m[0].encode())) for m in self.cut.finditer(text)]

    def append(self, text: str) -> int:
        return self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> int:
        """Put text in the place of characters start to end. Returns how many pre-tokens were encoded anew.

        Cutting starts again two pre-tokens before the edit, as a cut depends on the characters after it, and ends
        where it meets an old cut behind the edit after which the text is unchanged.
        """
        shift = len(text) - (end - start)
        self.text = self.text[:start] + text + self.text[end:]
        first = next((i for i, p in enumerate(self.parts) if p[1] >= start), len(self.parts))
        first = max(0, first - 2)
        behind = {a + shift: i for i, (a, _, _) in enumerate(self.parts) if a >= end + 1}
        at, new = self.parts[first][0] if first < len(self.parts) else 0, []
        stop = len(self.parts)
        for m in self.cut.finditer(self.text, at):
            if m.start() in behind:
                stop = behind[m.start()]
                break
            new.append((m.start(), m.end(), Prefixes(self.v, m[0].encode())))
        self.parts = self.parts[:first] + new + [(a + shift, b + shift, p) for a, b, p in self.parts[stop:]]
        return len(new)

    def tokens(self) -> list[int]:
        return [t for _, _, p in self.parts for t in p.tokens()]


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """docs with the column tokens (with underscores where docs has such): the token ids of the whole text.

    A null text has null tokens, an empty one none. Rows are independent: repeated rows repeat, an empty table
    gives none, nothing is shuffled; extra columns pass through. path is a vocabulary file that every executor can
    read.
    """
    tokens = new_name(docs, "tokens")
    place = docs.columns.index(text_col)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names may clash

    def run(batches: Batches) -> Batches:
        v = vocabulary(path)
        for batch in slices(batches, f"c{place}", SLICE):
            lists = token_lists(batch.column(place), v, pattern)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "t"])

    return named.mapInArrow(run, _with(named, "t", "array<int>")).toDF(*docs.columns, tokens)


def decode(docs: DataFrame, path: str = VOCABULARY, tokens_col: str = "tokens") -> DataFrame:
    """docs with the column decoded: the text of the tokens; null for null, "" for none. Inverse of encode(). Rows are
    independent: repeated rows repeat, an empty table gives none; extra columns pass through."""
    name = new_name(docs, "decoded")
    place = docs.columns.index(tokens_col)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Batches) -> Batches:
        v = vocabulary(path)
        for batch in slices(batches, f"c{place}", SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded_texts(batch.column(place), v)], names=[*batch.schema.names, "t"])

    return named.mapInArrow(run, _with(named, "t", "string")).toDF(*docs.columns, name)


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in df.schema] + [f"{name} {kind}"])


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs).select(col("doc_id"), col("tokens"))


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, text_col: str = "text") -> DataFrame:
    """docs with the column decoded, as decode(encode(docs)) has it, by one worker a task: the tokens don't leave it."""
    name = new_name(docs, "decoded")
    place = docs.columns.index(text_col)
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])

    def run(batches: Batches) -> Batches:
        v = vocabulary(path)
        for batch in slices(batches, f"c{place}", SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded_texts(token_lists(batch.column(place), v, pattern), v)], names=[*batch.schema.names, "t"])

    return named.mapInArrow(run, _with(named, "t", "string")).toDF(*docs.columns, name)


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, encoded and decoded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs).select("doc_id", F.col("decoded").alias("text"))


EXTRA = {"bpe_round_trip": (bpe_round_trip, "SELECT doc_id, text FROM documents")}

"""Document fingerprints by randomised edit embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import hashed, mix, plain, slices, words_of
from graphloom.llm.language import normal
from graphloom.llm.links import links_by_keys
from graphloom.llm.near_dedup import comparable, emitted, first_seen, linked_by_keys
from graphloom.llm.vocabulary import gathered

#: Walks on segments whose lengths are in one class, which spans this factor, are sampled at the same steps.
GROWTH = 1.5
#: Minima that a key of a document joins.
JOINED = 3


class Walk:
    """The shared random walk: at step j a walker that stands on a character of code c mod 64 moves on if bit c of
    word j is set. places(c): for length class c the sampled steps, a row a band, drawn from the steps that walkers on
    the class's shortest segments still spend inside: on average a walker needs two steps for a character."""

    def __init__(self, bands: int, bits: int, seed: int):
        self.bands, self.bits, self.seed = bands, bits, seed
        self.words = np.zeros(0, np.uint64)
        self._places: dict[int, np.ndarray] = {}

    def up_to(self, n: int) -> np.ndarray:
        if len(self.words) < n:
            self.words = mix(np.arange(max(n, 1 << 12, 2 * len(self.words)), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(plain(self.seed)))
        return self.words

    def places(self, c: int) -> np.ndarray:
        if c not in self._places:
            self._places[c] = np.random.default_rng([self.seed, c]).integers(0, max(1, int(1.9 * GROWTH**c)), (self.bands, self.bits))
        return self._places[c]


def segments(texts: pa.Array, per_cut: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(texts' numbers of words, texts' offsets in segments, segments' offsets in characters, characters).

    Texts are taken as tokens() of near_dedup, each with a space behind it. A segment ends after a word whose hash
    is divisible by per_cut, so that an edit changes only the segments that it is in.
    """
    at, ids, words = words_of(texts)
    cleaned = normal(words)
    h = hashed(cleaned)
    filled = pc.not_equal(cleaned, "").to_numpy(zero_copy_only=False)
    keep = filled[ids] if len(ids) else np.zeros(0, bool)
    at, ids = np.concatenate([[0], np.cumsum(keep)])[at], ids[keep]
    lengths = pc.utf8_length(cleaned).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    codes = np.frombuffer("".join(w + " " for w in cleaned.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    to, codes = gathered(np.concatenate([[0], np.cumsum(lengths)]), codes, ids)
    starts = np.zeros(len(ids) + 1, bool)
    starts[at[:-1]] = True
    starts[1:] |= h[ids] % np.uint64(per_cut) == 0
    starts[-1] = False
    first = np.flatnonzero(starts)
    return np.diff(at), np.searchsorted(first, at), np.append(to[first], len(codes)), codes


def embedded(offsets: np.ndarray, codes: np.ndarray, walk: Walk) -> np.ndarray:
    """(segments, bands): a key of the characters on which a segment's walker stands at a band's sampled steps.

    Behind its segment a walker stands on an end mark. All walkers take a step at once; they are in the order of
    falling length, so that those which still have sampled steps before them are the first ones."""
    lengths = np.diff(offsets)
    n = len(lengths)
    keys = np.zeros((n, walk.bands), np.uint64)
    if not n:
        return keys
    own = np.floor(np.log(lengths) / np.log(GROWTH) + 1e-9).astype(np.int64)
    order = np.argsort(-own, kind="stable")
    sorted_own = own[order]
    used = {}
    for c in np.unique(own).tolist():
        for band, row in enumerate(walk.places(c).tolist()):
            for i, j in enumerate(row):
                used.setdefault(j, []).append((c, band, i))
    # Those of class c and longer are the first count[c] walkers.
    live_at = {c: int(np.searchsorted(-sorted_own, -c, "right")) for c in np.unique(own).tolist()}
    low_at = {c: int(np.searchsorted(-sorted_own, -c, "left")) for c in live_at}
    last_step = {c: int(walk.places(c).max()) for c in live_at}
    # Characters as places in the alphabet, 0 being the end mark, which stands behind every segment.
    present = np.zeros(int(codes.max()) + 1, bool)
    present[codes] = True
    alphabet = np.flatnonzero(present)
    place = np.cumsum(present).astype(np.uint16 if len(alphabet) < 2**16 - 1 else np.uint32)
    letters = np.zeros(len(codes) + n, place.dtype)
    inside = np.ones(len(letters), bool)
    inside[offsets[1:] - offsets[0] + np.arange(n)] = False
    letters[inside] = place[codes]
    shift = (alphabet.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
    ahead = max(1, (1 << 18) // len(alphabet))  # steps whose moves are made at once
    marks = np.append(np.uint64(0), alphabet.astype(np.uint64) + np.uint64(1))
    at = (offsets[:-1] - offsets[0] + np.arange(n))[order]
    at = at.astype(np.int32 if len(letters) < 2**31 else np.int64)
    words = walk.up_to(max(last_step.values()) + 1)
    salt = mix(np.arange(walk.bits, dtype=np.uint64) + np.uint64(0xABCDEF))
    mixed = [mix(marks + x) for x in salt]
    by_class = sorted(live_at)
    total = np.zeros((walk.bands, n), np.uint64)
    for j in range(max(last_step.values()) + 1):
        while by_class and last_step[by_class[0]] < j:
            by_class.pop(0)
        live = live_at[by_class[0]]
        p = at[:live]
        here = letters[p]
        for c, band, i in used.get(j, ()):
            a, b = low_at[c], live_at[c]
            total[band, a:b] += mixed[i][here[a:b]]
        if not j % ahead:
            moves = np.zeros((ahead, len(marks)), at.dtype)
            moves[: len(words) - j, 1:] = words[j : j + ahead, None] >> shift & np.uint64(1)
        p += moves[j % ahead][here]
    base = mix((sorted_own.astype(np.uint64) << np.uint64(8)) + np.uint64(walk.seed))
    for band in range(walk.bands):
        keys[order, band] = mix(total[band] + base + np.uint64(band))
    return keys


def document_keys(to: np.ndarray, lengths: np.ndarray, keys: np.ndarray, rows: int, seed: int, shortest: int) -> np.ndarray:
    """(documents, rows): each row joins JOINED minima, under hash orders of its own, over the keys that one band
    gives the document's segments. Segments of fewer than ``shortest`` characters, which unrelated texts share, count only in
    documents that have no longer one. Documents without segments get 0."""
    out = np.zeros((len(to) - 1, rows), np.uint64)
    some = np.flatnonzero(np.diff(to))
    if not len(some):
        return out
    long_enough = lengths >= shortest
    owner = np.repeat(np.arange(len(to) - 1), np.diff(to))
    kept = long_enough | ~(np.bincount(owner[long_enough], minlength=len(to) - 1) > 0)[owner]
    keys, begin = keys[kept], np.concatenate([[0], np.cumsum(kept)])[to[:-1][some]]
    for r in range(rows):
        of_band = np.ascontiguousarray(keys[:, r % keys.shape[1]])
        key = np.full(len(some), r + 1, np.uint64)
        for i in range(JOINED):
            least = np.minimum.reduceat(of_band * np.uint64(plain(seed * 7919 + r * JOINED + i) | 1), begin)
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[some, r] = key
    return out


def fingerprints(docs: DataFrame, rows: int = 48, bands: int = 8, bits: int = 8, shortest: int = 24, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, words, keys): each document's number of words and keys, from its whole text; no keys for one
    without words, nor for a copy of a text whose keys the same task has given. Rows with a null id or text are left
    out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, seen = Walk(bands, bits, seed), set()
        for batch in slices(batches, "text", 4 << 20):
            words, to, offsets, codes = segments(batch.column(2))
            keys = document_keys(to, np.diff(offsets), embedded(offsets, codes, walk), rows, seed, shortest)
            lists = emitted(np.full(len(keys), rows), keys.ravel(), first_seen(batch.column(1), seen) & (np.diff(to) > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), lists], names=["id", "digest", "words", "keys"])

    return comparable(docs, id_col, text_col).mapInArrow(run, "id long, digest binary, words long, keys array<long>")


def similar_by_fingerprint(docs: DataFrame, threshold: float = 0.8, rows: int = 48, bands: int = 8, bits: int = 8, shortest: int = 24, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, similarity): pairs of similar documents, doc_a < doc_b, that connect each group of them.

    Texts are cut into segments by content. Walkers on all segments draw the same random bits, so on two segments at a
    small edit distance they come to stand on the same characters at most steps: a small Hamming distance. A band
    samples some steps, and its key is the characters there. A document's fingerprint is made of minima of its
    segments' keys, and texts with an equal part of it are candidates. (One walk over a whole text would drift apart
    after some edits and meet again only after a number of steps that grows with the square of the drift.) Segments of
    fewer than ``shortest`` characters give keys only where a document has no longer one. Candidates
    count if their word edit distance is at most 1 - threshold of the longer text.
    Groups are connected as near_duplicates() does it, copies to the least of them. A null text or one
    without words is similar to none. Rows with a null id are left out; rows of one id are one document. An empty table gives no pairs. Other
    columns aren't read.
    """
    return linked_by_keys(docs, fingerprints(docs, rows, bands, bits, shortest, seed, id_col, text_col), threshold, id_col, text_col)


def links_by_fingerprint(docs: DataFrame, threshold: float = 0.8, rows: int = 48, bands: int = 8, bits: int = 8, shortest: int = 24, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_id, class_id, links), a row a document: the least document of the same text, the least of its group,
    and how many other documents are as similar as the threshold, copies included.

    Groups are those of similar_by_fingerprint(). Within one every two texts are compared, whether or not they share a
    part of the fingerprint, so no link between texts of a group is left out; they are counted without being
    listed, as a group of n texts can have n squared. A document without words has none, and itself as its class. Rows
    with a null id are left out; of an id with several texts one is taken. Other columns aren't read.
    """
    return links_by_keys(docs, fingerprints(docs, rows, bands, bits, shortest, seed, id_col, text_col), threshold, id_col, text_col)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links_by_fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))

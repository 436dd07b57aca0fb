"""Near-duplicate detection by Order MinHash and banded alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import banded_distance, col, components, drop_stored, hashed, mix, new_name, plain, slices, stored, words_of
from graphloom.llm.exact_dedup import digest_of
from graphloom.llm.language import normal
from graphloom.llm.toxicity import AROUND

TOP = np.uint64(2**64 - 1)
#: Bytes that ids sent to every executor may take there.
MOST_BROADCAST = 128 << 20
#: Counts in a text's bag.
BAG = 128


def tokens(text: str) -> list[str]:
    """A text's words as they are compared: lower case, without outer punctuation; words of punctuation alone fall out."""
    return [w for w in (x.strip(AROUND).lower() for x in text.split()) if w]


def token_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of tokens() of many texts."""
    at, ids, words = words_of(texts)
    plain_words = normal(words)
    h = hashed(plain_words)
    filled = pc.not_equal(plain_words, "").to_numpy(zero_copy_only=False)
    keep = filled[ids] if len(ids) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(keep)])
    return before[at], h[ids[keep]]


def labelled_kmers(at: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of each sequence's k-mers in the order of the text, each with the number of its earlier
    occurrences in the sequence. A sequence shorter than k has itself as its only one; an empty one has none."""
    lengths = np.diff(at)
    count = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(lengths)), count)
    first = at[:-1][owner] + np.arange(to[-1]) - to[:-1][owner]
    value = np.zeros(len(first), np.uint64)
    end = at[1:][owner]
    for i in range(k):
        inside = first + i < end
        value[inside] = mix(value[inside] * np.uint64(0x9E3779B97F4A7C15) + h[first[inside] + i] + np.uint64(i))
    own = mix(value + mix(owner.astype(np.uint64)))  # a k-mer in its sequence
    order = np.argsort(own, kind="stable")
    v = own[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])[: len(v)]
    run = np.arange(len(v)) - np.maximum.accumulate(np.where(new, np.arange(len(v)), 0)) if len(v) else np.zeros(0, int)
    occurrence = np.empty(len(v), np.uint64)
    occurrence[order] = run
    return to, mix(value + occurrence * np.uint64(0xD6E8FEB86659FD93))


def order_min_hashes(to: np.ndarray, kmers: np.ndarray, sketches: int, size: int, seed: int) -> np.ndarray:
    """(sequences, sketches): under each of the hash orders, the ``size`` least k-mers, put back into the order of the
    text and hashed together. Sequences with fewer k-mers take all; empty ones get 0."""
    count = np.diff(to)
    some = np.flatnonzero(count)
    out = np.zeros((len(count), sketches), np.uint64)
    if not len(some):
        return out
    begin, owner = to[:-1][some], np.repeat(np.arange(len(some)), count[some])
    for s in range(sketches):
        ranked = kmers * np.uint64(plain(seed * 1000 + s) | 1)
        places = np.full((len(some), size), len(kmers), np.int64)
        for i in range(size):
            least = np.minimum.reduceat(ranked, begin)
            hit = np.flatnonzero(ranked == least[owner])
            hit = hit[ranked[hit] != TOP]
            who, first = np.unique(owner[hit], return_index=True)
            places[who, i] = hit[first]
            ranked[hit[first]] = TOP
        places.sort(axis=1)
        padded = np.append(kmers, np.uint64(0))
        key = np.full(len(some), np.uint64(s + 1))
        for i in range(size):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + padded[places[:, i]])
        out[some, s] = key
    return out


def sketches_of(texts: pa.Array, k: int, size: int, sketches: int, seed: int, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, offsets, keys): each text's number of words and sketch keys; texts of fewer than ``short`` words also have those of single words."""
    at, h = token_arrays(texts)
    full = order_min_hashes(*labelled_kmers(at, h, k), sketches, size, seed)
    lengths = np.diff(at)
    few = np.flatnonzero((lengths > 0) & (lengths < short))
    lists = [row for row in full]
    if len(few):
        sub = np.concatenate([[0], np.cumsum(lengths[few])])
        inside = np.repeat(at[:-1][few] - sub[:-1], lengths[few]) + np.arange(sub[-1])
        extra = order_min_hashes(*labelled_kmers(sub, h[inside], 1), sketches, size, seed + 1)
        for i, row in zip(few, extra):
            lists[i] = np.concatenate([lists[i], row])
    for i in np.flatnonzero(lengths == 0):
        lists[i] = lists[i][:0]
    return lengths, np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.concatenate(lists) if lists else np.zeros(0, np.uint64)


def similarity(a: list, b: list, threshold: float) -> float | None:
    """1 - edit distance / length of the longer, or None if that is under the threshold."""
    longer = max(len(a), len(b))
    if not longer:
        return None
    most = int((1 - threshold) * longer + 1e-9)
    d = banded_distance(a, b, most)
    return None if d > most else 1 - d / longer


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(doc_a, doc_b, similarity) of the pairs whose texts are that similar. texts: (id, text)."""
    one = texts.select(F.col("id").alias("doc_a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("doc_b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "doc_a").join(two, "doc_b").select("doc_a", "text_a", "doc_b", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in slices(batches, "text_a", 8 << 20):
            a, ta, b, tb = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i in range(len(a)):
                both_tokens = []
                for text in (ta[i], tb[i]):
                    if text not in known:
                        if len(known) >= 200:  # only spares work
                            known.clear()
                        known[text] = tokens(text)
                    both_tokens.append(known[text])
                s = similarity(*both_tokens, threshold)
                if s is not None:
                    out.append((a[i], b[i], s))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["doc_a", "doc_b", "similarity"])

    found = both.mapInArrow(run, "doc_a long, doc_b long, similarity double")
    return found.groupBy("doc_a", "doc_b").agg(F.max("similarity").alias("similarity"))


def size_class(words, threshold: float) -> F.Column:
    """Length classes: two texts as similar as the threshold are in the same class or in adjacent ones."""
    return F.floor(F.log(words.cast("double")) / F.lit(-math.log(threshold))).cast("int")


def bags_of(texts: pa.Array) -> np.ndarray:
    """(texts, BAG): how many of a text's words fall on each remainder of their hashes, up to 2**16 - 1."""
    at, h = token_arrays(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    counts = np.bincount(owner * BAG + (h % np.uint64(BAG)).astype(np.int64), minlength=len(texts) * BAG)
    return np.minimum(counts, 2**16 - 1).astype("<u2").reshape(len(texts), BAG)


def possible(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(doc_a, doc_b) of the pairs (doc_a, doc_b, longer) whose bags don't rule the threshold out: an edit adds one word
    at most and takes one at most, so the distance is at least what either bag has over the other."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row.tobytes() for row in bags_of(batch.column(1))], pa.binary())], names=["id", "bag"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, BAG).astype(np.int32) for i in (3, 4))
            over = np.maximum(np.maximum(a - b, 0).sum(axis=1), np.maximum(b - a, 0).sum(axis=1))
            most = np.floor((1 - threshold) * batch.column(2).to_numpy(zero_copy_only=False) + 1e-9)
            yield batch.filter(pa.array(over <= most)).select([0, 1])

    named = pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("id")).distinct()
    bag = stored(texts.join(named, "id", "left_semi").mapInArrow(bags, "id long, bag binary"), "bags")
    one = bag.select(F.col("id").alias("doc_a"), F.col("bag").alias("bag_a"))
    two = bag.select(F.col("id").alias("doc_b"), F.col("bag").alias("bag_b"))
    both = pairs.join(one, "doc_a").join(two, "doc_b").select("doc_a", "doc_b", "longer", "bag_a", "bag_b")
    return both.mapInArrow(run, "doc_a long, doc_b long")


def lengths_allow(words_a: str, words_b: str, threshold: float) -> F.Column:
    """Whether two lengths alone allow the threshold: a distance is at least the difference of the lengths."""
    longer = F.greatest(words_a, words_b)
    return longer - F.least(words_a, words_b) <= F.floor((1 - threshold) * longer + 1e-9)


def untried(members: DataFrame, roots: DataFrame, tried: DataFrame, threshold: float) -> DataFrame:
    """(doc_a, doc_b, longer): all pairs that share a bucket, are not connected yet, were not compared and whose lengths
    allow the threshold."""
    part = members.join(roots, members.id == roots.node, "left").select("key", "class", "words", "id", F.coalesce("root", "id").alias("root"))
    part = stored(part, "parts")
    several = part.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    part_of = part.join(several, "key")
    one = part_of.select("key", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("class_a"), F.col("words").alias("words_a"), F.col("id").alias("a"), F.col("root").alias("root_a"))
    two = part_of.select("key", "class", F.col("words").alias("words_b"), F.col("id").alias("b"), F.col("root").alias("root_b"))
    near = one.join(two, ["key", "class"]).where("root_a <> root_b and (class_a < class or a < b)").where(lengths_allow("words_a", "words_b", threshold))
    near = near.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), F.greatest("words_a", "words_b").alias("longer")).distinct()
    rest = stored(near.join(tried, ["doc_a", "doc_b"], "left_anti"), "untried")
    drop_stored(part)
    return rest


def joined_roots(roots: DataFrame | None, edges: DataFrame) -> DataFrame:
    """(node, root) after more edges: only the old parts' roots that the new edges connect are looked at."""
    if roots is None:
        return stored(components(edges), "roots")
    one = roots.select(F.col("node").alias("doc_a"), F.col("root").alias("root_a"))
    two = roots.select(F.col("node").alias("doc_b"), F.col("root").alias("root_b"))
    ends = edges.join(one, "doc_a", "left").join(two, "doc_b", "left").select("doc_a", "doc_b", F.coalesce("root_a", "doc_a").alias("root_a"), F.coalesce("root_b", "doc_b").alias("root_b"))
    tops = components(ends, "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("top"))
    nodes = roots.union(ends.select("doc_a", "root_a")).union(ends.select("doc_b", "root_b")).distinct()
    after = stored(nodes.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
    drop_stored(roots)
    return after


def linked(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs that connect all similar documents which share a bucket. members: (key, class, words, id).

    First every member is compared with the least member of its bucket and length class. Where members of one bucket
    are still unconnected, the least members of its connected parts are compared, if their length classes are the same
    or adjacent, round by round, until every two such parts that share a bucket have been. A bucket of thousands of
    copies so costs thousands of comparisons, not millions. At last every pair that shares a bucket and is still
    unconnected is compared: each pair that isn't has ends that other pairs connect, so the groups are complete.
    Pairs whose lengths alone rule the threshold out are nowhere compared. What is returned is written; the tables made
    on the way are deleted.
    """
    least = members.groupBy("key", "class").agg(F.min("id").alias("doc_a"), F.min_by("words", "id").alias("words_a"))
    first = members.join(least, ["key", "class"]).where("id > doc_a").where(lengths_allow("words_a", "words", threshold))
    pairs = stored(first.select("doc_a", F.col("id").alias("doc_b")).distinct(), "pairs")
    rounds, edges, roots = [pairs], [], None
    while True:
        edges.append(stored(verified(pairs, texts, threshold), "edges"))
        roots = joined_roots(roots, edges[-1])
        part = members.join(roots, members.id == roots.node, "left").groupBy("key", "class", F.coalesce("root", "id").alias("root")).agg(F.min("id").alias("id"), F.min_by("words", "id").alias("words"))
        part = stored(part, "parts")
        several = part.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        part_of = stored(part.join(several, "key"), "parts")
        drop_stored(part)
        one = part_of.select("key", F.explode(F.array(F.col("class"), F.col("class") + 1)).alias("class"), F.col("class").alias("class_a"), F.col("words").alias("words_a"), F.col("id").alias("a"), F.col("root").alias("root_a"))
        two = part_of.select("key", "class", F.col("words").alias("words_b"), F.col("id").alias("b"), F.col("root").alias("root_b"))
        # Of the same class each two once, of adjacent ones the shorter class's from the left.
        near = one.join(two, ["key", "class"]).where("root_a <> root_b and (class_a < class or a < b)").where(lengths_allow("words_a", "words_b", threshold))
        near = near.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
        pairs = stored(near.join(reduce(DataFrame.union, rounds), ["doc_a", "doc_b"], "left_anti"), "pairs")
        drop_stored(part_of)
        rounds.append(pairs)
        if pairs.isEmpty():
            break
    rest = untried(members, roots, reduce(DataFrame.union, rounds), threshold)
    if not rest.isEmpty():
        last = stored(possible(rest, texts, threshold), "pairs")
        edges.append(stored(verified(last, texts, threshold), "edges"))
        rounds.append(last)
    found = stored(reduce(DataFrame.union, edges), "links")
    drop_stored(roots, rest, *rounds, *edges)
    return found


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows whose id is among ids, one a row. The ids go to every executor while they take less than
    MOST_BROADCAST bytes there, so that only texts that are looked for move; beyond that both sides are shuffled."""
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
    small = ids.count() * 32 <= MOST_BROADCAST
    return texts.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def members_of(sketched: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """(key, class, words, id) of the documents that share a bucket with another text; copies: (id, first)."""
    buckets = sketched.select(F.explode("keys").alias("key"), F.col("words").cast("int").alias("words"), "id")
    shared = buckets.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    raw = stored(buckets.join(shared, "key"), "members")
    # Only now, when few are left, the least copy takes the place of the others.
    named = raw.join(copies, "id", "left").select("key", size_class(F.col("words"), threshold).alias("class"), "words", F.coalesce("first", "id").alias("id")).distinct()
    named = stored(named, "members")
    drop_stored(raw)
    shared = named.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    members = stored(named.join(shared, "key"), "members")
    drop_stored(named)
    return members


def linked_by_keys(docs: DataFrame, sketched: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_a, doc_b, similarity) from each document's (id, digest, words, keys): copies paired with the least of
    them, the others by linked(). Of copies some may have keys and some not (first_seen())."""
    sketched = stored(sketched.where("words > 0"), "sketches")
    several = sketched.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    copies = stored(sketched.select("id", "digest").join(several, "digest").where("id > first").select("id", "first").distinct(), "copies")
    members = members_of(sketched, copies, threshold)
    drop_stored(sketched)
    ids = stored(members.select("id").distinct(), "ids")
    texts = stored(texts_of(docs, ids, id_col, text_col), "texts")
    found = linked(members, texts, threshold)
    drop_stored(members, ids, texts)
    return found.union(copies.select(F.col("first").alias("doc_a"), F.col("id").alias("doc_b"), F.lit(1.0).alias("similarity")))


def first_seen(digests: pa.Array, seen: set) -> np.ndarray:
    """Which rows have a digest that isn't in ``seen`` yet, which gets them. A task so emits a text's keys once, and
    thousands of copies make no hot buckets; a set that has grown large starts anew, which only costs work."""
    if len(seen) > 1 << 20:
        seen.clear()
    out = np.zeros(len(digests), bool)
    for i, d in enumerate(digests.to_pylist()):
        if d not in seen:
            seen.add(d)
            out[i] = True
    return out


def emitted(lengths: np.ndarray, values: np.ndarray, keep: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths over values; those not to be kept become empty."""
    at = np.concatenate([[0], np.cumsum(np.where(keep, lengths, 0))])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values[np.repeat(keep, lengths)].view(np.int64)))


def near_duplicates(docs: DataFrame, threshold: float = 0.75, k: int = 3, size: int = 3, sketches: int = 32, short: int = 32, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b, similarity): pairs of near duplicates, doc_a < doc_b, that connect each group of them.

    A sketch is the ``size`` least of a text's occurrence-labelled k-mers of words under one of ``sketches`` hash
    orders, in the order of the text. Texts of fewer than ``short`` words, where one edit
    takes a large part of the k-mers, have as many sketches of single words besides; that adds candidates and takes none.
    Texts with an equal sketch are candidates; a pair counts if alignment finds a
    word edit distance of at most 1 - threshold of the longer text. Case and outer punctuation don't count. Documents
    are in one group if such pairs connect them; copies of a text are paired with the least of them, others with
    members of their bucket (linked()), so that a group of n has about n pairs and not n squared.
    A null text or one without words is near to none, not even to its like. Rows with a null id are left out; rows of
    one id are one document. An empty table gives no pairs. Other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in slices(batches, "text"):
            words, at, keys = sketches_of(batch.column(2), k, size, sketches, seed, short)
            lists = emitted(np.diff(at), keys, first_seen(batch.column(1), seen))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words), lists], names=["id", "digest", "words", "keys"])

    rows = comparable(docs, id_col, text_col)
    return linked_by_keys(docs, rows.mapInArrow(run, "id long, digest binary, words long, keys array<long>"), threshold, id_col, text_col)


def comparable(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, text) of the rows that have both."""
    rows = docs.where(col(id_col).isNotNull() & col(text_col).isNotNull())
    return rows.select(col(id_col).cast("long").alias("id"), F.substring(digest_of(col(text_col)), 1, 16).alias("digest"), col(text_col).cast("string").alias("text"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs but for those of documents that are in a group with a lesser id; all columns stay."""
    groups = components(near_duplicates(docs, id_col=id_col, **options)).where("node <> root").select(F.col("node").alias(node := new_name(docs, "__node")))
    return docs.join(groups, col(id_col).cast("long") == F.col(node), "left_anti")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

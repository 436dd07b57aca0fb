"""All links of a similarity join, counted a document: groups by verified pairs, then every two texts of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import banded_distance, col, drop_stored, slices, stored
from graphloom.llm.near_dedup import MOST_BROADCAST, comparable, joined_roots, members_of, token_arrays

#: Counts in a text's small bag, a byte each.
BINS = 64
#: Longest text that is aligned beside others; longer ones are aligned alone, in a band.
LONGEST = 768
#: Texts and words that are held of a group at once; larger groups are cut into blocks and each two blocks compared.
BLOCK, BLOCK_WORDS = 2048, 2 << 20


def most_edits(words, threshold: float) -> np.ndarray:
    return np.floor((1 - threshold) * np.asarray(words) + 1e-9).astype(np.int64)


def small_bag(h: np.ndarray) -> np.ndarray:
    """How many words fall on each remainder of their hashes, up to 255; such a bound can only bring bags closer."""
    return np.minimum(np.bincount((h % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8)


def bags_allow(bag: np.ndarray, n, bags: np.ndarray, ns: np.ndarray, threshold: float) -> np.ndarray:
    """Which texts the lengths and bags don't keep from one text (or from as many texts): an edit adds one word at most
    and takes one at most."""
    most = most_edits(np.maximum(n, ns), threshold)
    ok = np.abs(ns - n) <= most
    at = np.flatnonzero(ok)
    if len(at):
        diff = bags[at].astype(np.int16) - (bag if bag.ndim == 1 else bag[at]).astype(np.int16)
        over = np.maximum(np.maximum(diff, 0).sum(axis=1), np.maximum(-diff, 0).sum(axis=1))
        ok[at] = over <= most[at]
    return ok


def aligned_together(codes: list[np.ndarray], a: np.ndarray, b: np.ndarray, vocabulary: int) -> np.ndarray:
    """Edit distances of the pairs (codes[a], codes[b]), all b's columns at once, by bit vectors of the a's."""
    lb = np.array([len(codes[x]) for x in b])
    order = np.argsort(-lb, kind="stable")
    a, b, lb = a[order], b[order], lb[order]
    ones, which = np.unique(a, return_inverse=True)
    la = np.array([len(codes[x]) for x in ones])
    wide = int(-(-la.max() // 64))
    # Row of the table of bits for a word of an a: looked up at once, or sought where that would take much memory.
    dense = len(ones) * vocabulary <= 4 << 20
    row = np.zeros((len(ones), vocabulary) if dense else (0, 0), np.int32)
    sought, tables = [], [np.zeros((1, wide), np.uint64)]
    begin = 1
    for i, x in enumerate(ones):
        distinct, of = np.unique(codes[x], return_inverse=True)
        bits = np.zeros((len(distinct), wide), np.uint64)
        at = np.arange(len(of))
        np.bitwise_or.at(bits, (of, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
        if dense:
            row[i, distinct] = begin + np.arange(len(distinct))
        else:
            sought.append(distinct.astype(np.int64) + i * vocabulary)
        tables.append(bits)
        begin += len(distinct)
    table = np.ascontiguousarray(np.concatenate(tables).T)
    columns = np.zeros((int(lb[0]), len(b)), np.int32)
    known = None if dense else np.concatenate(sought)
    for i, x in enumerate(b):
        if dense:
            columns[: lb[i], i] = row[which[i]][codes[x]]
        else:
            word = codes[x] + which[i] * vocabulary
            at = np.minimum(np.searchsorted(known, word), len(known) - 1)
            columns[: lb[i], i] = np.where(known[at] == word, at + 1, 0)
    full = np.uint64(2**64 - 1)
    pv, mv = np.full((wide, len(b)), full), np.zeros((wide, len(b)), np.uint64)
    last_word, last_bit = (la[which] - 1) >> 6, ((la[which] - 1) & 63).astype(np.uint64)
    score = la[which].astype(np.int64)
    live = np.searchsorted(-lb, -np.arange(1, int(lb[0]) + 1), "right")  # longer ones stand first
    one, top = np.uint64(1), np.uint64(63)
    for j in range(int(lb[0])):
        n = live[j]
        carry = ph_in = mh_in = None
        for w in range(wide):
            p, m = pv[w, :n], mv[w, :n]
            eq = table[w][columns[j, :n]]
            xv = eq | m
            both = eq & p
            total = both + p
            over = total < p
            if carry is not None:
                total += carry
                over |= total < carry
            carry = over.astype(np.uint64)
            xh = (total ^ p) | eq
            ph = m | ~(xh | p)
            mh = p & xh
            here = last_word[:n] == w
            if here.any():
                score[:n] += np.where(here, (ph >> last_bit[:n] & one).astype(np.int64) - (mh >> last_bit[:n] & one).astype(np.int64), 0)
            ph_out, mh_out = ph >> top, mh >> top
            ph = (ph << one) | (one if ph_in is None else ph_in)
            mh = mh << one if mh_in is None else (mh << one) | mh_in
            ph_in, mh_in = ph_out, mh_out
            pv[w, :n] = mh | ~(xv | ph)
            mv[w, :n] = ph & xv
    out = np.empty(len(b), np.int64)
    out[order] = score
    return out


def distances(texts: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Word edit distances of the pairs (texts[a], texts[b]); where they are over what the threshold allows, they may
    be any number over it."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    size = np.array([len(x) for x in texts])
    alone = np.maximum(size[a], size[b]) > LONGEST
    rest = np.flatnonzero(~alone)
    if len(rest) < 24:
        alone[:], rest = True, rest[:0]
    for i in np.flatnonzero(alone).tolist():
        x, y = texts[a[i]], texts[b[i]]
        out[i] = banded_distance(x.tolist(), y.tolist(), int(most_edits(max(len(x), len(y)), threshold)))
    if len(rest):
        used = np.unique(np.concatenate([a[rest], b[rest]]))
        distinct, coded = np.unique(np.concatenate([texts[i] for i in used]), return_inverse=True)
        codes: list = [None] * len(texts)
        for i, x in zip(used.tolist(), np.split(coded, np.cumsum(size[used])[:-1])):
            codes[i] = x
        rest = rest[np.lexsort((a[rest], size[a[rest]] >> 6))]
        for start in range(0, len(rest), 4096):
            part = rest[start : start + 4096]
            out[part] = aligned_together(codes, a[part], b[part], len(distinct))
    return out


def tokens_of(texts: DataFrame) -> DataFrame:
    """(id, digest, n, bag, tokens): number, small bag and hashes of each text's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            at, h = token_arrays(batch.column(2))
            each = [h[x:y] for x, y in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int32)), pa.array([small_bag(x).tobytes() for x in each], pa.binary()), pa.array([x.tobytes() for x in each], pa.binary())], names=["id", "digest", "n", "bag", "tokens"])

    return texts.mapInArrow(run, "id long, digest binary, n int, bag binary, tokens binary")


def read_bags(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def stars(ids: np.ndarray, roots: np.ndarray, ns: np.ndarray, bags: np.ndarray, threshold: float, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's members that aren't connected and that nothing rules out: all, or each member with the first
    one that it may be similar to."""
    free = np.ones(len(ids), bool)
    for i in range(len(ids) - 1):
        if not free[i]:
            continue
        later = i + 1 + np.flatnonzero((roots[i + 1 :] != roots[i]) & free[i + 1 :])
        later = later[bags_allow(bags[i], ns[i], bags[later], ns[later], threshold)]
        if not len(later):
            continue
        if not every:
            free[later] = False
            later = later[np.unique(roots[later], return_index=True)[1]]
        yield np.full(len(later), ids[i]), ids[later]


def candidates(members: DataFrame, tokens: DataFrame, roots: DataFrame | None, threshold: float, every: bool) -> DataFrame:
    """(doc_a, doc_b) of stars() in each bucket. A bucket's bags are held at once, its pairs never leave the task."""
    part = members.select("key", "id")
    if roots is None:
        part = part.withColumn("root", F.col("id"))
    else:
        part = part.join(roots, part.id == roots.node, "left").select("key", "id", F.coalesce("root", "id").alias("root"))
        several = part.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        part = part.join(several, "key")
    rows = part.join(tokens.select("id", "n", "bag"), "id").select("key", "id", "root", "n", "bag").repartition("key").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key, ids, roots, ns = (table.column(i).to_numpy() for i in range(4))
            ns, bags = ns.astype(np.int64), read_bags(table.column(4))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            two = cuts[:-1][np.diff(cuts) == 2]
            two = two[roots[two] != roots[two + 1]]
            two = two[bags_allow(bags[two], ns[two], bags[two + 1], ns[two + 1], threshold)]
            out = [(ids[two], ids[two + 1])]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if y - x > 2:
                    out += stars(ids[x:y], roots[x:y], ns[x:y], bags[x:y], threshold, every)
            one, other = (np.concatenate([p[i] for p in out]) for i in (0, 1))
            for i in range(0, len(one), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(one[i : i + (1 << 16)]), pa.array(other[i : i + (1 << 16)])], names=["doc_a", "doc_b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # where the last bucket, which may go on, begins
            if held and held[-1].column(0)[-1].as_py() != key[-1] or last:
                yield from found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from found(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "doc_a long, doc_b long").distinct()


def pairs_within(pairs: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """The pairs (doc_a, doc_b) whose texts are as similar as the threshold."""
    one = tokens.select(F.col("id").alias("doc_a"), F.col("tokens").alias("tokens_a"))
    two = tokens.select(F.col("id").alias("doc_b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(one, "doc_a").join(two, "doc_b").select("doc_a", "tokens_a", "doc_b", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "tokens_a", 8 << 20):
            texts = [np.frombuffer(x, np.uint64) for i in (1, 3) for x in batch.column(i).to_pylist()]
            n = batch.num_rows
            size = np.array([len(x) for x in texts])
            d = distances(texts, np.arange(n), np.arange(n, 2 * n), threshold)
            yield batch.select([0, 2]).filter(pa.array(d <= most_edits(np.maximum(size[:n], size[n:]), threshold)))

    return both.mapInArrow(run, "doc_a long, doc_b long").distinct()


def connected(members: DataFrame, tokens: DataFrame, threshold: float) -> DataFrame:
    """(node, root): the groups that similar texts with a common bucket form. In two rounds each member is compared with the
    first one of its bucket that it may be similar to, then every pair that is still unconnected. members: (key, id)."""
    roots, tried = None, []
    for every in (False, False, True):
        pairs = candidates(members, tokens, roots, threshold, every)
        for t in tried:
            pairs = pairs.join(t, ["doc_a", "doc_b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tried.append(pairs)
        edges = stored(pairs_within(pairs, tokens, threshold), "edges")
        roots = joined_roots(roots, edges)
        drop_stored(edges)
    drop_stored(*tried)
    return roots


class Texts:
    """Some texts of one group: ids, weights (their copies), word hashes, distances to the group's pivots."""

    def __init__(self, ids: list, weights: list, texts: list[np.ndarray], bags: np.ndarray):
        self.ids, self.weights, self.texts, self.bags = ids, np.array(weights, np.int64), texts, bags
        self.size = np.array([len(x) for x in texts], np.int64)
        self.far = np.zeros((len(ids), 0), np.int64)

    def measure(self, pivots: list[np.ndarray], threshold: float) -> None:
        """Distances to pivots. One that is over the threshold is known only as such: it then counts as very large."""
        n = len(self.ids)
        far = []
        for p in pivots:
            d = distances([*self.texts, p], np.arange(n), np.full(n, n), threshold)
            far.append(np.where(d <= most_edits(np.maximum(self.size, len(p)), threshold), d, 1 << 40))
        if far:
            self.far = np.concatenate([self.far, np.stack(far, axis=1)], axis=1)


def pivots_of(group: Texts, threshold: float, most: int = 8) -> list[np.ndarray]:
    """Texts in the middle of a group, so that most others are within half the allowed distance of one; measures them."""
    pivots: list[np.ndarray] = []
    if len(group.ids) <= 8:
        return pivots
    uncovered = np.ones(len(group.ids), bool)
    while uncovered.any() and len(pivots) < most:
        at = np.flatnonzero(uncovered)
        bags = group.bags[at].astype(np.float32)
        pivots.append(group.texts[at[np.abs(bags - bags.mean(axis=0)).sum(axis=1).argmin()]])
        group.measure(pivots[-1:], threshold)
        left = uncovered & (group.far[:, -1] > most_edits(group.size, threshold) // 2)
        if left.sum() == uncovered.sum():
            break
        uncovered = left
    return pivots


def count_links(a: Texts, b: Texts, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a the weight of those of b that it is similar to, and the other way round; for a group with
    itself in the first alone. Distances to a pivot prove most links (their sum is a bound) without alignment."""
    to_a, to_b = np.zeros(len(a.ids), np.int64), np.zeros(len(b.ids), np.int64)
    texts, shift = (a.texts, 0) if same else (a.texts + b.texts, len(a.ids))
    open_a, open_b, waiting = [], [], 0

    def settle() -> None:
        i, j = np.concatenate(open_a), np.concatenate(open_b)
        d = distances(texts, i, j + shift, threshold)
        link = d <= most_edits(np.maximum(a.size[i], b.size[j]), threshold)
        np.add.at(to_a, i[link], b.weights[j[link]])
        np.add.at(to_b, j[link], a.weights[i[link]])

    for i in range(len(a.ids)):
        first = i + 1 if same else 0
        if first >= len(b.ids):
            break
        sizes = b.size[first:]
        sure = np.zeros(len(sizes), bool)
        if a.far.shape[1]:
            sure = (b.far[first:] + a.far[i]).min(axis=1) <= most_edits(np.maximum(sizes, a.size[i]), threshold)
        links = first + np.flatnonzero(sure)
        to_a[i] += b.weights[links].sum()
        to_b[links] += a.weights[i]
        unsure = first + np.flatnonzero(~sure)
        unsure = unsure[bags_allow(a.bags[i], a.size[i], b.bags[unsure], b.size[unsure], threshold)]
        if len(unsure):
            open_a.append(np.full(len(unsure), i))
            open_b.append(unsure)
            waiting += len(unsure)
            if waiting > 1 << 18:
                settle()
                open_a, open_b, waiting = [], [], 0
    if waiting:
        settle()
    return (to_a + to_b, to_b) if same else (to_a, to_b)


def group_links(tokens: DataFrame, roots: DataFrame, weights: DataFrame, threshold: float, most: int = BLOCK) -> DataFrame:
    """(id, links): for each text of a group the weight of all texts of the group that it is similar to."""
    whole = roots.withColumnRenamed("node", "id").join(tokens, "id").join(weights, "id")
    whole = whole.select("root", "id", "copies", "bag", "tokens").repartition("root").sortWithinPartitions("root", "id")

    def texts_in(rows: list[tuple]) -> Texts:
        return Texts([r[1] for r in rows], [r[2] for r in rows], [np.frombuffer(r[4], np.uint64) for r in rows], np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, BINS))

    def batch_of(root: int, block: int | None, t: Texts, links: np.ndarray | None) -> pa.RecordBatch:
        n = len(t.ids)
        done = block is None
        columns = [
            pa.array([root] * n, pa.int64()),
            pa.array([block] * n, pa.int32()),
            pa.array(t.ids, pa.int64()),
            pa.array(t.weights),
            pa.array([None] * n if done else [x.tobytes() for x in t.bags], pa.binary()),
            pa.array([None] * n if done else [x.tobytes() for x in t.texts], pa.binary()),
            pa.array([None] * n if done else [x.tobytes() for x in t.far], pa.binary()),
            pa.array([None] * n if links is None else links, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["root", "block", "id", "copies", "bag", "tokens", "far", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, rows, words, block, pivots, last = None, [], 0, 0, [], None

        def flush(ends: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pivots
            if not rows:
                return
            t = texts_in(rows)
            if ends and not block:
                if len(t.ids) == 2:  # a group of two is a link
                    yield batch_of(root, None, t, t.weights[::-1])
                    return
                pivots_of(t, threshold)
                yield batch_of(root, None, t, count_links(t, t, True, threshold)[0])
                return
            if not block:
                pivots = pivots_of(t, threshold)
            else:
                t.measure(pivots, threshold)
            for i in range(0, len(t.ids), 256):
                part = texts_in(rows[i : i + 256])
                part.far = t.far[i : i + 256]
                yield batch_of(root, block, part, None)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if row[0] != root:
                    yield from flush(True)
                    root, rows, words, block, pivots, last = row[0], [], 0, 0, [], None
                if row[1] == last:  # rows of one id
                    continue
                last = row[1]
                if len(rows) >= most or rows and words + len(row[4]) // 8 > BLOCK_WORDS:
                    yield from flush(False)
                    rows, words, block = [], 0, block + 1
                rows.append(row)
                words += len(row[4]) // 8
        yield from flush(True)

    first = stored(whole.mapInArrow(run, "root long, block int, id long, copies long, bag binary, tokens binary, far binary, links long"), "blocks")
    several = first.where("block is not null")
    count = several.groupBy("root").agg((F.max("block") + 1).alias("blocks"))
    each = several.join(F.broadcast(count), "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "copies", "bag", "tokens", "far")
    each = each.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "block", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(key: tuple, sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
            a, b = (texts_in([(None, *r[:4]) for r in side]) if side else None for side in sides)
            for t, side in ((a, sides[0]), (b, sides[1])):
                if t:
                    t.far = np.frombuffer(b"".join(r[4] for r in side), np.int64).reshape(len(side), -1)
            found = [(a, count_links(a, a, True, threshold)[0])] if key[1] == key[2] else list(zip((a, b), count_links(a, b, False, threshold)))
            for t, links in found:
                yield pa.RecordBatch.from_arrays([pa.array(t.ids, pa.int64()), pa.array(links)], names=["id", "links"])

        key, sides = None, ([], [])
        for batch in batches:
            for root, low, high, block, *row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if (root, low, high) != key:
                    if key:
                        yield from counted(key, sides)
                    key, sides = (root, low, high), ([], [])
                sides[block != low].append(row)
        if key:
            yield from counted(key, sides)

    found = first.where("block is null").select("id", "links").union(each.mapInArrow(compare, "id long, links long"))
    found = stored(found.groupBy("id").agg(F.sum("links").alias("links")), "links")
    drop_stored(first)
    return found


def links_by_keys(docs: DataFrame, sketched: DataFrame, threshold: float, id_col: str, text_col: str, most: int = BLOCK) -> DataFrame:
    """(doc_id, text_id, class_id, links) from each document's (id, digest, words, keys), a row a document: the least
    document with the same text, the least of the group that similar texts connect, and the number of other
    documents that are as similar as the threshold, copies included."""
    sketched = stored(sketched, "sketches")
    own = sketched.where("words > 0").groupBy("id").agg(F.min("digest").alias("digest"))
    per_text = own.groupBy("digest").agg(F.min("id").alias("text_id"), F.count(F.lit(1)).alias("copies"))
    named = stored(own.join(per_text, "digest").select("id", "digest", "text_id", "copies"), "texts")
    copies = named.where("id > text_id").select("id", F.col("text_id").alias("first"))
    members = members_of(sketched, copies, threshold)
    drop_stored(sketched)
    ids = named.where("id = text_id").join(members.select("id").distinct(), "id", "left_semi").select("id")
    ids = stored(ids, "ids")
    small = ids.count() * 32 <= MOST_BROADCAST
    texts = comparable(docs, id_col, text_col).join(F.broadcast(ids) if small else ids, "id", "left_semi")
    tokens = stored(tokens_of(texts).groupBy("id").agg(F.min_by(F.struct("n", "bag", "tokens"), "digest").alias("x")).select("id", "x.*"), "tokens")
    roots = connected(members, tokens, threshold)
    links = group_links(tokens, roots, named.where("id = text_id").select("id", "copies"), threshold, most)
    drop_stored(members, tokens, ids)
    of_text = links.join(roots, links.id == roots.node).select(F.col("id").alias("text_id"), "root", "links")
    known = named.join(of_text, "text_id", "left").select("id", "text_id", F.coalesce("root", "text_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    every = docs.select(col(id_col).cast("long").alias("id")).where("id is not null").distinct()
    return every.join(known, "id", "left").select(F.col("id").alias(id_col), F.coalesce("text_id", "id").alias("text_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))

"""Community detection. Moves happen one node after the other, so each connected component is one sequential task;
components run in parallel, as no move in one depends on another."""

from __future__ import annotations

from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import Graph, named
from graphloom.storage import forget, kept_by, parts_for, written


def ids(g: Graph) -> DataFrame:
    parts = [n.frame.select("id") for n in g.nodes.values()]
    if not parts:
        return g.node_table("").select("id")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def ends(g: Graph) -> DataFrame:
    """(source, target) of all edges, as many rows as edges."""
    parts = [e.frame.select("source", "target") for e in g.edges.values()]
    if not parts:
        return g.edge_table("").select("source", "target")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def edge_rows(g: Graph, kind: str | None = None) -> int:
    """About how many edges there are: the rows of the Parquet files behind each type, which their footers tell without
    running what makes edges of them; of other tables a count."""
    total = 0
    for k, e in g.edges.items():
        if kind in (None, k):
            files = e.frame.inputFiles()
            total += (g.spark.read.parquet(*files) if files and all(f.endswith(".parquet") for f in files) else e.frame).count()
    return total


def adjacency(g: Graph) -> DataFrame:
    """(a, b): each two neighbours once in either direction, without counting parallel edges."""
    e = ends(g)
    return e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source")).distinct()


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with ``n``: its rows' places 0, 1, 2 ... in the order of key, which has no repeats. Rows are sorted by
    range; only each partition's count passes the driver."""
    part = written(df.orderBy(key).withColumn("%p", F.spark_partition_id()))
    before, total = {}, 0
    for row in part.groupBy("%p").count().orderBy("%p").collect():
        before[row["%p"]] = total
        total += row["count"]
    start = F.coalesce(*[F.when(F.col("%p") == p, F.lit(n)) for p, n in before.items()]) if len(before) == 1 else F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("%p")) if before else F.lit(0)
    return part.withColumn("n", (start + F.row_number().over(Window.partitionBy("%p").orderBy(key)) - 1).cast("long")).drop("%p")


#: Edges that a task holds at a time while it connects them.
EDGES = 2_000_000


def connected(batches):
    """Of batches of edges (a, b): (id, low), each node with the least node that the edges held here connect it with."""
    import numpy as np
    import pyarrow as pa

    def stars(parts: list):
        both = [pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1)]
        n = len(both[0])
        values = pa.concat_arrays(both).dictionary_encode()
        names = values.dictionary
        order = np.argsort(names.to_numpy(zero_copy_only=False), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        codes = rank[values.indices.to_numpy()]
        u, v = codes[:n], codes[n:]
        low = np.arange(len(order))
        while len(u):
            x, y = low[u], low[v]
            differ = x != y
            u, v, x, y = u[differ], v[differ], x[differ], y[differ]
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # roots hang under lesser ones
            while True:
                up = low[low]
                if (up == low).all():
                    break
                low = up
        ranked = names.take(pa.array(order))
        return pa.RecordBatch.from_arrays([ranked, ranked.take(pa.array(low))], names=["id", "low"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= EDGES:
            yield stars(held)
            held, rows = [], 0
    if held:
        yield stars(held)


def components(g: Graph) -> DataFrame:
    """(id, component): the least id that a node is connected with, directions aside.

    Each task first connects the edges that it holds, up to EDGES at a time. What edges of several tasks connect is
    settled among the least nodes found so: each round every node takes the least label around it, and labels jump to
    their label's label, so that the number of rounds grows with the logarithm of the longest path rather than with the
    path. Where no component's edges are in several tasks there is nothing left to settle.
    """
    kind = g.id_type.simpleString()
    own = written(ends(g).where("source <> target").mapInArrow(connected, f"id {kind}, low {kind}"))
    best = written(own.groupBy("id").agg(F.min("low").alias("low"), F.max("low").alias("high")))
    nodes = ids(g).distinct()
    first = nodes.join(best.select("id", "low"), "id", "left").select("id", F.coalesce("low", "id").alias("label"))
    if best.where("low <> high").isEmpty():
        out = written(first).withColumnRenamed("label", "component")
        forget(own)
        forget(best)
        return out
    # A node's least nodes by different tasks are connected with each other.
    split = best.where("low <> high").select("id", F.col("low").alias("a"))
    links = split.join(own, "id").where("a <> low").select("a", F.col("low").alias("b"))
    near = written(links.union(links.select("b", "a")).distinct())
    roots = settled(near, near.select(F.col("a").alias("id")).distinct())
    first = written(first)
    up = roots.select(F.col("id").alias("up"), F.col("label").alias("above"))
    out = written(first.join(up, first.label == F.col("up"), "left").select("id", F.coalesce("above", "label").alias("component")))
    for df in (own, best, first, near):
        forget(df)
    return out


def settled(near: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, label): the least node that each is connected with by ``near``, edges (a, b) in either direction."""
    now = written(nodes.select("id", F.col("id").alias("label")))
    near = kept_by(near, "b", parts_for(near.sparkSession, near.count()))
    while True:
        around = near.join(now, near.b == now.id).groupBy("a").agg(F.min("label").alias("m"))
        hooked = now.join(around, now.id == around.a, "left").select("id", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("was"))
        # A root that a member saw a lesser label from follows it.
        pull = hooked.where("label < was").groupBy("was").agg(F.min("label").alias("lower")).withColumnRenamed("was", "root")
        hooked = hooked.join(pull, F.col("id") == F.col("root"), "left").select("id", F.least("label", F.coalesce("lower", "label")).alias("label"), "was")
        up = hooked.select(F.col("id").alias("up"), F.col("label").alias("above"))
        jumped = hooked.join(up, F.col("label") == F.col("up"), "left").select("id", F.least("label", F.coalesce("above", "label")).alias("label"), "was")
        after = written(jumped)
        changed = not after.where("label <> was").isEmpty()
        forget(now)
        now = after.select("id", "label")
        now.written_at = after.written_at
        if not changed:
            near.unpersist()
            return now


def louvain(nodes: list, near: dict, whole: float, most: int, least_gain: float, resolution: float) -> dict:
    """One level of modularity moves. ``whole``: twice the number of undirected edges of the whole graph."""
    home = {v: v for v in nodes}
    degree = {v: float(len(near[v])) for v in nodes}
    weight = dict(degree)
    for _ in range(most):
        moved = False
        for v in nodes:
            mine, k = home[v], degree[v]
            links = Counter(home[u] for u in near[v])
            best, gain = mine, 0.0
            for c in sorted(links):
                if c == mine:
                    continue
                d = (links[c] - links[mine]) / whole - resolution * (weight[c] - weight[mine] + k) * k / whole**2
                if d > gain:
                    best, gain = c, d
            if gain > least_gain:
                weight[mine] -= k
                weight[best] += k
                home[v] = best
                moved = True
        if not moved:
            break
    return home


def leiden_partition(nodes: list, near: dict, gamma: float, most: int, least_gain: float) -> dict:
    """Constant-Potts moves to a fixpoint, then refinement of each community, in turn until neither changes."""
    home = {v: i for i, v in enumerate(nodes)}
    size = Counter(home.values())
    fresh = len(nodes)

    def move_all() -> bool:
        ever = False
        while True:
            moved = False
            for v in nodes:
                mine = home[v]
                links = Counter(home[u] for u in near[v] if u != v)
                best, gain = mine, least_gain
                for c in sorted(c for c in links if c != mine):
                    d = links[c] - links[mine] + gamma * (size[mine] - 1 - size[c])
                    if d > gain:
                        best, gain = c, d
                if best != mine:
                    size[mine] -= 1
                    size[best] += 1
                    home[v] = best
                    moved = ever = True
            if not moved:
                return ever

    def refine() -> bool:
        nonlocal fresh
        groups = defaultdict(list)
        for v in nodes:
            groups[home[v]].append(v)
        changed = False
        for base in sorted(groups):
            group = groups[base]
            n = len(group)
            if n < 2:
                continue
            inside = {v: [u for u in near[v] if home[u] == base and u != v] for v in group}
            part = {v: fresh + i for i, v in enumerate(group)}
            fresh += n
            count = {c: 1 for c in part.values()}
            outer = {part[v]: float(len(inside[v])) for v in group}
            inner = dict.fromkeys(count, 0.0)
            for v in group:
                own = part[v]
                if count[own] != 1 or len(inside[v]) < gamma * (n - 1):
                    continue
                links = Counter(part[u] for u in inside[v])
                best, gain = None, 0.0
                for c in sorted(c for c in links if c != own):
                    if outer[c] - 2 * inner[c] < gamma * count[c] * (n - count[c]):
                        continue
                    d = links[c] - gamma * count[c]
                    if d > gain:
                        best, gain = c, d
                if best is not None:
                    part[v] = best
                    count[best] += 1
                    count[own] -= 1
                    outer[best] += len(inside[v])
                    outer[own] -= len(inside[v])
                    inner[best] += links[best]
            parts = sorted(set(part.values()))
            if len(parts) == 1:
                continue
            changed = True
            if len(parts) == n:
                name = part
            else:
                new = {c: base if i == 0 else fresh + i - 1 for i, c in enumerate(parts)}
                fresh += len(parts) - 1
                name = {v: new[part[v]] for v in group}
            for v in group:
                size[home[v]] -= 1
                home[v] = name[v]
                size[home[v]] += 1
        return changed

    for _ in range(most):
        a = move_all()
        b = refine()
        if not a and not b:
            break
    return home


def by_component(g: Graph, partition, whole: bool) -> DataFrame:
    """(id, community): communities are numbered by their least node."""
    near = written(adjacency(g))
    total = float(near.count()) if whole else 0.0
    roots = components(g)
    kind = roots.schema["id"].dataType.simpleString()
    lists = roots.join(near.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near")), roots.id == F.col("a"), "left").select("id", "component", "near")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        nodes = pdf["id"].tolist()
        around = {v: list(x) if x is not None else [] for v, x in zip(nodes, pdf["near"])}
        home = partition(nodes, around, total)
        least: dict = {}
        for v in nodes:
            least.setdefault(home[v], v)
        return pd.DataFrame({"id": nodes, "first": [least[home[v]] for v in nodes]})

    found = written(lists.groupBy("component").applyInPandas(run, f"id {kind}, first {kind}"))
    number = numbered(found.select("first").distinct(), "first").select(F.col("first").alias("f"), F.col("n").alias("community"))
    out = found.join(number, found["first"] == number.f).select("id", "community")
    forget(near)
    return out


def community(g: Graph, most: int = 100, least_gain: float = 1e-4, resolution: float = 1.0) -> DataFrame:
    """Single-level Louvain: nodes move in the order of id to the neighbouring community of the highest gain."""
    return by_component(g, lambda nodes, near, m: louvain(nodes, near, m, most, least_gain, resolution) if m else {v: v for v in nodes}, True)


def leiden(g: Graph, gamma: float = 0.1, most: int = 10, least_gain: float = 1e-9) -> DataFrame:
    return by_component(g, lambda nodes, near, _: leiden_partition(nodes, near, gamma, most, least_gain), False)


#: Edges, in either direction, of the nodes that are together in label propagation.
GROUP = 500_000


def packed(values) -> bytes:
    """Numbers of 64 bits with their first bytes first: sorted ones shrink so where they are compressed."""
    return values.view("uint8").reshape(-1, 8).T.tobytes()


def unpacked(data: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def sent(pairs, groups: int):
    """(group, packed pairs) of pairs node * 2 ** 32 + value: the group is a hash of the node."""
    import numpy as np
    import pyarrow as pa

    group = ((pairs >> 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % groups
    order = np.lexsort((pairs, group))
    pairs, group = pairs[order], group[order]
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() if len(pairs) else []
    rows = [(int(group[x]), packed(pairs[x:y])) for x, y in zip(cuts, [*cuts[1:], len(pairs)])]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["g", "pairs"])


def gathered(batches):
    """(group, all its pairs) of rows in the order of their group."""
    import numpy as np

    now, held = None, []
    for batch in batches:
        for group, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if group != now and held:
                yield now, np.concatenate(held)
                held = []
            now = group
            held.append(unpacked(data.as_buffer()))
    if held:
        yield now, np.concatenate(held)


def majority(votes):
    """Of votes node * 2 ** 32 + label each node's most frequent, of equal ones that of the least label."""
    import numpy as np

    votes.sort()
    first = np.flatnonzero(np.append(True, votes[1:] != votes[:-1]))
    count = np.diff(np.append(first, len(votes)))
    votes = votes[first]
    node = votes >> 32
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    most = np.repeat(np.maximum.reduceat(count, begin), np.diff(np.append(begin, len(votes))))
    top = votes[count == most]
    return top[np.append(True, top[1:] >> 32 != top[:-1] >> 32)]


def propagated(e: DataFrame, rows: int, rounds: int) -> DataFrame:
    """(id, label) of the nodes that have an edge to another, of edges (x, y) between numbers under 2 ** 31: a label is
    a node's own number at first, then ``rounds`` times what most neighbours have, of equal ones the least.

    Nodes are in groups by their hash; a group's edges stay where they are, and its labels are what its votes give. A
    round moves a neighbour and a label an edge and direction, by groups and packed, and counts a group at a time.
    """
    import numpy as np
    import pyarrow as pa

    groups = max(1, 2 * rows // GROUP)
    n = max(parts_for(e.sparkSession, 0), groups // 2)
    kind = "g long, pairs binary"

    def both_ways(batches):
        held, size = [], 0
        for b in batches:
            x, y = (b.column(i).to_numpy() for i in (0, 1))
            held += [x << 32 | y, y << 32 | x]
            size += 2 * len(x)
            if size > EDGES:
                yield sent(np.concatenate(held), groups)
                held, size = [], 0
        if held:
            yield sent(np.concatenate(held), groups)

    def distinct(batches):
        for group, pairs in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([packed(np.unique(pairs))], pa.binary())], names=["g", "pairs"])

    def vote(batches):
        for b in batches:
            for i in range(b.num_rows):
                pairs = unpacked(b.column(0)[i].as_buffer())
                label = node = pairs >> 32
                if b.num_columns > 1:
                    known = unpacked(b.column(1)[i].as_buffer())
                    label = (known & (2**32 - 1))[np.searchsorted(known >> 32, node)]
                yield sent((pairs & (2**32 - 1)) << 32 | label, groups)

    def count(batches):
        for group, votes in gathered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([group]), pa.array([packed(majority(votes))], pa.binary())], names=["g", "labels"])

    def rows_of(batches):
        for b in batches:
            for data in b.column(0):
                known = unpacked(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(known >> 32), pa.array(known & (2**32 - 1))], names=["id", "label"])

    near = e.mapInArrow(both_ways, kind).repartition(n, "g").sortWithinPartitions("g").mapInArrow(distinct, kind)
    # The number of a task's rows is small, so they are put in their partitions once more, by Spark's own account of them.
    near = written(near).repartition(n, "g").persist()
    now = None
    for _ in range(rounds):
        votes = (near.select("pairs") if now is None else near.join(now.hint("shuffle_hash"), "g").select("pairs", "labels")).mapInArrow(vote, kind)
        after = written(votes.repartition(n, "g").sortWithinPartitions("g").mapInArrow(count, "g long, labels binary"))
        forget(now)
        now = after
    near.unpersist()
    return now.select("labels").mapInArrow(rows_of, "id long, label long")


def community_fast(g: Graph, rounds: int = 3) -> DataFrame:
    """(id, community): rounds of synchronous label propagation; the majority's label, of equal ones the lowest.

    Labels are places in the order of id, or ids themselves where they are numbers that have that order and fit.
    """
    nodes = ids(g).distinct()
    e = ends(g).where("source <> target").toDF("x", "y")
    order = None
    if g.id_type.simpleString() in ("bigint", "int"):
        low, high = nodes.agg(F.min("id"), F.max("id")).first()
    else:
        low, high = -1, -1
    if low is not None and (low < 0 or high >= 1 << 31):
        order = written(numbered(nodes, "id"))
        if order.count() >= 1 << 31:
            raise ValueError("more than 2 ** 31 nodes")
        e = e.join(order.toDF("x", "s"), "x").join(order.toDF("y", "t"), "y").select(F.col("s").alias("x"), F.col("t").alias("y"))
    else:
        e = e.join(nodes, e.x == nodes.id, "left_semi").join(nodes, e.y == nodes.id, "left_semi") if not all(k.from_label and k.to_label for k in g.edges.values()) else e
    own = order if order is not None else nodes.withColumn("n", F.col("id").cast("long"))
    found = propagated(e.select(F.col("x").cast("long"), F.col("y").cast("long")), edge_rows(g), rounds).toDF("found", "label")
    now = written(own.join(found, own.n == F.col("found"), "left").select(own.id, F.coalesce("label", "n").alias("label")))
    number = numbered(now.select("label").distinct(), "label").select(F.col("label").alias("l"), F.col("n").alias("community"))
    return now.join(number, now.label == number.l).select("id", "community")


def modularity(g: Graph, partition: DataFrame) -> float:
    """Of a partition (id, community): the share of edges inside minus what degrees alone would give, on the
    deduplicated undirected graph."""
    near = adjacency(g).where("a <> b")
    p = partition.select("id", named(partition.columns[1]).alias("c"))
    full = near.join(p.toDF("a", "ca"), "a").join(p.toDF("b", "cb"), "b")
    row = full.groupBy("ca").agg(F.sum((F.col("ca") == F.col("cb")).cast("long")).alias("inside"), F.count(F.lit(1)).alias("degree")).agg(F.sum("inside").alias("inside"), F.sum("degree").alias("m2"), F.sum(F.col("degree").cast("double") ** 2).alias("squares")).first()
    return row["inside"] / row["m2"] - row["squares"] / row["m2"] ** 2 if row["m2"] else 0.0

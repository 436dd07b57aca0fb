"""Graph algorithms as (id, value) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import Graph
from graphloom.operators.community import adjacency, community, community_fast, edge_rows, ends, ids, leiden
from graphloom.storage import forget, parts_for, written


def degree(g: Graph, direction: str = "both", normalised: bool = False) -> DataFrame:
    """(id, degree): edges at a node, parallel ones counted, a loop twice; normalised by the other nodes' number."""
    e = ends(g)
    parts = {"out": e.select(F.col("source").alias("id")), "in": e.select(F.col("target").alias("id"))}
    rows = parts["out"].union(parts["in"]) if direction == "both" else parts[direction]
    counts = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    out = ids(g).join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("double").alias("degree"))
    if normalised:
        n = max(1, ids(g).count() - 1)
        out = out.withColumn("degree", F.col("degree") / n)
    return out


def degree_stats(g: Graph) -> DataFrame:
    d = degree(g)
    return d.agg(F.min("degree").alias("min"), F.max("degree").alias("max"), F.avg("degree").alias("mean"), F.median("degree").alias("median"), (F.sum("degree") / 2).cast("long").alias("total_edges"))


def pagerank(g: Graph, damping: float = 0.85, most: int = 100, tolerance: float = 1e-6, start: DataFrame | None = None) -> DataFrame:
    """(id, pagerank) until the change in sum is under ``tolerance``. What ends in a node without edges is lost.

    start: ids to return to (personalised). Edges stay partitioned by source in a cache that spills and can be
    recomputed; a round shuffles ranks and one sum a target, and writes the ranks.
    """
    e = ends(g).repartition(parts_for(g.spark, edge_rows(g)), "source")
    times = e.groupBy("source", "target").agg(F.count(F.lit(1)).alias("times"))
    out = F.sum("times").over(Window.partitionBy("source"))
    links = times.select("source", "target", (F.col("times") / out).alias("share")).sortWithinPartitions("source").persist()
    base = ids(g).distinct()
    n = base.count()
    if not n:
        return base.select("id", F.lit(0.0).alias("pagerank"))
    if start is None:
        own = base.select("id", F.lit(1.0 / n).alias("own"))
    else:
        seeds = start.select(F.col(start.columns[0]).alias("id")).distinct().join(base, "id", "left_semi")
        m = max(1, seeds.count())
        own = base.join(seeds.withColumn("s", F.lit(1.0 / m)), "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("own"))
    own = written(own)
    now = own.select("id", F.col("own").alias("rank"))
    previous = None
    for _ in range(most):
        came = links.join(now, links.source == now.id).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("sum"))
        new = own.join(came, own.id == came.target, "left").select("id", (F.lit(1 - damping) * F.col("own") + F.lit(damping) * F.coalesce("sum", F.lit(0.0))).alias("rank"))
        after = written(new if not tolerance else new.join(now.withColumnRenamed("rank", "was"), "id"))
        forget(previous)
        now, previous = after.select("id", "rank"), after
        if tolerance and after.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] < tolerance:
            break
    links.unpersist()
    return now.withColumnRenamed("rank", "pagerank")


def upward(g: Graph) -> tuple[DataFrame, list[tuple[int, int]]]:
    """((u, out), pairs): each node's greater neighbours as an array of (c, v), c being the neighbour's class, and the
    classes (of u's neighbours v and w) whose nodes can be linked, v not after w.

    Any order of the nodes gives the same triangles; this one bounds the pairs of neighbours. Hubs, the nodes of more
    edges than sqrt(2 * edges), of which there can't be more than that, come last, by their edges; others by their
    label, those with fewer edges a node first. So no node has more greater neighbours than about sqrt(2 * edges). A
    class is a label, where the edges' types declare one, hubs apart. Edges move once.
    """
    rows = edge_rows(g)
    declared = all(e.from_label and e.to_label for e in g.edges.values())
    sides: dict[str, int] = {}
    linked = set()
    if declared:
        for e in g.edges.values():
            n = e.frame.count()
            for x in (e.from_label, e.to_label):
                sides[x] = sides.get(x, 0) + n
            linked |= {(e.from_label, e.to_label), (e.to_label, e.from_label)}
        size = {x: max(1, g.nodes[x].frame.count()) if x in g.nodes else 1 for x in sides}
        names = sorted(sides, key=lambda x: (sides[x] / size[x], x))
    else:
        names, linked = [""], {("", "")}
    place = {x: i for i, x in enumerate(names)}
    parts = [e.frame.select("source", "target", F.lit(place[e.from_label if declared else ""]).alias("cs"), F.lit(place[e.to_label if declared else ""]).alias("ct")) for e in g.edges.values()]
    table = g.edge_table("").select("source", "target", F.lit(0).alias("cs"), F.lit(0).alias("ct")) if not parts else parts[0]
    for p in parts[1:]:
        table = table.union(p)
    table = table.where("source <> target")
    # Edges are counted with their parallel ones: an order needs no exact degrees.
    many = table.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    hubs = written(many.where(F.col("d") > max(64.0, (2.0 * rows) ** 0.5)))
    n = len(names)
    if hubs.isEmpty():
        table = table.withColumns({"ds": F.lit(0), "dt": F.lit(0)})
    else:
        table = table.join(F.broadcast(hubs.toDF("source", "ds")), "source", "left").join(F.broadcast(hubs.toDF("target", "dt")), "target", "left")
        table = table.withColumns({x: F.when(F.col(d).isNotNull(), F.col(x) + n).otherwise(F.col(x)) for x, d in (("cs", "ds"), ("ct", "dt"))})
        table = table.fillna(0, ["ds", "dt"])
    # Hubs are after all others, whatever their label, by their edges.
    late = lambda c: F.when(F.col(c) >= n, F.lit(n)).otherwise(F.col(c))
    first = F.struct(late("cs"), F.col("ds").alias("d"), F.col("source").alias("id")) < F.struct(late("ct"), F.col("dt").alias("d"), F.col("target").alias("id"))
    up = table.select(F.when(first, F.col("source")).otherwise(F.col("target")).alias("u"), F.when(first, F.col("ct")).otherwise(F.col("cs")).alias("c"), F.when(first, F.col("target")).otherwise(F.col("source")).alias("v"))
    up = up.repartition(parts_for(g.spark, rows), "u").distinct()
    lists = written(up.groupBy("u").agg(F.collect_list(F.struct("c", "v")).alias("out")))
    pairs = [(i, j) for i in range(2 * n) for j in range(2 * n) if min(i, n) <= min(j, n) and (names[i % n], names[j % n]) in linked]
    if hubs.isEmpty():
        pairs = [(i, j) for i, j in pairs if max(i, j) < n]
    forget(hubs)
    return lists, pairs


def closed(lists: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(id, n) parts of the triangles' counts: each u sends the neighbours that can close a triangle to each v among its
    own, where they are compared with v's; so a message an edge moves instead of a row a pair of neighbours."""
    messages = []
    for i in sorted({i for i, _ in pairs}):
        others = [j for a, j in pairs if a == i]
        pick = lambda x, some: F.transform(F.filter(x, lambda y: y["c"].isin(some)), lambda y: y["v"])
        messages.append(F.struct(pick("out", [i]).alias("vs"), pick("out", others).alias("ws")))
    if not messages:
        return lists.select(F.col("u").alias("id"), F.lit(0).cast("long").alias("n")).limit(0)
    each = lists.select("u", F.explode(F.array(*messages)).alias("m")).where("size(m.vs) > 0 and size(m.ws) > 0")
    sent = each.select("u", "m.ws", F.explode("m.vs").alias("v"))
    own = lists.select(F.col("u").alias("v"), F.transform("out", lambda y: y["v"]).alias("out"))
    met = sent.join(own, "v").select("u", "v", F.array_intersect("ws", "out").alias("ws")).where("size(ws) > 0")
    hit = F.size("ws").cast("long")
    ends_ = F.concat(F.array(F.struct(F.col("u").alias("id"), hit.alias("n")), F.struct(F.col("v").alias("id"), hit.alias("n"))), F.transform("ws", lambda w: F.struct(w.alias("id"), F.lit(1).cast("long").alias("n"))))
    return met.select(F.explode(ends_).alias("x")).select("x.id", "x.n")


def triangles(g: Graph) -> DataFrame:
    """(id, n): triangles at each node that has one; see upward() and closed()."""
    return closed(*upward(g)).groupBy("id").agg(F.sum("n").alias("n"))


def clustering(g: Graph) -> DataFrame:
    """(id, clustering): linked pairs of neighbours over pairs of neighbours, directions aside. A loop makes a node its
    own neighbour. Under two neighbours: 0."""
    lists, pairs = upward(g)
    none = F.lit(0).cast("long")
    counts = closed(lists, pairs).select("id", "n", none.alias("k"), none.alias("loop"))
    counts = counts.union(lists.select("u", none, F.size("out").cast("long"), none)).union(lists.select(F.explode("out.v"), none, F.lit(1).cast("long"), none))
    loops = ends(g).where("source = target").select(F.col("source").alias("id")).distinct()
    counts = counts.union(loops.select("id", none, F.lit(1).cast("long"), F.lit(1).cast("long")))
    sums = counts.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", "k", "loop")])
    full = ids(g).join(sums, "id", "left")
    linked = F.col("n") + F.col("loop") * (F.col("k") - 1)
    return full.select("id", F.when(F.col("k") >= 2, 2.0 * linked / (F.col("k") * (F.col("k") - 1))).otherwise(0.0).alias("clustering"))


def global_clustering(g: Graph) -> float:
    """Three times the triangles over the connected triples."""
    t = triangles(g).agg(F.sum("n")).first()[0] or 0
    triples = adjacency(g).where("a <> b").groupBy("a").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(F.expr("k * (k - 1) / 2"))).first()[0] or 0
    return t / triples if triples else 0.0


def betweenness(g: Graph, sources: DataFrame | None = None) -> DataFrame:
    """(id, betweenness) over shortest paths of the undirected multigraph, over (n - 1)(n - 2) where n > 2.

    All sources go at once, a level a join: a table of (source, node, paths) for each level, then the dependencies
    from the last level back. Tables hold a row a pair that is connected, as the exact measure needs; with
    ``sources``, only those nodes' paths count.
    """
    e = ends(g)
    steps = e.select(F.col("source").alias("a"), F.col("target").alias("b")).union(e.select("target", "source")).where("a <> b")
    steps = steps.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("times")).repartition("a").persist()
    base = ids(g).distinct()
    n = base.count()
    begin = base if sources is None else base.join(sources.toDF("id"), "id", "left_semi")
    levels = [written(begin.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")))]
    seen = levels[0].select("s", "v")
    while True:
        reach = levels[-1].join(steps, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum(F.col("paths") * F.col("times")).alias("paths"))
        # A node at the next level can have been met only at this one or the one before.
        recent = levels[-1].select("s", "v") if len(levels) == 1 else levels[-1].select("s", "v").union(levels[-2].select("s", "v"))
        level = written(reach.join(recent, ["s", "v"], "left_anti"))
        if level.isEmpty():
            forget(level)
            break
        levels.append(level)
        seen = None
    total = None
    later = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("dep"))
    for level in levels[-2::-1]:
        share = later.select("s", F.col("v").alias("w"), ((1.0 + F.col("dep")) / F.col("paths")).alias("x"))
        back = share.join(steps, share.w == steps.a).select("s", F.col("b").alias("v"), (F.col("x") * F.col("times")).alias("x"))
        came = back.groupBy("s", "v").agg(F.sum("x").alias("x"))
        now = written(level.join(came, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("dep")))
        part = now.where("s <> v").groupBy("v").agg(F.sum("dep").alias("dep"))
        total = part if total is None else total.union(part)
        later = now
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    if total is None:
        return base.select("id", F.lit(0.0).alias("betweenness"))
    sums = total.groupBy("v").agg(F.sum("dep").alias("dep"))
    out = base.join(sums, base.id == sums.v, "left").select("id", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness"))
    steps.unpersist()
    return out


def distances(g: Graph, start, weight: str | None = None, direction: str = "out", stop=None, parents: bool = True) -> DataFrame:
    """(id, distance, parent) of what is reached from ``start``: hops, or sums of an edge property (missing: 1).

    Every round relaxes the edges of the nodes that improved in the round before; without weights each node is
    improved once. Of equal parents the least. ``stop``: end once this node is reached (without weights). Edges stay where
    their first node is; without ``parents`` that column is null, and offers are compared as plain numbers.
    """
    e = g.edge_table()
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight and weight in e.columns else F.lit(1.0)
    forth = e.select(F.col("source").alias("a"), F.col("target").alias("b"), w.alias("w"))
    back = e.select(F.col("target").alias("a"), F.col("source").alias("b"), w.alias("w"))
    n = parts_for(g.spark, edge_rows(g) * (2 if direction == "both" else 1))
    steps = {"out": forth, "in": back, "both": forth.union(back)}[direction].repartition(n, "a").groupBy("a", "b").agg(F.min("w").alias("w"))
    steps = steps.sortWithinPartitions("a").persist()
    if weight and not steps.where("w < 0").isEmpty():
        raise ValueError("weights must not be negative")
    kind = g.id_type
    known = written(ids(g).where(F.col("id") == F.lit(start)).distinct().select("id", F.lit(0.0).alias("distance"), F.lit(None).cast(kind).alias("parent"), F.lit(True).alias("new")))
    while True:
        fringe = known.where("new")
        met = steps.join(fringe, steps.a == fringe.id).select(F.col("b").alias("id"), (F.col("distance") + F.col("w")).alias("distance"), F.col("a").alias("parent"))
        if parents:
            both = known.select("id", "distance", "parent", F.lit(False).alias("offer")).unionByName(met.withColumn("offer", F.lit(True)))
            # false sorts before true: what is known stays unless an offer is less.
            best = both.groupBy("id").agg(F.min(F.struct("distance", "offer", "parent")).alias("x"))
            after = written(best.select("id", "x.distance", "x.parent", F.col("x.offer").alias("new")))
        else:
            both = known.select("id", F.col("distance").alias("was"), F.lit(None).cast("double").alias("offer")).union(met.select("id", F.lit(None).cast("double"), "distance"))
            best = both.groupBy("id").agg(F.min("was").alias("was"), F.min("offer").alias("offer"))
            less = F.col("offer").isNotNull() & (F.col("was").isNull() | (F.col("offer") < F.col("was")))
            after = written(best.select("id", F.when(less, F.col("offer")).otherwise(F.col("was")).alias("distance"), F.lit(None).cast(kind).alias("parent"), less.alias("new")))
        forget(known)
        known = after
        ended = known.where("new").isEmpty()
        if ended or (stop is not None and not weight and not known.where(F.col("id") == F.lit(stop)).isEmpty()):
            steps.unpersist()
            return known.select("id", "distance", "parent")


def average_path_length(g: Graph, sources: DataFrame | None = None) -> float:
    """The mean distance along the edges' directions over all pairs of different nodes that are connected; 0 without
    any. All sources (or those given) go a level a round; a pair is kept once, so this needs a row a connected pair."""
    steps = ends(g).where("source <> target").select(F.col("source").alias("v"), F.col("target").alias("w")).distinct()
    begin = ids(g).distinct() if sources is None else sources.toDF("id")
    fringe = written(begin.select(F.col("id").alias("s"), F.col("id").alias("v")))
    seen, depth, total, pairs = [fringe], 0, 0, 0
    while True:
        depth += 1
        met = seen[0]
        for x in seen[1:]:
            met = met.union(x)
        reach = fringe.join(steps, "v").select("s", F.col("w").alias("v")).distinct()
        fringe = written(reach.join(met, ["s", "v"], "left_anti"))
        n = fringe.count()
        if not n:
            break
        seen.append(fringe)
        total, pairs = total + n * depth, pairs + n
    for x in seen:
        forget(x)
    return total / pairs if pairs else 0.0


def distance(g: Graph, u, v, weight: str | None = None) -> float:
    """From u to v along the edges' directions; -1 where there is no way."""
    row = distances(g, u, weight, stop=v).where(F.col("id") == F.lit(v)).first()
    return row["distance"] if row else -1.0


def shortest_path(g: Graph, u, v, weight: str | None = None, direction: str = "out") -> list | None:
    """The ids from u to v, or None. One lookup a node of the path."""
    known = distances(g, u, weight, direction, stop=v)
    path, now = [], v
    while now is not None:
        row = known.where(F.col("id") == F.lit(now)).first()
        if row is None:
            return None
        path.append(now)
        now = row["parent"]
    return path[::-1]


def by_name(name: str, g: Graph) -> DataFrame:
    """The algorithm as the pattern language calls it; partitions are kept with the graph."""
    if name in g.cached:
        return g.cached[name]
    out = {"pagerank": pagerank, "betweenness": betweenness, "clustering": clustering, "degree": degree, "community": community, "community_fast": community_fast, "leiden": leiden}[name](g)
    if name in ("community", "leiden"):
        g.cached[name] = out
    return out

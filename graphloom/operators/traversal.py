"""Stepwise traversal, accumulators along ways, and breadth-first search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph, named
from graphloom.operators.community import edge_rows
from graphloom.storage import forget, kept_by, parts_for, written


def hops(g: Graph, direction: str, kind: str | None = None, props: list[str] = ()) -> DataFrame:
    """(a, b, edge, edge properties) in the direction of travel; a loop counts once in either direction."""
    e = g.edge_table(kind)
    extra = [named(p).alias(f"e.{p}") if p in e.columns else F.lit(None).alias(f"e.{p}") for p in props]
    forth = e.select(F.col("source").alias("a"), F.col("target").alias("b"), F.col("id").alias("edge"), *extra)
    back = e.select(F.col("target").alias("a"), F.col("source").alias("b"), F.col("id").alias("edge"), *extra)
    return {"out": forth, "in": back, "both": forth.union(back)}[direction]


def neighbours(g: Graph, node, direction: str = "out", kind: str | None = None) -> DataFrame:
    """(id) as often as there are edges to it."""
    return hops(g, direction, kind).where(F.col("a") == F.lit(node)).select(F.col("b").alias("id"))


def edges_of(g: Graph, node, direction: str = "out", kind: str | None = None) -> DataFrame:
    """A node's edges with their properties; ``direction`` says on which side the node is. A loop is on both."""
    e = g.edge_table(kind)
    parts = [e.where(F.col(end) == F.lit(node)).withColumn("direction", F.lit(word)) for end, word in (("source", "out"), ("target", "in")) if direction in (word, "both")]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def two_hops(g: Graph, first: str, second: str) -> DataFrame:
    """(a, b, c): ways over an edge of the one type and then one of the other."""
    one = g.edge_table(first).select(F.col("source").alias("a"), F.col("target").alias("b"))
    return one.join(g.edge_table(second).select(F.col("source").alias("b"), F.col("target").alias("c")), "b").select("a", "b", "c")


@dataclass(frozen=True)
class Traversal:
    """A lazy frontier of nodes in which repetitions stay: every step is a join, a filter or a cut."""

    g: Graph
    frontier: DataFrame

    @classmethod
    def at(cls, g: Graph, *start) -> Traversal:
        t = g.id_type
        rows = g.spark.createDataFrame([(s,) for s in start], f"id {t.simpleString()}")
        return cls(g, rows.join(g.node_table().select("id").distinct(), "id", "left_semi"))

    def _step(self, direction: str, kind: str | None) -> Traversal:
        e = hops(self.g, direction, kind)
        return Traversal(self.g, self.frontier.join(e, F.col("id") == F.col("a")).select(F.col("b").alias("id")))

    def out(self, kind: str | None = None) -> Traversal:
        return self._step("out", kind)

    def in_(self, kind: str | None = None) -> Traversal:
        return self._step("in", kind)

    def both(self, kind: str | None = None) -> Traversal:
        return self._step("both", kind)

    def filter(self, cond: Column) -> Traversal:
        return Traversal(self.g, self.frontier.join(self.g.node_table().where(cond).select("id"), "id"))

    def has_label(self, label: str) -> Traversal:
        return self.filter(F.col("label") == label)

    def limit(self, n: int) -> Traversal:
        return Traversal(self.g, self.frontier.orderBy("id").limit(n))

    def skip(self, n: int) -> Traversal:
        return Traversal(self.g, self.frontier.orderBy("id").offset(n))

    def ids(self) -> DataFrame:
        return self.frontier

    def nodes(self) -> DataFrame:
        return self.frontier.join(self.g.node_table(), "id")

    def count(self) -> int:
        return self.frontier.count()

    def sack(self, init) -> Sack:
        return Sack(self.g, self.frontier, init)


@dataclass(frozen=True)
class Sack:
    """Ways from the frontier with a value along each. Ways are kept apart, however many lead to a node."""

    g: Graph
    start: DataFrame
    init: object
    direction: str = "out"
    kinds: tuple[str, ...] = ()
    by: Callable | None = None
    props: tuple[str, ...] = ()
    condition: Callable | None = None
    max_depth: int = 32
    max_nodes: int = 10_000
    on_cycle: str = "error"
    repeated: bool = False

    def _with(self, **x) -> Sack:
        return Sack(**{**self.__dict__, **x})

    def out_e(self, *kinds: str) -> Sack:
        return self._with(direction="out", kinds=kinds)

    def in_e(self, *kinds: str) -> Sack:
        return self._with(direction="in", kinds=kinds)

    def filter_edge(self, cond: Callable, *props: str) -> Sack:
        """cond takes a function from a property's name to its column."""
        return self._with(condition=cond, props=tuple(dict.fromkeys((*self.props, *props))))

    def sack_by(self, fold: Callable, *props: str) -> Sack:
        """fold(sack, property) gives the next sack; property(name) is the edge's column."""
        return self._with(by=fold, props=tuple(dict.fromkeys((*self.props, *props))))

    def sack_mul_by(self, prop: str) -> Sack:
        return self.sack_by(lambda s, p: s * needed(p(prop), prop), prop)

    def sack_sum_by(self, prop: str) -> Sack:
        return self.sack_by(lambda s, p: s + needed(p(prop), prop), prop)

    def repeat(self, max_depth: int = 32, max_nodes: int = 10_000, on_cycle: str = "error") -> Sack:
        return self._with(repeated=True, max_depth=max_depth, max_nodes=max_nodes, on_cycle=on_cycle)

    def emit(self) -> Emitted:
        """A level a join, each level written; a way that comes back to an ancestor is an error or is left out.

        More items than max_nodes stop it after the level that passes the bound; its items in the order of their ways
        are cut to the bound and ``truncated`` is set.
        """
        e = None
        for k in self.kinds or (None,):
            part = hops(self.g, self.direction, k, list(self.props))
            e = part if e is None else e.unionByName(part)
        t = self.g.id_type
        way = F.array(F.col("id").cast("string"))
        level = written(self.start.select("id", F.lit(float(self.init)).alias("sack"), F.lit(0).alias("depth"), F.lit(None).cast(t).alias("parent"), F.lit(None).cast("string").alias("via_edge"), F.array("id").alias("%way"), way.alias("%order")))
        levels, skipped, total, truncated = [], 0, 0, False
        for depth in range(1, (self.max_depth if self.repeated else 1) + 1):
            step = level.select(F.col("id").alias("%from"), F.col("sack").alias("%sack"), "%way", "%order").join(e, F.col("%from") == F.col("a"))
            get = lambda p: named(f"e.{p}")
            if self.condition is not None:
                step = step.where(self.condition(get))
            step = step.withColumn("%cycle", F.array_contains("%way", F.col("b")))
            if self.on_cycle == "error":
                guard = F.when(F.col("%cycle"), F.raise_error(F.concat(F.lit("cycle at "), F.col("b").cast("string"))).cast(t)).otherwise(F.col("b"))
                step = step.withColumn("b", guard)
            value = self.by(F.col("%sack"), get) if self.by else F.col("%sack")
            rows = step.select(F.col("b").alias("id"), value.cast("double").alias("sack"), F.lit(depth).alias("depth"), F.col("%from").alias("parent"), F.col("edge").cast("string").alias("via_edge"), F.concat("%way", F.array("b")).alias("%way"), F.concat("%order", F.array(F.concat(F.col("edge").cast("string"), F.lit("/"), F.col("b").cast("string")))).alias("%order"), "%cycle")
            full = written(rows)
            if self.on_cycle == "skip":
                skipped += full.where("`%cycle`").count()
            level = full.where("not `%cycle`").drop("%cycle")
            n = level.count()
            if not n:
                break
            levels.append(level)
            total += n
            if total > self.max_nodes:
                truncated = True
                break
        items = levels[0] if levels else level.limit(0)
        for x in levels[1:]:
            items = items.union(x)
        if truncated:
            items = items.orderBy("depth", "%order").limit(self.max_nodes)
        return Emitted(items, truncated, skipped)


def needed(c: Column, name: str) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(f"an edge has no number {name}")).cast("double")).otherwise(c.cast("double"))


@dataclass(frozen=True)
class Emitted:
    """items: (id, sack, depth, parent, via_edge), a row a way."""

    rows: DataFrame
    truncated: bool
    cycles_skipped: int

    @property
    def items(self) -> DataFrame:
        return self.rows.select("id", "sack", "depth", "parent", "via_edge")

    def leaves(self) -> DataFrame:
        """Items whose way goes no further."""
        inner = self.rows.where(F.size("%way") > 1).select(F.slice("%order", 1, F.size("%order") - 1).alias("%order")).distinct()
        return self.rows.join(inner, "%order", "left_anti").select("id", "sack", "depth", "parent", "via_edge")


@dataclass
class Search:
    """distances: (id, distance)."""

    distances: DataFrame
    completed: bool
    rounds: int = 0
    extra: dict = field(default_factory=dict)


def bfs(g: Graph, start, direction: str = "out", kind: str | None = None, allowed: Column | None = None, max_depth: int | None = None, max_nodes: int | None = 10_000) -> Search:
    """Level by level. Nodes that ``allowed`` refuses are neither listed nor passed. At the level that passes max_nodes
    it ends, those with the least ids filling it up, and it isn't completed."""
    rows = edge_rows(g, kind) * (2 if direction == "both" else 1)
    e = kept_by(hops(g, direction, kind).select("a", "b"), "a", parts_for(g.spark, rows))
    nodes = g.node_table()
    ok = (nodes.where(allowed) if allowed is not None else nodes).select("id")
    levels = [written(nodes.where(F.col("id") == F.lit(start)).select("id", F.lit(0).alias("distance")))]
    depth, total, completed = 0, levels[0].count(), True
    while max_depth is None or depth < max_depth:
        depth += 1
        seen = levels[0]
        for x in levels[1:] if direction != "both" else levels[-2:]:  # both ways, a node of an earlier level has none here
            seen = seen.union(x)
        fringe = levels[-1]
        new = e.join(fringe, e.a == fringe.id).select(F.col("b").alias("id")).distinct().join(ok, "id", "left_semi").join(seen, "id", "left_anti")
        new = written(new.withColumn("distance", F.lit(depth)))
        n = new.count()
        if not n:
            break
        completed = max_nodes is None or total + n <= max_nodes
        levels.append(new if completed else new.orderBy("id").limit(max(0, max_nodes - total)))
        if not completed:
            break
        total += n
    e.unpersist()
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return Search(out, completed, depth)


def dfs(g: Graph, start, direction: str = "out", max_nodes: int = 10_000) -> list:
    """Preorder with the least id first. The order is sequential by nature: it runs on the driver over what bfs reaches
    within max_nodes, and raises beyond that."""
    reach = bfs(g, start, direction, max_nodes=max_nodes)
    if not reach.completed:
        raise ValueError(f"more than {max_nodes} nodes; preorder needs them all at once")
    e = hops(g, direction).select("a", "b").distinct().join(reach.distances.select(F.col("id").alias("a")), "a", "left_semi")
    near: dict = {}
    for r in e.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("b")).toLocalIterator():
        near[r["a"]] = r["b"]
    out, seen, stack = [], set(), [start]
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            out.append(v)
            stack += reversed([u for u in near.get(v, ()) if u not in seen])
    return out

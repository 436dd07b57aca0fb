"""Patterns as joins."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import compared, literal
from graphloom.model import Graph, named
from graphloom.plans.syntax import Node, Pattern, PatternError, Rel

NODES, EDGES, SEEN, HERE = "%nodes", "%edges", "%seen", "%here"


@dataclass
class Needs:
    """What the rest of the query reads of the patterns."""

    #: Properties of each variable; None: all.
    props: dict[str, set[str] | None] = field(default_factory=dict)
    path: bool = False
    #: Properties of the nodes and edges along the path.
    path_node_props: set[str] = field(default_factory=set)
    path_edge_props: set[str] = field(default_factory=set)
    node_models: list[str] = field(default_factory=list)
    edge_models: list[str] = field(default_factory=list)

    def of(self, var: str) -> set[str] | None:
        return self.props.get(var, set())


def kept(df: DataFrame, fixed: tuple[str, ...], props: set[str] | None) -> list[str]:
    """Columns of a node or edge table that are needed."""
    return [c for c in df.columns if c in fixed or props is None or c in props]


def holds(df: DataFrame, props: tuple) -> DataFrame:
    """The rows that have these property values; a property that no row can have matches none."""
    for key, v in props:
        if key not in df.columns:
            return df.where(F.lit(False))
        df = df.where(compared("=", named(key), df.schema[key].dataType, *literal(v), bare=True))
    return df


def node_source(g: Graph, n: Node, props: set[str] | None, needs: Needs) -> DataFrame:
    """A node's table as far as it's needed, with the path's struct where there is a path."""
    df = holds(g.node_table(n.label), n.props)
    if needs.path:
        extra = [named(p).alias(p) if p in df.columns else F.lit(None).alias(p) for p in sorted(needs.path_node_props)]
        df = df.withColumn(HERE, F.struct("id", "label", "kind", *extra))
        df = with_vectors(df, g.node_vectors, needs.node_models)
    return df.select(*[named(c).alias(f"{n.var}.{c}") for c in kept(df, ("id", "label", "kind", HERE), props)])


def with_vectors(df: DataFrame, vectors: DataFrame | None, models: list[str]) -> DataFrame:
    """HERE with a field ``v:<model>`` for each model: the vector of the row's id, or null."""
    for m in models:
        field_name = f"v:{m}"
        if vectors is None:
            df = df.withColumn(HERE, F.col(HERE).withField(f"`{field_name}`", F.lit(None).cast("array<float>")))
            continue
        one = vectors.where(F.col("model") == m).select(F.col("id").alias("%vid"), F.col("vector").alias("%vec"))
        df = df.join(one, df["id"] == F.col("%vid"), "left").withColumn(HERE, F.col(HERE).withField(f"`{field_name}`", F.col("%vec"))).drop("%vid", "%vec")
    return df


def edge_source(g: Graph, r: Rel, props: set[str] | None, needs: Needs) -> DataFrame:
    """An edge's table with %from and %to in the direction of travel."""
    df = holds(g.edge_table(r.type), r.props)
    if needs.path:
        extra = [named(p).alias(p) if p in df.columns else F.lit(None).alias(p) for p in sorted(needs.path_edge_props)]
        df = df.withColumn(HERE, F.struct("id", "type", "source", "target", *extra))
        df = with_vectors(df, g.edge_vectors, needs.edge_models)
    cols = [named(c).alias(f"{r.var}.{c}") for c in kept(df, ("id", "source", "target", "type", HERE), props)]
    forth = df.select(*cols, F.col("source").alias("%from"), F.col("target").alias("%to"))
    if r.direction == "out":
        return forth
    back = df.select(*cols, F.col("target").alias("%from"), F.col("source").alias("%to"))
    return back if r.direction == "in" else forth.union(back.where("`%from` <> `%to`"))


def end_label(g: Graph, r: Rel, first: bool) -> str | None:
    """The label that the edge type declares for the end where the hop starts (or arrives)."""
    e = g.edges.get(r.type or "")
    if e is None or r.direction == "both":
        return None
    return e.from_label if (r.direction == "out") == first else e.to_label


def only_id(n: Node, needs: Needs) -> bool:
    props = needs.of(n.var)
    return not needs.path and not n.props and props is not None and props <= {"id"}


def implied(g: Graph, n: Node, r: Rel, first: bool, needs: Needs) -> bool:
    """Whether the edge alone says that the node is there and has the label."""
    label = end_label(g, r, first)
    return only_id(n, needs) and label is not None and n.label in (None, label)


def match(g: Graph, p: Pattern, needs: Needs) -> DataFrame:
    """A row a match. Variables are the columns ``var.property``; a path is in NODES and EDGES."""
    first = p.nodes[0]
    bound = {first.var}
    if p.rels and p.rels[0].least is None and implied(g, first, p.rels[0], True, needs) and not (p.nodes[1].var == first.var):
        df = None
    else:
        df = node_source(g, first, needs.of(first.var), needs)
        if needs.path:
            df = df.withColumns({NODES: F.array(named(f"{first.var}.{HERE}")), EDGES: F.lit(None)}).drop(f"{first.var}.{HERE}")
    previous = first
    edge_bound: set[str] = set()
    for r, n in zip(p.rels, p.nodes[1:]):
        if r.var in edge_bound or r.var in bound or n.var in edge_bound:
            raise PatternError(f"{r.var} stands for more than one thing")
        if r.least is not None:
            df = variable(g, df, previous, r, n, needs, n.var in bound)
        else:
            df = fixed(g, df, previous, r, n, needs, n.var in bound)
            edge_bound.add(r.var)
        bound.add(n.var)
        previous = n
    if needs.path and not p.rels:
        raise PatternError("path functions need a relationship")
    return df


def fixed(g: Graph, df: DataFrame | None, a: Node, r: Rel, b: Node, needs: Needs, again: bool) -> DataFrame:
    e = edge_source(g, r, needs.of(r.var), needs)
    start = named(f"{a.var}.id")
    if df is None:
        df = e.withColumn(f"{a.var}.id", F.col("%from"))
    else:
        df = df.join(e, start == F.col("%from"))
    if again:
        df = df.where(named(f"{b.var}.id") == F.col("%to"))
        if needs.path:
            nodes = node_source(g, Node(f"%{b.var}", b.label, b.props), set(), needs)
            df = df.join(nodes, named(f"%{b.var}.id") == F.col("%to"))
            df = step(df, r, f"%{b.var}").drop(*[c for c in nodes.columns])
    elif implied(g, b, r, False, needs):
        df = df.withColumn(f"{b.var}.id", F.col("%to"))
    else:
        nodes = node_source(g, b, needs.of(b.var), needs)
        df = df.join(nodes, named(f"{b.var}.id") == F.col("%to"))
        if needs.path:
            df = step(df, r, b.var)
    return df.drop("%from", "%to")


def step(df: DataFrame, r: Rel, to: str) -> DataFrame:
    """The path with one more edge and node."""
    edge = F.array(named(f"{r.var}.{HERE}"))
    edges = edge if str(df.schema[EDGES].dataType) == "NullType()" else F.concat(EDGES, edge)
    return df.withColumns({NODES: F.concat(NODES, F.array(named(f"{to}.{HERE}"))), EDGES: edges}).drop(f"{to}.{HERE}", f"{r.var}.{HERE}")


def variable(g: Graph, df: DataFrame, a: Node, r: Rel, b: Node, needs: Needs, again: bool) -> DataFrame:
    """A quantified hop: a join a step, of which those within the bounds are united. No node is visited twice in it.

    Each depth's plan holds the plan of the depth before; exchanges that they share run once. Steps carry ids alone
    unless the path is asked for.
    """
    e = edge_source(g, r, set(), needs)
    keep = ["%from", "%to"] + ([f"{r.var}.{HERE}"] if needs.path else [])
    e = e.select(*[named(c) for c in keep])
    df = df.withColumns({HERE: named(f"{a.var}.id"), SEEN: F.array(named(f"{a.var}.id"))})
    anywhere = node_source(g, Node("%n"), set(), needs) if needs.path else None
    out = None
    for depth in range(1, r.most + 1):
        df = df.join(e, F.col(HERE) == F.col("%from")).where(~F.array_contains(SEEN, F.col("%to")))
        df = df.withColumns({HERE: F.col("%to"), SEEN: F.concat(SEEN, F.array("%to"))}).drop("%from", "%to")
        if needs.path:
            df = step(df.join(anywhere.drop("%n.label", "%n.kind"), named("%n.id") == F.col(HERE)), r, "%n").drop("%n.id")
        if depth >= r.least:
            out = df if out is None else out.unionByName(df)
    out = out.withColumnRenamed(HERE, "%to").drop(SEEN)
    if again:
        return out.where(named(f"{b.var}.id") == F.col("%to")).drop("%to")
    if implied(g, b, r, False, needs):
        return out.withColumnRenamed("%to", f"{b.var}.id")
    nodes = node_source(g, b, needs.of(b.var), needs)
    nodes = nodes.drop(f"{b.var}.{HERE}")
    return out.join(nodes, named(f"{b.var}.id") == F.col("%to")).drop("%to")


def cut(patterns: list[Pattern]) -> list[Pattern]:
    """Patterns of which one ends in a node that another one has as well, taken apart two hops before that end.

    The end and the node at the cut are then keys of one join, after the others have bound the end, where otherwise all
    of the last two hops would be walked before the end is compared. The last part comes last.
    """
    out, tails = [], []
    for i, p in enumerate(patterns):
        others = {n.var for j, q in enumerate(patterns) if j != i for n in q.nodes}
        names = [n.var for n in p.nodes]
        plain = all(r.least is None for r in p.rels) and len(set(names)) == len(names)
        if len(p.rels) >= 3 and plain and names[-1] in others and not others & set(names[-3:-1]) and others & set(names[:-3]):
            middle = p.nodes[-3]
            out.append(Pattern(p.nodes[:-2], p.rels[:-2]))
            tails.append(Pattern((replace(middle, props=()), *p.nodes[-2:]), p.rels[-2:]))
        else:
            out.append(p)
    return out + tails


def joined(frames: list[tuple[DataFrame, set[str]]]) -> DataFrame:
    """Patterns joined on the ids of their common variables. Patterns that share a variable with what is joined
    already come first; one that shares none is multiplied."""
    frames = list(frames)
    df, have = frames.pop(0)
    while frames:
        i = next((i for i, (_, vs) in enumerate(frames) if vs & have), 0)
        right, vs = frames.pop(i)
        common = sorted(vs & have)
        if common:
            renamed = right
            for v in common:
                renamed = renamed.withColumnRenamed(f"{v}.id", f"%{v}.id")
            on: Column | None = None
            for v in common:
                same = named(f"{v}.id") == named(f"%{v}.id")
                on = same if on is None else on & same
            twice = [c for c in renamed.columns if c in df.columns]
            df = df.join(renamed.drop(*twice), on).drop(*[f"%{v}.id" for v in common])
        else:
            df = df.crossJoin(right)
        have |= vs
    return df

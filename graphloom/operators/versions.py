"""Versions of nodes and edges, writing as new snapshots, and merging."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.expressions import literal, value
from graphloom.model import Edges, Graph, Nodes, named, together
from graphloom.plans.syntax import Add, Delete, Node, Pattern, PatternError, Query, Update

SPAN = ("valid_from", "valid_to", "version")


@dataclass(frozen=True)
class History:
    """All versions: for each label and type a table with the columns of Nodes or Edges and valid_from (inclusive),
    valid_to (exclusive, null while current) and version."""

    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]


def versions_of(changes: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """Changes (key, at, ...) as versions: each holds until the key's next change."""
    order = Window.partitionBy(key).orderBy(at)
    spans = changes.withColumns({"valid_from": F.col(at), "valid_to": F.lead(at).over(order), "version": F.row_number().over(order).cast("long")})
    return spans.drop(at)


def valid(df: DataFrame, t) -> DataFrame:
    """The rows that hold at t; of several the highest version."""
    inside = df.where((F.col("valid_from") <= F.lit(t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(t))))
    rest = [c for c in df.columns if c not in (*SPAN, "id")]
    best = inside.groupBy("id").agg(F.max_by(F.struct(*[named(c) for c in rest], F.lit(0).alias("%")), "version").alias("x"))
    return best.select("id", *[F.col("x").getField(c).alias(c) for c in rest])


def as_of(g: Graph, t) -> Graph:
    """The graph as it was at t. Labels and types without a history are as they are now."""
    h = g.history
    if h is None:
        raise PatternError("the graph has no history")
    nodes = {**g.nodes, **{k: Nodes(valid(v, t)) for k, v in h.nodes.items()}}
    edges = {**g.edges, **{k: replace(g.edges[k], frame=valid(v, t)) if k in g.edges else Edges(valid(v, t)) for k, v in h.edges.items()}}
    return g.but(nodes=nodes, edges=edges)


def history_of(g: Graph, label: str, node) -> DataFrame:
    return g.history.nodes[label].where(F.col("id") == F.lit(node)).orderBy("version")


def edge_history(g: Graph, kind: str, edge) -> DataFrame:
    return g.history.edges[kind].where(F.col("id") == F.lit(edge)).orderBy("version")


def edges_at(g: Graph, kind: str, t) -> DataFrame:
    """The edges of a type that held at t."""
    return valid(g.history.edges[kind], t)


def node_at(g: Graph, label: str, node, t, strict: bool = False) -> dict | None:
    """A node as it was at t, or None; with ``strict`` a LookupError where it wasn't there."""
    row = valid(g.history.nodes[label].where(F.col("id") == F.lit(node)), t).first()
    if row is None and strict:
        raise LookupError(f"{node} wasn't there at {t}")
    return None if row is None else row.asDict()


def collected(versions: DataFrame, cutoff, keep: int = 1, active: object = None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): versions that ended before the cutoff, and before the earliest time that is still read, go;
    the last ``keep`` versions of each id stay whatever their age."""
    limit = cutoff if active is None else min(cutoff, active)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("version").desc()))
    old = F.coalesce(F.col("valid_to") <= F.lit(limit), F.lit(False))
    marked = versions.withColumn("%go", old & (place > keep))
    return marked.where("not `%go`").drop("%go"), marked.where("`%go`").drop("%go")


# --- writing: each returns a new graph -------------------------------------------------------------------------------


def appended(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else together([old, new])


def with_nodes(g: Graph, label: str, rows: DataFrame) -> Graph:
    old = g.nodes.get(label)
    return g.but(nodes={**g.nodes, label: Nodes(appended(old and old.frame, rows))})


def with_edges(g: Graph, kind: str, rows: DataFrame) -> Graph:
    old = g.edges.get(kind)
    if "id" not in rows.columns:
        rows = rows.withColumn("id", F.xxhash64(*[named(c) for c in rows.columns]))
    ends = (old.from_label, old.to_label) if old else (None, None)
    return g.but(edges={**g.edges, kind: Edges(appended(old and old.frame, rows), *ends)})


def add(g: Graph, statement: Add) -> tuple[Graph, dict]:
    """New nodes and edges by a pattern; a variable that occurs again is the same node. Ids are the next free ones
    where ids are numbers, else random names drawn once."""
    import uuid

    kind = g.id_type.simpleString()
    if kind == "string" or not g.nodes:
        kind = "string" if not g.nodes else kind
    if kind == "string":
        fresh = lambda: str(uuid.uuid4())
    else:
        from graphloom.operators.community import ids

        start = [(ids(g).agg(F.max("id")).first()[0] or 0)]

        def fresh():
            start[0] += 1
            return start[0]

    made: dict[str, object] = {}
    out, edges = g, 0

    def row(values: dict) -> DataFrame:
        return g.spark.range(1).select(*[(v if k == "%" else literal(v)[0].cast(kind) if k in ("id", "source", "target") and values.get("%") is None else literal(v)[0]).alias(k) for k, v in values.items()])

    for n in statement.pattern.nodes:
        if n.var not in made:
            made[n.var] = fresh()
            out = with_nodes(out, n.label or "Node", row({"id": made[n.var], **dict(n.props)}))
    for r, a, b in zip(statement.pattern.rels, statement.pattern.nodes, statement.pattern.nodes[1:]):
        if r.least is not None:
            raise PatternError("a quantified relationship can't be added")
        for s, t in {"out": [(a, b)], "in": [(b, a)], "both": [(a, b), (b, a)]}[r.direction]:
            out = with_edges(out, r.type or "RELATED_TO", row({"source": made[s.var], "target": made[t.var], **dict(r.props)}))
            edges += 1
    return out, {"nodes_created": len(made), "edges_created": edges}


def matched(g: Graph, pattern: Pattern, where, limit: int | None) -> DataFrame:
    from graphloom.plans.compile import Compiler
    from graphloom.plans.syntax import Prop

    find = [(Prop(n.var), f"n:{n.var}") for n in dict.fromkeys(pattern.nodes)] + [(Prop(r.var), f"r:{r.var}") for r in pattern.rels]
    q = Query(list({name: (e, name) for e, name in find}.values()), [pattern], where=where, limit=limit)
    return Compiler(g, q).compile()


def delete(g: Graph, s: Delete) -> tuple[Graph, dict]:
    """A node pattern: the nodes and all their edges. A pattern with relationships: those edges alone."""
    from graphloom.storage import written

    hits = written(matched(g, s.pattern, s.where, s.limit))
    if s.pattern.rels:
        out, gone = g, 0
        for r in s.pattern.rels:
            ids = hits.select(named(f"r:{r.var}").alias("id")).distinct()
            gone += ids.count()
            edges = {k: replace(e, frame=e.frame.join(ids, "id", "left_anti")) if r.type in (None, k) else e for k, e in out.edges.items()}
            out = out.but(edges=edges)
        return out, {"edges_deleted": gone}
    var = s.pattern.nodes[0].var
    ids = hits.select(named(f"n:{var}").alias("id")).distinct()
    nodes = {k: Nodes(n.frame.join(ids, "id", "left_anti")) for k, n in g.nodes.items()}
    edges = {}
    for k, e in g.edges.items():
        f = e.frame.join(ids.withColumnRenamed("id", "source"), "source", "left_anti")
        edges[k] = replace(e, frame=f.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"))
    return g.but(nodes=nodes, edges=edges), {"nodes_deleted": ids.count()}


def update(g: Graph, s: Update) -> tuple[Graph, dict]:
    """Properties of the matched nodes and edges get the values; a value can be computed from the row's own properties."""
    from graphloom.storage import written

    hits = written(matched(g, s.pattern, s.where, s.limit))
    out, done = g, 0
    labels = {n.var: n.label for n in s.pattern.nodes}
    types = {r.var: r.type for r in s.pattern.rels}
    for var in dict.fromkeys(v for v, _, _ in s.sets):
        sets = [(p, e) for v, p, e in s.sets if v == var]
        if var not in labels and var not in types:
            raise PatternError(f"unknown variable {var}")
        ids = hits.select(named(f"{'n' if var in labels else 'r'}:{var}").alias("id")).distinct().withColumn("%hit", F.lit(True))
        done += ids.count()

        def changed(frame: DataFrame, ids=ids, sets=sets, var=var) -> DataFrame:
            df = frame.join(ids, "id", "left")

            def look(e):
                name = e.names[0] if getattr(e, "names", ()) else "id"
                return (named(name), df.schema[name].dataType) if getattr(e, "var", None) == var and name in df.columns else None

            new = {}
            for p, e in sets:
                c, t = value(e, look)
                old = named(p) if p in df.columns else F.lit(None)
                if p in df.columns and t != df.schema[p].dataType:
                    c = c.cast(df.schema[p].dataType)
                new[p] = F.when(F.col("%hit"), c).otherwise(old)
            return df.withColumns(new).drop("%hit")

        if var in labels:
            out = out.but(nodes={k: Nodes(changed(n.frame)) if labels[var] in (None, k) else n for k, n in out.nodes.items()})
        else:
            out = out.but(edges={k: replace(e, frame=changed(e.frame)) if types[var] in (None, k) else e for k, e in out.edges.items()})
    return out, {"updated": done}


def merged(current: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """current and incoming, by key, with ``change``: Created, Updated, Unchanged or Kept (not in incoming).

    Incoming values that are not null win. Two rows of one key on a side are an error. One full join.
    """
    props = [c for c in incoming.columns if c not in (key, "id")]
    mark = F.count(F.lit(1)).over(Window.partitionBy(named(key)))
    clash = F.raise_error(F.concat(F.lit("ambiguous key "), named(key).cast("string")))
    sole = lambda df: df.withColumn("%n", mark).withColumn(key, F.when(F.col("%n") > 1, clash.cast(df.schema[key].dataType)).otherwise(named(key))).drop("%n")
    a = sole(current).select(named(key).alias("%a"), F.struct("*").alias("old"))
    b = sole(incoming).select(named(key).alias("%b"), F.struct("*").alias("new"))
    both = a.join(b, F.col("%a") == F.col("%b"), "full")
    have = set(current.columns)
    differs = F.lit(False)
    for p in props:
        n = F.col("new").getField(p)
        differs = differs | (n.isNotNull() & ~(F.col("old").getField(p).eqNullSafe(n) if p in have else F.lit(False)))
    change = F.when(F.col("%a").isNull(), "Created").when(F.col("%b").isNull(), "Kept").when(differs, "Updated").otherwise("Unchanged")
    new_id = F.col("new").getField("id") if "id" in incoming.columns else F.xxhash64(F.coalesce("%a", "%b").cast("string"))
    cols = [F.coalesce(F.col("old").getField("id"), new_id.cast(current.schema["id"].dataType)).alias("id"), F.coalesce("%a", "%b").alias(key)]
    for p in dict.fromkeys([*current.columns, *props]):
        if p in ("id", key):
            continue
        sides = [F.col("new").getField(p)] if p in props else []
        sides += [F.col("old").getField(p)] if p in have else []
        cols.append(F.coalesce(*sides).alias(p))
    return both.select(*cols, change.alias("change"))


def upsert(g: Graph, label: str, key: str, rows: DataFrame, links: list[tuple[str, str, str, str]] = ()) -> tuple[Graph, DataFrame]:
    """(graph, changes): rows merged into a label by key. links: (column of rows, edge type, target label, target key);
    targets that don't exist are created with their key alone, and an edge that exists isn't doubled."""
    from graphloom.storage import written

    drop = [c for c, *_ in links]
    incoming = rows.drop(*drop)
    kind = rows.schema[key].dataType
    current = g.nodes[label].frame if label in g.nodes else g.spark.createDataFrame([], f"id long, `{key}` {kind.simpleString()}")
    result = written(merged(current, incoming, key))
    out = g.but(nodes={**g.nodes, label: Nodes(result.drop("change"))})
    for column, edge, target, target_key in links:
        wanted = rows.select(named(key).alias("%k"), named(column).alias("%t")).where("`%t` is not null").distinct()
        stub = wanted.select(F.col("%t").alias(target_key)).distinct()
        have = out.nodes[target].frame if target in out.nodes else g.spark.createDataFrame([], f"id {g.id_type.simpleString()}, `{target_key}` {rows.schema[column].dataType.simpleString()}")
        everyone = written(merged(have, stub, target_key).drop("change"))
        out = out.but(nodes={**out.nodes, target: Nodes(everyone)})
        a = out.nodes[label].frame.select(F.col("id").alias("source"), named(key).alias("%k"))
        b = everyone.select(F.col("id").alias("target"), named(target_key).alias("%t"))
        new = wanted.join(a, "%k").join(b, "%t").select("source", "target").distinct()
        if edge in out.edges:
            new = new.join(out.edges[edge].frame.select("source", "target"), ["source", "target"], "left_anti")
        out = with_edges(out, edge, new)
    return out, result.where("change <> 'Kept'").select("id", named(key), "change")


def delete_by_key(g: Graph, label: str, key: str, v) -> Graph:
    return delete(g, Delete(Pattern((Node("n", label, ((key, v),)),))))[0]

"""Shape validation: violations as a table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.expressions import family, literal
from graphloom.model import Graph, named

DATATYPES = {"string": "string", "integer": "number", "int": "number", "long": "number", "float": "number", "double": "number", "decimal": "number", "boolean": "boolean", "bool": "boolean"}
WHOLE = {"integer", "int", "long"}


@dataclass(frozen=True)
class Constraint:
    """kind: minCount, maxCount, datatype, minInclusive, maxInclusive, minExclusive, maxExclusive, minLength,
    maxLength, pattern, in, hasValue, nodeKind, class."""

    kind: str
    value: object
    severity: str = "Violation"
    message: str | None = None


@dataclass(frozen=True)
class Path:
    """A node's property, or the targets of its outgoing edges of a type."""

    prop: str | None = None
    edge: str | None = None


@dataclass(frozen=True)
class PropertyShape:
    path: Path
    constraints: tuple[Constraint, ...]


@dataclass(frozen=True)
class Shape:
    """Applies to the nodes with target_nodes' ids and those of target_class; without either to all."""

    name: str
    properties: tuple[PropertyShape, ...] = ()
    target_class: str | None = None
    target_nodes: tuple = ()
    constraints: tuple[Constraint, ...] = field(default=())


def targets(g: Graph, s: Shape) -> DataFrame:
    if s.target_class and not s.target_nodes:
        return g.node_table(s.target_class)
    if not s.target_nodes:
        return g.node_table()
    inside = F.col("id").isin(list(s.target_nodes))
    return g.node_table().where(inside | (F.col("label") == s.target_class) if s.target_class else inside)


def bad(c: Constraint, v: Column, kind: T.DataType, count: Column) -> Column:
    """Whether a value breaks a constraint; for the two counts, whether the number of values does."""
    if c.kind == "minCount":
        return count < c.value
    if c.kind == "maxCount":
        return count > c.value
    what = family(kind)
    if c.kind == "datatype":
        name = str(c.value).split("#")[-1].split(":")[-1].lower()
        fits = DATATYPES.get(name) == what and (name not in WHOLE or isinstance(kind, T.IntegralType)) and not (name in ("float", "double", "decimal") and isinstance(kind, T.IntegralType))
        return v.isNotNull() & F.lit(not fits)
    if c.kind in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
        if what != "number":
            return v.isNotNull()
        good = {"minInclusive": v >= c.value, "maxInclusive": v <= c.value, "minExclusive": v > c.value, "maxExclusive": v < c.value}[c.kind]
        return v.isNotNull() & ~good
    if c.kind in ("minLength", "maxLength"):
        if what != "string":
            return F.lit(False)
        return v.isNotNull() & (F.char_length(v) < c.value if c.kind == "minLength" else F.char_length(v) > c.value)
    if c.kind == "pattern":
        return v.isNotNull() & (F.lit(True) if what != "string" else ~v.rlike(str(c.value)))
    if c.kind in ("in", "hasValue"):
        values = list(c.value) if c.kind == "in" else [c.value]
        same = F.lit(False)
        for x in values:
            x, t = literal(x)
            if family(t) == what:
                same = same | F.coalesce(v == x, F.lit(False))
        return (v.isNotNull() if c.kind == "in" else F.lit(True)) & ~same
    raise ValueError(f"no constraint {c.kind}")


def violations(g: Graph, shapes: list[Shape]) -> DataFrame:
    """(focus, shape, path, message, severity). One scan a shape for all its properties' constraints; a join for each
    edge type that a path follows."""
    out = None

    def report(df: DataFrame, focus: str, s: Shape, path: str, c: Constraint) -> DataFrame:
        severity, message = c.severity, c.message or f"{c.kind} {c.value}"
        return df.select(named(focus).cast("string").alias("focus"), F.lit(s.name).alias("shape"), F.lit(path).alias("path"), F.lit(message).alias("message"), F.lit(severity).alias("severity"))

    parts: list[DataFrame] = []
    for s in shapes:
        nodes = targets(g, s)
        checks: list[tuple[Column, Column]] = []

        def check(cond: Column, path: str, c: Constraint) -> None:
            checks.append((cond, F.struct(F.lit(path).alias("path"), F.lit(c.message or f"{c.kind} {c.value}").alias("message"), F.lit(c.severity).alias("severity"))))

        def invalid(c: Constraint) -> bool:
            if c.kind != "pattern":
                return False
            try:
                re.compile(str(c.value))
                return False
            except re.error:
                return True

        for c in s.constraints:
            if c.kind == "nodeKind":
                check(F.col("kind") != c.value, "", c)
            elif c.kind == "class":
                check(F.col("label") != c.value, "", c)
        for p in s.properties:
            if p.path.prop is not None:
                there = p.path.prop in nodes.columns
                v = named(p.path.prop) if there else F.lit(None)
                kind = nodes.schema[p.path.prop].dataType if there else T.NullType()
                for c in p.constraints:
                    if invalid(c):
                        check(v.isNotNull(), p.path.prop, Constraint(c.kind, c.value, "Warning", f"{c.value} is no pattern"))
                    elif kind == T.NullType() and c.kind not in ("minCount", "hasValue"):
                        continue
                    elif c.kind in ("class", "nodeKind"):
                        continue
                    else:
                        check(bad(c, v, kind, v.isNotNull().cast("int")), p.path.prop, c)
        if checks:
            found = F.array_compact(F.array(*[F.when(cond, row) for cond, row in checks]))
            parts.append(nodes.select(F.col("id").cast("string").alias("focus"), F.explode(found).alias("x")).select("focus", F.lit(s.name).alias("shape"), "x.path", "x.message", "x.severity"))
        for p in s.properties:
            if p.path.edge is None:
                continue
            focus = nodes.select(F.col("id").alias("%focus")).distinct()
            hop = g.edge_table(p.path.edge).select("source", "target")
            counts = [c for c in p.constraints if c.kind in ("minCount", "maxCount")]
            if counts:
                n = focus.join(hop.groupBy("source").agg(F.count(F.lit(1)).alias("n")), F.col("%focus") == F.col("source"), "left").select("%focus", F.coalesce("n", F.lit(0)).alias("n"))
                parts += [report(n.where(bad(c, F.lit(None), T.NullType(), F.col("n"))), "%focus", s, p.path.edge, c) for c in counts]
            for c in p.constraints:
                if c.kind in ("class", "nodeKind"):
                    ends = g.node_table().select(F.col("id").alias("%end"), "label", "kind")
                    hit = focus.join(hop, F.col("%focus") == F.col("source")).join(ends, F.col("target") == F.col("%end"), "left")
                    wrong = F.coalesce(F.col("label" if c.kind == "class" else "kind") != c.value, F.lit(True))
                    parts.append(report(hit.where(wrong), "%focus", s, p.path.edge, c))
                elif c.kind == "hasValue":
                    hit = focus.join(hop.where(F.col("target") == F.lit(c.value)), F.col("%focus") == F.col("source"), "left_anti")
                    parts.append(report(hit, "%focus", s, p.path.edge, c))
                elif c.kind == "in":
                    hit = focus.join(hop.where(~F.col("target").isin(list(c.value))), F.col("%focus") == F.col("source"))
                    parts.append(report(hit, "%focus", s, p.path.edge, c))
                elif c.kind not in ("minCount", "maxCount"):
                    # Of an edge's target the value is its id: datatype, range, length and pattern hold for that.
                    if invalid(c):
                        hit = focus.join(hop, F.col("%focus") == F.col("source"))
                        parts.append(report(hit, "%focus", s, p.path.edge, Constraint(c.kind, c.value, "Warning", f"{c.value} is no pattern")))
                    else:
                        hit = focus.join(hop.where(bad(c, F.col("target"), hop.schema["target"].dataType, F.lit(1))), F.col("%focus") == F.col("source"))
                        parts.append(report(hit, "%focus", s, p.path.edge, c))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if out is None:
        return g.spark.createDataFrame([], "focus string, shape string, path string, message string, severity string")
    return out


def conforms(report: DataFrame) -> bool:
    return report.where("severity = 'Violation'").isEmpty()


def shapes_in(g: Graph) -> list[Shape]:
    """Shapes that the graph itself holds: nodes labelled sh:NodeShape with sh:targetClass, sh:nodeKind, sh:name."""
    out = []
    for row in g.node_table("sh:NodeShape").toLocalIterator():
        x = row.asDict()
        kind = x.get("sh:nodeKind")
        out.append(Shape(x.get("sh:name") or str(x["id"]), (), x.get("sh:targetClass"), (), (Constraint("nodeKind", kind),) if kind else ()))
    return out

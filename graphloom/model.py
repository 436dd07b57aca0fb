"""The graph: a typed DataFrame for each node label and each edge type."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("Individual", "Class", "ObjectProperty", "DataProperty", "Restriction", "AnnotationProperty")
#: Columns that nodes and edges have beside their properties.
NODE_COLUMNS = ("id", "label", "kind")
EDGE_COLUMNS = ("id", "source", "target", "type")


def named(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Nodes:
    """One label's nodes: ``id`` and a column for each property; ``kind`` where it isn't Individual."""

    frame: DataFrame

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.frame.schema if f.name not in NODE_COLUMNS}

    def table(self, label: str) -> DataFrame:
        kind = F.col("kind") if "kind" in self.frame.columns else F.lit("Individual")
        return self.frame.select("id", F.lit(label).alias("label"), kind.alias("kind"), *[named(p) for p in self.properties])


@dataclass(frozen=True)
class Edges:
    """One type's edges: ``id``, ``source``, ``target`` and a column for each property.

    from_label and to_label declare that every source and target exists and has that label. Joins with the nodes'
    tables are then left out where nothing but the id is asked for.
    """

    frame: DataFrame
    from_label: str | None = None
    to_label: str | None = None

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.frame.schema if f.name not in EDGE_COLUMNS}

    def table(self, kind: str) -> DataFrame:
        return self.frame.select("id", "source", "target", F.lit(kind).alias("type"), *[named(p) for p in self.properties])


def together(frames: list[DataFrame]) -> DataFrame:
    """The union by name. A column that has several types becomes double if all are numbers, else string."""
    types: dict[str, set] = {}
    for df in frames:
        for f in df.schema:
            types.setdefault(f.name, set()).add(f.dataType)
    wide = {}
    for name, kinds in types.items():
        if len(kinds) > 1:
            kinds.discard(T.NullType())
        if len(kinds) > 1:
            numbers = all(isinstance(k, T.NumericType) for k in kinds)
            wide[name] = "bigint" if all(isinstance(k, T.IntegralType) for k in kinds) else "double" if numbers else "string"
    out = None
    for df in frames:
        df = df.select(*[named(c).cast(wide[c]).alias(c) if c in wide else named(c) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


@dataclass
class Graph:
    """Nodes by label and edges by type, both immutable; writing makes a new graph.

    histories hold all versions where there are any (operators.versions); embeddings and references hold vectors
    (operators.retrieval); indexes is the catalogue of CREATE INDEX.
    """

    spark: SparkSession
    nodes: dict[str, Nodes] = field(default_factory=dict)
    edges: dict[str, Edges] = field(default_factory=dict)
    node_vectors: DataFrame | None = None
    edge_vectors: DataFrame | None = None
    references: DataFrame | None = None
    history: object | None = None
    indexes: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    sketches: dict = field(default_factory=dict)
    cached: dict = field(default_factory=dict)
    built: dict = field(default_factory=dict)

    @classmethod
    def of(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame | None = None) -> Graph:
        """From two tables: nodes (id, label, properties) and edges (source, target, type, properties, perhaps id).

        Labels and types are looked up with one distinct each; properties that a label never has are left out.
        """

        def split(df: DataFrame, key: str, fixed: tuple) -> dict[str, DataFrame]:
            props = [c for c in df.columns if c not in (*fixed, key)]
            seen = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count(named(p)).alias(f"n{i}") for i, p in enumerate(props)]).collect()
            out = {}
            for row in sorted(seen, key=lambda r: str(r[key])):
                keep = [p for i, p in enumerate(props) if row[f"n{i}"]]
                out[row[key]] = df.where(named(key) == row[key]).select(*[c for c in fixed if c in df.columns and c != key], *[named(p) for p in keep])
            return out

        by_label = split(nodes, "label", NODE_COLUMNS)
        by_type = {}
        if edges is not None:
            if "id" not in edges.columns:
                edges = edges.withColumn("id", F.xxhash64(*[named(c) for c in edges.columns]))
            by_type = split(edges, "type", EDGE_COLUMNS)
        return cls(spark, {k: Nodes(v) for k, v in by_label.items()}, {k: Edges(v) for k, v in by_type.items()})

    def but(self, **changes) -> Graph:
        # What is stored of an index holds as long as the nodes do; after a write it is made anew when it is asked for.
        if "nodes" in changes:
            changes["built"] = {}
        return replace(self, cached={}, **changes)

    # tables

    def node_table(self, label: str | None = None) -> DataFrame:
        """(id, label, kind, properties) of one label or of all."""
        if label is not None:
            if label in self.nodes:
                return self.nodes[label].table(label)
            kind = self.id_type
            return self.spark.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("label", T.StringType()), T.StructField("kind", T.StringType())]))
        return together([n.table(k) for k, n in self.nodes.items()]) if self.nodes else self.node_table("")

    def edge_table(self, kind: str | None = None) -> DataFrame:
        """(id, source, target, type, properties) of one type or of all."""
        if kind is not None:
            if kind in self.edges:
                return self.edges[kind].table(kind)
            t = self.id_type
            return self.spark.createDataFrame([], T.StructType([T.StructField("id", T.LongType()), T.StructField("source", t), T.StructField("target", t), T.StructField("type", T.StringType())]))
        return together([e.table(k) for k, e in self.edges.items()]) if self.edges else self.edge_table("")

    @property
    def id_type(self) -> T.DataType:
        return next((n.frame.schema["id"].dataType for n in self.nodes.values()), T.LongType())

    def subgraph(self, ids: DataFrame) -> Graph:
        """The nodes whose id is in ``ids`` and the edges that have both ends there."""
        ids = ids.select(named(ids.columns[0]).alias("id")).distinct()
        inside = {k: replace(n, frame=n.frame.join(ids, "id", "left_semi")) for k, n in self.nodes.items()}
        ends = {}
        for k, e in self.edges.items():
            f = e.frame.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
            ends[k] = replace(e, frame=f.join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
        return self.but(nodes=inside, edges=ends)

    # queries

    def run(self, text: str):
        """Run a statement of the pattern language."""
        from graphloom.plans.statements import execute

        return execute(self, text)

    def query(self, text: str) -> DataFrame:
        """The lazy result of a FIND statement."""
        from graphloom.plans.compile import compile_query
        from graphloom.plans.syntax import Query, parse

        tree = parse(text)
        if not isinstance(tree, Query):
            raise ValueError("not a query")
        return compile_query(self, tree)

    # what there is

    def labels(self) -> list[str]:
        return sorted(self.nodes)

    def edge_types(self) -> list[str]:
        return sorted(self.edges)

    def schema(self) -> DataFrame:
        """(kind, name, property, type, filled, total): a row a property of a label or a type, and one with no
        property for each label and type. One aggregation a table."""
        parts = []
        for what, tables in (("node", self.nodes), ("edge", self.edges)):
            for name, t in tables.items():
                props = t.properties
                counts = t.frame.agg(F.count(F.lit(1)).alias("n"), *[F.count(named(p)).alias(f"c{i}") for i, p in enumerate(props)])
                rows = [F.struct(F.lit(None).cast("string").alias("property"), F.lit(None).cast("string").alias("type"), F.col("n").alias("filled"))]
                rows += [F.struct(F.lit(p).alias("property"), F.lit(k.simpleString()).alias("type"), F.col(f"c{i}").alias("filled")) for i, (p, k) in enumerate(props.items())]
                parts.append(counts.select("n", F.explode(F.array(*rows)).alias("x")).select(F.lit(what).alias("kind"), F.lit(name).alias("name"), "x.property", "x.type", "x.filled", F.col("n").alias("total")))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def find(self, label: str | None, **equal) -> DataFrame:
        """Nodes of a label, or of all labels that have the properties, by their values (get_node_by_property and its
        kin). The filter is in each label's scan."""

        def one(name: str) -> DataFrame:
            df = self.node_table(name)
            for k, v in equal.items():
                df = df.where(named(k) == F.lit(v)) if k in df.columns else df.limit(0)
            return df

        if label is not None:
            return one(label)
        have = [k for k, n in self.nodes.items() if set(equal) <= set(n.properties)]
        return together([one(k) for k in have]) if have else self.node_table("")

    def find_edges(self, kind: str | None, **equal) -> DataFrame:
        """Edges of a type, or of all types that have the properties, by their values."""
        kinds = [kind] if kind is not None else [k for k, e in self.edges.items() if set(equal) <= set(e.properties)]
        out = []
        for k in kinds:
            df = self.edge_table(k)
            for p, v in equal.items():
                df = df.where(named(p) == F.lit(v)) if p in df.columns else df.limit(0)
            out.append(df)
        return together(out) if out else self.edge_table("")

"""Small graphs as literals."""

from pyspark.sql import functions as F

from graphloom.model import Graph


def graph(spark, nodes, edges, node_schema, edge_schema=""):
    """nodes: (id, label, properties...), edges: (source, target, type, properties...); ids are numbers."""
    n = spark.createDataFrame(nodes, "id long, label string" + (", " + node_schema if node_schema else ""))
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "id long, source long, target long, type string" + (", " + edge_schema if edge_schema else ""))
    return Graph.of(spark, n, e)


def people(spark, pairs, names="Alice Bob Charlie Diana".split(), kind="KNOWS"):
    return graph(spark, [(i, "Person", n) for i, n in enumerate(names)], [(a, b, kind) for a, b in pairs], "name string")


def column(df, name=None):
    return sorted(r[0] for r in (df.select(F.col(f"`{name}`")) if name else df).collect())

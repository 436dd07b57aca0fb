"""The star schema's tables as a graph."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import Edges, Graph, Nodes

#: A node's id is its key times 16 plus its label's number: one long, the same in every run, without a shuffle.
CODES = {"Region": 0, "Nation": 1, "Customer": 2, "Supplier": 3, "Order": 4, "Part": 5, "User": 6, "Event": 7, "Vector": 8, "Document": 9}


def node_id(label: str, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return key.cast("long") * 16 + CODES[label]


def nodes_of(df: DataFrame, label: str, prefix: str, key: str, **renamed: str) -> Nodes:
    """Columns lose their prefix; the key stays as the property ``key``."""
    props = [F.col(c).alias(renamed.get(c, "key" if c == key else c.removeprefix(prefix))) for c in df.columns]
    return Nodes(df.select(node_id(label, key).alias("id"), *props))


def edges_of(df: DataFrame, a: str, source: Column | str, b: str, target: Column | str, *props: Column) -> Edges:
    """Edges between the nodes that the two keys name; an edge's id is a hash of its ends and properties."""
    ends = df.select(node_id(a, source).alias("source"), node_id(b, target).alias("target"), *props)
    return Edges(ends.select(F.xxhash64(*ends.columns).alias("id"), "*"), a, b)


def star(spark: SparkSession, folder: str, only: set[str] | None = None) -> Graph:
    """The graph of the tables in ``folder``; ``only``: labels and types to take, by default all but SIMILAR."""
    read = cache(lambda t: spark.read.parquet(f"{folder}/{t}.parquet"))
    want = lambda x: only is None or x in only
    nodes, edges = {}, {}
    for label, table, prefix, key in (("Region", "region", "r_", "r_regionkey"), ("Nation", "nation", "n_", "n_nationkey"), ("Customer", "customer", "c_", "c_custkey"), ("Supplier", "supplier", "s_", "s_suppkey"), ("Part", "part", "p_", "p_partkey"), ("Order", "orders", "o_", "o_orderkey")):
        if want(label):
            nodes[label] = nodes_of(read(table), label, prefix, key)
    if want("Event"):
        nodes["Event"] = nodes_of(read("events"), "Event", "", "event_id")
    if want("User"):
        nodes["User"] = Nodes(read("events").select("user_id").distinct().select(node_id("User", "user_id").alias("id"), F.col("user_id").alias("key")))
    if want("Vector"):
        nodes["Vector"] = Nodes(read("embeddings").select(node_id("Vector", "vec_id").alias("id"), F.col("vec_id").alias("key"), F.col("label").alias("cls")))
    if want("Document"):
        nodes["Document"] = nodes_of(read("documents"), "Document", "", "doc_id")
    for kind, table, a, source, b, target in (("IN_REGION", "nation", "Nation", "n_nationkey", "Region", "n_regionkey"), ("LIVES_IN", "customer", "Customer", "c_custkey", "Nation", "c_nationkey"), ("BASED_IN", "supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey"), ("PLACED", "orders", "Customer", "o_custkey", "Order", "o_orderkey"), ("DID", "events", "User", "user_id", "Event", "event_id")):
        if want(kind):
            edges[kind] = edges_of(read(table), a, source, b, target)
    if want("CONTAINS"):
        props = [F.col(f"l_{c}").alias(n) for c, n in (("quantity", "qty"), ("extendedprice", "price"), ("discount", "discount"), ("tax", "tax"), ("returnflag", "returnflag"), ("linenumber", "line"), ("shipdate", "shipdate"))]
        edges["CONTAINS"] = edges_of(read("lineitem"), "Order", "l_orderkey", "Part", "l_partkey", *props)
    if want("SUPPLIES"):
        edges["SUPPLIES"] = edges_of(read("lineitem").select("l_suppkey", "l_partkey").distinct(), "Supplier", "l_suppkey", "Part", "l_partkey")
    if want("NEXT"):
        after = Window.partitionBy("user_id").orderBy("ts", "event_id")
        step = read("events").withColumn("next", F.lead("event_id").over(after)).where("next is not null")
        edges["NEXT"] = edges_of(step, "Event", "event_id", "Event", "next")
    g = Graph(spark, nodes, edges)
    if want("Vector"):
        g.node_vectors = read("embeddings").select(node_id("Vector", "vec_id").alias("id"), F.lit("default").alias("model"), F.col("embedding").alias("vector"))
    return g


def transitions(spark: SparkSession, folder: str) -> Graph:
    """A small directed cyclic graph of (event type) -> (event type), as it follows for some user, with its count."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.withColumn("next", F.lead("event_type").over(after)).where("next is not null").groupBy("event_type", "next").agg(F.count(F.lit(1)).alias("times"))
    names = events.select(F.col("event_type").alias("id")).distinct().withColumn("name", F.col("id"))
    step = pairs.select(F.xxhash64("event_type", "next").alias("id"), F.col("event_type").alias("source"), F.col("next").alias("target"), "times")
    return Graph(spark, {"Kind": Nodes(names)}, {"THEN": Edges(step, "Kind", "Kind")})


def trade(spark: SparkSession, folder: str) -> Graph:
    """Orders, parts and suppliers, each two linked by the lines that name both: a graph that grows with the lines and
    has triangles. ``qty`` is a line's quantity between order and part, 1 and 2 on the others. Lines that name the same two
    are parallel edges, as in its SQL: none of the algorithms that run on it tells them apart."""
    g = star(spark, folder, {"Order", "Part", "Supplier"})
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    one = edges_of(lines, "Order", "l_orderkey", "Part", "l_partkey", F.col("l_quantity").alias("qty"))
    two = edges_of(lines, "Supplier", "l_suppkey", "Part", "l_partkey", F.lit(1.0).alias("qty"))
    three = edges_of(lines, "Supplier", "l_suppkey", "Order", "l_orderkey", F.lit(2.0).alias("qty"))
    return g.but(edges={"CONTAINS": one, "SUPPLIES": two, "SHIPS": three})


def supply(spark: SparkSession, folder: str) -> Graph:
    """Nations and the nations that they buy parts from: a directed, cyclic graph with weights, by two joins."""
    orders, lines = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "lineitem"))
    customer, supplier, nation = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("customer", "supplier", "nation"))
    # Lines are summed by order and supplier before nations are looked up.
    trade = lines.groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    full = trade.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = full.groupBy("c_nationkey", "s_nationkey").agg(F.sum("n").alias("lines"))
    return Graph(spark, {"Nation": nodes_of(nation, "Nation", "n_", "n_nationkey")}, {"BUYS_FROM": edges_of(pairs, "Nation", "c_nationkey", "Nation", "s_nationkey", F.col("lines"))})

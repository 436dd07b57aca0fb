"""Queries over the graph that the star-schema tables hold, and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Edges, Graph, Nodes, named
from graphloom.operators import algorithms, community, ontology, retrieval, shapes, traversal, versions
from graphloom.sources import files
from graphloom.queries_operators import EXTRA, hybrid_where_q
from graphloom.sources.star import node_id, star, supply, trade, transitions

FLAGSHIP = 'find n.name as name, count(*) as orders, sum(o.totalprice) as revenue from (n:Nation)<-[:LIVES_IN]-(c:Customer)-[:PLACED]->(o:Order) where o.orderstatus = "F" group by n.name having count(*) > 1 order by revenue desc'

#: name: (graph, statement, SQL). Sums of doubles are rounded on either side, as their order differs.
TEXTS: dict[str, tuple[Callable, str, str]] = {
    "flagship": (star, FLAGSHIP, "SELECT n_name AS name, count(*) AS orders, sum(o_totalprice) AS revenue FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY n_name HAVING count(*) > 1"),
    "node_scan": (star, 'find c.key as k, c.name as name, c.acctbal as bal from (c:Customer)', "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer"),
    "inline_properties": (star, 'find c.key as k from (c:Customer {mktsegment: "BUILDING"}) where c.acctbal > 5000.0 and not (c.nationkey = 3)', "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AND NOT c_nationkey = 3"),
    "boolean_arithmetic": (star, "find p.key as k, p.size * 2 + 1 as s, -p.retailprice / 4 as q, p.size % 7 as m from (p:Part) where (p.size > 40 or p.size < 3) and !(p.size % 2 = 0)", "SELECT p_partkey AS k, CAST(p_size * 2 + 1 AS BIGINT) AS s, -p_retailprice / 4 AS q, CAST(p_size % 7 AS BIGINT) AS m FROM part WHERE (p_size > 40 OR p_size < 3) AND NOT p_size % 2 = 0"),
    "missing_property": (star, "find n.key as k from (n:Nation) where not (n.nothing = 1) and not (n.nothing != 1)", "SELECT n_nationkey AS k FROM nation"),
    "typed_equality": (star, 'find n.key as k from (n:Nation) where n.key != "3" and n.key = 4.0', "SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 4"),
    "wildcard": (star, "find * from (r:Region)", 'SELECT r_regionkey AS "r.key", r_name AS "r.name", \'Region\' AS "r.label", CAST(r_regionkey AS BIGINT) * 16 AS "r.id" FROM region'),
    "all_of_edge": (star, 'find all(e), n.name as nation from (n:Nation)-[e:IN_REGION]->(r:Region {name: "ASIA"})', "SELECT 'IN_REGION' AS \"e.type\", 0 AS \"e.id\", n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "single_hop": (star, "find c.name as name, o.totalprice as price from (c:Customer)-[r:PLACED]->(o:Order) where o.totalprice > 400000", "SELECT c_name AS name, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000"),
    "incoming_hop": (star, "find o.key as o, c.key as c from (o:Order)<-[:PLACED]-(c:Customer) where c.acctbal < 0", "SELECT o_orderkey AS o, c_custkey AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0"),
    "undirected_hop": (star, 'find a.key as a, count(*) as n from (a:Event)<->[:NEXT](b:Event) where b.value > 100.0 group by a.key'.replace("<->[:NEXT]", "<-[:NEXT]->"), "WITH s AS (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT a, b FROM s WHERE b IS NOT NULL UNION ALL SELECT b, a FROM s WHERE b IS NOT NULL) SELECT a, count(*) AS n FROM e JOIN events v ON v.event_id = b WHERE v.value > 100 GROUP BY a"),
    "edge_properties": (star, 'find o.key as o, p.name as part, e.price as price from (o:Order)-[e:CONTAINS {returnflag: "R"}]->(p:Part) where e.qty >= 45 and p.size > 25', "SELECT l_orderkey AS o, p_name AS part, l_extendedprice AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_quantity >= 45 AND p_size > 25"),
    "two_hops_grouped": (star, "find c.mktsegment as segment, p.type as type, count(e.qty) as n, sum(e.qty) as qty, avg(e.price) as mean, min(p.size) as low, max(p.size) as high from (c:Customer)-[:PLACED]->(o:Order)-[e:CONTAINS]->(p:Part) group by c.mktsegment, p.type", "SELECT c_mktsegment AS segment, p_type AS type, count(l_quantity) AS n, sum(l_quantity) AS qty, round(avg(l_extendedprice), 4) AS mean, min(p_size) AS low, max(p_size) AS high FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2"),
    "global_aggregates": (star, "find count(*) as n, sum(o.totalprice) as total, avg(o.totalprice) as mean, min(o.orderstatus) as low, max(o.orderdate) as last from (o:Order)", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_orderstatus) AS low, max(o_orderdate) AS last FROM orders"),
    "empty_aggregate": (star, "find count(*) as n, sum(o.totalprice) as total, avg(o.totalprice) as mean from (o:Order) where o.totalprice < 0", "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0.0) AS total, avg(o_totalprice) AS mean FROM orders WHERE o_totalprice < 0"),
    "having_alias": (star, "find c.key as c, count(*) as n from (c:Customer)-[:PLACED]->(o:Order) group by c.key having n > 12 and max(o.totalprice) > 300000", "SELECT c_custkey AS c, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 300000"),
    "pattern_join": (star, "find n.name as nation, count(*) as pairs from (c:Customer)-[:LIVES_IN]->(n:Nation), (s:Supplier)-[:BASED_IN]->(n) where c.acctbal < s.acctbal group by n.name", "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal < s_acctbal GROUP BY 1"),
    "cyclic_pattern": (star, "find count(*) as n from (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part)<-[:SUPPLIES]-(s:Supplier)-[:BASED_IN]->(n:Nation), (c)-[:LIVES_IN]->(n)", "SELECT count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) ON pk = l_partkey JOIN supplier ON s_suppkey = sk AND s_nationkey = c_nationkey"),
    "cross_product": (star, "find r.name as region, n.name as nation from (r:Region), (n:Nation) where n.key < r.key", "SELECT r_name AS region, n_name AS nation FROM region, nation WHERE n_nationkey < r_regionkey"),
    "repeated_variable": (transitions, "find a.name as a, e.times as n from (a:Kind)-[e:THEN]->(a)", "WITH s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT a, count(*) AS n FROM s WHERE a = b GROUP BY a"),
    "distinct_ordered": (star, "find distinct c.mktsegment as segment, n.name as nation from (c:Customer)-[:LIVES_IN]->(n:Nation) order by nation desc, segment limit 40 offset 7", "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY nation DESC, segment LIMIT 40 OFFSET 7"),
    "order_by_hidden": (star, "find o.key as k from (o:Order) order by o.totalprice desc, o.key limit 25 offset 3", "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 3"),
    "quantified_chain": (star, "find a.key as a, b.key as b, path.depth as d from (a:Event)-[:NEXT]->{2,4}(b:Event) where a.value > 150.0", "WITH s AS (SELECT event_id AS a, lead(event_id, 2) OVER w AS b2, lead(event_id, 3) OVER w AS b3, lead(event_id, 4) OVER w AS b4, value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT a, b, d FROM (SELECT a, b2 AS b, CAST(2 AS BIGINT) AS d, value FROM s UNION ALL SELECT a, b3, 3, value FROM s UNION ALL SELECT a, b4, 4, value FROM s) WHERE b IS NOT NULL AND value > 150"),
}

WAYS = """WITH RECURSIVE s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
e AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY a, b),
w AS (SELECT a AS first, b AS last, [a, b] AS seen, [n] AS ns, CAST(1 AS BIGINT) AS d FROM e WHERE a <> b
UNION ALL SELECT first, b, list_append(seen, b), list_append(ns, n), d + 1 FROM w JOIN e ON a = last WHERE d < 3 AND NOT list_contains(seen, b)) """
TEXTS |= {
    "quantified_cycles": (transitions, "find a.name as a, b.name as b, path.depth as d, path.nodes as seen from (a:Kind)-[:THEN]->{2,3}(b:Kind)", WAYS + "SELECT first AS a, last AS b, d, array_to_string(seen, '>') AS seen FROM w WHERE d >= 2"),
    "path_reducers": (transitions, 'find a.name as a, b.name as b, path_sum("times") as s, path_min("times") as lo, path_max("times") as hi, path_avg("times") as mean from (a:Kind)-[:THEN]->{1,3}(b:Kind) where path_sum("times") > 100', WAYS + "SELECT first AS a, last AS b, CAST(list_sum(ns) AS BIGINT) AS s, list_min(ns) AS lo, list_max(ns) AS hi, list_avg(ns) AS mean FROM w WHERE list_sum(ns) > 100"),
    "path_machine": (transitions, 'find a.name as a, b.name as b, path_eval("total - first") as rest, path.state as state from (a:Kind)-[:THEN]->{1,3}(b:Kind) where path_eval("hops >= 2 and total > 50") init "total = 0" init "hops = 0" init "first = -1" gather "total = total + edge.times" gather "hops = hops + 1" gather "first = first + 1"', WAYS + "SELECT first AS a, last AS b, CAST(list_sum(ns) - (d - 1) AS BIGINT) AS rest, d AS hops FROM w WHERE d >= 2 AND list_sum(ns) > 50"),
    "path_return": (transitions, 'find a.name as a, path.result as ratio from (a:Kind)-[:THEN]->{1,2}(b:Kind) where path.result > 0.1 init "total = 0" gather "total = total + edge.times" return "total / (path.depth * 100)"', WAYS + "SELECT first AS a, list_sum(ns) / (d * 100) AS ratio FROM w WHERE d <= 2 AND list_sum(ns) / (d * 100) > 0.1"),
    "mixed_hops": (transitions, "find a.name as a, b.name as b, count(*) as n from (a:Kind)-[e:THEN]->(m:Kind)-[:THEN]->{1,2}(b:Kind) where e.times > 3 group by a.name, b.name", WAYS + "SELECT e.a AS a, w.last AS b, count(*) AS n FROM e JOIN w ON w.first = e.b WHERE e.n > 3 AND d <= 2 GROUP BY 1, 2"),
}
ROUNDED = {"two_hops_grouped": {"mean": 4}, "global_aggregates": {"total": 2, "mean": 4}}


def text_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    make, text, _ = TEXTS[name]
    mentioned = set(re.findall(r":(\w+)", text))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = star(spark, sf_dir, mentioned) if make is star else make(spark, sf_dir)
        df = g.query(text)
        if name == "quantified_cycles":
            df = df.withColumn("seen", F.array_join(F.transform("seen", lambda x: x["id"]), ">"))
        if name == "path_machine":
            df = df.withColumn("hops", F.col("state.hops")).drop("state")
        if name == "all_of_edge":
            df = df.withColumn("e.id", F.lit(0))
        return df.withColumns({c: F.round(named(c), n) for c, n in ROUNDED.get(name, {}).items()})

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_query("flagship")(spark, sf_dir)


# --- algorithms ------------------------------------------------------------------------------------------------------

STEPS = "WITH s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY a, b)"
BUYS = "WITH RECURSIVE e AS (SELECT c_nationkey AS a, s_nationkey AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def purchases(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders, parts and suppliers as one graph: the large one that algorithms run on."""
    return star(spark, sf_dir, {"Order", "Part", "Supplier", "CONTAINS", "SUPPLIES"})


def heavy(g: Graph) -> Graph:
    """The trade between nations that is above the mean."""
    e = g.edges["BUYS_FROM"]
    mean = e.frame.agg(F.avg("lines").alias("mean"))
    return g.but(edges={"BUYS_FROM": Edges(e.frame.crossJoin(mean).where("lines > mean").drop("mean"), "Nation", "Nation")})


TRADE = "WITH RECURSIVE nodes AS (SELECT o_orderkey * 16 + 4 AS id FROM orders UNION ALL SELECT p_partkey * 16 + 5 FROM part UNION ALL SELECT s_suppkey * 16 + 3 FROM supplier), h AS (SELECT l_orderkey * 16 + 4 AS a, l_partkey * 16 + 5 AS b, l_quantity AS q FROM lineitem UNION ALL SELECT l_suppkey * 16 + 3, l_partkey * 16 + 5, 1.0 FROM lineitem UNION ALL SELECT l_suppkey * 16 + 3, l_orderkey * 16 + 4, 2.0 FROM lineitem), u AS (SELECT a, b, min(q) AS n FROM (SELECT a, b, q FROM h UNION ALL SELECT b, a, q FROM h) GROUP BY a, b)"
KC = "SELECT id // 16 AS k, CAST(id % 16 AS INT) AS code, "
HEAVY = BUYS + ", h AS (SELECT a, b, n FROM e WHERE n > (SELECT avg(n) FROM e)), u AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM h UNION ALL SELECT b, a FROM h)), v AS (SELECT a, b FROM u WHERE a <> b)"


def keyed(df: DataFrame, value: str, digits: int | None = None) -> DataFrame:
    v = F.col(value) if digits is None else F.round(value, digits)
    return df.select((F.col("id") / 16).cast("bigint").alias("k"), (F.col("id") % 16).cast("int").alias("code"), v.alias(value))


def degree_q(spark, sf_dir):
    return keyed(algorithms.degree(purchases(spark, sf_dir)), "degree")


def pagerank_q(spark, sf_dir):
    return keyed(algorithms.pagerank(purchases(spark, sf_dir), most=10, tolerance=0), "pagerank", 9)


def _ranks(rounds: int, start: str, own: str, head: str) -> str:
    parts = [head, f"r0 AS (SELECT id, {start} AS r FROM nodes)"]
    for i in range(rounds):
        parts.append(f"r{i + 1} AS (SELECT nodes.id, 0.15 * {own} + 0.85 * coalesce(x, 0) AS r FROM nodes LEFT JOIN (SELECT b, sum(r / o) AS x FROM links JOIN outs USING (a) JOIN r{i} ON a = id GROUP BY b) ON b = nodes.id)")
    return ", ".join(parts)


PURCHASES = "WITH nodes AS (SELECT o_orderkey * 16 + 4 AS id FROM orders UNION ALL SELECT p_partkey * 16 + 5 FROM part UNION ALL SELECT s_suppkey * 16 + 3 FROM supplier), links AS (SELECT l_orderkey * 16 + 4 AS a, l_partkey * 16 + 5 AS b FROM lineitem UNION ALL SELECT DISTINCT l_suppkey * 16 + 3, l_partkey * 16 + 5 FROM lineitem), outs AS (SELECT a, count(*) AS o FROM links GROUP BY a)"
NATIONS = BUYS.replace("WITH RECURSIVE", "WITH") + ", nodes AS (SELECT n_nationkey AS id FROM nation), links AS (SELECT a, b FROM e), outs AS (SELECT a, count(*) AS o FROM links GROUP BY a)"


def personalised_q(spark, sf_dir):
    g = purchases(spark, sf_dir)
    start = g.node_table("Supplier").where("nationkey = 3").select("id")
    return keyed(algorithms.pagerank(g, most=5, tolerance=0, start=start), "pagerank", 9)


def clustering_q(spark, sf_dir):
    return keyed(algorithms.clustering(trade(spark, sf_dir)), "clustering", 9)


def triangles_q(spark, sf_dir):
    return keyed(algorithms.triangles(trade(spark, sf_dir)), "n")


def betweenness_q(spark, sf_dir):
    return keyed(algorithms.betweenness(heavy(supply(spark, sf_dir))), "betweenness", 9).drop("code")


def components_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Event", "NEXT"})
    return community.components(g).select((F.col("id") / 16).cast("bigint").alias("k"), (F.col("component") / 16).cast("bigint").alias("component"))


def label_propagation_q(spark, sf_dir):
    return keyed(community.community_fast(trade(spark, sf_dir)), "community")


def community_q(spark, sf_dir):
    return community.community(star(spark, sf_dir, {"Event", "NEXT"})).select((F.col("id") / 16).cast("bigint").alias("k"), "community")


def leiden_q(spark, sf_dir):
    return community.leiden(star(spark, sf_dir, {"Event", "NEXT"})).select((F.col("id") / 16).cast("bigint").alias("k"), "community")


def bfs_q(spark, sf_dir):
    return keyed(traversal.bfs(trade(spark, sf_dir), 16 + 3, "both", max_nodes=None).distances, "distance")


def shortest_paths_q(spark, sf_dir):
    return keyed(algorithms.distances(trade(spark, sf_dir), 16 + 3, "qty", "both", parents=False), "distance")


def algorithm_filter_q(spark, sf_dir):
    return supply(spark, sf_dir).query("find n.key as k, degree(n) as d from (n:Nation) where degree(n) > 40")


# --- traversal -------------------------------------------------------------------------------------------------------


def traverse_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Customer", "Order", "Part", "Nation", "PLACED", "CONTAINS", "LIVES_IN"})
    t = traversal.Traversal(g, g.node_table("Nation").where("key = 5").select("id")).in_("LIVES_IN").out("PLACED").out("CONTAINS")
    return t.ids().groupBy((F.col("id") / 16).cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("n"))


def sack_q(spark, sf_dir):
    g = transitions(spark, sf_dir)
    start = g.node_table("Kind").where("id = 'click'").select("id")
    found = traversal.Traversal(g, start).sack(1.0).out_e("THEN").sack_sum_by("times").repeat(max_depth=3, max_nodes=100_000, on_cycle="skip").emit()
    return found.items.select(F.col("id").alias("node"), "sack", F.col("depth").cast("bigint").alias("depth"))


# --- vectors and text -------------------------------------------------------------------------------------------------


def vectors(spark, sf_dir) -> Graph:
    return star(spark, sf_dir, {"Vector"})


def knn_q(spark, sf_dir):
    g = vectors(spark, sf_dir)
    query = retrieval.vector_of(g, 3 * 16 + 8, "default")
    return retrieval.knn(retrieval.vectors_of(g, "default"), query, 10).select((F.col("id") / 16).cast("bigint").alias("k"), F.round("distance", 6).alias("distance"))


def knn_filtered_q(spark, sf_dir):
    g = vectors(spark, sf_dir)
    query = retrieval.vector_of(g, 3 * 16 + 8, "default")
    return retrieval.knn(retrieval.vectors_of(g, "default"), query, 5, g.node_table("Vector").where("cls = 2").select("id")).select((F.col("id") / 16).cast("bigint").alias("k"), F.round("distance", 6).alias("distance"))


def knn_join_q(spark, sf_dir):
    v = retrieval.vectors_of(vectors(spark, sf_dir), "default")
    return retrieval.knn_join(v, v, 3).select((F.col("id") / 16).cast("bigint").alias("k"), (F.col("other") / 16).cast("bigint").alias("other"))


def similar_to_q(spark, sf_dir):
    return vectors(spark, sf_dir).query('find v.key as k, v.cls as cls, has_embedding(v, "default") as h from (v:Vector) where similar_to(v, "56") limit 12')


TERM = "stupid trash"


def full_text_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Document"}).but(indexes={"Document_text": ("Document", "text", "fulltext")})
    return retrieval.bm25(retrieval.text_table(g), TERM, 50).select((F.col("id") / 16).cast("bigint").alias("k"), F.round("score", 6).alias("score"))


DOCS_BM25 = "WITH w AS (SELECT doc_id, [t FOR t IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF t <> ''] AS ws FROM documents), t AS (SELECT doc_id, len(ws) AS l, len([x FOR x IN ws IF x = 'stupid']) AS f0, len([x FOR x IN ws IF x = 'trash']) AS f1 FROM w), s AS (SELECT count(*) AS n, avg(l) AS m, count_if(f0 > 0) AS d0, count_if(f1 > 0) AS d1 FROM t), x AS (SELECT doc_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * l / m)) AS score FROM t, s WHERE f0 + f1 > 0) "


def both_kinds(spark, sf_dir) -> Graph:
    """Documents with the vectors of the same number."""
    g = star(spark, sf_dir, {"Document"})
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return g.but(node_vectors=e.select(node_id("Document", "vec_id").alias("id"), F.lit("default").alias("model"), F.col("embedding").alias("vector")))


def hybrid_q(spark, sf_dir):
    g = both_kinds(spark, sf_dir)
    query = retrieval.vector_of(g, 3 * 16 + 9, "default")
    return retrieval.hybrid(g, TERM, query, k=10, label="Document", text_prop="text").select((F.col("id") / 16).cast("bigint").alias("k"), F.round("score", 9).alias("score"), F.col("text_rank").cast("bigint").alias("text_rank"), F.col("vector_rank").cast("bigint").alias("vector_rank"))


def path_embedding_q(spark, sf_dir):
    """Two-hop ways between vectors of consecutive numbers: the mean of their vectors."""
    g = vectors(spark, sf_dir)
    n = g.nodes["Vector"].frame
    e = n.select(F.xxhash64("id").alias("id"), F.col("id").alias("source"), (F.col("id") + 16).alias("target"))
    ev = e.select("id", F.lit("w").alias("model"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    g = g.but(edges={"AFTER": Edges(e, "Vector", "Vector")}, edge_vectors=ev)
    df = g.query('find a.key as k, path_embedding("default", "w") as v from (a:Vector)-[:AFTER]->(b:Vector)-[:AFTER]->(c:Vector)')
    return df.select("k", F.size("v").cast("bigint").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# --- versions, merging, streams -----------------------------------------------------------------------------------------

DAY = "2024-01-15 00:00:00"


def moods(spark, sf_dir) -> Graph:
    """Users with their last event's type and value, at all times."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    changes = events.select(node_id("User", "user_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("mood"), "value", F.col("ts").alias("at"))
    h = versions.versions_of(changes)
    now = h.where("valid_to is null").drop("valid_from", "valid_to", "version")
    return Graph(spark, {"User": Nodes(now)}, history=versions.History({"User": h}, {}))


def at_timestamp_q(spark, sf_dir):
    import datetime

    t = datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc)
    g = versions.as_of(moods(spark, sf_dir), t)
    return g.query("find u.mood as mood, count(*) as n from (u:User) group by u.mood")


def history_gc_q(spark, sf_dir):
    import datetime

    t = datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc)
    kept, dropped = versions.collected(moods(spark, sf_dir).history.nodes["User"], t, 2)
    return kept.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("kept")).unionByName(dropped.agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("dropped")))


def upsert_q(spark, sf_dir):
    """All customers, with their number of orders before 1996, merged with that of their later ones."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    count = lambda when: orders.where(when).groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("orders"))
    early = count("o_orderdate < date '1996-01-01'")
    base = customers.join(early, F.col("c_custkey") == early.key, "left").select(node_id("Customer", "c_custkey").alias("id"), F.col("c_custkey").alias("key"), F.coalesce("orders", F.lit(0)).cast("bigint").alias("orders"))
    return versions.merged(base, count("o_orderdate >= date '1996-01-01'"), "key").groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.sum("orders").alias("orders"))


def delete_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Customer", "Order", "PLACED"})
    g = g.run("delete (c:Customer) where c.acctbal < 0").graph
    g = g.run('update (o:Order) set o.orderstatus = "X" where o.totalprice > 400000').graph
    return g.query("find o.orderstatus as status, count(*) as n from (c:Customer)-[:PLACED]->(o:Order) group by o.orderstatus")


def stream_q(spark, sf_dir):
    """The events' stream merged into each user's latest state."""
    from graphloom.storage import work_dir
    from graphloom.streaming import upserts
    import uuid

    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    changes = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("mood"))
    upserts.stream_upserts(changes, folder, "key", "ts", "event_id").trigger(availableNow=True).start().awaitTermination()
    return upserts.current(spark, folder).select(F.col("key").alias("user_id"), "mood", "event_id")


def windows_q(spark, sf_dir):
    from graphloom.streaming import upserts

    return upserts.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type", "1 day")


# --- ontology, shapes, schema -------------------------------------------------------------------------------------------


def places(spark, sf_dir) -> DataFrame:
    """(sub, super): nations below regions below the world."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("sub"), F.col("r_name").alias("super")).union(n.select("r_name", F.lit("WORLD")))


def closure_q(spark, sf_dir):
    return ontology.closure(places(spark, sf_dir))


def instance_of_q(spark, sf_dir):
    """Customers labelled by their nation, where the nation is below a region."""
    edges = places(spark, sf_dir).distinct()
    names = edges.select(F.col("sub").alias("n")).union(edges.select("super")).distinct()
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    nodes = customers.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("n_name").alias("label"), F.lit("Individual").alias("kind"), F.lit(None).cast("string").alias("name"))
    nodes = nodes.union(names.select("n", F.lit("Class"), F.lit("Class"), "n"))
    links = edges.select(F.col("sub").alias("source"), F.col("super").alias("target"), F.lit("subClassOf").alias("type"))
    g = Graph.of(spark, nodes, links)
    return g.query('find x.label as nation, count(*) as n from (x) where instanceOf(x, "ASIA") group by x.label')


SHAPE = shapes.Shape("customer", (shapes.PropertyShape(shapes.Path("acctbal"), (shapes.Constraint("minInclusive", 0), shapes.Constraint("datatype", "double"))), shapes.PropertyShape(shapes.Path("mktsegment"), (shapes.Constraint("in", ("BUILDING", "FURNITURE", "MACHINERY")),)), shapes.PropertyShape(shapes.Path(edge="PLACED"), (shapes.Constraint("maxCount", 15),))), target_class="Customer")


def shapes_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Customer", "Order", "PLACED"})
    return shapes.violations(g, [SHAPE]).groupBy("path", "message").agg(F.count(F.lit(1)).alias("n"))


def schema_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Region", "Nation", "IN_REGION", "Order"})
    return g.schema().where("property is null").select("kind", "name", F.col("total").alias("n"))


def tensors_q(spark, sf_dir):
    t = files.tensors(star(spark, sf_dir, {"Nation", "Region", "IN_REGION"}), ["Region", "Nation"], ["key"])
    n = t.nodes.select("index", ((F.col("id") % 16) == 1).alias("nation"), F.col("features")[0].alias("key"))
    ends = t.edges.join(n.select(F.col("index").alias("source"), F.col("key").alias("n")), "source").join(n.select(F.col("index").alias("target"), F.col("key").alias("r")), "target")
    return ends.select(F.col("n").cast("int").alias("n"), F.col("r").cast("int").alias("r"), "source", "target")


OTHERS: dict[str, tuple[Callable, str | None]] = {
    "degree": (degree_q, PURCHASES + " SELECT id // 16 AS k, CAST(id % 16 AS INT) AS code, CAST(coalesce(n, 0) AS DOUBLE) AS degree FROM nodes LEFT JOIN (SELECT x, count(*) AS n FROM (SELECT a AS x FROM links UNION ALL SELECT b FROM links) GROUP BY x) ON x = id"),
    "pagerank": (pagerank_q, _ranks(10, "1.0 / (SELECT count(*) FROM nodes)", "(1.0 / (SELECT count(*) FROM nodes))", PURCHASES) + " SELECT id // 16 AS k, CAST(id % 16 AS INT) AS code, round(r, 9) AS pagerank FROM r10"),
    "personalised_pagerank": (personalised_q, _ranks(5, "CASE WHEN id IN (SELECT s_suppkey * 16 + 3 FROM supplier WHERE s_nationkey = 3) THEN 1.0 / (SELECT count(*) FROM supplier WHERE s_nationkey = 3) ELSE 0 END", "(CASE WHEN nodes.id IN (SELECT s_suppkey * 16 + 3 FROM supplier WHERE s_nationkey = 3) THEN 1.0 / (SELECT count(*) FROM supplier WHERE s_nationkey = 3) ELSE 0 END)", PURCHASES) + " SELECT id // 16 AS k, CAST(id % 16 AS INT) AS code, round(r, 9) AS pagerank FROM r5"),
    "clustering": (clustering_q, TRADE + ", d AS (SELECT a, count(*) AS d FROM u GROUP BY a), o AS (SELECT u.a, u.b FROM u JOIN d x ON x.a = u.a JOIN d y ON y.a = u.b WHERE x.d < y.d OR (x.d = y.d AND u.a < u.b)), t AS (SELECT x.a, x.b, y.b AS c FROM o x JOIN o y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b), t3 AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id) " + KC + "round(CASE WHEN d.d >= 2 THEN 2.0 * coalesce(n, 0) / (d.d * (d.d - 1)) ELSE 0 END, 9) AS clustering FROM nodes LEFT JOIN d ON d.a = id LEFT JOIN t3 USING (id)"),
    "triangles": (triangles_q, TRADE + ", d AS (SELECT a, count(*) AS d FROM u GROUP BY a), o AS (SELECT u.a, u.b FROM u JOIN d x ON x.a = u.a JOIN d y ON y.a = u.b WHERE x.d < y.d OR (x.d = y.d AND u.a < u.b)), t AS (SELECT x.a, x.b, y.b AS c FROM o x JOIN o y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b), t3 AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id) " + KC + "n FROM t3"),
    "betweenness": (betweenness_q, None),
    "components": (components_q, "SELECT event_id AS k, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS component FROM events"),
    "label_propagation": (label_propagation_q, TRADE + ", l0 AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS l FROM nodes), l1 AS (SELECT id, coalesce(best, l) AS l FROM l0 LEFT JOIN (SELECT a, first(l ORDER BY n DESC, l) AS best FROM (SELECT u.a, x.l, count(*) AS n FROM u JOIN l0 x ON x.id = u.b WHERE u.a <> u.b GROUP BY 1, 2) GROUP BY a) ON a = id), l2 AS (SELECT id, coalesce(best, l) AS l FROM l1 LEFT JOIN (SELECT a, first(l ORDER BY n DESC, l) AS best FROM (SELECT u.a, x.l, count(*) AS n FROM u JOIN l1 x ON x.id = u.b WHERE u.a <> u.b GROUP BY 1, 2) GROUP BY a) ON a = id), l3 AS (SELECT id, coalesce(best, l) AS l FROM l2 LEFT JOIN (SELECT a, first(l ORDER BY n DESC, l) AS best FROM (SELECT u.a, x.l, count(*) AS n FROM u JOIN l2 x ON x.id = u.b WHERE u.a <> u.b GROUP BY 1, 2) GROUP BY a) ON a = id) " + KC + "dense_rank() OVER (ORDER BY l) - 1 AS community FROM l3"),
    "community": (community_q, None),
    "leiden": (leiden_q, None),
    "bfs": (bfs_q, TRADE + ", w AS (SELECT CAST(19 AS BIGINT) AS id, 0 AS d UNION SELECT b, d + 1 FROM w JOIN u ON a = id WHERE d < 6) " + KC + "CAST(min(d) AS INT) AS distance FROM w GROUP BY id"),
    "weighted_distances": (shortest_paths_q, TRADE + ", w AS (SELECT CAST(19 AS BIGINT) AS id, CAST(0 AS DOUBLE) AS d, 0 AS i UNION ALL SELECT b, min(d + n), i + 1 FROM w JOIN u ON a = id WHERE i < 9 GROUP BY b, i) " + KC + "min(d) AS distance FROM w GROUP BY id"),
    "algorithm_filter": (algorithm_filter_q, BUYS + ", x AS (SELECT k, count(*) AS d FROM (SELECT a AS k FROM e UNION ALL SELECT b FROM e) GROUP BY k) SELECT CAST(k AS INT) AS k, CAST(d AS DOUBLE) AS d FROM x WHERE d > 40"),
    "traversal": (traverse_q, "SELECT l_partkey AS part, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_nationkey = 5 GROUP BY 1"),
    "sack": (sack_q, WAYS + "SELECT last AS node, CAST(list_sum(ns) + 1 AS DOUBLE) AS sack, d AS depth FROM w WHERE first = 'click'"),
    "knn": (knn_q, "SELECT vec_id AS k, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS distance FROM embeddings ORDER BY distance, k LIMIT 10"),
    "knn_filtered": (knn_filtered_q, "SELECT vec_id AS k, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS distance FROM embeddings WHERE label = 2 ORDER BY distance, k LIMIT 5"),
    "knn_join": (knn_join_q, "SELECT k, other FROM (SELECT a.vec_id AS k, b.vec_id AS other, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= 3"),
    "similar_to": (similar_to_q, "SELECT vec_id AS k, label AS cls, true AS h FROM (SELECT vec_id, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS d FROM embeddings ORDER BY d, vec_id LIMIT 12)"),
    "full_text": (full_text_q, DOCS_BM25 + "SELECT doc_id AS k, round(score, 6) AS score FROM x ORDER BY x.score DESC, doc_id LIMIT 50"),
    "hybrid": (hybrid_q, DOCS_BM25 + ", a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS r FROM x ORDER BY r LIMIT 40), b AS (SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) - 1 AS r FROM (SELECT vec_id, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS d FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) ORDER BY r LIMIT 40) SELECT coalesce(doc_id, vec_id) AS k, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 9) AS score, a.r AS text_rank, b.r AS vector_rank FROM a FULL JOIN b ON doc_id = vec_id ORDER BY coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) DESC, k LIMIT 10"),
    "path_embedding": (path_embedding_q, "SELECT a.vec_id AS k, CAST(66 AS BIGINT) AS size, round((list_sum(CAST(a.embedding AS DOUBLE[])) + list_sum(CAST(b.embedding AS DOUBLE[])) + list_sum(CAST(c.embedding AS DOUBLE[]))) / 3 + 3, 6) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = b.vec_id + 1"),
    "at_timestamp": (at_timestamp_q, f"SELECT mood, count(*) AS n FROM (SELECT user_id, arg_max(event_type, ts) AS mood FROM events WHERE ts <= TIMESTAMP '{DAY}' GROUP BY 1) GROUP BY 1"),
    "history_collection": (history_gc_q, f"WITH v AS (SELECT lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS till, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events), m AS (SELECT coalesce(till <= TIMESTAMP '{DAY}', false) AND r > 2 AS gone FROM v) SELECT 'kept' AS what, CAST(count_if(NOT gone) AS BIGINT) AS n FROM m UNION ALL SELECT 'dropped', CAST(count_if(gone) AS BIGINT) FROM m"),
    "upsert": (upsert_q, "WITH b AS (SELECT c_custkey AS k, count(o_orderkey) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate < DATE '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, count(*) AS o FROM orders WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1) SELECT CASE WHEN b.k IS NULL THEN 'Created' WHEN n.k IS NULL THEN 'Kept' WHEN n.o <> b.o THEN 'Updated' ELSE 'Unchanged' END AS change, count(*) AS n, CAST(sum(coalesce(n.o, b.o)) AS BIGINT) AS orders FROM b FULL JOIN n ON b.k = n.k GROUP BY 1"),
    "delete_update": (delete_q, "SELECT CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS status, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY 1"),
    "stream_upsert": (stream_q, "SELECT user_id, event_type AS mood, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"),
    "event_windows": (windows_q, "SELECT date_trunc('day', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"),
    "class_closure": (closure_q, "SELECT n_name AS sub, r_name AS super FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region JOIN nation ON n_regionkey = r_regionkey UNION SELECT n_name, 'WORLD' FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "instance_of": (instance_of_q, "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"),
    "shapes": (shapes_q, "SELECT 'acctbal' AS path, 'minInclusive 0' AS message, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'mktsegment', 'in (''BUILDING'', ''FURNITURE'', ''MACHINERY'')', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE', 'MACHINERY') HAVING count(*) > 0 UNION ALL SELECT 'PLACED', 'maxCount 15', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 15) HAVING count(*) > 0"),
    "schema": (schema_q, "SELECT 'node' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Order', count(*) FROM orders UNION ALL SELECT 'edge', 'IN_REGION', count(*) FROM nation"),
    "tensors": (tensors_q, "WITH x AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT n_nationkey * 16 + 1 AS id FROM nation UNION ALL SELECT r_regionkey * 16 FROM region)) SELECT n_nationkey AS n, n_regionkey AS r, a.i AS source, b.i AS target FROM nation JOIN x a ON a.id = n_nationkey * 16 + 1 JOIN x b ON b.id = n_regionkey * 16"),
}
OTHERS["hybrid_where"] = (hybrid_where_q, f"SELECT k FROM ({OTHERS['hybrid'][1]})")


def queries() -> dict:
    return {name: text_query(name) for name in TEXTS} | {name: f for name, (f, _) in {**OTHERS, **EXTRA}.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in TEXTS.items()} | {name: sql for name, (_, sql) in {**OTHERS, **EXTRA}.items() if sql}

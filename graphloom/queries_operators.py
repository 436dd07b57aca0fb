"""Queries for the operators that patterns alone don't reach: statements, files, ontologies, vectors, reads; and their SQL."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.model import Edges, Graph, Nodes
from graphloom.operators import algorithms, community, ontology, retrieval, shapes, traversal, versions
from graphloom.sources import files
from graphloom.sources.star import node_id, star, transitions
from graphloom.storage import work_dir


def key(c: str = "id"):
    return (F.col(c) / 16).cast("bigint")


def folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- statements ------------------------------------------------------------------------------------------------------

SPENT = "find c.mktsegment as segment, sum(o.totalprice) as total from (c:Customer)-[:PLACED]->(o:Order) where o.totalprice > 1000 group by c.mktsegment order by segment limit 3"


def explain_q(spark, sf_dir):
    text = star(spark, sf_dir, {"Customer", "Order", "PLACED"}).run(f"explain {SPENT}").text
    steps = text.split("\n\n")[0].split("\n")
    return table(spark, [(i, s) for i, s in enumerate(steps)] + [(len(steps), "Spark's plan" if "SortMergeJoin" in text or "BroadcastHashJoin" in text else "no join")], "place int, step string")


def profile_q(spark, sf_dir):
    p = star(spark, sf_dir, {"Event", "NEXT"}).run("profile find a.key as a, b.key as b from (a:Event)-[:NEXT]->{1,3}(b:Event) where b.value > 200.0")
    return table(spark, [(int(p.summary["rows"]), int(p.summary["max_depth"]), int(p.summary["bindings_examined"]))], "rows long, max_depth long, examined long")


def add_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Region", "Nation", "IN_REGION"})
    r = g.run('add (n:Nation {name: "MU"})-[:IN_REGION]->(r:Region {name: "LEMURIA"})<-[:IN_REGION]-(m:Nation {name: "YS"})')
    found = r.graph.query("find r.name as region, count(*) as nations from (n:Nation)-[:IN_REGION]->(r:Region) group by r.name")
    return found.withColumn("made", F.lit(r.summary["nodes_created"] + r.summary["edges_created"]))


def sketch_q(spark, sf_dir):
    """A write that is only shown first and then done."""
    g = star(spark, sf_dir, {"Customer", "Order", "PLACED"})
    s = g.run("sketch s = delete (o:Order) where o.totalprice > 200000")
    before = s.graph.query("find count(*) as n from (o:Order)").withColumn("stage", F.lit("sketched"))
    shown = table(spark, [(int(s.summary["rows"]), "touched")], "n long, stage string")
    after = s.graph.run("commit s").graph.query("find count(*) as n from (c:Customer)-[:PLACED]->(o:Order)").withColumn("stage", F.lit("committed"))
    return before.unionByName(shown).unionByName(after)


def danger_q(spark, sf_dir):
    """How dangerous writes are, and what they would touch."""
    g = star(spark, sf_dir, {"Nation"})
    rows = []
    for text in ("delete (n:Nation)", "delete (n:Nation) limit 4", "delete (n:Nation) where n.key > 20"):
        r = g.run(text)
        rows.append((text, r.warning or "none", int(r.graph.nodes["Nation"].frame.count())))
    return table(spark, rows, "statement string, level string, left_over long")


def at_clause_q(spark, sf_dir):
    from graphloom.queries import moods

    ms = int(datetime.datetime(2024, 1, 15, tzinfo=datetime.timezone.utc).timestamp())
    g = moods(spark, sf_dir)
    # With their fractions: what changes within the second that begins at the asked one holds only after it.
    seconds = {"User": g.history.nodes["User"].withColumns({c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) / 1e6D") for c in ("valid_from", "valid_to")})}
    g = g.but(history=versions.History(seconds, {}))
    return g.query(f"find u.mood as mood, count(*) as n, avg(u.value) as mean from (u:User) group by u.mood at timestamp {ms}").withColumn("mean", F.round("mean", 6))


def comments_q(spark, sf_dir):
    text = "FIND p.brand AS brand, Count(*) AS n // the brands\nFROM (p:Part) /* of\nsome parts */ WHERE p.size >= 10 GROUP BY p.brand"
    return star(spark, sf_dir, {"Part"}).query(text)


def bare_q(spark, sf_dir):
    return star(spark, sf_dir, {"Customer", "Nation", "LIVES_IN"}).query('find c as c, n as n from (c:Customer)-[:LIVES_IN]->(n:Nation {name: "NATION_7"})').select(key("c").alias("c"), key("n").alias("n"))


def implicit_group_q(spark, sf_dir):
    return star(spark, sf_dir, {"Order"}).query("find o.orderstatus as status, o.orderpriority as priority, count(*) as n, max(o.totalprice) as high from (o:Order)")


def migration_q(spark, sf_dir):
    """A name of the former language is an error that says what to use."""
    from graphloom.plans.syntax import PatternError

    g = star(spark, sf_dir, {"Nation", "Region", "IN_REGION"})
    said = []
    for text in ('find pattern_embedding_similarity("x") as s from (n:Nation)-[:IN_REGION]->(r:Region)', "find nothing(n) as s from (n:Nation)"):
        try:
            g.query(text)
            said.append((0, "fine"))
        except PatternError as e:
            said.append((1, "path_embedding_similarity" if "path_embedding_similarity" in str(e) else "unknown"))
    return table(spark, said, "error int, hint string")


# --- files -----------------------------------------------------------------------------------------------------------

SOLD = 'find p.brand as brand, e.returnflag as flag, count(*) as n, sum(e.qty) as qty, max(e.price) as high from (o:Order)-[e:CONTAINS]->(p:Part) group by p.brand, e.returnflag'


def exported(form: str) -> Callable:
    def run(spark, sf_dir):
        path = folder(spark, form)
        kind = f'{form} "{path}"' + (' with delimiter = ";"' if form == "csv" else "")
        star(spark, sf_dir, {"Order", "Part", "CONTAINS"}).run(f"{SOLD} export {kind}")
        schema = "brand string, flag string, n long, qty double, high double"
        if form == "csv":
            return spark.read.schema(schema).csv(path, sep=";", header=True)
        if form == "json":
            return spark.read.schema(schema).json(path)
        if form == "parquet":
            return spark.read.parquet(path)
        return files.read_arrow(spark, path, schema)

    return run


def saved_q(spark, sf_dir):
    """A graph written as Parquet tables and loaded again."""
    path = folder(spark, "graph")
    files.save(star(spark, sf_dir, {"Customer", "Nation", "LIVES_IN"}), path)
    return files.load(spark, path).query("find n.name as nation, count(*) as n, min(c.acctbal) as low from (c:Customer)-[:LIVES_IN]->(n:Nation) group by n.name")


def through_arrow(df: DataFrame) -> DataFrame:
    """df written as Arrow streams and read again, by tasks on either side."""
    path = folder(df.sparkSession, "arrow")
    files.write_arrow(df, path)
    return files.read_arrow(df.sparkSession, path, df.schema)


def arrow_nodes_q(spark, sf_dir):
    return through_arrow(files.nodes_table(star(spark, sf_dir, {"Supplier"}), "Supplier")).select(key().alias("k"), "label", "name", "acctbal")


def arrow_edges_q(spark, sf_dir):
    return through_arrow(files.edges_table(star(spark, sf_dir, {"Nation", "Region", "IN_REGION"}))).select(key("source").alias("n"), key("target").alias("r"), "edge_type")


def arrow_history_q(spark, sf_dir):
    from graphloom.queries import moods

    h = through_arrow(files.history_table(moods(spark, sf_dir), "User"))
    return h.groupBy("is_current").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))


def turtle_of(spark, sf_dir) -> str:
    """Regions as classes below continents below the world, suppliers as individuals of their region."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    head = "@prefix e: <http://e.org/#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    head += "e:WORLD a owl:Class . e:CONTINENT a owl:Class ; rdfs:subClassOf e:WORLD .\n"
    word = F.regexp_replace("r_name", "[^A-Za-z0-9]", "_")
    above = F.when(F.col("r_name") == "MIDDLE EAST", " a owl:Class ; rdfs:subClassOf e:WORLD .").otherwise(" a owl:Class ; rdfs:subClassOf e:CONTINENT .")
    classes = n.select(F.concat(F.lit("e:"), word, above).alias("line")).distinct()
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    people = s.select(F.concat(F.lit("e:s"), F.col("s_suppkey").cast("string"), F.lit(" a e:"), word, F.lit(" ; e:key "), F.col("s_suppkey").cast("string"), F.lit(" .")).alias("line"))
    return head + "\n".join(r["line"] for r in classes.union(people).collect())  # Turtle is a text by nature


def turtle_q(spark, sf_dir):
    """Turtle read, written and read again; suppliers below a region."""
    g, _ = files.import_turtle(spark, turtle_of(spark, sf_dir))
    back, _ = files.import_turtle(spark, files.export_turtle(g))
    return back.query('find x.key as k, x.label as region from (x) where instanceOf(x, "CONTINENT")')


def sub_class_q(spark, sf_dir):
    g, _ = files.import_turtle(spark, turtle_of(spark, sf_dir))
    return g.query('find c.label as class from (c) where subClassOf(c, "WORLD")')


# --- ontology and shapes ----------------------------------------------------------------------------------------------


def reasoner(spark, sf_dir) -> ontology.Reasoner:
    """Nations below regions, regions below the world; the world and trade give a market; who supplies something of
    Asia is a partner."""
    r = ontology.Reasoner(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").join(spark.read.parquet(f"{sf_dir}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name").collect()  # an ontology
    for x in rows:
        r.assert_subclass(x["n_name"], x["r_name"])
    for name in sorted({x["r_name"] for x in rows}):
        r.assert_subclass(name, "WORLD")
    r.assert_conjunction("WORLD", "EUROPE", "MARKET")
    r.assert_existential("SHIP", "sails_to", "NATION_7")
    r.assert_existential("CAMEL", "walks_to", "NATION_4")
    r.assert_existential_domain("sails_to", "ASIA", "PARTNER")
    r.assert_existential_domain("walks_to", "ASIA", "PARTNER")
    return r


def inferences_q(spark, sf_dir):
    return reasoner(spark, sf_dir).classify_all()


def lookups_q(spark, sf_dir):
    r = reasoner(spark, sf_dir)
    r.classify_all()
    up = r.superclasses("NATION_7").withColumn("what", F.lit("above NATION_7"))
    down = r.subclasses("AFRICA").withColumn("what", F.lit("below AFRICA"))
    facts = table(spark, [(str(r.is_subclass_of("NATION_8", "MARKET")), "NATION_8 MARKET"), (str(r.is_subclass_of("CAMEL", "PARTNER")), "CAMEL PARTNER"), (str(r.axiom_count()), "axioms"), (str(r.derived_count()), "derived")], "class string, what string")
    return up.unionByName(down).unionByName(facts)


def taxonomy_at_q(spark, sf_dir):
    """A reasoner of the classes as they were: half of the regions joined the world later."""
    n = spark.read.parquet(f"{sf_dir}/region.parquet")
    nodes = n.select(F.col("r_name").alias("id"), F.col("r_name").alias("name"), F.lit("Class").alias("kind")).union(table(spark, [("WORLD", "WORLD", "Class")], "id string, name string, kind string"))
    links = n.select(F.xxhash64("r_name").alias("id"), F.col("r_name").alias("source"), F.lit("WORLD").alias("target"), F.when(F.col("r_regionkey") < 3, 10).otherwise(20).alias("at"))
    h = versions.History({}, {ontology.SUB: versions.versions_of(links)})
    g = Graph(spark, {"Class": Nodes(nodes)}, {ontology.SUB: Edges(links.drop("at"))}, history=h)
    return ontology.Reasoner.of(versions.as_of(g, 15)).subclasses("WORLD")


def edge_shapes_q(spark, sf_dir):
    """Constraints on what edges lead to, with the report's focus nodes."""
    g = star(spark, sf_dir, {"Customer", "Order", "Nation", "PLACED", "LIVES_IN"})
    c = shapes.Constraint
    s = [shapes.Shape("buyer", (shapes.PropertyShape(shapes.Path(edge="PLACED"), (c("minCount", 1, "Warning"), c("class", "Order"))), shapes.PropertyShape(shapes.Path(edge="LIVES_IN"), (c("in", tuple(k * 16 + 1 for k in range(20)), message="of the first 20 nations"),))), target_class="Customer")]
    r = shapes.violations(g, s)
    return r.select((F.col("focus").cast("long") / 16).cast("bigint").alias("c"), "path", "message", "severity")


def shapes_in_graph_q(spark, sf_dir):
    """Shapes that are nodes of the graph themselves."""
    g = star(spark, sf_dir, {"Nation", "Region"})
    held = table(spark, [(900, "Nation", "Class", "nations"), (901, "Region", "Individual", "regions")], "id long, `sh:targetClass` string, `sh:nodeKind` string, `sh:name` string")
    g = g.but(nodes={**g.nodes, "sh:NodeShape": Nodes(held)})
    return shapes.violations(g, shapes.shapes_in(g)).groupBy("shape", "severity").agg(F.count(F.lit(1)).alias("n"))


def members_q(spark, sf_dir):
    """Ways whose ends are instances of classes: regions are below the world here, nations of one region of it."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    where = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = supplier.join(where, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("id"), F.col("r_name").alias("label"), F.lit("Individual").alias("kind"), F.lit(None).cast("string").alias("name"))
    classes = r.select("r_name", F.lit("Class"), F.lit("Class"), "r_name").union(table(spark, [("OLD", "Class", "Class", "OLD")], "a string, b string, c string, d string"))
    below = r.where("r_name in ('ASIA', 'AFRICA', 'EUROPE')").select(F.col("r_name").alias("source"), F.lit("OLD").alias("target"), F.lit(ontology.SUB).alias("type"))
    after = Window.orderBy("s_suppkey")
    chain = supplier.select(F.col("s_suppkey").cast("string").alias("source"), F.lead("s_suppkey").over(after).cast("string").alias("target"), F.lit("NEXT").alias("type")).where("target is not null")
    g = Graph.of(spark, people.union(classes), below.union(chain))
    tests = [f"path_{w}_instanceof(\"OLD\")" for w in ("start", "end", "any", "all")]
    return g.query(f"find a.id as a, {', '.join(f'{t} as {t.split(chr(95))[1]}_in' for t in tests)}, path_any_subclassof(\"OLD\") as class_in from (a)-[:NEXT]->(b)-[:NEXT]->(c)")


# --- vectors ---------------------------------------------------------------------------------------------------------


def chained(spark, sf_dir) -> Graph:
    """Vectors with an edge to the next number, which has a vector of two numbers itself; two references."""
    g = star(spark, sf_dir, {"Vector"})
    n = g.nodes["Vector"].frame
    e = n.select(F.xxhash64("id").alias("id"), F.col("id").alias("source"), (F.col("id") + 16).alias("target"), "key")
    e = e.join(n.select(F.col("id").alias("target")), "target", "left_semi").select("id", "source", "target", "key")
    ev = e.select("id", F.lit("w").alias("model"), F.array(F.lit(1.0), F.col("key").cast("double")).alias("vector"))
    g = g.but(edges={"AFTER": Edges(e.drop("key"), "Vector", "Vector")}, edge_vectors=ev)
    first = retrieval.vector_of(g, 3 * 16 + 8, "default")
    g = retrieval.with_reference(g, "third", [*first, 1.0, 3.0], "default", "w")
    return retrieval.with_reference(g, "fifth", [*retrieval.vector_of(g, 5 * 16 + 8, "default"), 1.0, 5.0], "default", "w")


def path_similarity_q(spark, sf_dir):
    g = chained(spark, sf_dir)
    df = g.query('find a.key as k, path_embedding_similarity("third", "default", "w") as s, path_has_embeddings("default", "w") as h, path_anomaly_score("default", "w") as odd from (a:Vector)-[:AFTER]->(b:Vector)')
    return df.select("k", F.round("s", 6).alias("s"), "h", F.round("odd", 6).alias("odd"))


def pattern_embedding_q(spark, sf_dir):
    df = chained(spark, sf_dir).query('find a.key as k, pattern_embedding("default", "w") as v from (a:Vector)-[:AFTER]->(b:Vector)')
    return df.select("k", F.size("v").cast("bigint").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


def path_references_q(spark, sf_dir):
    df = chained(spark, sf_dir).query('find a.key as k, path_knn_references("default", "w", 1, -1.0) as near from (a:Vector)-[:AFTER]->(b:Vector)')
    return df.select("k", F.col("near")[0]["name"].alias("name"), F.round(F.col("near")[0]["score"], 6).alias("score"))


def embedding_similarity_q(spark, sf_dir):
    return star(spark, sf_dir, {"Vector"}).query('find v.key as k, embedding_similarity(v, "56") as s from (v:Vector) where v.cls = 1').withColumn("s", F.round("s", 6))


def knn_nodes_q(spark, sf_dir):
    df = star(spark, sf_dir, {"Vector"}).query("find v.key as k, knn_nodes(v, 2) as near from (v:Vector) where v.cls = 3")
    return df.select("k", F.concat_ws(",", F.transform(F.from_json("near", "array<string>"), lambda x: (x.cast("long") / 16).cast("bigint").cast("string"))).alias("near"))


def euclidean_q(spark, sf_dir):
    v = retrieval.vectors_of(star(spark, sf_dir, {"Vector"}), "default")
    query = retrieval.vector_of(star(spark, sf_dir, {"Vector"}), 7 * 16 + 8, "default")
    return v.select(key().alias("k"), F.round(retrieval.euclidean(F.col("vector").cast("array<double>"), retrieval.vector_literal(query)), 5).alias("d"))


def hybrid_where_q(spark, sf_dir):
    from graphloom.queries import TERM, both_kinds

    g = both_kinds(spark, sf_dir)
    g = g.but(node_vectors=g.node_vectors.join(g.node_table("Document").select("id"), "id", "left_semi"), indexes={"Document_text": ("Document", "text", "fulltext")})
    return g.query(f'find d.key as k from (d:Document) where hybrid(d, "{TERM}", "57") limit 10')


def full_text_index_q(spark, sf_dir):
    """Phrases and conjunctions on a stored index, which holds each term's places."""
    g = star(spark, sf_dir, {"Document"}).run("create index on Document(text) type fulltext").graph
    found = [retrieval.search(g, "Document_text", q, None).select(key().alias("k"), F.round("score", 6).alias("score"), F.lit(q).alias("query")) for q in ("stupid AND trash", '"the of"', "-stupid trash")]
    return found[0].union(found[1]).union(found[2])


# --- reads ------------------------------------------------------------------------------------------------------------


def find_property_q(spark, sf_dir):
    """Nodes of any label by a property's value."""
    g = star(spark, sf_dir, {"Nation", "Region", "Supplier"})
    return g.find(None, key=3).select(key().alias("k"), "label")


def pattern_pairs_q(spark, sf_dir):
    """Two-hop triples: customers, nations, regions."""
    g = star(spark, sf_dir, {"Customer", "Nation", "Region", "LIVES_IN", "IN_REGION"})
    t = traversal.two_hops(g, "LIVES_IN", "IN_REGION")
    return t.groupBy(key("c").alias("region")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("b").alias("nations"))


def edges_of_q(spark, sf_dir):
    g = transitions(spark, sf_dir)
    return traversal.edges_of(g, "click", "both").select("source", "target", "times", "direction")


def neighbours_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Nation", "Region", "Customer", "LIVES_IN", "IN_REGION"})
    return traversal.neighbours(g, 7 * 16 + 1, "both").select(key().alias("k"), (F.col("id") % 16).cast("int").alias("code"))


def subgraph_q(spark, sf_dir):
    """The orders of rich customers alone, with the edges inside."""
    g = star(spark, sf_dir, {"Customer", "Order", "PLACED"})
    rich = g.node_table("Customer").where("acctbal > 5000").select("id").union(g.node_table("Order").where("orderstatus = 'O'").select("id"))
    return g.subgraph(rich).query("find c.mktsegment as segment, count(*) as n from (c:Customer)-[:PLACED]->(o:Order) group by c.mktsegment")


def dfs_q(spark, sf_dir):
    g = transitions(spark, sf_dir)
    return table(spark, [(i, n) for i, n in enumerate(traversal.dfs(g, "click"))], "place int, node string")


def shortest_path_q(spark, sf_dir):
    """From a customer to the region, over the nation."""
    g = star(spark, sf_dir, {"Customer", "Nation", "Region", "LIVES_IN", "IN_REGION"})
    region = g.query("find r.id as r from (c:Customer {key: 1})-[:LIVES_IN]->(n:Nation)-[:IN_REGION]->(r:Region)").first()[0]
    way = algorithms.shortest_path(g, 1 * 16 + 2, region)
    back = algorithms.shortest_path(g, region, 1 * 16 + 2)
    return table(spark, [(i, x // 16, x % 16) for i, x in enumerate(way)] + ([(-1, -1, -1)] if back is None else []), "place int, k long, code int")


def distance_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Customer", "Nation", "Region", "LIVES_IN", "IN_REGION"})
    return g.query(f"find shortestPath({1 * 16 + 2}, {0 * 16}) as far, shortestPath({1 * 16 + 2}, {1 * 16 + 2}) as self, n.name as name from (n:Region)")


def average_path_q(spark, sf_dir):
    """The mean distance over all connected pairs of event kinds."""
    return table(spark, [(round(algorithms.average_path_length(transitions(spark, sf_dir)), 9),)], "mean double")


def path_words_q(spark, sf_dir):
    df = transitions(spark, sf_dir).query("find path.start as s, path.end as t, path.edges as e, path.depth as d from (a:Kind)-[:THEN]->{2,2}(b:Kind)")
    return df.select(F.col("s.id").alias("s"), F.col("t.id").alias("t"), F.concat_ws(">", F.transform("e", lambda x: F.concat_ws("-", x["source"], x["target"]))).alias("way"), "d")


def algorithm_in_group_q(spark, sf_dir):
    g = star(spark, sf_dir, {"Nation", "Customer", "LIVES_IN"})
    return g.query("find n.name as nation, degree(n) as d, count(*) as n from (c:Customer)-[:LIVES_IN]->(n:Nation) group by n.name")


def modularity_q(spark, sf_dir):
    """The modularity of customers, suppliers and nations by nation."""
    g = star(spark, sf_dir, {"Nation", "Customer", "Supplier", "LIVES_IN", "BASED_IN"})
    e = community.ends(g)
    part = community.ids(g).join(e.select(F.col("source").alias("id"), F.col("target").alias("home")), "id", "left").select("id", F.coalesce("home", "id").alias("c"))
    return table(spark, [(round(community.modularity(g, part), 9),)], "q double")


def cached_q(spark, sf_dir):
    """A graph keeps a partition; a write makes another graph, which has none."""
    g = star(spark, sf_dir, {"Region", "Nation", "IN_REGION"})
    first, second = algorithms.by_name("community", g), algorithms.by_name("community", g)
    after = g.run("delete (n:Nation) where n.key = 0").graph
    same = table(spark, [("same again", int(first is second)), ("after a write", int("community" in after.cached))], "what string, kept int")
    return same.union(first.select(F.lit("communities"), F.countDistinct("community").cast("int")))


def edge_history_q(spark, sf_dir):
    """Edges with versions: whom each part was last supplied by, as it was on a day, and all versions of it."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    day = F.to_date("l_shipdate")
    last = lines.groupBy("l_partkey", day.alias("day")).agg(F.max("l_suppkey").alias("s"))
    changes = last.select(F.col("l_partkey").alias("id"), node_id("Part", "l_partkey").alias("source"), node_id("Supplier", "s").alias("target"), F.col("day").alias("at"))
    g = Graph(spark, {}, {"FROM": Edges(changes.drop("at").dropDuplicates(["id"]))}, history=versions.History({}, {"FROM": versions.versions_of(changes)}))
    then = versions.edges_at(g, "FROM", datetime.date(1996, 6, 1)).groupBy(key("target").alias("k")).agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit("supplier"))
    one = versions.edge_history(g, "FROM", 1).select(F.lit(1).cast("bigint").alias("k"), F.col("version").alias("n"), F.lit("version").alias("what"))
    return then.unionByName(one)


def strict_read_q(spark, sf_dir):
    """A node at a time before it was there is an error for the strict read, nothing for the other."""
    from graphloom.queries import moods

    g = moods(spark, sf_dir)
    early, late = datetime.datetime(1990, 1, 1), datetime.datetime(2100, 1, 1)
    one = g.history.nodes["User"].agg(F.min("id")).first()[0]
    try:
        versions.node_at(g, "User", one, early, strict=True)
        said = "found"
    except LookupError:
        said = "error"
    return table(spark, [("early", 0 if versions.node_at(g, "User", one, early) is None else 1), ("late", 0 if versions.node_at(g, "User", one, late) is None else 1), ("strict", int(said == "error"))], "what string, n int")


NEXT_TWO = "WITH v AS (SELECT vec_id, embedding, lead(embedding) OVER (ORDER BY vec_id) AS b, lead(vec_id) OVER (ORDER BY vec_id) AS nb FROM embeddings), p AS (SELECT vec_id AS k, list_concat([(x + y) / 2 FOR x, y IN list_zip(e, f)], [1.0, CAST(vec_id AS DOUBLE)]) AS w FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, CAST(b AS DOUBLE[]) AS f FROM v WHERE nb = vec_id + 1)), r AS (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [1.0, CAST(vec_id AS DOUBLE)]) AS w FROM embeddings WHERE vec_id IN (3, 5)) "
NEXT_TWO = NEXT_TWO.replace("[(x + y) / 2 FOR x, y IN list_zip(e, f)]", "list_transform(list_zip(e, f), lambda z: (z[1] + z[2]) / 2)")
THEN = "WITH RECURSIVE s AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), e AS (SELECT a, b, count(*) AS n FROM s WHERE b IS NOT NULL GROUP BY a, b)"
WORDS = "WITH w AS (SELECT doc_id, [t FOR t IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF t <> ''] AS ws FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, ws, len(ws) AS l FROM w), s AS (SELECT count(*) AS n, avg(l) AS m FROM t)"


def _bm25(term: str) -> str:
    return f"(SELECT doc_id, l, len([x FOR x IN ws IF x = '{term}']) AS f FROM t WHERE list_contains(ws, '{term}'))"


def _search_sql() -> str:
    score = lambda a, d: f"ln(1 + (n - {d} + 0.5) / ({d} + 0.5)) * {a}.f * 2.2 / ({a}.f + 1.2 * (0.25 + 0.75 * {a}.l / m))"
    parts = [WORDS, ", " + ", ".join(f"f_{t} AS {_bm25(t)}, d_{t} AS (SELECT count(*) AS d_{t} FROM f_{t})" for t in ("stupid", "trash", "the", "of"))]
    both = f" SELECT a.doc_id AS k, round({score('a', 'd_stupid')} + {score('b', 'd_trash')}, 6) AS score, 'stupid AND trash' AS query FROM f_stupid a JOIN f_trash b USING (doc_id), s, d_stupid, d_trash"
    phrase = f" SELECT a.doc_id, round({score('a', 'd_the')} + {score('b', 'd_of')}, 6), '\"the of\"' FROM f_the a JOIN f_of b USING (doc_id) JOIN t USING (doc_id), s, d_the, d_of WHERE contains(' ' || array_to_string(t.ws, ' ') || ' ', ' the of ')"
    without = f" SELECT b.doc_id, round({score('b', 'd_trash')}, 6), '-stupid trash' FROM f_trash b ANTI JOIN f_stupid a USING (doc_id), s, d_trash"
    return "".join(parts) + both + " UNION ALL" + phrase + " UNION ALL" + without.replace("FROM f_trash b ANTI JOIN f_stupid a USING (doc_id), s, d_trash", "FROM (SELECT * FROM f_trash WHERE doc_id NOT IN (SELECT doc_id FROM f_stupid)) b, s, d_trash")


OLD = "('ASIA', 'AFRICA', 'EUROPE')"
SOLD_SQL = "SELECT p_brand AS brand, l_returnflag AS flag, count(*) AS n, sum(l_quantity) AS qty, max(l_extendedprice) AS high FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"
UP = "WITH c AS (SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey)"
DERIVED = UP + ", d AS (SELECT n AS sub, 'WORLD' AS super, 'CR1' AS rule FROM c UNION SELECT n, 'MARKET', 'CR2' FROM c WHERE r = 'EUROPE' UNION SELECT 'EUROPE', 'MARKET', 'CR2' FROM c WHERE r = 'EUROPE' UNION SELECT 'SHIP', 'PARTNER', 'CR3' FROM c WHERE n = 'NATION_7' AND r = 'ASIA' UNION SELECT 'CAMEL', 'PARTNER', 'CR3' FROM c WHERE n = 'NATION_4' AND r = 'ASIA')"

EXTRA: dict[str, tuple[Callable, str | None]] = {
    "explain": (explain_q, "SELECT * FROM (VALUES (0, 'Scan c:Customer'), (1, 'Expand out PLACED'), (2, 'Reach o:Order'), (3, 'Filter o.totalprice > 1000'), (4, 'Group c.mktsegment'), (5, 'Sort segment'), (6, 'Limit 3'), (7, 'Spark''s plan')) AS t(place, step)"),
    "profile": (profile_q, "WITH s AS (SELECT event_id, lead(event_id, 1) OVER w AS b1, lead(event_id, 2) OVER w AS b2, lead(event_id, 3) OVER w AS b3, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2, lead(value, 3) OVER w AS v3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), x AS (SELECT v1 AS v, 1 AS d FROM s WHERE b1 IS NOT NULL UNION ALL SELECT v2, 2 FROM s WHERE b2 IS NOT NULL UNION ALL SELECT v3, 3 FROM s WHERE b3 IS NOT NULL) SELECT CAST(count_if(v > 200) AS BIGINT) AS rows, CAST(max(d) AS BIGINT) AS max_depth, count(*) AS examined FROM x"),
    "add_pattern": (add_q, "SELECT r_name AS region, count(*) AS nations, 5 AS made FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'LEMURIA', 2, 5"),
    "sketch_commit": (sketch_q, "SELECT count(*) AS n, 'sketched' AS stage FROM orders UNION ALL SELECT count(*), 'touched' FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT count(*), 'committed' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice <= 200000"),
    "danger_levels": (danger_q, "SELECT 'delete (n:Nation)' AS statement, 'critical' AS level, CAST(0 AS BIGINT) AS left_over UNION ALL SELECT 'delete (n:Nation) limit 4', 'high', count(*) - 4 FROM nation UNION ALL SELECT 'delete (n:Nation) where n.key > 20', 'none', count(*) FROM nation WHERE n_nationkey <= 20"),
    "at_timestamp_clause": (at_clause_q, "SELECT mood, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT user_id, arg_max(event_type, ts) AS mood, arg_max(value, ts) AS value FROM events WHERE epoch(ts) <= epoch(TIMESTAMP '2024-01-15 00:00:00') GROUP BY 1) GROUP BY 1"),
    "comments_keywords": (comments_q, "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size >= 10 GROUP BY 1"),
    "bare_variable": (bare_q, "SELECT c_custkey AS c, CAST(n_nationkey AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'"),
    "implicit_group": (implicit_group_q, "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, max(o_totalprice) AS high FROM orders GROUP BY 1, 2"),
    "migration_error": (migration_q, "SELECT * FROM (VALUES (1, 'path_embedding_similarity'), (1, 'unknown')) AS t(error, hint)"),
    **{f"export_{f}": (exported(f), SOLD_SQL) for f in ("csv", "json", "parquet", "arrow")},
    "save_load": (saved_q, "SELECT n_name AS nation, count(*) AS n, min(c_acctbal) AS low FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "arrow_nodes": (arrow_nodes_q, "SELECT s_suppkey AS k, 'Supplier' AS label, s_name AS name, s_acctbal AS acctbal FROM supplier"),
    "arrow_edges": (arrow_edges_q, "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r, 'IN_REGION' AS edge_type FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "arrow_history": (arrow_history_q, "SELECT c AS is_current, count(*) AS n, max(v) AS version FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts) AS v, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL AS c FROM events) GROUP BY 1"),
    "turtle": (turtle_q, "SELECT s_suppkey AS k, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'MIDDLE EAST'"),
    "sub_class_of": (sub_class_q, "SELECT replace(r_name, ' ', '_') AS class FROM region UNION ALL SELECT 'CONTINENT'"),
    "reasoner": (inferences_q, DERIVED + " SELECT sub, super, rule FROM d"),
    "reasoner_lookups": (lookups_q, DERIVED + " SELECT * FROM (SELECT r AS class, 'above NATION_7' AS what FROM c WHERE n = 'NATION_7' UNION ALL SELECT 'WORLD', 'above NATION_7' FROM c WHERE n = 'NATION_7' UNION ALL SELECT n, 'below AFRICA' FROM c WHERE r = 'AFRICA' UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'True' ELSE 'False' END, 'NATION_8 MARKET' FROM d WHERE sub = 'NATION_8' AND super = 'MARKET' UNION ALL SELECT CASE WHEN count(*) > 0 THEN 'True' ELSE 'False' END, 'CAMEL PARTNER' FROM d WHERE sub = 'CAMEL' UNION ALL SELECT CAST((SELECT count(*) FROM c) + (SELECT count(DISTINCT r) FROM c) + 5 AS VARCHAR), 'axioms' UNION ALL SELECT CAST(count(*) AS VARCHAR), 'derived' FROM d)"),
    "taxonomy_at": (taxonomy_at_q, "SELECT r_name AS class FROM region WHERE r_regionkey < 3"),
    "edge_shapes": (edge_shapes_q, "SELECT c_custkey AS c, 'PLACED' AS path, 'minCount 1' AS message, 'Warning' AS severity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'LIVES_IN', 'of the first 20 nations', 'Violation' FROM customer WHERE c_nationkey >= 20"),
    "shapes_in_graph": (shapes_in_graph_q, "SELECT 'nations' AS shape, 'Violation' AS severity, count(*) AS n FROM nation"),
    "path_members": (members_q, f"WITH x AS (SELECT s_suppkey AS k, r_name IN {OLD} AS o, row_number() OVER (ORDER BY s_suppkey) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT CAST(a.k AS VARCHAR) AS a, a.o AS start_in, c.o AS end_in, a.o OR b.o OR c.o AS any_in, a.o AND b.o AND c.o AS all_in, false AS class_in FROM x a JOIN x b ON b.p = a.p + 1 JOIN x c ON c.p = a.p + 2"),
    "path_similarity": (path_similarity_q, NEXT_TWO + ", m AS (SELECT list_transform(list_zip(a.w, b.w), lambda z: (z[1] + z[2]) / 2) AS w FROM r a, r b WHERE a.vec_id = 3 AND b.vec_id = 5) SELECT k, round(list_cosine_similarity(p.w, r.w), 6) AS s, true AS h, round(least(1, greatest(0, 1 - list_cosine_similarity(p.w, m.w))), 6) AS odd FROM p, r, m WHERE r.vec_id = 3"),
    "pattern_embedding": (pattern_embedding_q, "SELECT a.vec_id AS k, CAST(len(a.embedding) + len(b.embedding) + 2 AS BIGINT) AS size, round(list_sum(CAST(a.embedding AS DOUBLE[])) + list_sum(CAST(b.embedding AS DOUBLE[])) + 1 + a.vec_id, 5) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"),
    "path_references": (path_references_q, NEXT_TWO + "SELECT k, name, round(score, 6) AS score FROM (SELECT k, CASE r.vec_id WHEN 3 THEN 'third' ELSE 'fifth' END AS name, list_cosine_similarity(p.w, r.w) AS score, row_number() OVER (PARTITION BY k ORDER BY list_cosine_similarity(p.w, r.w) DESC, CASE r.vec_id WHEN 3 THEN 'third' ELSE 'fifth' END) AS i FROM p, r) WHERE i = 1"),
    "embedding_similarity": (embedding_similarity_q, "SELECT vec_id AS k, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 6) AS s FROM embeddings WHERE label = 1"),
    "knn_nodes": (knn_nodes_q, "SELECT k, string_agg(o, ',' ORDER BY r) AS near FROM (SELECT a.vec_id AS k, CAST(b.vec_id AS VARCHAR) AS o, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.label = 3) WHERE r <= 2 GROUP BY 1"),
    "euclidean": (euclidean_q, "SELECT vec_id AS k, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)), 5) AS d FROM embeddings"),
    "full_text_index": (full_text_index_q, _search_sql()),
    "find_property": (find_property_q, "SELECT CAST(3 AS BIGINT) AS k, 'Nation' AS label FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 3, 'Region' FROM region WHERE r_regionkey = 3 UNION ALL SELECT 3, 'Supplier' FROM supplier WHERE s_suppkey = 3"),
    "two_hop_triples": (pattern_pairs_q, "SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n, count(DISTINCT n_nationkey) AS nations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "edges_of": (edges_of_q, THEN.replace(" RECURSIVE", "") + " SELECT a AS source, b AS target, n AS times, 'out' AS direction FROM e WHERE a = 'click' UNION ALL SELECT a, b, n, 'in' FROM e WHERE b = 'click'"),
    "neighbours": (neighbours_q, "SELECT c_custkey AS k, 2 AS code FROM customer WHERE c_nationkey = 7 UNION ALL SELECT n_regionkey, 0 FROM nation WHERE n_nationkey = 7"),
    "induced_subgraph": (subgraph_q, "SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 AND o_orderstatus = 'O' GROUP BY 1"),
    "dfs": (dfs_q, THEN + ", w AS (SELECT ['click'] AS seen, ['click'] AS stack UNION ALL SELECT * FROM (SELECT CASE WHEN x IS NULL THEN seen ELSE list_append(seen, x) END, CASE WHEN x IS NULL THEN stack[:-2] ELSE list_append(stack, x) END FROM (SELECT seen, stack, (SELECT min(b) FROM e WHERE a = stack[-1] AND NOT list_contains(seen, b)) AS x FROM w WHERE len(stack) > 0))), f AS (SELECT seen FROM w ORDER BY len(seen) DESC LIMIT 1) SELECT CAST(i - 1 AS INT) AS place, seen[i] AS node FROM (SELECT seen, unnest(range(1, len(seen) + 1)) AS i FROM f)"),
    "shortest_path": (shortest_path_q, "WITH x AS (SELECT c_custkey AS c, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1) SELECT 0 AS place, c AS k, 2 AS code FROM x UNION ALL SELECT 1, n, 1 FROM x UNION ALL SELECT 2, r, 0 FROM x UNION ALL SELECT -1, -1, -1"),
    "shortest_path_function": (distance_q, "SELECT CASE WHEN (SELECT n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 1) = 0 THEN 2.0 ELSE -1.0 END AS far, 0.0 AS self, r_name AS name FROM region"),
    "average_path_length": (average_path_q, THEN + ", w AS (SELECT a, b, 1 AS d FROM e UNION SELECT w.a, e.b, d + 1 FROM w JOIN e ON e.a = w.b WHERE d < 8) SELECT round(avg(d), 9) AS mean FROM (SELECT a, b, min(d) AS d FROM w WHERE a <> b GROUP BY a, b)"),
    "path_words": (path_words_q, THEN + " SELECT x.a AS s, y.b AS t, x.a || '-' || x.b || '>' || y.a || '-' || y.b AS way, CAST(2 AS BIGINT) AS d FROM e x JOIN e y ON x.b = y.a WHERE x.a <> x.b AND y.a <> y.b AND x.a <> y.b"),
    "algorithm_in_group": (algorithm_in_group_q, "SELECT n_name AS nation, CAST(count(*) AS DOUBLE) AS d, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "modularity": (modularity_q, "WITH x AS (SELECT n, count(*) AS k FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY n), m AS (SELECT sum(k) AS m FROM x) SELECT round(1 - sum((CAST(k AS DOUBLE) / m) ** 2), 9) AS q FROM x, m"),
    "partition_cache": (cached_q, "SELECT 'same again' AS what, 1 AS kept UNION ALL SELECT 'after a write', 0 UNION ALL SELECT 'communities', CAST(count(DISTINCT n_regionkey) AS INT) FROM nation"),
    "edge_history": (edge_history_q, "WITH l AS (SELECT l_partkey AS p, CAST(l_shipdate AS DATE) AS d, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2), t AS (SELECT p, arg_max(s, d) AS s FROM l WHERE d <= DATE '1996-06-01' GROUP BY p) SELECT s AS k, count(*) AS n, 'supplier' AS what FROM t GROUP BY s UNION ALL SELECT 1, row_number() OVER (ORDER BY d), 'version' FROM l WHERE p = 1"),
    "strict_read": (strict_read_q, "SELECT * FROM (VALUES ('early', 0), ('late', 1), ('strict', 1)) AS t(what, n)"),
}


import math

import pytest

from graphloom.model import Graph
from graphloom.operators import algorithms, community, ontology, retrieval, shapes, traversal, versions
from graphloom.sources import files
from tests.graphs import column, graph, people


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def simple(spark, n, pairs):
    return graph(spark, [(i, "N") for i in range(n)], [(a, b, "E") for a, b in pairs], "")


def test_degree(spark):
    g = simple(spark, 4, [(0, 1), (0, 1), (2, 2)])
    assert values(algorithms.degree(g)) == {0: 2, 1: 2, 2: 2, 3: 0}
    assert values(algorithms.degree(g, "in")) == {0: 0, 1: 2, 2: 1, 3: 0}
    assert algorithms.degree_stats(g).first()["total_edges"] == 3


def test_pagerank_leaks_and_converges(spark):
    g = simple(spark, 3, [(0, 1), (1, 2), (0, 1)])
    got = values(algorithms.pagerank(g))
    a = 0.05
    b = 0.05 + 0.85 * a
    assert got == pytest.approx({0: a, 1: b, 2: 0.05 + 0.85 * b}, abs=1e-6)
    seeds = g.node_table("N").where("id = 0").select("id")
    assert values(algorithms.pagerank(g, start=seeds))[0] == pytest.approx(0.15)


def test_clustering_triangles_betweenness(spark):
    g = simple(spark, 4, [(0, 1), (1, 2), (2, 0), (2, 3)])
    assert values(algorithms.clustering(g)) == pytest.approx({0: 1, 1: 1, 2: 1 / 3, 3: 0})
    assert algorithms.global_clustering(g) == pytest.approx(3 / 5)
    chain = simple(spark, 4, [(0, 1), (1, 2), (2, 3)])
    assert values(algorithms.betweenness(chain)) == pytest.approx({0: 0, 1: 4 / 6, 2: 4 / 6, 3: 0})


def test_betweenness_against_enumeration(spark):
    import random
    from collections import deque

    r = random.Random(5)
    pairs = [(r.randrange(7), r.randrange(7)) for _ in range(11)]
    near = {i: [] for i in range(7)}
    for a, b in pairs:
        if a != b:
            near[a].append(b)
            near[b].append(a)
    want = dict.fromkeys(range(7), 0.0)
    for s in range(7):
        dist, count, order, q = {s: 0}, {s: 1.0}, [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for u in near[v]:
                if u not in dist:
                    dist[u], count[u] = dist[v] + 1, 0.0
                    q.append(u)
                if dist[u] == dist[v] + 1:
                    count[u] += count[v]
        dep = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in near[v]:
                if dist[u] == dist[v] + 1:
                    dep[v] += count[v] / count[u] * (1 + dep[u])
            if v != s:
                want[v] += dep[v] / 30
    assert values(algorithms.betweenness(simple(spark, 7, pairs))) == pytest.approx(want)


def test_distances_and_paths(spark):
    g = graph(spark, [(i, "N") for i in range(5)], [(0, 1, "E", 5.0), (0, 2, "E", 1.0), (2, 1, "E", 1.0), (1, 3, "E", None)], "", "w double")
    assert algorithms.shortest_path(g, 0, 3) == [0, 1, 3]
    assert algorithms.shortest_path(g, 0, 3, "w") == [0, 2, 1, 3]
    assert algorithms.distance(g, 0, 3, "w") == 3 and algorithms.distance(g, 3, 0) == -1 and algorithms.distance(g, 4, 4) == 0
    assert g.query("find shortestPath(0, 3) as d from (n) limit 1").first()[0] == 2


def test_communities(spark):
    two = [(a, b) for o in (0, 4) for a in range(o, o + 4) for b in range(a + 1, o + 4)] + [(3, 4)]
    g = simple(spark, 9, two)
    for f in (community.community, community.leiden, community.community_fast):
        got = values(f(g))
        assert len({got[i] for i in range(4)}) == 1 and len({got[i] for i in range(4, 8)}) == 1 and got[0] != got[4] != got[8]
        assert sorted(set(got.values())) == [0, 1, 2]
    part = community.community(g)
    assert community.modularity(g, part) == pytest.approx(12 / 13 - 2 * (13 / 26) ** 2)
    assert values(community.components(g)) == {**dict.fromkeys(range(8), 0), 8: 8}
    long = simple(spark, 40, [(i, i + 1) for i in range(39)])
    assert set(values(community.components(long)).values()) == {0}


def test_algorithms_inside_queries(spark):
    g = graph(spark, [(i, "User", f"u{i}", f"t{i % 4}") for i in range(24)], [(i, (i + 1) % 24, "KNOWS") for i in range(24)], "name string, team string")
    rows = g.query("find u.team, count(*) as n, avg(u.missing) as m from (u:User) group by u.team").collect()
    assert sorted((r[0], r[1]) for r in rows) == [(f"t{i}", 6) for i in range(4)]
    assert {r[1] for r in g.query("find u.name, degree(u) as d from (u:User) where degree(u) > 1").collect()} == {2.0}
    assert g.query("find u.team, pagerank(u) as p from (u:User) group by u.team").count() == 4
    sub = g.query('find u.name, clustering(u) as c from (u:User) where u.team = "t1"').collect()
    assert len(sub) == 6 and {r["c"] for r in sub} == {0.0}


def test_traversal_keeps_repetitions(spark):
    g = simple(spark, 4, [(0, 1), (0, 2), (1, 3), (2, 3)])
    t = traversal.Traversal.at(g, 0).out("E").out("E")
    assert t.count() == 2 and column(t.ids()) == [3, 3]
    assert column(traversal.Traversal.at(g, 3).in_().has_label("N").skip(1).ids()) == [2]
    assert column(traversal.neighbours(g, 3, "both")) == [1, 2]


def test_sack_over_parts(spark):
    names = ["Mesa", "Tornillo", "Barniz", "Pata", "Regaton"]
    g = graph(spark, [(i, "P", n) for i, n in enumerate(names)], [(0, 1, "C", 8), (0, 1, "C", 2), (0, 2, "C", 1), (0, 3, "C", 4), (3, 4, "C", 1)], "name string", "q long")
    out = traversal.Traversal.at(g, 0).sack(10).out_e("C").sack_mul_by("q").repeat().emit()
    got = sorted((names[r["id"]], r["sack"], r["depth"]) for r in out.items.collect())
    assert got == [("Barniz", 10, 1), ("Pata", 40, 1), ("Regaton", 40, 2), ("Tornillo", 20, 1), ("Tornillo", 80, 1)]
    assert sorted(names[r["id"]] for r in out.leaves().collect()) == ["Barniz", "Regaton", "Tornillo", "Tornillo"]
    loop = graph(spark, [(0, "P"), (1, "P")], [(0, 1, "C", 1), (1, 0, "C", 1)], "", "q long")
    with pytest.raises(Exception, match="cycle"):
        traversal.Traversal.at(loop, 0).sack(1).out_e("C").repeat().emit()
    skip = traversal.Traversal.at(loop, 0).sack(1).out_e("C").repeat(on_cycle="skip").emit()
    assert skip.cycles_skipped == 1 and skip.items.count() == 1
    few = traversal.Traversal.at(g, 0).sack(1).out_e("C").repeat(max_nodes=2).emit()
    assert few.truncated and few.items.count() == 2


def test_search_orders(spark):
    g = simple(spark, 6, [(0, 2), (0, 1), (1, 3), (2, 3), (3, 4)])
    assert values(traversal.bfs(g, 0).distances) == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    from pyspark.sql import functions as F

    assert column(traversal.bfs(g, 0, allowed=F.col("id") != 1).distances.select("id")) == [0, 2, 3, 4]
    assert not traversal.bfs(g, 0, max_nodes=2).completed
    assert traversal.dfs(g, 0) == [0, 1, 3, 4, 2]


def with_vectors(spark):
    g = graph(spark, [(i, "A", n) for i, n in enumerate("abc")], [(0, 1, "E"), (1, 2, "E")], "name string")
    n = spark.createDataFrame([(0, "m", [1.0]), (1, "m", [3.0]), (2, "m", [5.0])], "id long, model string, vector array<float>")
    e = spark.createDataFrame([(0, "m", [10.0, 20.0]), (1, "m", [30.0, 40.0])], "id long, model string, vector array<float>")
    return g.but(node_vectors=n, edge_vectors=e)


def test_path_vectors(spark):
    g = with_vectors(spark)
    r = g.query('find path_embedding("m", "m") as v, pattern_embedding("m", "m") as p, path_has_embeddings("m", "m") as h from (a {name: "a"})-[:E]->(b)-[:E]->(c)').first()
    assert r["v"] == [3, 20, 30] and r["p"] == [1, 10, 20, 3, 30, 40, 5] and r["h"]
    q = g.query('find path_embedding("m", "m") as v from (a {name: "a"})-[:E]->{1,2}(b)').collect()
    assert sorted(map(tuple, (r["v"] for r in q))) == [(2, 10, 20), (3, 20, 30)]
    with pytest.raises(Exception, match="no vector"):
        g.query('find path_embedding("other", "m") as v from (a)-[:E]->(b)').collect()
    g = retrieval.with_reference(g, "near", [2.0, 10.0, 20.0], "m", "m")
    g = retrieval.with_reference(g, "far", [-2.0, -10.0, -20.0], "m", "m")
    q = 'find path_embedding_similarity("near", "m", "m") as s, path_knn_references("m", "m", 2, 0.5) as k from (a {name: "a"})-[:E]->(b)'
    r = g.query(q).first()
    assert r["s"] == pytest.approx(1) and [x["name"] for x in r["k"]] == ["near"]


def test_anomaly(spark):
    g = graph(spark, [(0, "R", "root"), (1, "R", "normal"), (2, "R", "odd")], [(0, 1, "TX"), (0, 2, "TX")], "name string")
    n = spark.createDataFrame([(0, "m", [1.0, 0.0]), (1, "m", [1.0, 0.0]), (2, "m", [0.0, 1.0])], "id long, model string, vector array<float>")
    e = spark.createDataFrame([(0, "m", [1.0, 0.0]), (1, "m", [0.0, 1.0])], "id long, model string, vector array<float>")
    g = g.but(node_vectors=n, edge_vectors=e)
    q = 'find b.name, path_anomaly_score("m", "m") as s from (a)-[:TX]->(b)'
    assert {r["s"] for r in g.query(q).collect()} == {1.0}
    g = retrieval.with_reference(g, "usual", [1.0, 0.0, 1.0, 0.0], "m", "m")
    got = values(g.query(q))
    assert got["normal"] == pytest.approx(0, abs=1e-9) and got["odd"] == pytest.approx(1 - 0.5 / math.sqrt(3))
    assert column(g.query('find b.name from (a)-[:TX]->(b) where path_anomaly_score("m", "m") > 0.3')) == ["odd"]


def test_hybrid(spark):
    g = graph(spark, [(0, "Doc", "d0", "apple pie"), (1, "Doc", "d1", "pear"), (2, "Other", "x0", "apple apple")], [], "name string, body string")
    v = spark.createDataFrame([(0, "default", [1.0, 0.0]), (1, "default", [0.0, 1.0]), (2, "default", [1.0, 0.0])], "id long, model string, vector array<float>")
    g = g.but(node_vectors=v)
    hits = retrieval.hybrid(g, "Apple", [1.0, 0.0], label="Doc", text_prop="body").collect()
    assert [r["id"] for r in hits] == [0, 1] and hits[0]["text_rank"] == hits[0]["vector_rank"] == 0 and hits[1]["text_rank"] is None
    assert hits[0]["score"] == pytest.approx(2 / 60)
    assert retrieval.bm25(retrieval.text_table(g, "Doc", "body"), "").count() == 0
    with pytest.raises(ValueError):
        retrieval.with_reference(g, "none", [0.0])


TTL = """@prefix ex: <http://e.org/#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
ex:Disease a owl:Class . ex:Infection a owl:Class ; rdfs:subClassOf ex:Disease .
ex:Viral a owl:Class ; rdfs:subClassOf ex:Infection . # note
ex:flu a ex:Viral ; ex:name "Flu" ; ex:cases 12 . ex:cold a ex:Infection ; ex:name "Cold" .
ex:well a ex:Disease ."""


def test_turtle_and_instances(spark):
    g, report = files.import_turtle(spark, TTL)
    assert report == {"classes": 3, "subclass_edges": 2, "individuals": 3}
    assert column(g.query('find n.name from (n) where instanceOf(n, "Disease")')) == ["Cold", "Flu"]
    assert column(g.query('find n.label from (n) where subClassOf(n, "Disease")')) == ["Infection", "Viral"]
    assert g.query('find n from (n) where instanceOf(n, "Nothing")').count() == 0
    again, _ = files.import_turtle(spark, TTL, g)
    assert again.node_table().count() == g.node_table().count() == 6 and again.edge_table().count() == 2
    text = files.export_turtle(g)
    back, _ = files.import_turtle(spark, text)
    assert files.export_turtle(back) == text


def test_reasoner(spark):
    r = ontology.Reasoner(spark)
    for a, b in [("A", "B"), ("B", "C"), ("C", "D")]:
        r.assert_subclass(a, b)
    r.assert_conjunction("B", "C", "E")
    r.assert_existential("X", "has", "A")
    r.assert_existential_domain("has", "C", "Y")
    got = {(x["sub"], x["super"]): x["rule"] for x in r.classify_all().collect()}
    assert got == {("A", "C"): "CR1", ("A", "D"): "CR1", ("B", "D"): "CR1", ("A", "E"): "CR2", ("B", "E"): "CR2", ("X", "Y"): "CR3"}
    assert r.is_subclass_of("X", "Y") and not r.is_subclass_of("Y", "X") and r.axiom_count() == 6
    with pytest.raises(ValueError):
        r.assert_subclass("A", "A")


def test_shapes(spark):
    g = people(spark, [(0, 1)], ["Alice", "B"])
    s = shapes.Shape("p", (shapes.PropertyShape(shapes.Path(edge="KNOWS"), (shapes.Constraint("minCount", 1),)), shapes.PropertyShape(shapes.Path("name"), (shapes.Constraint("minLength", 2), shapes.Constraint("pattern", "^[A-Z]"), shapes.Constraint("pattern", "(", ), shapes.Constraint("datatype", "xsd:string"), shapes.Constraint("hasValue", "Alice", "Info")))), target_class="Person")
    got = sorted((r["focus"], r["path"], r["message"], r["severity"]) for r in shapes.violations(g, [s]).collect())
    assert got == [("0", "name", "( is no pattern", "Warning"), ("1", "KNOWS", "minCount 1", "Violation"), ("1", "name", "( is no pattern", "Warning"), ("1", "name", "hasValue Alice", "Info"), ("1", "name", "minLength 2", "Violation")]
    assert not shapes.conforms(shapes.violations(g, [s]))
    assert shapes.conforms(shapes.violations(g, [shapes.Shape("none", (), "Nobody")]))


def test_versions(spark):
    changes = spark.createDataFrame([(1, "Alice", 0, 10), (1, "Alice", 25, 20), (1, "Alice", 30, 30)], "id long, name string, age int, at long")
    h = versions.versions_of(changes)
    now = h.where("valid_to is null").drop("valid_from", "valid_to", "version")
    from graphloom.model import Nodes

    g = Graph(spark, {"Person": Nodes(now)}, history=versions.History({"Person": h}, {}))
    assert versions.history_of(g, "Person", 1).count() == 3
    assert [g.query(f"find p.age from (p:Person) at timestamp {t}").collect() for t in (5, 10, 29, 99)] == [[], [(0,)], [(25,)], [(30,)]]
    kept, dropped = versions.collected(h, 25, 1)
    assert (kept.count(), dropped.count()) == (2, 1)
    kept, _ = versions.collected(h, 99, 1, active=15)
    assert kept.count() == 3


def test_upsert_links_once(spark):
    g = people(spark, [], ["Alice"])
    rows = spark.createDataFrame([("Alice", 30, "Oslo"), ("Bob", 40, "Oslo")], "name string, age int, city string")
    g2, changes = versions.upsert(g, "Person", "name", rows, [("city", "IN", "City", "name")])
    assert sorted((r["name"], r["change"]) for r in changes.collect()) == [("Alice", "Updated"), ("Bob", "Created")]
    g3, changes = versions.upsert(g2, "Person", "name", rows, [("city", "IN", "City", "name")])
    assert {r["change"] for r in changes.collect()} == {"Unchanged"} and g3.edge_table("IN").count() == 2 and g3.node_table("City").count() == 1
    with pytest.raises(Exception, match="ambiguous"):
        versions.merged(g3.nodes["Person"].frame, rows.union(rows), "name").collect()
    assert versions.delete_by_key(g3, "Person", "name", "Bob").edge_table("IN").count() == 1


def test_files(spark, tmp_path):
    g = graph(spark, [(0, "A", "x,y", 1.5, True), (1, "A", 'q"q', None, False)], [(0, 1, "E", 2)], "s string, f double, b boolean", "w long")
    files.save(g, str(tmp_path / "g"))
    back = files.load(spark, str(tmp_path / "g"))
    assert back.query("find a.s, b.s, r.w from (a)-[r:E]->(b)").collect() == [("x,y", 'q"q', 2)]
    df = g.query("find a.s as s, a.f as f, a.b as b from (a) order by s desc")
    assert files.csv_text(df) == 's,f,b\n"x,y",1.5,true\n"q""q",,false\n'
    assert files.json_text(df, jsonl=True).splitlines()[1] == '{"s": "q\\"q", "f": null, "b": false}'
    assert files.nodes_arrow(g).column_names == ["id", "label", "b", "f", "s"] and files.nodes_arrow(g, properties=False)["property_count"].to_pylist() == [3, 2]
    assert files.edges_arrow(g)["w"].to_pylist() == ["2"]
    files.export(df, "arrow", {"path": str(tmp_path / "arrow")})
    import pyarrow as pa

    assert sum(pa.ipc.open_stream(p.read_bytes()).read_all().num_rows for p in (tmp_path / "arrow").glob("*.arrows")) == 2
    files.export(df, "json", {"path": str(tmp_path / "json")})
    files.export(df, "parquet", {"path": str(tmp_path / "pq")})
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
    t = files.tensors(g, ["A"], ["f"], ["w", "none"])
    assert [tuple(r) for r in t.edges.collect()] == [(0, 1, [2.0, 0.0])] and values(t.nodes.select("index", "features")) == {0: [1.5], 1: [0.0]}
    assert {(r["name"], r["property"]): r["filled"] for r in g.schema().collect()}[("A", "f")] == 1


def test_subgraph(spark):
    g = people(spark, [(0, 1), (1, 2)])
    s = g.subgraph(g.node_table().where("id < 2").select("id"))
    assert s.node_table().count() == 2 and s.edge_table().count() == 1


def test_stream(spark, tmp_path):
    from graphloom.streaming import upserts

    schema = "key long, at long, mood string"
    spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "x")], schema).coalesce(1).write.parquet(str(tmp_path / "in/0"))

    def go():
        changes = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        upserts.stream_upserts(changes, str(tmp_path / "state"), "key", "at").trigger(availableNow=True).start().awaitTermination()
        return {r["key"]: r["mood"] for r in upserts.current(spark, str(tmp_path / "state")).collect()}

    assert go() == {1: "c", 2: "x"}
    spark.createDataFrame([(1, 2, "late"), (3, 1, "new")], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    assert go() == {1: "c", 2: "x", 3: "new"}


def test_shapes_at_the_ends_of_edges(spark):
    g = people(spark, [(0, 1), (0, 2), (1, 3)])
    c = shapes.Constraint
    s = shapes.Shape("p", (shapes.PropertyShape(shapes.Path(edge="KNOWS"), (c("maxInclusive", 2), c("datatype", "string", "Warning"))),), target_class="Person")
    got = sorted((r["focus"], r["message"]) for r in shapes.violations(g, [s]).collect())
    assert got == [("0", "datatype string"), ("0", "datatype string"), ("1", "datatype string"), ("1", "maxInclusive 2")]


def test_nearest_others_in_blocks(spark, monkeypatch):
    import random

    r = random.Random(4)
    v = [(i, [r.choice((0.0, 1.0, -1.0)) for _ in range(3)]) for i in range(40)] + [(40, [0.0, 0.0, 0.0]), (41, [1.0])]
    monkeypatch.setattr(retrieval, "BLOCK", 11)

    def distance(a, b):
        x, y = math.hypot(*a), math.hypot(*b)
        return 1.0 if len(a) != len(b) or not x or not y else 1 - sum(p * q for p, q in zip(a, b)) / x / y

    df = spark.createDataFrame(v, "id long, vector array<double>")
    got = {(x["id"], x["other"]): x["distance"] for x in retrieval.knn_join(df, df, 2).collect()}
    assert len(got) == 84
    for i, a in v:
        near = sorted(distance(a, b) for j, b in v if j != i)[:2]
        assert sorted(d for (x, _), d in got.items() if x == i) == pytest.approx(near)


def test_stored_indexes(spark):
    from graphloom.operators import indexes

    g = graph(spark, [(0, "D", "the red fox", 3), (1, "D", "red the fox fox", 5), (2, "D", None, 9)], [], "body string, n int")
    g = g.run("create index on D(body) type fulltext").graph.run("create index on D(n) type btree").graph
    ids = lambda q: column(retrieval.search(g, "D_body", q).select("id"))
    assert ids('"red fox"') == [0] and ids("red AND fox") == [0, 1] and ids("the -fox") == [] and ids("") == [] and ids("NOT red fox") == []
    assert column(indexes.between(g, "D_n", 4).select("id")) == [1, 2] and column(indexes.lookup(g, "D_n", 3)) == [0]
    later = g.run('add (d:D {body: "a red fox", n: 4})').graph
    assert retrieval.search(later, "D_body", '"red fox"').count() == 2 and indexes.between(later, "D_n", 4, 5).count() == 2
    assert not later.run("drop index D_n").graph.built.get("D_n")

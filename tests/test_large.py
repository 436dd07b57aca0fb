"""What only larger tables show: ties, hubs, fractions, and work that must not grow with the square."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import algorithms, community, indexes, retrieval
from graphloom.queries import queries
from tests.graphs import graph

SF = "/root/testdata/sf0.001"


def test_at_timestamp_tells_fractions_of_a_second(spark, tmp_path):
    t = datetime.datetime(2024, 1, 15)
    rows = [(0, t - datetime.timedelta(seconds=0.7), 1, "view", 1.0), (1, t - datetime.timedelta(seconds=0.3), 1, "click", 2.0), (2, t + datetime.timedelta(seconds=0.5), 1, "error", 3.0), (3, t, 2, "view", 5.0), (4, t + datetime.timedelta(microseconds=1), 3, "view", 7.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").withColumn("props", F.lit("{}")).write.parquet(f"{tmp_path}/events.parquet")
    got = queries()["at_timestamp_clause"](spark, str(tmp_path)).collect()
    assert {x["mood"]: (x["n"], x["mean"]) for x in got} == {"click": (1, 2.0), "view": (1, 5.0)}


def test_turtle_is_read_in_a_fixed_number_of_passes(spark, monkeypatch):
    from graphloom.sources import files

    class Counted(list):
        passes = 0

        def __iter__(self):
            Counted.passes += 1
            return super().__iter__()

    text = "@prefix e: <http://e.org/#> . @prefix owl: <http://www.w3.org/2002/07/owl#> .\ne:C a owl:Class .\n"
    text += "\n".join(f"e:s{i} a e:C ; e:key {i} ; e:next e:s{i + 1} ." for i in range(40)) + "\ne:s40 a e:C ."
    read = files.triples
    monkeypatch.setattr(files, "triples", lambda t: Counted(read(t)))
    g, report = files.import_turtle(spark, text)
    assert report["individuals"] == 41 and Counted.passes < 10
    assert {x["name"]: x["key"] for x in g.node_table().where("kind = 'Individual'").selectExpr("substring_index(id, '#', -1) as name", "key").collect()} == {f"s{i}": i if i < 40 else None for i in range(41)}
    assert g.edge_table("next").count() == 40


def test_arrow_queries_gather_nothing(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def gathered(self):
        raise AssertionError("a table was gathered on the driver")

    monkeypatch.setattr(DataFrame, "toArrow", gathered)
    got = {name: queries()[name](spark, SF).count() for name in ("arrow_nodes", "arrow_edges", "arrow_history")}
    assert got == {"arrow_nodes": spark.read.parquet(f"{SF}/supplier.parquet").count(), "arrow_edges": 25, "arrow_history": 2}


def moved(spark) -> float:
    """MB that shuffles have written so far."""
    status = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    return sum(status.apply(i).totalShuffleWrite() for i in range(status.size())) / 1e6


@pytest.mark.parametrize("name, most", [("label_propagation", 6), ("triangles", 12), ("clustering", 15), ("bfs", 6), ("weighted_distances", 12), ("components", 3), ("community", 4), ("leiden", 4)])
def test_rounds_move_little(spark, name, most):
    """Edges stay where they are in every round, pairs of neighbours that can't be linked are never made."""
    before = moved(spark)
    queries()[name](spark, SF.replace("0.001", "0.01")).write.format("noop").mode("overwrite").save()
    assert moved(spark) - before < most


def random_graph(spark, n, edges, seed, label="N"):
    r = random.Random(seed)
    pairs = [(r.randrange(n) ** 2 // n, r.randrange(n)) for _ in range(edges)]  # some nodes have many
    return pairs, graph(spark, [(i, label) for i in range(n)], [(a, b, "E") for a, b in pairs], "")


def test_triangles_and_clustering_of_hubs(spark):
    pairs, g = random_graph(spark, 200, 1500, 1)
    pairs += [(7, x) for x in range(200)] + [(x, 8) for x in range(200)]
    g = graph(spark, [(i, "N") for i in range(200)], [(a, b, "E") for a, b in pairs], "")
    near = {v: set() for v in range(200)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = {v: sum(1 for a in near[v] for b in near[v] if a < b and b in near[a] and v not in (a, b)) for v in near}
    got = {x["id"]: x["n"] for x in algorithms.triangles(g).collect()}
    assert got == {v: n for v, n in want.items() if n}
    ratio = {x["id"]: x["clustering"] for x in algorithms.clustering(g).collect()}
    for v, around in near.items():
        links = sum(1 for a in around for b in around if a != b and b in near[a])
        assert ratio[v] == pytest.approx(links / (len(around) * (len(around) - 1)) if len(around) > 1 else 0.0)
    lists, _ = algorithms.upward(g)
    assert max(len(x["out"]) for x in lists.collect()) <= (2 * len(pairs)) ** 0.5 + 1


@pytest.mark.parametrize("tasks", [1, 7])
def test_components_of_edges_in_several_tasks(spark, tasks):
    r = random.Random(tasks)
    pairs = [(i, i + 1) for i in range(300)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(300)]
    r.shuffle(pairs)
    nodes = spark.createDataFrame([(f"n{i:03}", "N") for i in range(900)], "id string, label string")
    edges = spark.createDataFrame([(f"n{a:03}", f"n{b:03}", "E") for a, b in pairs], "source string, target string, type string").repartition(tasks)
    root = list(range(900))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["id"]: x["component"] for x in community.components(Graph.of(spark, nodes, edges)).collect()}
    assert got == {f"n{i:03}": f"n{find(i):03}" for i in range(900)}


@pytest.mark.parametrize("name", [lambda i: i, lambda i: i - 50, lambda i: i << 40, lambda i: f"n{i:03}"])
def test_label_propagation_of_any_ids(spark, name):
    r = random.Random(5)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(110)]
    kind = "string" if isinstance(name(0), str) else "long"
    nodes = spark.createDataFrame([(name(i), "N") for i in range(62)], f"id {kind}, label string")
    edges = spark.createDataFrame([(name(a), name(b), "E") for a, b in pairs] + [(name(3), name(99), "E")], f"source {kind}, target {kind}, type string")
    near = {i: {b for a, b in [*pairs, *[(y, x) for x, y in pairs]] if a == i and b != i} for i in range(62)}
    label = {i: i for i in range(62)}
    for _ in range(3):
        votes = {i: Counter(label[j] for j in near[i]) for i in near}
        label = {i: min(votes[i], key=lambda x: (-votes[i][x], x)) if votes[i] else label[i] for i in near}
    place = {x: i for i, x in enumerate(sorted(set(label.values())))}
    got = {x["id"]: x["community"] for x in community.community_fast(Graph.of(spark, nodes, edges)).collect()}
    assert got == {name(i): place[x] for i, x in label.items()}


def test_knn_join_moves_vectors_once(spark, monkeypatch):
    """The right side isn't moved a time for each block of the left one; equal vectors in other blocks go by id."""
    monkeypatch.setattr(retrieval, "BLOCK", 64)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 16)).astype("float32")
    v[200:260] = v[:60]
    v[299] = 0
    df = spark.createDataFrame([(i * 7 % 300, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>").repartition(5)
    before = moved(spark)
    got = {}
    for x in retrieval.knn_join(df, df, 3).orderBy("id", "distance", "other").collect():
        got.setdefault(x["id"], []).append(x["other"])
    assert moved(spark) - before < 0.3
    ids = np.array([i * 7 % 300 for i in range(300)])
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-30)
    for i in range(300):
        d = np.round(1 - u @ u[i], 12)
        d[i] = np.inf
        assert got[ids[i]] == [ids[j] for j in np.lexsort((ids, d))[:3]], i


def test_postings_are_made_in_a_document(spark):
    text = "The cat, the dog. " * 3 + "ünï THE 7"
    g = Graph.of(spark, spark.createDataFrame([(1, "D", text), (2, "D", ""), (3, "D", None), (4, "D", "dog cat dog")], "id long, label string, text string"))
    index = indexes.build(g, "D", "text", "fulltext")
    got = {(x["term"], x["id"]): (x["tf"], x["length"], x["places"]) for x in index.postings.collect()}
    words = {1: text.lower().replace(",", "").replace(".", "").split(), 4: ["dog", "cat", "dog"]}
    assert got == {(t, d): (ws.count(t), len(ws), [i for i, x in enumerate(ws) if x == t]) for d, ws in words.items() for t in set(ws)}
    assert tuple(index.stats.first()) == (3, (15 + 0 + 3) / 3)
    d = spark.createDataFrame([(i, ["a", "b", "a"]) for i in range(9)], "id long, w array<string>")
    plan = d.mapInArrow(indexes.postings, "term string, id long, tf long, length int, places array<int>")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan

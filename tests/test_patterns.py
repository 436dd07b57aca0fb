import pytest

from graphloom.plans.syntax import PatternError, danger, parse
from tests.graphs import column, graph, people


@pytest.fixture(scope="module")
def chain(spark):
    return people(spark, [(0, 1), (1, 2), (2, 3)])


@pytest.fixture(scope="module")
def transfers(spark):
    return graph(spark, [(i, "Person", n) for i, n in enumerate(["Alice", "Bob", "Carol"])], [(0, 1, "TX", 5000, "USD"), (0, 2, "TX", 200, "USD"), (1, 2, "TX", 5000, "EUR")], "name string", "amount long, currency string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_exact_and_ranged_hops(chain):
    assert column(chain.query('find b.name from (a:Person {name: "Alice"})-[:KNOWS]->{2}(b)')) == ["Charlie"]
    assert column(chain.query('find b.name from (a:Person {name: "Alice"})-[:KNOWS]->{1,3}(b)')) == ["Bob", "Charlie", "Diana"]


def test_a_cycle_ends(spark):
    g = people(spark, [(0, 1), (1, 0)], ["Alfa", "Beta"])
    assert column(g.query('find b.name from (a:Person {name: "Alfa"})-[:KNOWS]->{1,5}(b)')) == ["Beta"]


def test_edge_properties_hold_on_every_hop(transfers):
    assert rows(transfers.query("find a.name, b.name from (a)-[:TX {amount: 5000}]->(b)")) == [("Alice", "Bob"), ("Bob", "Carol")]
    assert rows(transfers.query('find a.name, b.name from (a)-[:TX {amount: 5000, currency: "EUR"}]->(b)')) == [("Bob", "Carol")]
    assert column(transfers.query('find b.name from (a {name: "Alice"})-[:TX {currency: "EUR"}]->{1,2}(b)')) == []


def test_directions(chain):
    assert column(chain.query('find b.name from (a {name: "Bob"})<-[:KNOWS]-(b)')) == ["Alice"]
    assert column(chain.query('find b.name from (a {name: "Bob"})<-[:KNOWS]->(b)')) == ["Alice", "Charlie"]
    assert column(chain.query('find b.name from (a {name: "Bob"})<->(b)')) == ["Alice", "Charlie"]


def test_a_loop_matches_once_both_ways(spark):
    g = people(spark, [(0, 0)], ["A"])
    assert g.query("find b.name from (a)<->(b)").count() == 1
    assert g.query("find a.name from (a)-[:KNOWS]->(a)").count() == 1


def test_triangle_of_patterns(spark):
    names = ["Albizzi", "Medici", "Ridolfi", "Pazzi", "Salviati"]
    g = people(spark, [(0, 1), (1, 2), (0, 2), (0, 3), (3, 4), (0, 4)], names, "MARRIAGE")
    found = rows(g.query("find a.name, b.name, c.name from (a)-[:MARRIAGE]->(b), (b)-[:MARRIAGE]->(c), (a)-[:MARRIAGE]->(c)"))
    assert found == [("Albizzi", "Medici", "Ridolfi"), ("Albizzi", "Pazzi", "Salviati")]
    plan = g.query("find a.name, c.name from (a)-[:MARRIAGE]->(b), (b)-[:MARRIAGE]->(c)")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_group_having_order_limit(transfers):
    assert rows(transfers.query("find a.name, count(*) as n from (a)-[:TX]->(b) group by a.name having count(*) > 1")) == [("Alice", 2)]
    df = transfers.query("find a.name, sum(r.amount) from (a)-[r:TX]->(b) order by sum desc")
    assert df.columns == ["a.name", "sum"] and [r[0] for r in df.collect()] == ["Alice", "Bob"]
    assert [r[0] for r in transfers.query("find b.name from (a)-[r:TX]->(b) order by r.amount, b.name limit 2 offset 1").collect()] == ["Bob", "Carol"]


def test_missing_values(spark):
    g = graph(spark, [(1, "N", 1), (2, "N", None), (3, "N", 3)], [], "v int")
    assert column(g.query("find n from (n:N) where n.v != 1")) == [3]
    assert column(g.query("find n from (n:N) where not (n.v = 1)")) == [2, 3]
    assert [r[0] for r in g.query("find n from (n:N) order by n.v").collect()] == [1, 3, 2]
    assert [r[0] for r in g.query("find n from (n:N) order by n.v desc").collect()] == [2, 3, 1]
    assert column(g.query("find n from (n:N) where n.v = null")) == []
    assert column(g.query('find n from (n:N) where n.v = "1"')) == []
    assert column(g.query('find n from (n:N) where n.v != "1"')) == [1, 3]
    assert rows(g.query("find count(*) as a, count(n.v) as b, sum(n.v), avg(n.v) from (n:N)")) == [(3, 2, 4.0, 2.0)]


def test_wildcards_and_distinct(transfers):
    df = transfers.query("find * from (a)-[r:TX]->(b) limit 1")
    assert set(df.columns) == {"a.name", "a.label", "a.id", "b.name", "b.label", "b.id", "r.amount", "r.currency", "r.type", "r.id"}
    assert transfers.query("find distinct a.* from (a)-[:TX]->(b)").count() == 2


def test_reducers_keep_the_number_kind(spark):
    g = graph(spark, [(i, "A", str(i)) for i in range(3)], [(0, 1, "TX", 300, 1.5), (1, 2, "TX", 200, 2.0)], "name string", "amount long, w double")
    r = g.query('find path_sum("amount") as s, path_avg("amount") as m, path_min("w") as w, path.depth from (a {name: "0"})-[:TX]->{2}(b)').first()
    assert (r["s"], r["m"], r["w"], r["path.depth"]) == (500, 250.0, 1.5, 2)
    assert isinstance(r["s"], int)
    assert column(g.query('find b.name from (a {name: "0"})-[:TX]->{1,2}(b) where path_sum("amount") > 400')) == ["2"]
    with pytest.raises(Exception, match="no number"):
        g.query('find path_sum("none") from (a)-[:TX]->(b)').collect()


def test_path_machine(spark):
    g = graph(spark, [(i, "A", n) for i, n in enumerate("ABC")], [(0, 1, "TX", 70), (1, 2, "TX", 50)], "name string", "amount long")
    q = 'find b.name, path_eval("sum") as s from (a {name: "A"})-[:TX]->{1,2}(b) where path_eval("sum > 100") init "sum = 0" gather "sum = sum + edge.amount"'
    assert rows(g.query(q)) == [("C", 120)]
    q = 'find b.name, path.state from (a {name: "A"})-[:TX]->{1,2}(b) init "last = \'\'" init "hops = 0" gather "last = target.name" gather "hops = hops + 1"'
    assert sorted((r[0], r[1]["last"], r[1]["hops"]) for r in g.query(q).collect()) == [("B", "B", 1), ("C", "C", 2)]
    q = 'find b.name, path.result from (a {name: "A"})-[:TX]->{1,2}(b) where path.result > 1 init "s = 0" gather "s = s + edge.amount" return "s / 60"'
    assert [(r[0], round(r[1], 3)) for r in g.query(q).collect()] == [("B", 1.167), ("C", 2.0)]
    q = 'find path_eval("s") as s from (a)-[:TX]->(b) init "s = 0" gather "s = s + edge.amount * 0.5"'
    assert column(g.query(q)) == [25.0, 35.0]
    for bad, why in [('gather "x = 1"', "INIT"), ('init "s = 0" gather "t = 1"', "INIT lacks"), ('init "s = 0" gather "s = true"', "kind")]:
        with pytest.raises(PatternError, match=why):
            g.query(f"find path.state from (a)-[:TX]->(b) {bad}")
    with pytest.raises(Exception, match="division"):
        g.query('find path_eval("s") as s from (a)-[:TX]->(b) init "s = 0" gather "s = edge.amount % 0"').collect()


@pytest.mark.parametrize(
    "text",
    ["find a", "find a.x from (a)-[r]->{2}(b)", "find a.x from (a)-[]->{2,}(b)", "find a.x from (a)-[]->{0,1}(b)", "find z.x from (a)", "find nope(a) from (a)", "find a.x from (a) where nope(a)", "find path.depth from (a)", "find a.x from (a)-[a]->(b)", "find a.x from (a) where path.nodes = 1", "find a.x from (a) where count(*) > 1", "find a.x from (a) having a.x > 1", 'find a.x from (a) export xml "x"', "find a.x from (a) limit 1.5", "find a.x from (a) where 1 +"],
)
def test_what_makes_no_sense_is_refused(chain, text):
    with pytest.raises(PatternError):
        chain.query(text).collect()


def test_reading_statements():
    assert parse("FIND a.x FROM (a) // note\n WHERE a.x = /* c */ 1").where.op == "="
    assert danger(parse("delete (n:L)")) == "critical" and danger(parse("delete (n:L) limit 3")) == "high" and danger(parse("delete (n:L) where n.x = 1")) is None
    assert parse('find trueish.x from (trueish)').find[0][0].var == "trueish"
    assert parse("find a.x from (a) limit 0 offset 5").limit == 0


def test_scan_is_pruned_and_filters_reach_it(spark):
    from graphloom.sources.star import star

    g = star(spark, "/root/testdata/sf0.001")
    plan = g.query("find c.name from (c:Customer)-[:PLACED]->(o:Order) where o.totalprice > 400000")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,400000.0)" in plan and "c_acctbal" not in plan and "o_orderstatus" not in plan


def test_declared_ends_save_joins(spark):
    from graphloom.sources.star import star

    g = star(spark, "/root/testdata/sf0.001")
    plan = g.query("find c.name, count(*) as n from (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) group by c.name")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # neither orders' nor parts' nodes are read


def test_explain_profile_sketch_index_and_writing(transfers, tmp_path):
    assert "Expand out TX" in transfers.run("explain find a.name from (a)-[:TX]->(b)").text
    p = transfers.run("profile find a.name from (a)-[:TX]->{1,2}(b)")
    assert p.summary["rows"] == 4 and p.summary["max_depth"] == 2
    g = transfers.run("create index on Person(name) type fulltext").graph
    assert list(g.indexes) == ["Person_name"]
    with pytest.raises(PatternError):
        g.run("create index on Person(name)")
    assert not g.run("drop index Person_name").graph.indexes
    s = transfers.run('sketch s = delete (a:Person {name: "Bob"})')
    assert s.summary == {"rows": 1} and s.graph.query("find a from (a)").count() == 3
    done = s.graph.run("commit s")
    assert done.summary == {"nodes_deleted": 1} and done.graph.query("find a.name from (a)-[:TX]->(b)").count() == 1
    assert transfers.run("delete (a)-[r:TX {amount: 200}]->(b)").graph.edge_table("TX").count() == 2
    g = transfers.run('update (a:Person)-[r:TX]->(b) set r.amount = r.amount + 1, a.seen = true where b.name = "Carol"').graph
    assert column(g.edge_table("TX").select("amount")) == [201, 5000, 5001]
    assert g.find("Person", seen=True).count() == 2
    g = transfers.run('add (d:Person {name: "Dora"})-[:TX {amount: 1}]->(e:Person {name: "Emil"})').graph
    assert g.node_table("Person").count() == 5 and g.query('find e.name from (d {name: "Dora"})-[:TX]->(e)').first()[0] == "Emil"
    r = transfers.run(f'find a.name as n, r.amount as x from (a)-[r:TX]->(b) export csv "{tmp_path}/out" with delimiter = ";"')
    assert r.kind == "export"
    text = "".join(sorted(p.read_text() for p in (tmp_path / "out").glob("*.csv")))
    assert "Alice;5000" in text and "n;x" in text


def test_random_graphs_against_enumeration(spark):
    import random

    r = random.Random(3)
    for _ in range(3):
        n = 6
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(9)]
        g = graph(spark, [(i, "N", i) for i in range(n)], [(a, b, "E", r.randrange(5)) for a, b in edges], "k long", "w long")
        e = [(x["source"], x["target"], x["w"]) for x in g.edge_table("E").collect()]

        def ways(seen, ws, most):
            for a, b, w in e:
                if a == seen[-1] and b not in seen and len(ws) < most:
                    yield [*seen, b], [*ws, w]
                    yield from ways([*seen, b], [*ws, w], most)

        want = sorted((s[0], s[-1], sum(w), max(w)) for i in range(n) for s, w in ways([i], [], 3) if len(w) >= 2)
        assert rows(g.query('find a.k, b.k, path_sum("w"), path_max("w") from (a)-[:E]->{2,3}(b)')) == want
        two = sorted((a, b, d) for a, b, _ in e for c, d, _ in e if b == c)
        assert rows(g.query("find a.k, b.k, c.k from (a)-[:E]->(b)-[:E]->(c)")) == two

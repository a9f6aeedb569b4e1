"""The query language over small graphs."""

import pytest

from lodestone.errors import ConstraintViolation, GraphError, ParseError
from lodestone.functions.scalars import ulid_value
from lodestone.plans.parser import parse
from lodestone.session import GraphSession, empty_graph
from lodestone.sources.graph import GraphBuilder


@pytest.fixture()
def s(spark):
    return empty_graph(spark)


def rows(s, text, **params):
    return [tuple(r) for r in s.query(text, params).collect()]


def people(s):
    s.query("UNWIND $r AS p INSERT (:Person {name: p.name, age: p.age})", {"r": [{"name": "Alice", "age": 30}, {"name": "Bob", "age": 25}, {"name": "Carol", "age": 35}]})
    return s


def knows(s):
    s.query("INSERT (a:Person {name: 'Alice'}), (b:Person {name: 'Bob'}), (a)-[:KNOWS {since: 2020}]->(b)")
    return s


def test_order_limit_offset(s):
    people(s)
    assert rows(s, "MATCH (n:Person) RETURN n.name ORDER BY n.age") == [("Bob",), ("Alice",), ("Carol",)]
    assert rows(s, "MATCH (n:Person) RETURN n.name AS x ORDER BY x DESC OFFSET 1 LIMIT 1") == [("Bob",)]
    assert rows(s, "MATCH (n:Person) WHERE n.age > 26 AND NOT n.name = 'Carol' RETURN n.name") == [("Alice",)]
    assert s.query("MATCH (n:Person) RETURN n.name, n.age * 2, count(*)").columns == ["n.name", "n.age * 2", "count(*)"]


def test_union_and_aggregates(s):
    people(s)
    assert sorted(rows(s, "MATCH (n:Person) WHERE n.age > 26 RETURN n.name AS x UNION MATCH (n:Person) RETURN n.name AS x")) == [("Alice",), ("Bob",), ("Carol",)]
    assert rows(s, "MATCH (n:Person) RETURN sum(n.age) AS s, avg(n.age) AS a, min(n.name) AS m, collect(n.age) AS c") == [(90, 30.0, "Alice", [25, 30, 35])]
    assert rows(s, "MATCH (n:Nobody) RETURN sum(n.age), count(n), collect(n.age)") == [(None, 0, [])]
    assert rows(s, "MATCH (n:Nobody) RETURN n.name, count(*)") == []
    with pytest.raises(GraphError):
        s.query("MATCH (n:Person) RETURN toString(count(*))")


def test_null_logic(s):
    s.query("INSERT (:Item {name: 'A', rank: 1}), (:Item {name: 'B', rank: 2}), (:Item {name: 'C'})")
    assert rows(s, "MATCH (n:Item) RETURN n.name ORDER BY n.rank") == [("A",), ("B",), ("C",)]
    assert rows(s, "MATCH (n:Item) RETURN n.name ORDER BY n.rank DESC") == [("C",), ("B",), ("A",)]
    assert rows(s, "MATCH (n:Item) WHERE n.rank <> 1 RETURN n.name ORDER BY n.name") == [("B",), ("C",)]
    assert rows(s, "MATCH (n:Item) WHERE NOT n.rank > 1 RETURN n.name ORDER BY n.name") == [("A",), ("C",)]
    assert rows(s, "MATCH (n:Item {rank: null}) RETURN n.name") == [("C",)]
    assert rows(s, "UNWIND [1] AS x RETURN null = null AS a, null <= null AS b, null < 1 AS c, 1 = 1.0 AS d") == [(True, True, False, True)]


def test_mixed_types(s):
    for x in ("1", "'one'", "true", "2.5", "'1'"):
        s.query(f"INSERT (:M {{x: {x}}})")
    s.query("INSERT (:M {y: 1})")
    assert sorted(rows(s, "MATCH (m:M) WHERE m.x IS NOT NULL RETURN m.x")) == [("1",), ("1",), ("2.5",), ("one",), ("true",)]
    assert rows(s, "MATCH (m:M) WHERE m.x = 1 RETURN m.x, size(m.x), m.x + 1") == [("1", None, 2.0)]
    assert rows(s, "MATCH (m:M {x: '1'}) RETURN toString(m.x), size(m.x)") == [("1", 1)]
    assert rows(s, "MATCH (m:M) WHERE m.x > 'a' OR m.x > 2.0 RETURN m.x ORDER BY m.x") == [("2.5",), ("one",)]
    assert sorted(rows(s, "MATCH (m:M) RETURN m.x AS x, count(*) AS n"), key=str) == sorted([("1", 1), ("1", 1), ("2.5", 1), ("one", 1), ("true", 1), (None, 1)], key=str)
    s.query("INSERT (:M {x: 1})")
    assert rows(s, "MATCH (m:M) RETURN count(*), count(DISTINCT m.x), sum(m.x)") == [(6, 5, 3.5)]


def test_undirected_and_loops(s):
    s.query("INSERT (a:N {k: 1}), (b:N {k: 2}), (a)-[:U]-(b)")
    for arrow in ("-[:U]->", "<-[:U]-", "-[:U]-"):
        assert sorted(rows(s, f"MATCH (a:N){arrow}(b:N) RETURN a.k, b.k")) == [(1, 2), (2, 1)]
    s.query("INSERT (c:L {k: 3}), (c)-[:S]->(c)")
    assert rows(s, "MATCH (c:L)-[:S]->(c) RETURN c.k") == [(3,)]
    assert rows(s, "MATCH (c:L)-[:S]-(d) RETURN d.k") == [(3,)]
    s.query("INSERT (d:M {k: 4}), (d)-[:V]-(d)")
    assert len(rows(s, "MATCH (d:M)-[:V]->(e) RETURN e.k")) == 2


def test_insert_backwards(s):
    s.query("INSERT (a:N {k: 1}), (b:N {k: 2}), (a)<-[:R]-(b)")
    assert rows(s, "MATCH (a:N)-[:R]->(b:N) RETURN a.k, b.k") == [(2, 1)]


def test_paths(s):
    s.query("INSERT (a:N {k: 'A'}), (b:N {k: 'B'}), (a)-[:R]->(b), (b)-[:R]->(a)")
    count = lambda m, q: rows(s, f"MATCH {m} (a:N)-[:R{q}]->(b:N) RETURN count(*)")[0][0]
    assert [count("", "*1..4"), count("TRAIL", "*1..4"), count("SIMPLE", "*1..4")] == [8, 4, 2]
    assert [count("TRAIL", "*"), count("SIMPLE", "+"), count("", "{2}"), count("", "*0..1")] == [6, 2, 2, 4]
    assert rows(s, "MATCH TRAIL (a:N {k: 'A'})-[p:R*1..]->(b) RETURN length(p), b.k ORDER BY length(p)") == [(1, "B"), (2, "A")]


def test_optional_and_with(s):
    s.query("INSERT (a:P {n: 'A'}), (b:P {n: 'B'}), (c:C {n: 'X'}), (a)-[:W]->(c)")
    assert sorted(rows(s, "MATCH (p:P) OPTIONAL MATCH (p)-[:W]->(c:C) RETURN p.n, c.n")) == [("A", "X"), ("B", None)]
    assert rows(s, "OPTIONAL MATCH (z:Z) RETURN z.n, count(*), count(z)") == [(None, 1, 0)]
    assert rows(s, "MATCH (p:P) OPTIONAL MATCH (p)-[:W]->(c:C) OPTIONAL MATCH (c)-[:Q]->(d) WITH p, d WHERE d IS NULL RETURN p.n ORDER BY p.n") == [("A",), ("B",)]
    assert rows(s, "MATCH (a:P)-[:W]->(c), (b:P)-[:W]->(c) RETURN a.n, b.n") == [("A", "A")]


def test_functions(s):
    got = rows(s, "UNWIND ['  Héé '] AS x RETURN trim(x), size(x), reverse('ab'), substring('hello', 1, 99), split('a.b.', '.'), split('ab', ''), toString('a'), toString(1.0), toInteger('7'), range(3, 1), range(1, 3, -1), tail([1]), head([]), sign(0.0)")
    assert got == [("Héé", 6, "ba", "ello", ["a", "b", ""], ["", "a", "b", ""], "a", "1", 7, [3, 2, 1], [], [], None, 0.0)]
    with pytest.raises(GraphError):
        s.query("UNWIND [1] AS x RETURN nosuch(x)")


def test_ids(s):
    knows(s)
    (text,) = rows(s, "MATCH (n:Person {name: 'Bob'}) RETURN id(n)")[0]
    assert len(text) == 26 and ulid_value(text.lower()) > 0
    assert rows(s, "MATCH (n:Person) WHERE id(n) = $i RETURN n.name", i=text) == [("Bob",)]
    assert rows(s, "MATCH (a)-[r:KNOWS]->(b) RETURN type(r), keys(r), labels(a), r.since") == [("KNOWS", ["since"], ["Person"], 2020)]


def test_upsert(s):
    for _ in range(2):
        knows(s)
    assert rows(s, "MATCH (n) RETURN count(*)") == [(2,)]
    assert rows(s, "MATCH ()-[r]->() RETURN count(*)") == [(1,)]
    s.query("INSERT (:Person)")
    s.query("INSERT (:Person)")
    assert rows(s, "MATCH (n) RETURN count(*)") == [(4,)]
    s.query("MATCH (a:Person {name: 'Bob'}), (b:Person {name: 'Alice'}) INSERT (a)-[:LIKES]->(b)")
    assert rows(s, "MATCH (a)-[:LIKES]->(b) RETURN a.name, b.name") == [("Bob", "Alice")]


def test_set_remove_delete(s):
    knows(s)
    s.query("MATCH (n:Person {name: 'Bob'}) SET n.age = 7, n:Old")
    assert rows(s, "MATCH (n:Old) RETURN n.name, n.age, labels(n)") == [("Bob", 7, ["Old", "Person"])]
    s.query("MATCH (a)-[r:KNOWS]->(b) SET r.since = r.since + 1")
    assert rows(s, "MATCH ()-[r:KNOWS]->() RETURN r.since") == [(2021,)]
    with pytest.raises(GraphError):
        s.query("MATCH (n:Old) DELETE n")
    s.query("MATCH (n:Old) REMOVE n:Old, n.age")
    assert rows(s, "MATCH (n:Person {name: 'Bob'}) RETURN n.age, labels(n)") == [(None, ["Person"])]
    s.query("MATCH (n:Person {name: 'Bob'}) DETACH DELETE n")
    assert rows(s, "MATCH (n) RETURN n.name") == [("Alice",)]
    assert rows(s, "MATCH ()-[r]->() RETURN count(*)") == [(0,)]


def test_constraints_and_transactions(s):
    s.query("CREATE CONSTRAINT UNIQUE ON :P(k)")
    s.query("CREATE CONSTRAINT TYPE IS INTEGER ON :P(n)")
    s.query("INSERT (:P {k: 1, n: 1})")
    for bad in ("INSERT (:P {k: 1, n: 2})", "INSERT (:P {k: 2, n: 'x'})", "UNWIND [5, 5] AS x INSERT (:P {k: x})"):
        with pytest.raises(ConstraintViolation):
            s.query(bad)
    assert rows(s, "MATCH (p:P) RETURN count(*)") == [(1,)]
    s.query("BEGIN")
    s.query("INSERT (:P {k: 9})")
    with pytest.raises(GraphError):
        s.query("TRUNCATE")
    s.query("ROLLBACK")
    assert rows(s, "MATCH (p:P) RETURN count(*)") == [(1,)]
    with pytest.raises(GraphError):
        s.rollback()


def test_call(s):
    knows(s)
    got = rows(s, "CALL degreeCentrality(normalized: false) YIELD node, degree MATCH (n:Person) WHERE n = node RETURN n.name, degree ORDER BY n.name")
    assert got == [("Alice", 1), ("Bob", 1)]
    for bad in ("CALL nosuch()", "CALL pageRank(damping: 2)", "CALL bfs()", "CALL wcc() YIELD nothing"):
        with pytest.raises(GraphError):
            s.query(bad)


@pytest.mark.parametrize("bad", ["MATCH", "MATCH (n RETURN n", "RETURN 1", "MATCH (n) RETURN n LIMIT", "MATCH (a)-[*3..1]->(b) RETURN a", "INSERT (a)-[:X]->(b) RETURN a"])
def test_parse_errors(bad):
    with pytest.raises(ParseError):
        parse(bad)


def test_comments_and_case():
    parse("match (n) /* x */ return n // end\n;")


def test_pushdown(spark, tmp_path):
    from lodestone.plans.compiler import Compiler
    from lodestone.sources.graph import GraphBuilder

    spark.range(100).selectExpr("id AS k", "id * 2 AS v", "id / 2 AS d", "string(id) AS t", "'x' AS unused").write.parquet(str(tmp_path / "t"))
    g = GraphBuilder(spark).node_table("T", spark.read.parquet(str(tmp_path / "t")), "k").build()

    def plan(where):
        return Compiler(g).run(parse(f"MATCH (t:T) WHERE {where} RETURN t.v"))._jdf.queryExecution().executedPlan().toString()

    assert "GreaterThan(v,10)" in plan("t.v > 10") and "unused" not in plan("t.v > 10")
    for where, pushed in (("t.d >= 3.5", "GreaterThanOrEqual(d,3.5)"), ("t.v < 7", "LessThan(v,7)"), ("5 <= t.v", "GreaterThanOrEqual(v,5)"),
                          ("startsWith(t.t, '1')", "StringStartsWith(t,1)"), ("t.v > 2 AND t.d < 40.0 AND t.t = '9'", "LessThan(d,40.0)")):
        assert pushed in plan(where), plan(where)
    for where, n in (("t.v > 10", 94), ("NOT t.v > 10", 6), ("t.v > t.d", 0), ("t.v >= null", 0), ("startsWith(t.t, '1') AND t.v >= 20", 10)):
        assert Compiler(g).run(parse(f"MATCH (t:T) WHERE {where} RETURN t.v")).count() == n, where


def test_stored_graph(spark, tmp_path):
    from lodestone.sources.catalog import GraphCatalog

    c = GraphCatalog(spark, str(tmp_path / "graphs"))
    knows(c.create("one"))
    assert c.list() == ["one"]
    assert rows(c.open("one"), "MATCH (a)-[:KNOWS]->(b) RETURN a.name, b.name") == [("Alice", "Bob")]
    with pytest.raises(GraphError):
        c.create("no/name")
    c.drop("one")
    assert c.list() == []


def test_csv_ids_are_kept(spark, tmp_path):
    from lodestone.sources.catalog import GraphCatalog

    (tmp_path / "n.csv").write_text(":ID,name\n1,a\n2,b\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID\n1,2\n2,9\n")
    c = GraphCatalog(spark, str(tmp_path / "graphs"))
    c.create("one").load_csv_nodes(str(tmp_path / "n.csv"), "N")
    assert c.open("one").load_csv_edges(str(tmp_path / "e.csv")) == (1, 1)
    with pytest.raises(GraphError):
        c.open("one").load_csv_nodes(str(tmp_path / "n.csv"))


def test_range_ends(s):
    top = (1 << 63) - 1
    got = rows(s, "UNWIND [1] AS i RETURN size(range(1, 5000000)), last(range(0, 0 - 9000000, 0 - 3)), range($a, $b), range(3, 1, 1)", a=top - 1, b=top)
    assert got == [(1000001, -3000000, [top - 1, top], [])]


def test_edge_ids_are_stable(spark):
    from lodestone.sources.graph import GraphBuilder

    pairs = spark.range(0, 200, 1, 4).selectExpr("id % 7 AS a", "id % 5 AS b").distinct()
    g = GraphBuilder(spark).node_table("N", spark.range(7), "id").edge_table("E", pairs, ("N", "a"), ("N", "b")).build()
    (part,) = g.edges
    one, two = (sorted(map(tuple, part.df.select("id", "src", "dst").repartition(n, "dst").collect())) for n in (2, 3))
    assert one == two and "Exchange" not in part.df._jdf.queryExecution().executedPlan().toString()


def test_delete_leaves_other_parts(s):
    knows(s)
    s.query("INSERT (:City {name: 'Oslo'})")
    before = {p.labels: p.df for p in s.graph.nodes}
    s.query("MATCH (n:Person {name: 'Bob'}) DETACH DELETE n")
    after = {p.labels: p.df for p in s.graph.nodes}
    city, person = frozenset(["City"]), frozenset(["Person"])
    assert after[city] is before[city] and after[person] is not before[person]


def test_csv(s, tmp_path):
    (tmp_path / "n.csv").write_text(":ID,name,age,:LABEL,:X\n1, Alice ,30,Person,q\n2,Bob,,Person,q\n3,Acme,1.5,Co,q\n")
    (tmp_path / "e.csv").write_text(":START_ID,:END_ID,:TYPE,w\n1,2,KNOWS,0.5\n1,3,,2\n1,9,KNOWS,1\n")
    assert s.load_csv(str(tmp_path / "n.csv"), str(tmp_path / "e.csv")) == (3, 2, 1)
    assert rows(s, "MATCH (a:Person)-[r:KNOWS]->(b) RETURN a.name, b.name, r.w, b.age") == [("Alice", "Bob", 0.5, None)]
    assert rows(s, "MATCH (a)-[r:RELATED]->(b:Co) RETURN b.name, r.w") == [("Acme", 2.0)]
    with pytest.raises(GraphError):
        s.load_csv_nodes(str(tmp_path / "n.csv"))
    (tmp_path / "m.csv").write_text(":ID,v\n11,1\n12,x\n13,true\n14,\n")
    s.load_csv_nodes(str(tmp_path / "m.csv"), "Mix")
    assert rows(s, "MATCH (m:Mix) WHERE m.v = 1 OR m.v = true RETURN m.v ORDER BY toString(m.v)") == [("1",), ("true",)]


def test_stream(spark, tmp_path, s):
    from lodestone.streaming.ingest import stream_nodes

    spark.range(5).selectExpr("id AS k", "id * id AS sq").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, sq long").parquet(str(tmp_path / "in"))
    stream_nodes(stream, s, "S", "k", str(tmp_path / "cp")).awaitTermination(120)
    assert rows(s, "MATCH (n:S) RETURN count(*), sum(n.sq)") == [(5, 30)]


def trade(spark, customers, suppliers, nations):
    """Customers and suppliers in nations, both by an edge of the same label."""
    n, c, s = (spark.range(k).withColumnRenamed("id", "k").selectExpr("k", "k as v", f"k % {nations} as n") for k in (nations, customers, suppliers))
    b = GraphBuilder(spark).node_table("Nation", n, "k").node_table("Customer", c, "k").node_table("Supplier", s, "k")
    b.edge_table("IN", c, ("Customer", "k"), ("Nation", "n")).edge_table("IN", s, ("Supplier", "k"), ("Nation", "n"))
    return GraphSession(b.build())


def test_shared_variables_count_without_pairs(spark):
    s = trade(spark, 200_000, 100_000, 1)
    for text in (
        "MATCH (c:Customer)-[:IN]->(n:Nation), (s:Supplier)-[:IN]->(n) RETURN n.v AS n, count(*) AS k",
        "MATCH (n:Nation)<-[:IN]-(c:Customer), (n)<-[:IN]-(s:Supplier) RETURN n.v AS n, count(*) AS k",
    ):
        df = s.query(text)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == 3, plan  # before the patterns meet, and after
        assert [tuple(r) for r in df.collect()] == [(0, 20_000_000_000)]


@pytest.mark.parametrize("patterns", [
    "(c:Customer)-[:IN]->(n:Nation), (s:Supplier)-[:IN]->(n)",
    "(c:Customer)-[:IN]->(n:Nation {v: 1}), (s:Supplier)-[:IN]->(n {v: 1})",
    "(n:Nation)<-[:IN]-(c), (n)<-[:IN]-(s:Supplier), (d:Customer)-[:IN]->(n)",
    "(c:Customer)-[:IN]->(n:Nation), (s)-[:IN]->(n)<-[:IN]-(c:Customer)",
    "(c:Customer)-[e:IN]->(n), (s:Supplier)-[:IN]-(n), (n)-[:IN*1..2]-(d)",
])
def test_shared_variables_agree_with_rows(spark, patterns):
    s = trade(spark, 7, 5, 3)
    where = "WHERE c.v > 1 AND n.v < 2" if "(c:Customer)" in patterns else "WHERE n.v < 2"
    every = rows(s, f"MATCH {patterns} {where} RETURN id(n), n.v, c.v, s.v")
    out = {}
    for _, n, _, v in every:
        got = out.setdefault(n, [0, 0, set()])
        got[0], got[1] = got[0] + 1, got[1] + (v is not None)
        got[2].add(v)
    assert out
    want = sorted((n, k, some, len(v - {None})) for n, (k, some, v) in out.items())
    assert sorted(rows(s, f"MATCH {patterns} {where} RETURN n.v, count(*), count(s.v), count(DISTINCT s.v)")) == want
    assert sorted(rows(s, f"MATCH {patterns} {where} RETURN n.v, count(*) AS k ORDER BY k")) == sorted(x[:2] for x in want)
    assert rows(s, f"MATCH {patterns} {where} RETURN count(*)") == [(len(every),)]
    assert rows(s, f"MATCH {patterns} WHERE n.v > 99 RETURN count(*), count(n), max(n.v)") == [(0, 0, None)]

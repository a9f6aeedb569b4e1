"""The star-schema tables as a property graph, and a query with its SQL for each operator of the language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.plans.compiler import Compiler
from lodestone.plans.parser import parse
from lodestone.session import GraphSession
from lodestone.shared import new_folder
from lodestone.sources.graph import GraphBuilder, PropertyGraph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@lru_cache(maxsize=16)
def star_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Region, Nation, Customer, Supplier, Part, Order and Doc nodes; IN_REGION, IN_NATION, PLACED, CONTAINS and
    SUPPLIES edges. Lazy: a statement reads the tables and columns that it needs. The definition (no data) is kept, as
    a session keeps its graph."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    b = GraphBuilder(spark)
    b.node_table("Region", t("region"), "r_regionkey", 1)
    b.node_table("Nation", t("nation"), "n_nationkey", 2)
    b.node_table("Customer", t("customer"), "c_custkey", 3)
    b.node_table("Supplier", t("supplier"), "s_suppkey", 4)
    b.node_table("Part", t("part"), "p_partkey", 5)
    b.node_table("Order", t("orders"), "o_orderkey", 6)
    b.node_table("Doc", t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id", "left"), "doc_id", 8)
    b.edge_table("IN_REGION", t("nation"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"))
    b.edge_table("IN_NATION", t("customer"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"))
    b.edge_table("IN_NATION", t("supplier"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"))
    b.edge_table("PLACED", t("orders"), ("Customer", "o_custkey"), ("Order", "o_orderkey"))
    props = ["l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    b.edge_table("CONTAINS", t("lineitem"), ("Order", "l_orderkey"), ("Part", "l_partkey"), props)
    b.edge_table("SUPPLIES", t("lineitem").select("l_suppkey", "l_partkey").distinct(), ("Supplier", "l_suppkey"), ("Part", "l_partkey"))
    return b.build()


@lru_cache(maxsize=16)
def user_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Users and NEXT edges: the user of each event to that of the following one, weighing the first event's value.
    Each pair of following events comes from a join on the event's number, not from one global window."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    step = events.withColumn("next_id", F.col("event_id") + 1).join(events.select(F.col("event_id").alias("next_id"), F.col("user_id").alias("dst")), "next_id")
    b = GraphBuilder(spark)
    b.node_table("User", events.select("user_id").distinct(), "user_id", 7)
    b.edge_table("NEXT", step.select(F.col("user_id").alias("src"), "dst", "value"), ("User", "src"), ("User", "dst"), ["value"])
    return b.build()


def supply_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Nations, customers, suppliers and regions with their IN_NATION and IN_REGION edges only: a forest."""
    g = star_graph(spark, sf_dir)
    keep = {"Region", "Nation", "Customer", "Supplier"}
    return replace(g, nodes=tuple(p for p in g.nodes if p.labels & keep), edges=tuple(e for e in g.edges if e.label in ("IN_REGION", "IN_NATION")))


def gql(name: str, text: str, sql: str | None, graph=star_graph, params: dict | None = None) -> None:
    """Register a read statement and its SQL."""
    QUERIES[name] = lambda spark, sf_dir: Compiler(graph(spark, sf_dir), params).run(parse(text))
    if sql:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


NEXT = "n AS (SELECT a.user_id AS src, b.user_id AS dst, a.value, a.event_id AS e FROM events a JOIN events b ON b.event_id = a.event_id + 1)"
USERS = "u AS (SELECT DISTINCT user_id AS id FROM events)"

# -- scans, filters, projections ----------------------------------------------------------------------
gql("flagship", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 100000.0 RETURN c.c_mktsegment AS segment, count(*) AS n, max(o.o_totalprice) AS top ORDER BY n DESC",
    "SELECT c_mktsegment AS segment, count(*) AS n, max(o_totalprice) AS top FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 100000 GROUP BY 1")
gql("scan_filter", "MATCH (o:Order) WHERE o.o_totalprice > 300000 AND o.o_orderstatus = 'F' RETURN o.o_orderkey AS k, o.o_totalprice AS p",
    "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
gql("project_expr", "MATCH (p:Part) RETURN p.p_partkey AS k, p.p_size * 2 + 1 AS a, p.p_size / 3 AS b, p.p_size % 7 AS c, -p.p_size AS d",
    "SELECT p_partkey AS k, p_size::BIGINT * 2 + 1 AS a, p_size::BIGINT // 3 AS b, p_size::BIGINT % 7 AS c, -p_size::BIGINT AS d FROM part")
gql("default_names", "MATCH (r:Region) RETURN r.r_name, r.r_regionkey + 1, tolower(r.r_name)",
    'SELECT r_name AS "r.r_name", r_regionkey::BIGINT + 1 AS "r.r_regionkey + 1", lower(r_name) AS "tolower(r.r_name)" FROM region')
gql("distinct_values", "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
gql("order_limit_offset", "MATCH (o:Order) RETURN o.o_orderkey AS k ORDER BY o.o_totalprice DESC, k OFFSET 5 LIMIT 20",
    "SELECT o_orderkey AS k FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 LIMIT 20")
gql("null_order_optional", "MATCH (d:Doc) RETURN d.doc_id AS k, d.quality AS q ORDER BY d.quality DESC, k LIMIT 50",
    "SELECT doc_id AS k, quality AS q FROM documents LEFT JOIN labels USING (doc_id) ORDER BY q DESC NULLS FIRST, k LIMIT 50")
gql("inline_props", "MATCH (n:Nation {n_regionkey: 1}) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation WHERE n_regionkey = 1")
gql("inline_null", "MATCH (d:Doc {quality: null}) RETURN d.doc_id AS k", "SELECT doc_id AS k FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
gql("in_list", "MATCH (n:Nation) WHERE n.n_regionkey IN [0, 2, 4] AND NOT n.n_name IN ['NATION_1', $x] RETURN n.n_nationkey AS k",
    "SELECT n_nationkey AS k FROM nation WHERE n_regionkey IN (0, 2, 4) AND n_name NOT IN ('NATION_1', 'NATION_2')", params={"x": "NATION_2"})
gql("is_null", "MATCH (d:Doc) WHERE d.quality IS NULL OR d.toxic IS NOT NULL AND d.toxic = 1 RETURN d.doc_id AS k",
    "SELECT doc_id AS k FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR toxic = 1")
gql("two_valued_logic", "MATCH (d:Doc) WHERE NOT d.quality > 0 AND d.toxic <> 1 RETURN d.doc_id AS k, d.quality = null AS a, d.quality <= null AS b, d.quality < 1 AS c",
    "SELECT doc_id AS k, quality IS NULL AS a, quality IS NULL AS b, coalesce(quality < 1, false) AS c FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality > 0, false) AND toxic IS DISTINCT FROM 1")
gql("params_limit", "MATCH (c:Customer) WHERE c.c_mktsegment = $seg RETURN c.c_custkey AS k ORDER BY k SKIP $skip LIMIT $n",
    "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 OFFSET 3 LIMIT 10", params={"seg": "BUILDING", "skip": 3, "n": 10})
gql("param_missing", "MATCH (d:Doc) WHERE d.quality = $none RETURN count(*) AS n", "SELECT count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
gql("error_drops_row", "MATCH (p:Part) WHERE 100 / (p.p_size % 5) > 30 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size % 5 <> 0 AND 100 // (p_size % 5) > 30")
gql("unlabelled_count", "MATCH (n) RETURN count(*) AS n",
    "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM documents) AS n")
gql("label_count", "MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders")
# -- hops and joins -------------------------------------------------------------------------------------
gql("hop_out", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN c.c_custkey AS c, n.n_name AS n", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
gql("hop_in", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS n, count(*) AS c", "SELECT n_name AS n, count(*) AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
gql("hop_any", "MATCH (n:Nation)-[:IN_REGION]-(r) RETURN n.n_name AS n, labels(r) AS l", "SELECT n_name AS n, ['Region'] AS l FROM nation")
gql("hop_any_users", "MATCH (a:User)-[e:NEXT]-(b:User) RETURN a.user_id AS a, count(*) AS n, sum(b.user_id) AS s",
    f"WITH {NEXT}, x AS (SELECT src AS a, dst AS b FROM n UNION ALL SELECT dst, src FROM n WHERE src <> dst) SELECT a, count(*) AS n, sum(b)::BIGINT AS s FROM x GROUP BY a", user_graph)
gql("two_hop", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part) WHERE l.l_quantity > 45 RETURN c.c_mktsegment AS seg, p.p_brand AS brand, count(*) AS n",
    "SELECT c_mktsegment AS seg, p_brand AS brand, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 GROUP BY 1, 2")
gql("region_rollup", "MATCH (o:Order)<-[:PLACED]-(c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, count(*) AS n, count(DISTINCT c.c_custkey) AS cs",
    "SELECT r_name AS r, count(*) AS n, count(DISTINCT c_custkey) AS cs FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
gql("edge_props", "MATCH (o:Order)-[l:CONTAINS {l_returnflag: 'R'}]->(p) WHERE l.l_discount >= 0.05 RETURN o.o_orderkey AS k, l.l_linenumber AS n, type(l) AS t, l.l_quantity AS q",
    "SELECT l_orderkey AS k, l_linenumber AS n, 'CONTAINS' AS t, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05 AND l_orderkey IN (SELECT o_orderkey FROM orders)")
gql("cross_theta", "MATCH (a:Region), (b:Region) WHERE a.r_regionkey > b.r_regionkey RETURN a.r_name AS a, b.r_name AS b",
    "SELECT a.r_name AS a, b.r_name AS b FROM region a, region b WHERE a.r_regionkey > b.r_regionkey")
gql("cross_equi", "MATCH (c:Customer), (s:Supplier) WHERE c.c_nationkey = s.s_nationkey RETURN s.s_suppkey AS s, count(*) AS n",
    "SELECT s_suppkey AS s, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1")
gql("shared_var", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.n_name AS n, count(*) AS k",
    "SELECT n_name AS n, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
gql("cycle_back", "MATCH (a:User)-[:NEXT]->(b:User)-[:NEXT]->(a) RETURN a.user_id AS a, count(*) AS n", f"WITH {NEXT} SELECT x.src AS a, count(*) AS n FROM n x JOIN n y ON x.dst = y.src AND y.dst = x.src GROUP BY 1", user_graph)
gql("self_loops", "MATCH (a:User)-[:NEXT]->(a) RETURN a.user_id AS a, count(*) AS n", f"WITH {NEXT} SELECT src AS a, count(*) AS n FROM n WHERE src = dst GROUP BY 1", user_graph)
# -- optional, with, unwind, union ----------------------------------------------------------------------
gql("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) RETURN c.c_custkey AS c, count(o) AS n, count(*) AS r",
    "SELECT c_custkey AS c, count(o_orderkey) AS n, count(*) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
gql("optional_where", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 200000 AND c.c_acctbal > 0 RETURN c.c_custkey AS c, o.o_orderkey AS o",
    "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 AND c_acctbal > 0")
gql("optional_chain", "MATCH (n:Nation) OPTIONAL MATCH (n)<-[:IN_NATION]-(s:Supplier) WHERE s.s_acctbal > 9000 OPTIONAL MATCH (s)-[:SUPPLIES]->(p:Part) WHERE p.p_size > 45 RETURN n.n_name AS n, s.s_suppkey AS s, count(p) AS k",
    "SELECT n_name AS n, s_suppkey AS s, count(p_partkey) AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 LEFT JOIN (SELECT DISTINCT l_suppkey, p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 45) ON l_suppkey = s_suppkey GROUP BY 1, 2")
gql("anti_join", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WITH c.c_custkey AS k, count(o) AS n WHERE n = 0 RETURN k", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
gql("optional_standalone", "OPTIONAL MATCH (r:Region) WHERE r.r_regionkey > 100 RETURN r.r_name AS name, count(*) AS n, count(r) AS m", "SELECT NULL::VARCHAR AS name, 1::BIGINT AS n, 0::BIGINT AS m")
gql("with_having", "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c.c_custkey AS k, count(*) AS n, max(o.o_totalprice) AS top WHERE n > 12 RETURN k, n * 2 AS m, top ORDER BY k",
    "SELECT o_custkey AS k, count(*) * 2 AS m, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 12")
gql("with_element", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH DISTINCT r AS x WHERE x.r_regionkey < 3 RETURN x.r_name AS name", "SELECT r_name AS name FROM region WHERE r_regionkey < 3")
gql("with_distinct", "MATCH (o:Order) WITH DISTINCT o.o_orderstatus AS s RETURN count(*) AS n", "SELECT count(DISTINCT o_orderstatus) AS n FROM orders")
gql("unwind_list", "UNWIND [3, 1, 2, 3] AS x RETURN x, x * 10 AS y ORDER BY x", "SELECT unnest([3, 1, 2, 3])::BIGINT AS x, unnest([30, 10, 20, 30])::BIGINT AS y")
gql("unwind_range", "UNWIND range(10, 1, -3) AS x RETURN x", "SELECT unnest([10, 7, 4, 1])::BIGINT AS x")
gql("unwind_maps", "UNWIND $rows AS r RETURN r.name AS name, r.age + 1 AS age", "SELECT * FROM (VALUES ('a', 2::BIGINT), ('b', NULL)) t(name, age)", params={"rows": [{"name": "a", "age": 1}, {"name": "b"}]})
gql("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
gql("union_all", "MATCH (r:Region) RETURN r.r_name AS name UNION MATCH (r:Region) RETURN r.r_name AS name UNION ALL MATCH (n:Nation) RETURN n.n_name AS name",
    "SELECT r_name AS name FROM region UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation")
# -- aggregates -----------------------------------------------------------------------------------------
gql("agg_global", "MATCH (p:Part) RETURN count(*) AS n, sum(p.p_size) AS s, min(p.p_name) AS lo, max(p.p_retailprice) AS hi, count(DISTINCT p.p_brand) AS b",
    "SELECT count(*) AS n, sum(p_size)::BIGINT AS s, min(p_name) AS lo, max(p_retailprice) AS hi, count(DISTINCT p_brand) AS b FROM part")
gql("agg_empty", "MATCH (p:Part) WHERE p.p_size > 1000 RETURN count(*) AS n, sum(p.p_size) AS s, collect(p.p_name) AS c", "SELECT 0::BIGINT AS n, NULL::BIGINT AS s, []::VARCHAR[] AS c")
gql("agg_grouped", "MATCH (p:Part) RETURN p.p_brand AS b, count(*) AS n, avg(p.p_size) AS a ORDER BY b", "SELECT p_brand AS b, count(*) AS n, sum(p_size)::DOUBLE / count(p_size) AS a FROM part GROUP BY 1")
gql("agg_collect", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.r_name AS r, collect(n.n_nationkey) AS l", "SELECT r_name AS r, list(n_nationkey ORDER BY n_nationkey) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
gql("agg_nulls", "MATCH (d:Doc) RETURN d.lang AS l, count(d.quality) AS n, sum(d.toxic) AS t, min(d.quality) AS m",
    "SELECT lang AS l, count(quality) AS n, sum(toxic)::BIGINT AS t, min(quality) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
gql("agg_expr", "MATCH (p:Part) RETURN p.p_type AS t, sum(p.p_size) / count(*) AS a, max(p.p_size) - min(p.p_size) AS r, count(*) > 10 AS many",
    "SELECT p_type AS t, sum(p_size)::BIGINT // count(*) AS a, (max(p_size) - min(p_size))::BIGINT AS r, count(*) > 10 AS many FROM part GROUP BY 1")
# -- functions ------------------------------------------------------------------------------------------
gql("string_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, toUpper(p.p_name) AS a, size(p.p_name) AS b, substring(p.p_name, 2, 3) AS c, left(p.p_name, 2) AS d, right(p.p_name, 2) AS e, replace(p.p_name, 'a', 'xx') AS f, reverse(p.p_name) AS g, split(p.p_name, 'a') AS h, trim('  x ') AS i, lowercase('AbC') AS j",
    "SELECT p_partkey AS k, upper(p_name) AS a, length(p_name) AS b, substr(p_name, 3, 3) AS c, left(p_name, 2) AS d, right(p_name, 2) AS e, replace(p_name, 'a', 'xx') AS f, reverse(p_name) AS g, string_split(p_name, 'a') AS h, 'x' AS i, 'abc' AS j FROM part")
gql("predicate_functions", "MATCH (p:Part) WHERE startsWith(p.p_brand, 'Brand') AND contains(p.p_name, 'a') AND NOT endsWith(p.p_name, 'e') RETURN p.p_partkey AS k, exists(p.nothing) AS x, isNull(p.nothing) AS y, not(true) AS z",
    "SELECT p_partkey AS k, false AS x, true AS y, false AS z FROM part WHERE starts_with(p_brand, 'Brand') AND contains(p_name, 'a') AND NOT ends_with(p_name, 'e')")
gql("math_functions", "MATCH (c:Customer) RETURN c.c_custkey AS k, abs(c.c_acctbal) AS a, ceil(c.c_acctbal) AS b, floor(c.c_acctbal) AS c, round(c.c_acctbal) AS d, sign(c.c_acctbal) AS e, sqrt(c.c_custkey) AS f, abs(-3) AS g, ceil(2) AS h",
    "SELECT c_custkey AS k, abs(c_acctbal) AS a, ceil(c_acctbal) AS b, floor(c_acctbal) AS c, round(c_acctbal) AS d, sign(c_acctbal)::DOUBLE AS e, sqrt(c_custkey) AS f, 3::BIGINT AS g, 2::BIGINT AS h FROM customer")
gql("list_functions", "MATCH (r:Region) RETURN r.r_regionkey AS k, head([r.r_regionkey, 7]) AS a, last([1, 2]) AS b, tail([1, 2, 3]) AS c, reverse([1, 2]) AS d, size([1, 2, 3]) AS e, range(1, r.r_regionkey) AS f, head([]) AS g",
    "SELECT r_regionkey AS k, r_regionkey::BIGINT AS a, 2::BIGINT AS b, [2, 3]::BIGINT[] AS c, [2, 1]::BIGINT[] AS d, 3::BIGINT AS e, CASE WHEN r_regionkey = 0 THEN [1, 0] ELSE range(1, r_regionkey + 1) END::BIGINT[] AS f, NULL::VARCHAR AS g FROM region")
gql("conversion_functions", "MATCH (p:Part) RETURN p.p_partkey AS k, toString(p.p_size) AS a, toInteger(p.p_retailprice) AS b, toFloat(p.p_size) AS c, toInteger('42') AS d, toString(2.0) AS e, toString(null) AS f, coalesce(p.nothing, p.p_size) AS g",
    "SELECT p_partkey AS k, p_size::VARCHAR AS a, trunc(p_retailprice)::BIGINT AS b, p_size::DOUBLE AS c, 42::BIGINT AS d, '2' AS e, 'null' AS f, p_size AS g FROM part")
gql("graph_functions", "MATCH (r:Region)<-[e:IN_REGION]-(n:Nation) RETURN n.n_nationkey AS k, labels(r) AS l, type(e) AS t, keys(r) AS ks, id(r) AS i",
    "SELECT n_nationkey AS k, ['Region'] AS l, 'IN_REGION' AS t, ['r_name', 'r_regionkey'] AS ks, '0000000000000000010000000' || n_regionkey AS i FROM nation")
# -- paths ----------------------------------------------------------------------------------------------
FOREST = """e AS (SELECT 'n' || n_nationkey AS s, 'r' || n_regionkey AS d FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
gql("path_exact", "MATCH (s:Supplier)-[*2]->(r:Region) RETURN r.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", supply_graph)
gql("path_range", "MATCH (a:User)-[:NEXT*1..2]->(b:User) RETURN a.user_id AS a, count(*) AS n", f"WITH {NEXT}, p AS (SELECT src, dst FROM n UNION ALL SELECT x.src, y.dst FROM n x JOIN n y ON x.dst = y.src) SELECT src AS a, count(*) AS n FROM p GROUP BY 1", user_graph)
gql("path_zero_hop", "MATCH (n:Nation)-[:IN_REGION*0..1]->(x) RETURN n.n_nationkey AS k, labels(x) AS l", "SELECT n_nationkey AS k, ['Nation'] AS l FROM nation UNION ALL SELECT n_nationkey, ['Region'] FROM nation", supply_graph)
gql("path_unbounded", "MATCH (s)-[*]->(r:Region) RETURN r.r_name AS r, count(*) AS n",
    f"WITH RECURSIVE {FOREST}, v AS (SELECT DISTINCT s AS x FROM e UNION SELECT d FROM e), p(s, d) AS (SELECT x, x FROM v UNION ALL SELECT p.s, e.d FROM p JOIN e ON p.d = e.s) SELECT r_name AS r, count(*) AS n FROM p JOIN region ON d = 'r' || r_regionkey GROUP BY 1", supply_graph)
gql("path_length_var", "MATCH (s:Supplier)-[p*1..2]->(x) RETURN s.s_suppkey AS s, length(p) AS l, labels(x) AS t", "SELECT s_suppkey AS s, 1::BIGINT AS l, ['Nation'] AS t FROM supplier UNION ALL SELECT s_suppkey, 2, ['Region'] FROM supplier", supply_graph)
gql("path_trail", "MATCH TRAIL (a:User)-[:NEXT*1..2]->(b:User) RETURN b.user_id AS b, count(*) AS n",
    f"WITH {NEXT}, p AS (SELECT dst FROM n UNION ALL SELECT y.dst FROM n x JOIN n y ON x.dst = y.src AND x.e <> y.e) SELECT dst AS b, count(*) AS n FROM p GROUP BY 1", user_graph)
gql("path_simple", "MATCH SIMPLE (a:User)-[:NEXT*1..2]->(b:User) RETURN b.user_id AS b, count(*) AS n",
    f"WITH {NEXT}, p AS (SELECT dst FROM n WHERE dst <> src UNION ALL SELECT y.dst FROM n x JOIN n y ON x.dst = y.src WHERE x.dst <> x.src AND y.dst <> x.src AND y.dst <> x.dst) SELECT dst AS b, count(*) AS n FROM p GROUP BY 1", user_graph)
gql("path_undirected", "MATCH (r:Region {r_regionkey: 0})-[:IN_REGION*2]-(x) RETURN labels(x) AS l, count(*) AS n",
    "WITH k AS (SELECT count(*) AS c FROM nation WHERE n_regionkey = 0) SELECT ['Region'] AS l, c AS n FROM k WHERE c > 0", supply_graph)
gql("path_edge_prop_list", "MATCH (a:User)-[p:NEXT*2]->(b) RETURN a.user_id AS a, b.user_id AS b, p.value AS v, size(p.value) AS s",
    f"WITH {NEXT} SELECT x.src AS a, y.dst AS b, [x.value, y.value] AS v, 2::BIGINT AS s FROM n x JOIN n y ON x.dst = y.src", user_graph)
gql("path_plus_chain", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS{1,1}]->(p:Part) RETURN c.c_mktsegment AS s, count(*) AS n", "SELECT c_mktsegment AS s, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")


# -- algorithms -----------------------------------------------------------------------------------------
def users(name: str, call: str, sql: str | None = None, tail: str = "") -> None:
    gql(name, call + tail, sql, user_graph)


def uid(key: int) -> int:
    return key + (7 << 40)


ADJ = "d AS (SELECT DISTINCT src, dst FROM n WHERE src <> dst)"
users("call_degree", "CALL degreeCentrality(normalized: false) YIELD node, in_degree, out_degree, degree MATCH (u:User) WHERE u = node RETURN u.user_id AS u, in_degree AS i, out_degree AS o, degree AS d",
      f"WITH {NEXT}, {USERS} SELECT id AS u, (SELECT count(*) FROM n WHERE dst = id) AS i, (SELECT count(*) FROM n WHERE src = id) AS o, (SELECT count(*) FROM n WHERE dst = id) + (SELECT count(*) FROM n WHERE src = id) AS d FROM u")
users("call_bfs", f"CALL bfs(start: {uid(1)}) YIELD node, depth MATCH (u:User) WHERE u = node RETURN u.user_id AS u, depth",
      f"WITH RECURSIVE {NEXT}, {ADJ}, r(x, k) AS (SELECT 1::BIGINT, 0::BIGINT UNION SELECT dst, k + 1 FROM r JOIN d ON x = src WHERE k < 12) SELECT x AS u, min(k) AS depth FROM r GROUP BY 1")
users("call_wcc", "CALL wcc() YIELD node, component, size MATCH (u:User), (c:User) WHERE u = node AND c = component RETURN u.user_id AS u, c.user_id AS c, size",
      f"WITH RECURSIVE {NEXT}, {USERS}, b AS (SELECT DISTINCT src, dst FROM n UNION SELECT dst, src FROM n), r(s, x) AS (SELECT id, id FROM u UNION SELECT s, dst FROM r JOIN b ON x = src), c AS (SELECT s, min(x) AS c FROM r GROUP BY s) SELECT s AS u, c, count(*) OVER (PARTITION BY c) AS size FROM c")
users("call_scc", "CALL scc() YIELD node, component, size MATCH (u:User), (c:User) WHERE u = node AND c = component RETURN u.user_id AS u, c.user_id AS c, size",
      f"WITH RECURSIVE {NEXT}, {USERS}, {ADJ}, r(s, x) AS (SELECT id, id FROM u UNION SELECT s, dst FROM r JOIN d ON x = src), c AS (SELECT a.s, min(a.x) AS c FROM r a JOIN r b ON a.s = b.x AND a.x = b.s GROUP BY a.s) SELECT s AS u, c, count(*) OVER (PARTITION BY c) AS size FROM c")
gql("call_wcc_forest", "CALL wcc(minSize: 2) YIELD node, component, size MATCH (r:Region) WHERE r = component RETURN r.r_name AS r, count(*) AS n, max(size) AS s",
    "SELECT r_name AS r, c AS n, c AS s FROM (SELECT r_name, 1 + count(DISTINCT n_nationkey) + (SELECT count(*) FROM customer JOIN nation x ON c_nationkey = x.n_nationkey WHERE x.n_regionkey = r_regionkey) + (SELECT count(*) FROM supplier JOIN nation x ON s_nationkey = x.n_nationkey WHERE x.n_regionkey = r_regionkey) AS c FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name, r_regionkey)", supply_graph)
users("call_pagerank", "CALL pageRank(iterations: 3, tolerance: 0.0) YIELD node, score MATCH (u:User) WHERE u = node RETURN u.user_id AS u, round(score * 100000000) AS s",
      f"""WITH RECURSIVE {NEXT}, {USERS}, c AS (SELECT count(*)::DOUBLE AS c FROM u), w AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS p FROM n GROUP BY src, dst),
          z AS (SELECT id FROM u WHERE id NOT IN (SELECT src FROM n)),
          r0 AS (SELECT id, 1 / c AS s FROM u, c), r1 AS (SELECT id, 0.15 / c + 0.85 * (SELECT coalesce(sum(s), 0) FROM r0 WHERE id IN (FROM z)) / c + 0.85 * coalesce((SELECT sum(r0.s * p) FROM w JOIN r0 ON r0.id = src WHERE dst = u.id), 0) AS s FROM u, c),
          r2 AS (SELECT id, 0.15 / c + 0.85 * (SELECT coalesce(sum(s), 0) FROM r1 WHERE id IN (FROM z)) / c + 0.85 * coalesce((SELECT sum(r1.s * p) FROM w JOIN r1 ON r1.id = src WHERE dst = u.id), 0) AS s FROM u, c),
          r3 AS (SELECT id, 0.15 / c + 0.85 * (SELECT coalesce(sum(s), 0) FROM r2 WHERE id IN (FROM z)) / c + 0.85 * coalesce((SELECT sum(r2.s * p) FROM w JOIN r2 ON r2.id = src WHERE dst = u.id), 0) AS s FROM u, c)
          SELECT id AS u, round(s / (SELECT sum(s) FROM r3) * 100000000) AS s FROM r3""")  # fmt: skip
PAIR = "q AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM n WHERE src <> dst)"
TRI = "t AS (SELECT x.a AS a, x.b AS b, y.b AS c FROM q x JOIN q y ON x.b = y.a JOIN q z ON z.a = x.a AND z.b = y.b)"
users("call_triangles_local", "CALL triangleCount() YIELD node, triangles MATCH (u:User) WHERE u = node RETURN u.user_id AS u, triangles",
      f"WITH {NEXT}, {USERS}, {PAIR}, {TRI} SELECT id AS u, (SELECT count(*) FROM t WHERE id IN (a, b, c)) AS triangles FROM u")
users("call_triangles_global", "CALL triangleCount(mode: 'global') YIELD triangles, transitivity RETURN triangles, round(transitivity * 1000000) AS t",
      f"WITH {NEXT}, {PAIR}, {TRI}, g AS (SELECT x, count(*) AS k FROM (SELECT a AS x FROM q UNION ALL SELECT b FROM q) GROUP BY x) SELECT (SELECT count(*) FROM t) AS triangles, round(3.0 * (SELECT count(*) FROM t) / (SELECT sum(k * (k - 1) // 2) FROM g) * 1000000) AS t")
users("call_jaccard", "CALL jaccardSimilarity(topK: 3) YIELD node1, node2, score MATCH (a:User), (b:User) WHERE a = node1 AND b = node2 RETURN a.user_id AS a, b.user_id AS b, round(score * 1000000) AS s",
      f"WITH {NEXT}, x AS (SELECT DISTINCT src AS a, dst AS b FROM n WHERE src <> dst UNION SELECT dst, src FROM n WHERE src <> dst), g AS (SELECT a, count(*) AS k FROM x GROUP BY a), p AS (SELECT l.a AS a, r.a AS b, count(*) AS c FROM x l JOIN x r ON l.b = r.b AND l.a <> r.a GROUP BY 1, 2), s AS (SELECT p.a, p.b, c / (ga.k + gb.k - c)::DOUBLE AS s FROM p JOIN g ga ON ga.a = p.a JOIN g gb ON gb.a = p.b), w AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s) SELECT a, b, round(s * 1000000) AS s FROM w WHERE k <= 3")
VOTES = ", ".join(
    f"l{i + 1} AS MATERIALIZED (SELECT p.id, coalesce(v.l, p.l) AS l FROM l{i} p LEFT JOIN (SELECT a, l, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, l) AS k FROM x JOIN l{i} ON b = id GROUP BY a, l) v ON v.a = p.id AND v.k = 1)"
    for i in range(10)
)
users("call_label_propagation", "CALL labelPropagation() YIELD node, community MATCH (u:User), (c:User) WHERE u = node AND c = community RETURN u.user_id AS u, c.user_id AS c",
      f"WITH {NEXT}, {USERS}, x AS (SELECT DISTINCT src AS a, dst AS b FROM n WHERE src <> dst UNION SELECT dst, src FROM n WHERE src <> dst), l0 AS (SELECT id, id AS l FROM u), {VOTES} SELECT id AS u, l AS c FROM l10")
users("call_shortest_path", f"CALL shortestPath(source: {uid(1)}) YIELD target, cost, path MATCH (u:User) WHERE u = target RETURN u.user_id AS u, cost, size(path) AS l",
      f"WITH RECURSIVE {NEXT}, {ADJ}, r(x, k) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, k + 1 FROM r JOIN d ON x = src WHERE k < 12) SELECT x AS u, min(k)::DOUBLE AS cost, min(k)::BIGINT + 1 AS l FROM r WHERE x <> 1 GROUP BY 1")
users("call_shortest_path_weighted", f"CALL shortestPath(source: {uid(1)}, weight: 'value', maxCost: 8.0) YIELD target, cost MATCH (u:User) WHERE u = target RETURN u.user_id AS u, round(cost * 10000) AS c",
      f"WITH RECURSIVE {NEXT}, w AS (SELECT src, dst, min(value) AS w FROM n GROUP BY 1, 2), r(x, c) AS (SELECT 1::BIGINT, 0.0::DOUBLE UNION SELECT dst, c + w FROM r JOIN w ON x = src WHERE c + w <= 8.0) SELECT x AS u, round(min(c) * 10000) AS c FROM r WHERE x <> 1 GROUP BY 1")
users("call_closeness", "CALL closenessCentrality() YIELD node, score MATCH (u:User) WHERE u = node RETURN u.user_id AS u, round(score * 1000000) AS s",
      f"WITH RECURSIVE {NEXT}, {USERS}, {ADJ}, r(s, x, k) AS (SELECT id, id, 0 FROM u UNION SELECT s, dst, k + 1 FROM r JOIN d ON x = src WHERE k < 12), m AS (SELECT s, x, min(k) AS k FROM r WHERE s <> x GROUP BY 1, 2), g AS (SELECT s, count(*) AS c, sum(k) AS t FROM m GROUP BY s) SELECT id AS u, coalesce(round(c / t::DOUBLE * (c / ((SELECT count(*) FROM u) - 1)::DOUBLE) ** 2 * 1000000), 0) AS s FROM u LEFT JOIN g ON s = id")
users("call_dfs", f"CALL dfs(start: {uid(1)}) YIELD node, depth RETURN node, depth")
users("call_betweenness", "CALL betweennessCentrality() YIELD node, score MATCH (u:User) WHERE u = node RETURN u.user_id AS u, round(score * 1000000) AS s")
users("call_louvain", "CALL louvain(weight: 'value') YIELD node, community RETURN node, community")
users("call_leiden", "CALL leiden(weight: 'value') YIELD node, community RETURN node, community")
users("call_maxflow", f"CALL maxFlow(source: {uid(1)}, sink: {uid(2)}, capacity: 'value') YIELD maxFlow RETURN round(maxFlow * 100) AS f")
users("call_pipeline_match", "CALL pageRank(iterations: 2) YIELD node, score MATCH (u:User)-[:NEXT]->(v:User) WHERE u = node AND v.user_id < 5 RETURN v.user_id AS v, count(*) AS n, count(score) AS k",
      f"WITH {NEXT} SELECT dst AS v, count(*) AS n, count(*) AS k FROM n WHERE dst < 5 GROUP BY 1")


# -- writes: each starts from an empty graph or from regions and nations ----------------------------------
def small(spark: SparkSession, sf_dir: str) -> GraphSession:
    g = star_graph(spark, sf_dir)
    return GraphSession(replace(g, nodes=tuple(p for p in g.nodes if p.labels & {"Region", "Nation"}), edges=tuple(e for e in g.edges if e.label == "IN_REGION")))


@query("insert_then_match", "SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <= 1 UNION ALL SELECT 'NEW', r_name FROM region WHERE r_regionkey = 1")
def insert_then_match(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("MATCH (r:Region {r_regionkey: 1}) INSERT (n:Nation {n_name: 'NEW', n_regionkey: 1}), (n)-[:IN_REGION]->(r)")
    return s.query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WHERE r.r_regionkey <= 1 RETURN n.n_name AS name, r.r_name AS region")


@query("upsert_idempotent", "SELECT 6::BIGINT AS n")
def upsert_idempotent(spark, sf_dir):
    s = small(spark, sf_dir)
    for _ in range(2):
        s.query("INSERT (:Region {r_name: 'ATLANTIS'})")
    s.query("MATCH (r:Region) INSERT (:Region {r_regionkey: r.r_regionkey})")
    return s.query("MATCH (r:Region) RETURN count(*) AS n")


@query("unwind_insert", "SELECT x AS k, x * x AS sq FROM range(1, 6) t(x)")
def unwind_insert(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("UNWIND range(1, 5) AS x INSERT (:Sq {k: x, sq: x * x})")
    return s.query("MATCH (n:Sq) RETURN n.k AS k, n.sq AS sq")


@query("set_property", "SELECT r_regionkey AS k, CASE WHEN r_regionkey > 2 THEN r_regionkey::BIGINT * 10 END AS big, CASE WHEN r_regionkey > 2 THEN ['Far', 'Region'] ELSE ['Region'] END AS l FROM region")
def set_property(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("MATCH (r:Region) WHERE r.r_regionkey > 2 SET r.big = r.r_regionkey * 10, r:Far")
    return s.query("MATCH (r:Region) RETURN r.r_regionkey AS k, r.big AS big, labels(r) AS l")


@query("remove_label", "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 3 THEN NULL ELSE n_name END AS name FROM nation WHERE n_nationkey <> 2")
def remove_label(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("MATCH (n:Nation) WHERE n.n_nationkey < 3 REMOVE n.n_name")
    s.query("MATCH (n:Nation) WHERE n.n_nationkey = 2 REMOVE n:Nation")
    return s.query("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")


@query("detach_delete", "SELECT n_name AS n, CASE WHEN n_regionkey <> 1 THEN r_name END AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def detach_delete(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("MATCH (r:Region {r_regionkey: 1}) DETACH DELETE r")
    return s.query("MATCH (n:Nation) OPTIONAL MATCH (n)-[:IN_REGION]->(r:Region) RETURN n.n_name AS n, r.r_name AS r")


@query("delete_edges", "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0")
def delete_edges(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("MATCH (n:Nation)-[e:IN_REGION]->(r:Region {r_regionkey: 0}) DELETE e")
    return s.query("MATCH (n)-[e:IN_REGION]->(r) RETURN count(*) AS n")


@query("rollback_restores", "SELECT count(*) AS n FROM region")
def rollback_restores(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("BEGIN")
    s.query("INSERT (:Region {r_name: 'GONE'})")
    s.query("ROLLBACK")
    return s.query("MATCH (r:Region) RETURN count(*) AS n")


@query("truncate", "SELECT 0::BIGINT AS n")
def truncate(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("TRUNCATE")
    return s.query("MATCH (r) RETURN count(*) AS n")


@query("show_constraints", "SELECT * FROM (VALUES ('Region', 'r_name', 'TYPE IS STRING'), ('Region', 'r_regionkey', 'UNIQUE')) t(label, property, kind)")
def show_constraints(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("CREATE CONSTRAINT UNIQUE ON :Region(r_regionkey)")
    s.query("CREATE CONSTRAINT TYPE IS STRING ON :Region(r_name)")
    return s.query("SHOW CONSTRAINTS")


@query("show_indexes", "SELECT 'Nation' AS label, 'n_name' AS property, 'node' AS target, count(*) AS entries FROM nation")
def show_indexes(spark, sf_dir):
    s = small(spark, sf_dir)
    s.query("CREATE INDEX ON :Nation(n_name)")
    s.query("CREATE INDEX ON :Region(r_name)")
    s.query("DROP INDEX ON :Region(r_name)")
    return s.query("SHOW INDEXES")


@query("csv_roundtrip", "SELECT a.n_name AS a, r_name AS b, a.n_nationkey::BIGINT * 2 AS w FROM nation a JOIN region ON n_regionkey = r_regionkey")
def csv_roundtrip(spark, sf_dir):
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    folder = new_folder(spark, "csv")
    nodes = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias(":ID"), F.lit("Nation").alias(":LABEL"), F.col("n_name").alias("name"))
    nodes = nodes.union(t("region").select(F.concat(F.lit("r"), "r_regionkey"), F.lit("Region"), "r_name"))
    nodes.write.option("header", True).csv(f"{folder}/nodes")
    edges = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias(":START_ID"), F.concat(F.lit("r"), "n_regionkey").alias(":END_ID"), F.lit("IN").alias(":TYPE"), (F.col("n_nationkey") * 2).alias("w"))
    edges.union(edges.limit(1).withColumn(":END_ID", F.lit("nowhere"))).write.option("header", True).csv(f"{folder}/edges")
    s = GraphSession(PropertyGraph(spark))
    s.query(f"LOAD CSV NODES FROM '{folder}/nodes'")
    s.query(f"LOAD CSV EDGES FROM '{folder}/edges'")
    return s.query("MATCH (a:Nation)-[e:IN]->(b:Region) RETURN a.name AS a, b.name AS b, e.w AS w")

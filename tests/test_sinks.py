"""Results as JSON, text and elements; the shell; look-ups by id."""

import json

import pytest

from lodestone.cli import Shell
from lodestone.errors import GraphError
from lodestone.session import empty_graph
from lodestone.sources.catalog import GraphCatalog
from lodestone.sources.sinks import elements_of, json_rows, text_table


def test_sinks(spark):
    s = empty_graph(spark)
    s.query("INSERT (a:P {n: 'A'}), (b:P {n: 'B'}), (c:P {n: 'C'}), (a)-[:K {w: 1}]->(b)")
    df = s.query("MATCH (a)-[r:K]->(b) RETURN r, a.n AS n, sqrt(-1) AS x, b.none AS y")
    row = json.loads(json_rows(df).head()[0])
    assert row["n"] == "A" and row["x"] is None and row["y"] is None and len(row["r"]) == 26
    nodes, edges = elements_of(s.graph, df)
    assert sorted(json.loads(r.properties)["n"] for r in nodes.collect()) == ["A", "B"]
    assert [(r.label, json.loads(r.properties)) for r in edges.collect()] == [("K", {"w": 1})]
    assert s.get_edge(row["r"])["w"] == 1 and s.get_node(s.get_edge(row["r"])["src"])["n"] == "A"
    assert (s.node_count(), s.node_count("P"), s.node_count("Q"), s.edge_count("K")) == (3, 3, 0, 1) and s.get_node(10**9) is None
    assert "| A" in text_table(df)


def test_shell(spark, tmp_path):
    shell = Shell(GraphCatalog(spark, str(tmp_path)), "main")
    shell.run("INSERT (:P {n: 'A'});")
    assert "A" in shell.run("MATCH (p:P) RETURN p.n;")
    assert shell.run(":create other") and shell.run(":graphs") == "main\nother"
    shell.run(":use other")
    assert "0" in shell.run("MATCH (n) RETURN count(*);")
    shell.run(":drop main")
    assert shell.run(":graphs") == "other" and shell.run(":quit") is None
    with pytest.raises(GraphError):
        shell.run(":nothing")

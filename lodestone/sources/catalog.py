"""Named graphs in folders: versions of a graph, and the pointer to the current one."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from lodestone.errors import GraphError
from lodestone.session import GraphSession
from lodestone.sources.graph import PropertyGraph

NAME = re.compile(r"[A-Za-z0-9-][A-Za-z0-9_-]{0,63}")
META = "_meta"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete, in order. Works on any Hadoop file system."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if re.fullmatch(r"v\d+", s.getPath().getName())]
    done = [x for x in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "manifest/_SUCCESS"))]
    return sorted(int(x.getName()[1:]) for x in done)


def publish(graph: PropertyGraph, path: str, keep: int = 2) -> None:
    """Write the next version beside the others; it counts once its manifest is there. Older ones than the last
    ``keep`` are deleted."""
    versions = _versions(graph.spark, path)
    graph.save(f"{path}/v{(versions[-1] if versions else 0) + 1}")
    for v in versions[: 1 - keep] if keep > 1 else versions:
        fs, p = _fs(graph.spark, f"{path}/v{v}")
        fs.delete(p, True)


def open_at(spark: SparkSession, path: str) -> GraphSession:
    """The graph in a folder (made on the first write), as its last complete version has it."""
    versions = _versions(spark, path)
    graph = PropertyGraph.load(spark, f"{path}/v{versions[-1]}") if versions else PropertyGraph(spark)
    return GraphSession(graph, path)


class GraphCatalog:
    """Graphs by name under one or more root folders. The graph ``_meta`` is there but neither listed nor dropped."""

    def __init__(self, spark: SparkSession, *roots: str):
        self.spark, self.roots = spark, [r.rstrip("/") for r in roots]

    def add_location(self, root: str) -> None:
        if root.rstrip("/") not in self.roots:
            self.roots.append(root.rstrip("/"))

    def remove_location(self, root: str) -> None:
        if root.rstrip("/") not in self.roots:
            raise GraphError(f"no location {root}")
        self.roots.remove(root.rstrip("/"))

    def list_locations(self) -> list[str]:
        return list(self.roots)

    def list(self) -> list[str]:
        out = set()
        for root in self.roots:
            fs, p = _fs(self.spark, root)
            if fs.exists(p):
                out |= {s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()}
        return sorted(n for n in out if n != META)

    def find(self, name: str) -> str | None:
        for root in self.roots:
            fs, p = _fs(self.spark, f"{root}/{name}")
            if fs.exists(p):
                return f"{root}/{name}"
        return None

    def create(self, name: str, root: str | None = None) -> GraphSession:
        if not NAME.fullmatch(name):
            raise GraphError(f"not a graph name: {name!r}")
        if self.find(name):
            raise GraphError(f"graph {name} is there already")
        session = GraphSession(PropertyGraph(self.spark), f"{root or self.roots[0]}/{name}")
        session.publish()
        return session

    def open(self, name: str) -> GraphSession:
        if name != META and not NAME.fullmatch(name):
            raise GraphError(f"not a graph name: {name!r}")
        return open_at(self.spark, self.find(name) or f"{self.roots[0]}/{name}")

    def drop(self, name: str) -> None:
        if name == META:
            raise GraphError("the graph _meta can't be dropped")
        path = self.find(name)
        if not path:
            raise GraphError(f"no graph {name}")
        fs, p = _fs(self.spark, path)
        fs.delete(p, True)

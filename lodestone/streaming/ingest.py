"""Streams into a graph: each micro-batch is one UNWIND ... INSERT or MATCH statement's worth of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.session import GraphSession


def stream_nodes(stream: DataFrame, session: GraphSession, label: str, key: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the stream's rows as nodes of ``label``; a key that the graph has already, or that came before in
    the batch, is left out, so a batch that is replayed after a failure adds nothing twice."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from lodestone.shared import materialize

    def upsert(batch: DataFrame, number: int) -> None:
        graph = session.graph
        rows = batch.dropDuplicates([key])
        if graph.node_parts([label]):
            old, _ = graph.scan_nodes([label], {key})
            rows = rows.join(old.select(key), key, "left_anti")
        rows = rows.select((F.monotonically_increasing_id() + F.lit(graph.next_id)).alias("id"), *batch.columns)
        rows = materialize(rows, "stream")
        top = rows.agg(F.max("id")).head()[0]
        if top is not None:
            session.check(graph, frozenset([label]), rows)
            session.become(replace(graph.with_nodes(frozenset([label]), rows), next_id=top + 1))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

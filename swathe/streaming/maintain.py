"""Edges and counts kept up to date while new vectors arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from swathe.operators.join import spatial_edges


def stream_edges(vectors: DataFrame, rasters: DataFrame, edges_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that joins each micro-batch of a stream of vectors with the rasters that are there.

    Add-only, as updates of a dataset are. A batch goes to its own folder (``batch=<id>``), which a batch that runs again
    replaces: edges are written exactly once. Read them back with ``spark.read.parquet(edges_path)``.
    """

    def batch(new: DataFrame, batch_id: int) -> None:
        new.persist()
        try:
            spatial_edges(new, rasters).write.mode("overwrite").parquet(f"{edges_path}/batch={batch_id}")
        finally:
            new.unpersist()

    return vectors.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)

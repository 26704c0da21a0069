
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_anchors(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Accepted mappings of a stream (columns of sources.schemas.ANCHORS' mappings), appended to Parquet below path, each micro-batch once."""
    accepted = stream.where("status = 'accepted'")
    return accepted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

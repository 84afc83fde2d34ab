"""Documents as a stream: each micro-batch goes through the batch plan, whose windows stay inside one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import lint


def lint_stream(docs: DataFrame, output: str, checkpoint: str, config: dict | None = None) -> StreamingQuery:
    """Append findings, notices and suppressions of every new document to Parquet tables below ``output`` (the findings
    there, the others in ``_notices`` and ``_suppressions``); a batch that is replayed overwrites itself."""
    def write(batch: DataFrame, epoch: int) -> None:
        result = lint(batch, {"ordered": False, **(config or {})}, persist=True)
        for rows, place in ((result.findings, ""), (result.notices, "/_notices"), (result.suppressions, "/_suppressions")):
            rows.write.mode("overwrite").parquet(f"{output}{place}/batch={epoch}")
        result.release()

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()

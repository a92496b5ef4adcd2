"""Validation gate on a folder of arriving JSON lines.

The checks are row-local, so the batch expression runs unchanged on a stream;
there is no state and no watermark.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from matchlane.operators.validation import gate, validate


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def start_gate(lines: DataFrame, schema: dict, out: str, checkpoint: str) -> StreamingQuery:
    """Write valid lines to ``out/valid`` and the others with their errors to ``out/quarantine``.

    Each micro-batch replaces its own partition, so a retried batch leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validate(batch, schema, on_bad_json="quarantine")
        valid, quarantined = gate(checked, ["value"])
        for rows, name in ((valid.select("value"), "valid"), (quarantined, "quarantine")):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

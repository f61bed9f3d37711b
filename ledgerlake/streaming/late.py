"""Late rows kept apart: what lies behind the watermark goes to a table of its own in place of being dropped.

The watermark is the largest time of all batches before, less the delay, and is written down by batch beside the rows. A
batch that is done again after a failure overwrites what it wrote, so every row is in one of the tables once. A row
without a time is late. Where rows have turns, the watermark moves from turn to turn within a batch too, so what is late
doesn't depend on how the stream is cut into batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def kept_and_late(stream: DataFrame, path: str, time: str, delay_seconds: float, turn: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of all that a stream yields now, added to the tables below `path`; a later call goes on from there.

    `turn` is a whole number that rises along the stream: a row's watermark is the largest time of all turns before its own.
    Without one each batch is a turn. Turns are kept a row each, and the marks of a batch's turns are added up in one task.
    """
    spark = stream.sparkSession
    marks = f"{path}/marks"
    spark.createDataFrame([], "turn long, mark double").write.mode("ignore").parquet(f"{marks}/batch=-1")

    def split(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # read by three writes; a lost executor's part is read again
        turned = held.withColumn("_turn", F.lit(number) if turn is None else F.col(turn).cast("long"))
        own = turned.groupBy(F.col("_turn").alias("turn")).agg(F.max(F.col(time).cast("double")).alias("mark"))
        own.write.mode("overwrite").parquet(f"{marks}/batch={number}")
        known = spark.read.schema("turn long, mark double, batch long").parquet(marks).filter(F.col("batch") <= number)
        first = own.agg(F.min("turn")).first()[0]
        # turns before this batch's first one count as one
        so_far = known.groupBy(F.greatest("turn", F.lit(first) - 1).alias("_turn")).agg(F.max("mark").alias("mark"))
        before = so_far.select("_turn", F.max("mark").over(W.orderBy("_turn").rowsBetween(W.unboundedPreceding, -1)).alias("_mark"))
        late = F.col(time).isNull() | F.coalesce(F.col(time).cast("double") < F.col("_mark") - delay_seconds, F.lit(False))
        marked = turned.join(before, "_turn", "left").withColumn("_late", late)
        for name, rows in (("kept", marked.filter("not _late")), ("late", marked.filter("_late"))):
            rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        held.unpersist()

    run = stream.writeStream.foreachBatch(split).option("checkpointLocation", f"{path}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    for name in ("kept", "late"):
        spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/{name}/batch=-1")
    read = lambda name: spark.read.schema(f"{stream.schema.toDDL()}, batch long").parquet(f"{path}/{name}").drop("batch")
    return read("kept"), read("late")


def corrected_counts(kept: DataFrame, late: DataFrame, time: str, width: str, keys: list[str]) -> DataFrame:
    """(window_start, keys, n, n_late): counts of windows, with what came late."""
    both = kept.withColumn("_late", F.lit(0)).unionByName(late.withColumn("_late", F.lit(1)))
    counts = both.groupBy(F.window(time, width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_late").alias("n_late"))
    return counts.select(F.col("_w.start").alias("window_start"), *keys, "n", "n_late")

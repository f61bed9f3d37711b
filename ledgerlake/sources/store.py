"""A set of tables whose loads are published by manifest: a run of several tables is seen whole or not at all.

A run first writes its parts, each table by Spark's writer, where no reader looks; then one small file names all of
them, and that file is the commit. A run that dies before it leaves parts that nothing names, which the same run
overwrites when it's done again; a run that is published already isn't done twice. Readers take the parts that
manifests name, with the number of the run that wrote each row, so a later row of a key can stand for an earlier one.
One run is published at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlake.session import shared_folder

MANIFEST = "number long, run string, name string, path string"


class Store:
    """The tables below `root`: name and columns (DDL) of each."""

    def __init__(self, spark: SparkSession, tables: dict[str, str], root: str | None = None):
        self.spark, self.tables, self.root = spark, tables, root or shared_folder(spark)
        self._manifests = f"{self.root}/manifests"
        spark.createDataFrame([], MANIFEST).write.mode("ignore").json(f"{self._manifests}/0")

    def parts(self) -> list:
        """What is published: a row a part, in order of its run."""
        found = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(self._manifests)
        return sorted(found.collect(), key=lambda r: (r.number, r.name))  # a few rows a run

    def table(self, name: str) -> DataFrame:
        """All published rows of a table, with `_run`, the number of the run that wrote them."""
        out = self.spark.createDataFrame([], f"{self.tables[name]}, _run long")
        for part in self.parts():
            if part.name == name:
                out = out.unionByName(self.spark.read.schema(self.tables[name]).parquet(part.path).withColumn("_run", F.lit(part.number).cast("long")))
        return out

    def latest(self, name: str, keys: list[str]) -> DataFrame:
        """The last published row of each key."""
        rest = [c for c in self.spark.createDataFrame([], self.tables[name]).columns if c not in keys]
        rows = self.table(name).groupBy(*keys).agg(F.max_by(F.struct(*rest), "_run").alias("_r"))
        return rows.select(*keys, "_r.*")

    def published(self, run: str) -> bool:
        return any(part.run == run for part in self.parts())

    def publish(self, run: str, rows: dict[str, DataFrame]) -> None:
        """Writes the rows of a run and makes them visible at once; a run that is there already stays as it is."""
        known = self.parts()
        if any(part.run == run for part in known):
            return
        number = max((part.number for part in known), default=0) + 1
        named = []
        for name, df in rows.items():
            path = f"{self.root}/parts/{run}/{name}"
            columns = self.spark.createDataFrame([], self.tables[name]).columns
            df.select(*columns).write.mode("overwrite").parquet(path)
            named.append((number, run, name, path))
        self.spark.createDataFrame(named, MANIFEST).coalesce(1).write.json(f"{self._manifests}/{number}")

"""Artifacts by content: a data source whose tasks put bytes under their hash, and whose commit names them.

    spark.dataSource.register(ArtifactStore)
    rows.select("path", "content").write.format("artifact_store").option("root", root).mode("append").save()

Bytes lie at objects/ab/abcd..., by sha256, written to a name of the task's own and moved there whole; what is there
already isn't written again, so tasks that are tried twice, or write the same bytes, do no harm. Each task leaves one
Parquet file of references (path, content_hash, size_bytes, content_type) in a folder of its job, and the commit moves
that folder to where readers look: a load is seen whole or not at all. A job that fails takes its folder with it, and bytes that
nothing names stay for the next load. Of a path's references the last load's counts. Rows without a path or content are errors.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ledgerlake.sources.paths import opened

REFS = "path string, content_hash string, size_bytes long, content_type string"
REFS_SCHEMA = pa.schema([("path", pa.string()), ("content_hash", pa.string()), ("size_bytes", pa.int64()), ("content_type", pa.string())])


@dataclass
class Written(WriterCommitMessage):
    """A task's count of references, and of objects that weren't there before."""

    references: int
    objects: int


def object_path(root: str, digest: str) -> str:
    return f"{root}/objects/{digest[:2]}/{digest}"


def put(system: fs.FileSystem, root: str, content: bytes) -> tuple[str, bool]:
    """(hash, whether it was new) of bytes put in the store."""
    digest = hashlib.sha256(content).hexdigest()
    target = object_path(root, digest)
    if system.get_file_info(target).type == fs.FileType.File:
        return digest, False
    system.create_dir(target.rpartition("/")[0])
    own = f"{target}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(content)
    system.move(own, target)
    return digest, True


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, root: str, schema: StructType):
        self.root, self.names = root, schema.names
        self.job = uuid.uuid4().hex
        if not {"path", "content"} <= set(self.names):
            raise ValueError("artifacts have the columns path and content, and may have content_type")

    def _folders(self) -> tuple[fs.FileSystem, str, str]:
        system, root = opened(self.root)
        return system, f"{root}/pending/{self.job}", f"{root}/refs/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, pending, _ = self._folders()
        _, root = opened(self.root)
        system.create_dir(pending)
        own, objects, references = f"{pending}/{uuid.uuid4().hex}", 0, 0
        with pq.ParquetWriter(own, REFS_SCHEMA, filesystem=system) as out:
            for batch in iterator:
                rows = {name: batch.column(self.names.index(name)).to_pylist() for name in ("path", "content", "content_type") if name in self.names}
                refs = []
                for k, (path, content) in enumerate(zip(rows["path"], rows["content"], strict=True)):
                    if path is None or content is None:
                        raise ValueError("an artifact needs a path and content")
                    digest, fresh = put(system, root, content if isinstance(content, bytes) else content.encode())
                    objects += fresh
                    refs.append({"path": path, "content_hash": digest, "size_bytes": len(content if isinstance(content, bytes) else content.encode()), "content_type": rows["content_type"][k] if "content_type" in rows else None})
                out.write_batch(pa.RecordBatch.from_pylist(refs, REFS_SCHEMA))
                references += len(refs)
        if not references:
            system.delete_file(own)
            return Written(0, 0)
        system.move(own, f"{own}.parquet")  # a task that died halfway leaves no reference
        return Written(references, objects)

    def commit(self, messages: list[Written | None]) -> None:
        system, pending, refs = self._folders()
        if any(m is not None and m.references for m in messages):
            # files of attempts that Spark gave up are whole loads of the same rows, so naming them twice changes nothing
            system.create_dir(refs.rpartition("/")[0])
            system.move(pending, refs)
        elif system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)

    def abort(self, messages: list[Written | None]) -> None:
        system, pending, _ = self._folders()
        if system.get_file_info(pending).type == fs.FileType.Directory:
            system.delete_dir(pending)


class ArtifactStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "artifact_store"

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        if overwrite:
            raise ValueError("artifacts are only ever added")
        return ArtifactWriter(self.options["root"], schema)


def references(spark: SparkSession, root: str) -> DataFrame:
    """(path, content_hash, size_bytes, content_type, n_loads): the last load's reference of each path, and how many loads named it."""
    system, plain = opened(root)
    if system.get_file_info(f"{plain}/refs").type != fs.FileType.Directory:
        return spark.createDataFrame([], f"{REFS}, n_loads long")
    rows = spark.read.schema(REFS).option("recursiveFileLookup", "true").parquet(f"{root}/refs").select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file"))
    load = F.element_at(F.split("_file", "/"), -2)
    last = rows.groupBy("path").agg(F.max_by(F.struct("content_hash", "size_bytes", "content_type"), F.struct("_at", "content_hash")).alias("_r"), F.count_distinct(load).alias("n_loads"))
    return last.select("path", "_r.*", "n_loads")


def contents(spark: SparkSession, root: str, chosen: DataFrame) -> DataFrame:
    """The chosen references with the bytes they name; every object is read once."""
    objects = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/objects")
    named = objects.select(F.element_at(F.split("path", "/"), -1).alias("_hash"), "content")
    content = F.when(F.col("size_bytes") == 0, F.lit(b"")).otherwise(F.col("content"))  # readers pass over empty files
    return chosen.join(named, F.col("content_hash") == F.col("_hash"), "left").drop("_hash").withColumn("content", content)


def add(spark: SparkSession, root: str, rows: DataFrame, path: Column | str = "path", content: Column | str = "content") -> None:
    """Writes what the store doesn't hold: rows whose path names other bytes or none. Of several rows of a path the largest hash counts."""
    from ledgerlake.operators.ingestion import artifacts

    own = rows.select((F.col(path) if isinstance(path, str) else path).alias("path"), (F.col(content) if isinstance(content, str) else content).cast("binary").alias("content"))
    spark.dataSource.register(ArtifactStore)
    artifacts(own, references(spark, root)).select("path", "content").write.format("artifact_store").option("root", root).mode("append").save()

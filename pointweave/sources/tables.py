"""Readers and writers of point-field tables; text forms parsed by SQL functions."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.sources.durable import shared_dir


def read_table(spark: SparkSession, path: str, labels: Sequence[str] | str = "*", schema: T.StructType | None = None) -> DataFrame:
    """Only the requested labels are read from the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df if labels == "*" else df.select(*labels)


def read_many(spark: SparkSession, path: str, schema: T.StructType, on_error: str = "skip") -> DataFrame:
    """All shards of a folder with the file each row came from; unreadable ones are skipped or raise.

    :func:`unread_files` tells which were skipped.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", str(on_error == "skip").lower()).option("recursiveFileLookup", "true")
    return reader.parquet(path).select("*", F.col("_metadata.file_path").alias("shard_file"))


def unread_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Files of a folder that :func:`read_many` skipped: those in the listing that gave no row and are no empty table.

    The names of the files without rows, part of a listing that the driver holds anyway, are
    gathered so that only these files are opened once more.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("shard_file"))
    silent = listed.join(read_many(spark, path, schema).select("shard_file").distinct(), "shard_file", "left_anti")
    names = [r[0] for r in silent.collect()]
    if not names:
        return silent

    def unreadable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                try:
                    readable = pq.read_metadata(pa.BufferReader(content.as_buffer())).num_rows == 0
                except pa.ArrowException:
                    readable = False
                if not readable:
                    bad.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["shard_file"])

    return spark.read.format("binaryFile").load(names).select("path", "content").mapInArrow(unreadable, "shard_file string")


def mesh_text_to_tables(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of mesh texts (item_id, text): ``v x y z`` and ``f a//n b//n c//n`` lines, 1-based to 0-based."""
    lines = texts.select("item_id", F.posexplode(F.split("text", "\\r?\\n")).alias("pos", "line")).withColumn("t", F.split(F.trim("line"), "\\s+"))
    nth = (F.row_number().over(Window.partitionBy("item_id").orderBy("pos")) - 1).cast("long")
    v = lines.where("t[0] = 'v'").select("item_id", nth.alias("vid"), *(F.col("t")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")))
    corner = lambda i: (F.split(F.col("t")[i + 1], "/")[0].cast("long") - 1).alias(f"v{i}")
    f = lines.where("t[0] = 'f'").select("item_id", nth.alias("fid"), *map(corner, range(3)))
    return v, f


FEATURES = "struct<curves:array<struct<type:string,sharp:boolean,vert_indices:array<bigint>>>,surfaces:array<struct<type:string,face_indices:array<bigint>,vert_indices:array<bigint>>>>"


def features_from_json(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Curves and surfaces of serialised feature annotations (item_id, json)."""
    x = blobs.select("item_id", F.from_json("json", FEATURES).alias("f"))
    curves = x.select("item_id", F.posexplode("f.curves").alias("curve_id", "c")).select("item_id", F.col("curve_id").cast("long"), "c.type", "c.sharp", "c.vert_indices")
    surfaces = x.select("item_id", F.posexplode("f.surfaces").alias("surf_id", "s")).select("item_id", F.col("surf_id").cast("long"), "s.type", "s.face_indices", "s.vert_indices")
    return curves, surfaces


def predictions_from_numbered_files(spark: SparkSession, path: str) -> DataFrame:
    """Values of text files or folders named ``...test_<n>...``: patch number, place in the file, value."""
    rows = _numbered_texts(spark, path).select("number", F.posexplode("words").alias("pos", "v"))
    return rows.select(F.col("number").alias("patch_id"), F.col("pos").cast("long").alias("point_pos"), F.col("v").cast("double").alias("value"))


def _numbered_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: the last ``test_<n>`` of its path and the words of its text."""
    number = F.regexp_extract("_metadata.file_path", r".*test_([0-9]+)", 1).cast("long").alias("number")
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(number, F.filter(F.split("value", "\\s+"), lambda w: w != "").alias("words"))


def merge_numbered_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One dataset of many text vectors: number, vector.  A file is a row; an empty one gives an empty vector."""
    values = F.transform("words", lambda w: w.cast("double"))
    return _numbered_texts(spark, path).select("number", values.alias("vector"))


def parse_stat_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """``index item_id key=value ...`` lines to long rows."""
    parts = F.split(F.trim(column), "\\s+")
    return lines.select(parts[0].cast("long").alias("idx"), parts[1].alias("item_id"), F.explode(F.slice(parts, 3, F.size(parts))).alias("kv")).select("idx", "item_id", F.substring_index("kv", "=", 1).alias("key"), F.substring_index("kv", "=", -1).cast("double").alias("value"))


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_shards(df: DataFrame, path: str, n_items: int) -> None:
    """Files of at most ``n_items`` rows."""
    df.write.option("maxRecordsPerFile", n_items).parquet(path)


def write_ordered_shards(df: DataFrame, path: str, idx: str, n: int) -> None:
    """Shards of contiguous index ranges, in whatever order results arrive."""
    df.repartitionByRange(n, idx).sortWithinPartitions(idx).write.parquet(path)


def append_metrics_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def split_by_item(df: DataFrame, path: str, item: str = "item_id") -> None:
    """One folder per item; rows of an item are gathered first so that it gets few files."""
    df.repartition(item).write.partitionBy(item).parquet(path)


def through(df: DataFrame, name: str, write, read=None) -> DataFrame:
    """Write with ``write(df, path)`` to the shared folder and read back."""
    path = _new(df.sparkSession, name)
    write(df, path)
    return read(path) if read else df.sparkSession.read.parquet(path)

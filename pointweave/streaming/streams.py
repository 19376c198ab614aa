"""Metrics, fusion and flags kept up to date on streams.

Each function takes a streaming DataFrame (or any DataFrame, where the same
expressions give the batch result) and returns the aggregated one; ``settle``
runs a stream over what is there and returns its final table.

What a sink has written lives in the shared folder beside the stream's own
checkpoint: a batch that runs twice overwrites its own folders, and a stream that is
started again on the same path goes on where it stopped.  Appended rows have one
folder a micro-batch.  Keyed results come as the changes of each batch into a
:class:`KeyedTable`, which merges them as it goes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.operators.metrics import instances
from pointweave.sources.durable import shared_dir


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder, or a single file."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rstrip("/").rpartition("/")
    # a pattern that only this name meets: the source accepts folders and patterns
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{head}/{name[:-1]}[{name[-1]}]")


#: Rows of a file that :func:`replay` writes, about.
FILE_ROWS = 500_000


def replay(df: DataFrame, order: str, batches: int) -> DataFrame:
    """A stream that brings the rows of ``df`` in ``batches`` micro-batches, by rising ``order``.

    Files are written batch after batch, as the file source reads them by age; every batch has as many,
    about ``FILE_ROWS`` rows each, so that no task writes or reads a whole batch.  A batch of few rows is filled up with empty files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    cuts, rows = df.select(F.percentile_approx(order, [i / batches for i in range(1, batches)], 10_000), F.count(F.lit(1))).first()
    cuts, files = cuts or [], max(1, -(-rows // (batches * FILE_ROWS)))
    place = sum(((F.col(order) > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for i in range(batches):
        own = df.where(F.coalesce(place, F.lit(0)) == i)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
        while sum(f.getPath().getName().startswith("part-") for f in store.listStatus(at)) < files * (i + 1):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def _run(stream: DataFrame, path: str, mode: str, write) -> None:
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(write)
    sink.trigger(availableNow=True).start().awaitTermination()


def _written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every row in the sink with the number of its batch; an empty table before the first."""
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], whole).write.mode("append").partitionBy("batch").parquet(path)
    return spark.read.schema(whole).parquet(path)


class KeyedTable:
    """The latest row of each key, from batches of changed rows.

    A batch adds a folder of its changes.  Once the changes hold half as many rows as
    what was merged before, or ``MOST`` folders, the same step merges all into one, so
    a row is rewritten about as often as the table doubles.  A manifest for each
    batch names the folders that count; those that neither it nor the one before names are
    deleted, so that a batch that failed half-way can run again.  The latest row
    is that of the highest ``version``, or of the last batch where none is named.
    """

    MOST = 8

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], version: str | None = None) -> None:
        self.spark, self.path, self.key, self.version = spark, path, list(key), version
        self.schema = T.StructType([*schema.fields, T.StructField("folded", T.LongType())])
        self.columns = schema.names

    def _listed(self, folder: str) -> list[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        store = at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []

    def _delete(self, folder: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def parts(self, before: int | None = None) -> list[tuple[str, int]]:
        """Folders, merged rows first, and their numbers of rows, as the last manifest (under ``before``) has them."""
        numbers = [int(n) for n in self._listed("manifest") if n.isdigit() and "_SUCCESS" in self._listed(f"manifest/{n}")]
        numbers = [n for n in numbers if before is None or n < before]
        if not numbers:
            return []
        return [(r.folder, r.rows) for r in self.spark.read.parquet(f"{self.path}/manifest/{max(numbers)}").orderBy("place").collect()]  # at most MOST

    def _merged(self, parts: list[tuple[str, int]]) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{folder}" for folder, _ in parts))
        order = F.struct(*([self.version] if self.version else []), "folded")
        best = F.max_by(F.struct(*(c for c in self.schema.names if c not in self.key)), order).alias("best")
        return rows.groupBy(*self.key).agg(best).select(*self.key, "best.*").select(self.schema.names)

    def fold(self, batch: DataFrame, number: int) -> None:
        held = self.parts(number)
        self._write(batch.select(*self.columns, F.lit(number).cast("long").alias("folded")), f"{number}-changes")
        parts = [*held, (f"{number}-changes", self._rows(f"{number}-changes"))]
        if len(parts) > self.MOST or 2 * sum(n for _, n in parts[1:]) >= parts[0][1]:
            self._write(self._merged(parts), f"{number}-merged")
            parts = [(f"{number}-merged", self._rows(f"{number}-merged"))]
        rows = self.spark.createDataFrame([(i, folder, n) for i, (folder, n) in enumerate(parts)], "place int, folder string, rows long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        for folder in set(self._listed("data")) - {folder for folder, _ in (*held, *parts)}:
            self._delete(f"data/{folder}")
        for old in sorted((int(n) for n in self._listed("manifest") if n.isdigit() and int(n) < number))[:-1]:
            self._delete(f"manifest/{old}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{folder}")

    def _rows(self, folder: str) -> int:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}").count()

    def read(self) -> DataFrame:
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], self.schema).select(self.columns)
        return self._merged(parts).select(self.columns)


def settle(stream: DataFrame, mode: str = "complete", path: str | None = None, key: Sequence[str] | None = None) -> DataFrame:
    """Run to the end of the available input and return the sink's table.

    With ``key``, the key columns of an aggregation, only what a batch changes is written (update mode).
    Otherwise the last batch counts in complete mode, and all count in append mode.  With
    the ``path`` of an earlier run, that run is continued.
    """
    spark = stream.sparkSession
    path = path or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if key is not None:
        table = KeyedTable(spark, f"{path}/out", stream.schema, key)
        _run(stream, path, "update", table.fold)
        return table.read()

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    _run(stream, path, mode, keep)
    rows = _written(spark, f"{path}/out", stream.schema)
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == (-1 if last is None else last))
    return rows.drop("batch")


def stream_instances(pairs: DataFrame, threshold: float, instance: Sequence[str] = ("item_id",)) -> DataFrame:
    """Running sums of each instance; dataset metrics follow from them at any time."""
    return instances(pairs, threshold, instance)


def stream_flag_rates(rows: DataFrame, ts: str, flag: str, window: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of flagged rows per tumbling window; rows later than ``late`` are dropped in append mode."""
    grouped = rows.withWatermark(ts, late).groupBy(F.window(ts, window), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(flag).cast("double")).alias("rate")).select(F.unix_micros("window.start").alias("start"), *by, "n", "rate")


def stream_fusion(votes: DataFrame, key: Sequence[str], value: str = "value") -> DataFrame:
    """Running minimum, mean and number of the votes of each point."""
    return votes.groupBy(*key).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def stream_gap_sessions(rows: DataFrame, ts: str, gap: str, late: str, by: Sequence[str]) -> DataFrame:
    """Runs of events that are less than a gap apart."""
    grouped = rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(*by, F.unix_micros("session_window.start").alias("start"), "n")


def stream_apply_fixes(results: DataFrame, key: Sequence[str], ts: str, version: str, late: str, path: str | None = None) -> DataFrame:
    """Idempotent upsert: of results that arrive twice or out of order, the highest version of each key.

    Exact repeats within the watermark are dropped before they reach the sink,
    a :class:`KeyedTable` that merges the batches as they come.
    """
    spark = results.sparkSession
    path = path or f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    once = results.withWatermark(ts, late).dropDuplicatesWithinWatermark([*key, version])
    table = KeyedTable(spark, f"{path}/out", results.schema, key, version)
    _run(once, path, "append", lambda batch, number: table.fold(newest(batch, key, version), number))
    return table.read()


def newest(rows: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    best = F.max_by(F.struct(*(F.col(c) for c in rows.columns if c not in key)), version).alias("best")
    return rows.groupBy(*key).agg(best).select(*key, "best.*").select(rows.columns)


def compact(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], version: str) -> str:
    """The upserted table of ``path`` as one batch in a new folder, whose path is returned; the old one is left alone."""
    new = f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    KeyedTable(spark, f"{path}/out", schema, key, version).read().write.parquet(f"{new}/out/batch=0")
    return new


def stream_shards(rows: DataFrame, n: int, path: str | None = None) -> DataFrame:
    """Flush rows to files of at most n rows; returns the rows with the file they went to."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"

    def flush(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", n).parquet(f"{path}/out/batch={number}")

    _run(rows, path, "append", flush)
    return _written(spark, f"{path}/out", rows.schema).drop("batch").withColumn("file", F.col("_metadata.file_path"))

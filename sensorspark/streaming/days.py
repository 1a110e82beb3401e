"""Day-partitioned tables that streams write batch by batch, with few files a day.

A batch's rows of a day go to a folder of their own, ``<day>/first_batch=n/last_batch=n``, which a repeated
batch replaces. As folders of a day become many, neighbouring small ones are merged to one that covers
their range of batches. A folder whose range lies inside another's counts as replaced: readers leave it
out, so a run that ends between the merge and the clean-up changes no result.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sensorspark.sources.sinks import clustered

FIRST, LAST = "first_batch", "last_batch"
#: Folders of a day, at most, after a batch has been written.
MOST_FOLDERS = 8


@dataclass(frozen=True)
class Folder:
    day: str  # the folder's name, as in reading_date=2024-01-01
    first: int
    last: int
    size: int = 0

    def covers(self, other: Folder) -> bool:
        return self.day == other.day and (self.first, self.last) != (other.first, other.last) and self.first <= other.first and other.last <= self.last

    def path(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.day}/{FIRST}={self.first}/{LAST}={self.last}"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _children(spark: SparkSession, path: str) -> list[str]:
    system, at = _file_system(spark, path)
    if not system.exists(at):
        return []
    names = (s.getPath().getName() for s in system.listStatus(at) if s.isDirectory())
    return sorted(n for n in names if not n.startswith((".", "_")))


def folders(spark: SparkSession, root: str, day: str) -> list[Folder]:
    """The folders of a day, in the order of their batches."""
    out = []
    for first in _children(spark, f"{root}/{day}"):
        for last in _children(spark, f"{root}/{day}/{first}"):
            found = Folder(day, int(first.split("=")[1]), int(last.split("=")[1]))
            system, at = _file_system(spark, found.path(root))
            out.append(Folder(day, found.first, found.last, system.getContentSummary(at).getLength()))
    return sorted(out, key=lambda f: (f.first, f.last))


def write_batch(batch: DataFrame, batch_id: int, root: str, part: str, cluster: str) -> None:
    """A batch's rows to their days, a few sorted files each; again for the same batch replaces them."""
    rows = clustered(batch, part, cluster).withColumns({FIRST: F.lit(batch_id), LAST: F.lit(batch_id)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part, FIRST, LAST).parquet(root)


def compact(spark: SparkSession, root: str, before: int, part: str, cluster: str, schema: T.StructType, most: int = MOST_FOLDERS, days: list[str] | None = None) -> int:
    """Bring every day (or the given folders' names) down to ``most`` folders of batches below ``before``
    by merging neighbours of the least size; drop replaced folders. Returns the number of merges."""
    merged = 0
    names = days if days is not None else [d for d in _children(spark, root) if d.startswith(f"{part}=")]
    for day in names:
        held = [f for f in folders(spark, root, day) if f.last < before]
        for f in held:
            if any(o.covers(f) for o in held):
                _drop(spark, root, f)
        held = [f for f in held if not any(o.covers(f) for o in held)]
        if len(held) <= most:
            continue
        # One merge leaves half as many, so that a day is not merged again with every batch.
        width = len(held) - most // 2
        run = min((held[i : i + width] for i in range(len(held) - width + 1)), key=lambda fs: sum(f.size for f in fs))
        whole = Folder(day, run[0].first, run[-1].last)
        rows = spark.read.schema(schema).parquet(*[f.path(root) for f in run])
        rows.hint("rebalance").sortWithinPartitions(cluster).write.mode("overwrite").parquet(whole.path(root))
        for f in run:
            _drop(spark, root, f)
        merged += 1
    return merged


def delete_folder(spark: SparkSession, path: str) -> None:
    system, at = _file_system(spark, path)
    system.delete(at, True)


def _drop(spark: SparkSession, root: str, folder: Folder) -> None:
    system, at = _file_system(spark, folder.path(root))
    system.delete(at, True)
    parent = at.getParent()
    if system.exists(parent) and not system.listStatus(parent):
        system.delete(parent, True)


def read_days(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The table's rows without the batch columns. Replaced folders are left out by their partition
    values; before the first batch the table is empty, where its schema is given."""
    columns = None if schema is None else T.StructType([*schema.fields, T.StructField(FIRST, T.LongType()), T.StructField(LAST, T.LongType())])
    try:
        df = (spark.read if columns is None else spark.read.schema(columns)).parquet(root)
    except AnalysisException as e:
        if schema is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    by_day: dict[str, set[tuple[int, int]]] = defaultdict(set)
    for file in df.inputFiles():
        found = re.search(rf"/([^/]+)/{FIRST}=(\d+)/{LAST}=(\d+)/", file)
        if found:
            by_day[found[1]].add((int(found[2]), int(found[3])))
    gone = F.lit(False)
    for day, ranges in by_day.items():
        held = [Folder(day, *r) for r in ranges]
        name, value = day.split("=", 1)
        of_day = F.col(name).isNull() if value == "__HIVE_DEFAULT_PARTITION__" else F.col(name).cast("string") == value
        for f in held:
            if any(o.covers(f) for o in held):
                gone |= of_day & (F.col(FIRST) == f.first) & (F.col(LAST) == f.last)
    return df.where(~gone).drop(FIRST, LAST)


def touched_days(spark: SparkSession, root: str, batch_id: int, part: str) -> list[str]:
    """Names of the day folders that a batch has written to."""
    system, at = _file_system(spark, f"{root.rstrip('/')}/{part}=*/{FIRST}={batch_id}")
    return sorted({s.getPath().getParent().getName() for s in system.globStatus(at) or []})


def start_day_sink(
    stream: DataFrame, root: str, checkpoint: str, part: str, cluster: str = "sensor_id", available_now: bool = True, most: int = MOST_FOLDERS
) -> StreamingQuery:
    """A stream to a table by day: every row once, and at most ``most`` folders of finished batches (and
    the newest batch's) in each day that still gets rows."""
    data = T.StructType([f for f in stream.schema.fields if f.name != part])

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, batch_id, root, part, cluster)
        compact(spark, root, batch_id, part, cluster, data, most, touched_days(spark, root, batch_id, part))

    return start_batches(stream, work, checkpoint, available_now)


def start_batches(stream: DataFrame, work, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

"""Writers. Tables are Parquet partitioned by day and sorted by sensor within files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.operators.decide import audit_defaults


def clustered(df: DataFrame, part: str, cluster: str) -> DataFrame:
    """Few files per day: small days are merged, a hot day is split over several tasks (both by
    adaptive execution). Rows are sorted so that min/max statistics skip row groups by sensor."""
    return df.hint("rebalance", part).sortWithinPartitions(part, cluster)


def snk_append_partitioned(
    df: DataFrame, path: str, part: str = "reading_date", cluster: str = "sensor_id"
) -> None:
    clustered(df, part, cluster).write.mode("append").partitionBy(part).parquet(path)


def snk_replace_day(
    df: DataFrame, path: str, day_col: str = "pred_date", cluster: str = "sensor_id"
) -> None:
    """Replace exactly the days present in ``df``; other days stay."""
    (
        clustered(df, day_col, cluster)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day_col)
        .parquet(path)
    )


def snk_bucketed(df: DataFrame, table: str, path: str, by: Sequence[str] = ("sensor_id", "reading_ts"), buckets: int = 200) -> DataFrame:
    """A table whose files are bucketed and sorted by ``by``: joins and aggregations by those columns
    with other tables of as many buckets need no shuffle. Each bucket is one file, so ``buckets`` should
    follow the table's size. Returns the table."""
    rows = df.repartition(buckets, *by)
    rows.write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def snk_audit_append(df: DataFrame, path: str) -> None:
    """Append audit rows, with every default filled in."""
    audit_defaults(df).write.mode("append").parquet(path)


def snk_schema_evolve(df: DataFrame, target_schema: T.StructType) -> DataFrame:
    """Add the columns of ``target_schema`` that are missing, as nulls; keep all data."""
    have = set(df.columns)
    return df.select(
        "*",
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in target_schema.fields if f.name not in have],
    )


def snk_csv_split(train: DataFrame, test: DataFrame, path: str, split_id: str) -> None:
    """Write both parts as ``;`` CSV below a new split folder; earlier splits remain beside it."""
    for part, df in (("train", train), ("test", test)):
        df.write.mode("errorifexists").csv(f"{path}/split_id={split_id}/{part}", sep=";", header=True)


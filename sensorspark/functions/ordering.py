"""Ordered computations that stay spread over the cluster when one group is huge.

A plain window over a group sorts the whole group in one task. Here every group is cut into
buckets that follow the order of the values; buckets are summarised first, the (short) list of
summaries is scanned per group, and the rows of a bucket continue from the summary before them.
The largest unit of work is one bucket, not one group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorspark.functions.columns import micros
from sensorspark.session import stored_bytes, via_table

BUCKET = "order_bucket"

# kind -> (summary of a bucket, how summaries and rows accumulate)
_ACCUMULATE = {"sum": F.sum, "max": F.max, "min": F.min}


def as_number(df: DataFrame, col: str) -> Column:
    """A double that orders like the column; equal values give equal numbers."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return micros(F.col(col)).cast("double")
    return F.col(col).cast("double")


def split_points(df: DataFrame, col: str, buckets: int = 256) -> list[float]:
    """Lowest value, approximate quantiles, highest value: one column-pruned pass, at most
    ``buckets + 1`` numbers come back. They only steer balance; results do not depend on how exact
    they are."""
    probs = [i / buckets for i in range(buckets + 1)]
    x = as_number(df, col)
    found = df.where(~F.isnan(x)).agg(F.percentile_approx(x, probs, 2 * buckets)).first()[0]
    return sorted(set(found or []))


def with_bucket(
    df: DataFrame,
    col: str,
    points: Sequence[float] | None = None,
    out: str = BUCKET,
    parts: int = 64,
) -> DataFrame:
    """Add an integer bucket that never decreases while ``col`` grows; nulls come before all.

    Each span between two points is cut again into ``parts`` of equal width, so a few hundred
    points give many thousand buckets."""
    points = split_points(df, col) if points is None else list(points)
    tmp = f"__{out}_x"
    placed = df.withColumn(tmp, as_number(df, col))
    inner = points[1:-1]
    if inner:
        splits = [float("-inf"), *inner, float("inf")]
        placed = Bucketizer(
            splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep"
        ).transform(placed)
    else:
        placed = placed.withColumn(out, F.when(F.col(tmp).isNotNull(), 0.0))
    span = F.col(out).cast("int")
    if len(points) > 1:
        edges = F.expr(f"array({', '.join(f'{p!r}D' for p in points)})")
        lo, hi = F.get(edges, span), F.get(edges, span + 1)
        share = F.when(hi > lo, F.floor((F.col(tmp) - lo) / (hi - lo) * parts))
        inside = F.least(F.greatest(F.coalesce(share, F.lit(0)), F.lit(0)), F.lit(parts - 1))
        bucket = span * parts + inside.cast("int")
    else:
        bucket = span
    # A bucket is never null; saying so keeps null checks out of the plan, and with them a second
    # read of the input (both uses of the counts share one exchange).
    return placed.withColumn(out, F.coalesce(bucket, F.lit(-1))).drop(tmp)


def running(
    df: DataFrame,
    by: Sequence[str],
    order: str | Sequence[str],
    *,
    bucket: str = BUCKET,
    measures: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Running values per group, in order, including the current row.

    ``measures`` maps an output name to ``(kind, expression)``:

    - ``sum`` / ``max`` / ``min``: running value; a ``sum`` also yields ``<name>_total``, the
      value over the whole group
    - ``previous``: the (non-null) expression of the row before, null on the first row

    ``bucket`` must follow ``order``. Rows with a null key or bucket belong to no group and do
    not come back.
    """
    by = list(by)
    order = [order] if isinstance(order, str) else list(order)
    keys = [*by, bucket]
    rows = df.select("*", *[e.alias(f"__in_{n}") for n, (_, e) in measures.items()])

    def summary(name: str, kind: str) -> Column:
        x = F.col(f"__in_{name}")
        if kind == "previous":
            return F.max_by(x, F.struct(*order)).alias(f"__b_{name}")
        return _ACCUMULATE[kind](x).alias(f"__b_{name}")

    summaries = rows.groupBy(*keys).agg(*[summary(n, k) for n, (k, _) in measures.items()])
    group = Window.partitionBy(*(by or [F.lit(0)]))
    earlier = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, (kind, _) in measures.items():
        x = F.col(f"__b_{name}")
        if kind == "previous":
            carried.append(F.last(x, ignorenulls=True).over(earlier).alias(f"__c_{name}"))
        else:
            carried.append(_ACCUMULATE[kind](x).over(earlier).alias(f"__c_{name}"))
        if kind == "sum":
            carried.append(F.sum(x).over(group).alias(f"{name}_total"))
    carry = summaries.select(*keys, *carried)

    inside = Window.partitionBy(*keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = []
    for name, (kind, _) in measures.items():
        x, c = F.col(f"__in_{name}"), F.col(f"__c_{name}")
        if kind == "sum":
            out.append((F.sum(x).over(upto) + F.coalesce(c, F.lit(0))).alias(name))
            out.append(F.col(f"{name}_total"))
        elif kind == "previous":
            out.append(F.coalesce(F.lag(x).over(inside), c).alias(name))
        else:
            pick = F.greatest if kind == "max" else F.least
            out.append(pick(_ACCUMULATE[kind](x).over(upto), c).alias(name))
    return rows.join(carry, keys).select(*[F.col(f"`{c}`") for c in df.columns], *out)


def value_counts(df: DataFrame, by: Sequence[str], col: str, nulls: bool = False) -> DataFrame:
    """Distinct values per group with their row counts: copies collapse before any ordering."""
    rows = df if nulls else df.where(F.col(col).isNotNull())
    return rows.groupBy(*by, F.col(col).alias("x")).agg(F.count(F.lit(1)).alias("n"))


def ranked_values(
    df: DataFrame,
    by: Sequence[str],
    col: str,
    points: Sequence[float] | None = None,
    nulls: bool = False,
) -> DataFrame:
    """``by..., x, n, cum, cum_total``: distinct values with cumulative and total row counts. With
    ``nulls`` a group's null values keep a row of their own; they rank nowhere."""
    points = split_points(df, col) if points is None else points
    return ranked_counts(value_counts(df, by, col, nulls), by, points, nulls)


def ranked_counts(counts: DataFrame, by: Sequence[str], points: Sequence[float] | None = None, nulls: bool = False) -> DataFrame:
    """``ranked_values`` from value counts that are there already."""
    points = split_points(counts, "x") if points is None else points
    valued = F.when(F.col("x").isNotNull(), F.col("n")).otherwise(F.lit(0)) if nulls else F.col("n")
    return running(
        with_bucket(counts, "x", points), by, "x", measures={"cum": ("sum", valued)}
    ).drop(BUCKET)


def quantile_columns(probs: dict[str, float]) -> list[Column]:
    """Exact, linearly interpolated quantiles as aggregates over the rows of ``ranked_values``."""
    x, n, cum, total = (F.col(c) for c in ("x", "n", "cum", "cum_total"))

    def at(rank: Column) -> Column:
        hit = (cum - n <= rank) & (rank < cum) & x.isNotNull()
        return F.max(F.when(hit, x.cast("double")))

    out = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (total - 1)
        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        out.append((lo + (hi - lo) * frac).alias(name))
    return out


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    col: str,
    probs: dict[str, float],
    points: Sequence[float] | None = None,
) -> DataFrame:
    """Exact quantiles per group; no group is gathered in one task."""
    return ranked_values(df, by, col, points).groupBy(*by).agg(*quantile_columns(probs))


def hash_order(key: str | Sequence[str], seed: int | str) -> Column:
    """A reproducible random order: md5 of the key text followed by the seed."""
    key = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat(*[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def hash_cut(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    quota: Callable[[Column], Column],
    digits: int = 4,
) -> DataFrame:
    """``by..., cut``: per group the hash up to which rows must be taken to reach ``quota(rows)``,
    a column expression of the group's row count.

    Rows are counted per leading hash digits (combined before the shuffle); only the one slice of
    hashes that holds a group's boundary is looked at in full. Callers then compare each row's
    hash with its group's cut, so rows are neither sorted nor gathered by group. Rows with equal
    keys have equal hashes and stay together. Groups with a quota of 0 have no cut.
    """
    by = list(by)
    rows = df.select(*by, F.col(order).alias("__o")).withColumn(
        BUCKET, F.substring("__o", 1, digits)
    )
    n = F.col("__n")
    group = Window.partitionBy(*(by or [F.lit(0)]))

    def upto(col: str) -> Window:
        return group.orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    edge = (
        rows.groupBy(*by, BUCKET)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__cum", F.sum(n).over(upto(BUCKET)))
        .withColumn("__need", quota(F.sum(n).over(group)))
        .where((F.col("__cum") >= F.col("__need")) & (F.col("__cum") - n < F.col("__need")))
        .select(*by, BUCKET, (F.col("__need") - F.col("__cum") + n).alias("__need"))
    )
    return (
        rows.join(edge, [*by, BUCKET])
        .groupBy(*by, "__o", "__need")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__cum", F.sum(n).over(upto("__o")))
        .where(F.col("__cum") >= F.col("__need"))
        .groupBy(*by)
        .agg(F.min("__o").alias("cut"))
    )


#: A frame of one row per key is broadcast up to so many bytes as stored (what Spark builds of it in
#: memory is several times that).
BROADCAST_BYTES = 8 << 20
#: A key is hot from one in so many rows on; there can be no more hot keys than that.
HOT_SHARE = 4096


def salted_join(rows: DataFrame, small: DataFrame, keys: Sequence[str], most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Left join of rows to a frame with one row per key, whatever share of the rows a key holds.

    The small side is stored, so its size is known. Up to ``most_bytes`` it is broadcast and the rows
    stay where they are. Beyond, keys are counted; a hot one (``HOT_SHARE``) is cut into as many parts
    as its count needs on the side of the rows and repeated as often on the other, all others meet as
    they are. Null keys match nothing."""
    keys = list(keys)
    small = via_table(small, "keyed")
    if stored_bytes(small) <= most_bytes:
        return rows.join(F.broadcast(small), keys, "left")
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    counts = via_table(counts.dropna(subset=keys), "key-counts")
    share = (counts.agg(F.sum("__rows")).first()[0] or 0) // HOT_SHARE + 1
    hot = via_table(counts.where(F.col("__rows") > share).select(*keys, F.ceil(F.col("__rows") / share).cast("int").alias("__parts")), "hot-keys")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]) + F.spark_partition_id(), F.coalesce("__parts", F.lit(1)))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", part.cast("int")).drop("__parts")
    repeated = small.join(F.broadcast(hot), keys, "left")
    repeated = repeated.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(repeated, [*keys, "__salt"], "left").drop("__salt")


#: So many first rows are gathered by one task; more stay in the partitions that they are sorted in.
GATHERED = 10_000


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order. Beyond ``GATHERED`` rows are dealt by ranges of the order and
    stored; whole ranges are taken until ``n`` is reached, and of the next one its first rows. The
    result is the same either way, as far as the order settles it."""
    if n <= GATHERED:
        return df.orderBy(*order).limit(n)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = via_table(dealt.withColumns({"__part": F.spark_partition_id(), "__pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "first-rows")
    # One row a partition.
    sizes = sorted((r["__part"], r["count"]) for r in placed.groupBy("__part").count().collect())
    taken, edge, rest = 0, -1, 0
    for part, size in sizes:
        edge, rest = part, min(size, n - taken)
        taken += rest
        if taken == n:
            break
    return placed.where((F.col("__part") < edge) | ((F.col("__part") == edge) & (F.col("__pos") < rest))).drop("__part", "__pos")


def top_k_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, salts: int = 64
) -> DataFrame:
    """The first ``k`` rows of each group. Each part of a group is cut to ``k`` rows before the
    parts meet, so the last step sees at most ``k * salts`` rows of a group. The salt mixes in
    the input partition, so copies of one row are spread as well."""
    salted = df.withColumn(
        "__salt", F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(salts))
    )
    part = Window.partitionBy(*by, "__salt").orderBy(*order)
    whole = Window.partitionBy(*by).orderBy(*order)
    return (
        salted.withColumn("__rn", F.row_number().over(part))
        .where(F.col("__rn") <= k)
        .withColumn("__rn", F.row_number().over(whole))
        .where(F.col("__rn") <= k)
        .drop("__salt", "__rn")
    )

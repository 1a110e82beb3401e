"""Mixing of sources to target weights by weighted sampling without replacement.

Efraimidis-Spirakis keys: a document of quality weight ``w`` gets the key ``-ln(u) / w`` with a
uniform ``u`` that its id and text decide; of rows equal in both each has its own. A source's target is met by complete epochs first; the rest
is taken in the order of the keys until the running sum of sizes reaches the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorspark.llm.common import WORD, before, ranked, via_table

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST_EPOCHS = 3
#: Weight of a document that no label speaks of.
UNLABELLED = 0.5


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size`` (one row a source) -> with ``weight`` and ``target`` (double).

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. All sizes together
    are shared out by weight; a target stops at ``most`` times the source's size and the excess is
    shared by weight among the others, until none is above. That is the level ``t`` for which the
    sum of ``least(most * size, t * weight)`` is the total: sources reach their cap in order of
    cap / weight, so running sums over the sources find it. Sources of no size get 0. The rows are
    one a source, not one a document.
    """
    every = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    rows = sizes.select("source", "source_size", F.get(every, (place % len(weights)).cast("int")).alias("weight"))
    cap, w = F.col("source_size") * float(most), F.col("weight")
    fill = Window.orderBy(cap / w, F.col("source").isNull(), "source")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.select(
        "*",
        F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)).alias("full"),
        F.coalesce(F.sum(w).over(earlier), F.lit(0.0)).alias("gone"),
        F.sum("source_size").over(everything).cast("double").alias("all_sizes"),
        F.sum(w).over(everything).alias("all_weights"),
    )
    level = (F.col("all_sizes") - F.col("full")) / (F.col("all_weights") - F.col("gone"))
    rows = rows.withColumn("level", F.max(F.when(level * w <= cap, level)).over(everything))
    return rows.select("source", "source_size", "weight", F.least(cap, F.coalesce("level", F.lit(float("inf"))) * w).alias("target"))


def uniform(text: Column) -> Column:
    """In (0, 1): 52 bits of the md5 of a text."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def numbered_copies(rows: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Numbers rows that agree in ``by`` from 0, whatever share of the rows they are. Rows are stored
    with the task that wrote them; a task's rows of a key are numbered, and earlier tasks' counts of
    the key added: one row for each key and task that repeats it."""
    stored = via_table(rows.withColumn("__task", F.spark_partition_id()), "mix-rows")
    here = Window.partitionBy("__task", *by).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    local = stored.withColumn("__local", F.row_number().over(here) - 1)
    counts = stored.groupBy("__task", *by).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__first", F.sum("__n").over(earlier)).where("__first > 0").drop("__n")
    names = {c: f"__of_{i}" for i, c in enumerate([*by, "__task"])}
    offsets = offsets.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    on = same[0]
    for c in same[1:]:
        on &= c
    numbered = local.join(offsets, on, "left").withColumn(out, (F.col("__local") + F.coalesce("__first", F.lit(0))).cast("bigint"))
    return numbered.drop("__local", "__first", "__task", *names.values())


def mix_sources(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST_EPOCHS,
    seed: int = 7,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, size, source, weight, sample_key, source_size, target, epochs, part, taken``, and the
    columns ``keep`` of ``docs``.

    - ``size``: words of the text (null text: 0); ``quality`` (``doc_id, weight`` > 0, one row a
      document) scales the keys, ``UNLABELLED`` where it names none, 1 for all without it.
    - ``epochs`` complete passes over the source, then ``part`` words by the order of the keys: all
      of a document's words, or of the one document that crosses the budget as many as are left.
      ``taken = epochs * size + part``, so a source's taken words are its target, rounded.
    - Ties of the key go by id, text and number of the copy. Repeated rows are documents of their own
      with draws of their own, as are rows without an id. Null ids and null sources are values like
      others. An empty table gives an empty result.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), digest.alias("__text"), *[F.col(c).alias(f"__keep_{c}") for c in keep])
    if quality is not None:
        q = quality.select(F.col("doc_id").alias("__id"), F.col("weight").alias("__w")).where("__w > 0")
        rows = rows.join(q.groupBy("__id").agg(F.max("__w").alias("__w")), F.col("doc_id") == F.col("__id"), "left").drop("__id")
    else:
        rows = rows.withColumn("__w", F.lit(1.0))
    rows = rows.withColumn("weight", F.coalesce("__w", F.lit(UNLABELLED)).cast("double")).drop("__w")
    rows = numbered_copies(rows, ["source", "doc_id", "__text"], "__copy")
    draw = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__text", "__copy", F.lit(str(seed)))
    rows = rows.withColumn("sample_key", -F.ln(uniform(draw)) / F.col("weight"))
    order = [F.col("source").asc_nulls_last(), F.col("sample_key"), F.col("doc_id").asc_nulls_last(), F.col("__text"), F.col("__copy")]
    placed = ranked(rows, order, "mix")

    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = via_table(source_targets(sizes, weights, most).drop("weight"), "mix-targets")
    carried = before(placed, ["source"], {"__before": F.col("size")})
    # One row for each source and part that holds some of it: both sides of a join by key are small.
    budget = carried.join(targets, carried["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    budget = budget.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    budget = budget.withColumn("__left", F.round(F.col("target")).cast("bigint") - F.col("epochs") * F.col("source_size"))
    budget = budget.withColumnRenamed("source", "__s").withColumnRenamed("__part", "__p")
    inside = Window.partitionBy("__part", "source").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = summed.join(budget, (F.col("__part") == F.col("__p")) & F.col("source").eqNullSafe(F.col("__s")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left") - F.col("__before") - F.col("__in")))
    return out.select(
        "doc_id", "size", "source", "weight", "sample_key", "source_size", "target", "epochs",
        part.cast("bigint").alias("part"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
        (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"),
    )


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 1 for good, 0.25 for bad documents, that of unlabelled ones without
    a quality. Of several labels of a document the best counts."""
    w = F.when(F.col("quality") >= 1, 1.0).when(F.col("quality") < 1, 0.25).otherwise(UNLABELLED)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(w).alias("weight"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None, **options) -> DataFrame:
    """The documents of the mix, all their columns, whole: one row for each time a document is
    taken. The document that crosses a source's budget is taken if half of it or more fits.

    Documents are stored with a number of their own, so every row meets its own decision, whatever
    ids and texts repeat."""
    row = "__row"
    stored = via_table(docs.withColumn(row, F.monotonically_increasing_id()), "mix-documents")
    plan = mix_sources(stored, quality, keep=[row], **options)
    times = F.col("epochs") + F.when((F.col("part") * 2 >= F.col("size")) & (F.col("part") > 0), 1).otherwise(0)
    plan = plan.select(row, times.cast("int").alias("__times")).where("__times > 0")
    kept = stored.join(plan, row)
    return kept.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])

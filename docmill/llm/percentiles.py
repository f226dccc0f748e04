"""Problem 1: percentiles of very large numeric columns, per group, from mergeable summaries.

A summary is a table of counts per group and value, values rounded to about four
significant digits, so that its size depends on the range of the values and not
on the number of rows. Summaries of days, partitions or earlier runs are merged
by adding counts. Ranks are found by cumulative frequency: the counts are sorted
by range over the cluster, each partition adds up its own values in order, takes
the sum of the partitions before it as offset, and the first value whose running
sum reaches the target rank is the percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.scratch import stage

QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)
METRICS = ("total_time_ms", "retrieval_time_ms", "llm_time_ms")
#: A time of a day or more isn't a time of one query.
MOST_MS = 86_400_000.0
#: Rounding: up to each bound, the step between kept values. The error is at most half a step, 0.05 %.
STEPS = ((1e3, 0.1), (1e4, 1.0), (1e5, 10.0), (1e6, 100.0), (1e7, 1e3), (1e8, 1e4))


def rounded(c):
    """The kept value of ``c``: the nearest multiple of the step of its size."""
    out = F.when(c < STEPS[0][0], F.floor(c / STEPS[0][1] + 0.5) / (1 / STEPS[0][1]))
    for bound, step in STEPS[1:]:
        out = out.when(c < bound, F.floor(c / step + 0.5) * step)
    return out


def usable(c, most: float = MOST_MS):
    """Not null, not NaN, not infinite, not negative, and under ``most``."""
    return c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c < most)


def summary(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS, id_col: str | None = "id", most: float = MOST_MS) -> DataFrame:
    """(``keys``, metric, value, n): counts of rounded usable values.

    With ``id_col``, rows of one id count once (of differing rows the smallest),
    rows with a null id each.
    Null keys form a group of their own. Metrics without a usable value have no
    row. An empty table gives an empty summary; other columns are ignored.
    """
    rows = df.select(*([id_col] if id_col else []), *keys, *metrics)
    if id_col:
        # rows without an id stay apart by a number of their own
        own = F.when(F.col(id_col).isNull(), F.monotonically_increasing_id())
        rows = rows.withColumn("_row", own).groupBy(id_col, "_row").agg(F.min(F.struct(*keys, *metrics)).alias("r")).select("r.*")
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    good = long.select(*keys, "x.metric", "x.v").where(usable(F.col("v"), most))
    return good.groupBy(*keys, "metric", rounded(F.col("v")).alias("value")).agg(F.count("*").alias("n"))


def merge(*summaries: DataFrame) -> DataFrame:
    """One summary of several, such as those of single days; keys may be left out beforehand."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s)
    return out.groupBy(*[c for c in out.columns if c != "n"]).agg(F.sum("n").alias("n"))


def percentiles(counts: DataFrame, keys: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(``keys``, quantile, n, value): the value of rank ceil(quantile * n) of each group of a summary."""
    merged = counts.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    placed = stage(merged.repartitionByRange(*keys, "value").withColumn("part", F.spark_partition_id()), "ranges")
    own = placed.groupBy(*keys, "part").agg(F.sum("n").alias("own"))
    before = Window.partitionBy(*keys).orderBy("part")
    offsets = own.select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.col("part").alias("_part"),
        (F.sum("own").over(before) - F.col("own")).alias("offset"),
        F.sum("own").over(Window.partitionBy(*keys)).alias("total"),
    )
    same = F.col("part") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    running = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("value"))
    ranked = placed.withColumn("running", running).join(offsets, same).withColumn("upto", F.col("running") + F.col("offset"))
    hits = ranked.select(
        *keys, "value", "total", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile"), "upto", (F.col("upto") - F.col("n")).alias("below")
    )
    target = F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("total") - 1e-9))
    return hits.where((F.col("upto") >= target) & (F.col("below") < target)).select(*keys, "quantile", F.col("total").alias("n"), "value")


def query_times(metrics: DataFrame) -> DataFrame:
    """query_metrics with its path in one spelling and the UTC day of its timestamp; rows without a usable timestamp have a null day."""
    path = F.lower(F.trim("path"))
    seconds = F.when(F.col("timestamp").isNull() | F.isnan("timestamp"), None).otherwise(F.col("timestamp"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return metrics.select("id", path.alias("path"), day.alias("day"), *METRICS)


def by_path_and_day(metrics: DataFrame) -> DataFrame:
    """(path, day, metric, quantile, n, value) of each path and day, and of each path over all days (day null)."""
    days = stage(summary(query_times(metrics), ["path", "day"]), "days")
    both = days.select("path", "day", F.lit(0).alias("overall"), "metric", "value", "n").unionByName(
        days.groupBy("path", "metric", "value").agg(F.sum("n").alias("n")).select("path", F.lit(None).cast("date").alias("day"), F.lit(1).alias("overall"), "metric", "value", "n")
    )
    return percentiles(both, ["overall", "path", "day", "metric"]).drop("overall")

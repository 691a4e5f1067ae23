"""Safe segments and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions.text import MIN_CHARS, strip


def safe_segments(corpus: DataFrame, text: str = "content") -> DataFrame:
    """file_id, repo, pos, segment: stripped lines of eight characters and more."""
    rows = corpus.select("file_id", "repo", F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.select("file_id", "repo", "pos", strip(F.col("line")).alias("segment")).where(F.length("segment") >= MIN_CHARS)


def invert_ranges(ranges: Column, total: Column) -> Column:
    """The gaps in ``[0, total)`` that an array of (start, end) leaves, touching ranges merged.

    One pass over the sorted array: ``at`` is the end of what is covered so far."""
    gap = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    done = F.aggregate(
        F.array_sort(F.coalesce(ranges, empty)),
        start,
        lambda a, r: F.struct(F.greatest(a["at"], r["end"]).cast("int").alias("at"), F.when(r["start"] > a["at"], F.concat(a["out"], F.array(gap(a["at"], r["start"])))).otherwise(a["out"]).alias("out")),
    )
    return F.when(done["at"] < total, F.concat(done["out"], F.array(gap(done["at"], total)))).otherwise(done["out"])


def invert_range_rows(ranges: DataFrame, totals: DataFrame) -> DataFrame:
    """The same over rows (file_id, start, end) and (file_id, total): gaps and islands by a running
    maximum of ends, for files with so many ranges that an array is the wrong shape."""
    marks = ranges.select("file_id", "start", "end").unionByName(totals.select("file_id", F.col("total").alias("start"), F.col("total").alias("end")))
    order = Window.partitionBy("file_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    gaps = marks.withColumn("at", F.coalesce(F.max("end").over(order), F.lit(0)))
    return gaps.where("start > at").select("file_id", F.col("at").alias("start"), F.col("start").alias("end"))


def is_in_range(ranges: Column, at: Column) -> Column:
    return F.coalesce(F.exists(ranges, lambda r: (at >= r["start"]) & (at < r["end"])), F.lit(False))


def range_stats(safe: Column, total: Column) -> Column:
    """safe, unsafe, safe_pct of a file; 0 percent for an empty one."""
    n = F.aggregate(safe, F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return F.struct(n.alias("safe_bytes"), (total - n).alias("unsafe_bytes"), F.when(total > 0, 100.0 * n / total).otherwise(0.0).alias("safe_pct"))

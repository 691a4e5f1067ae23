"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Each source gets a word budget from its weight; whole copies of the source fill most of it, and one
more copy of the documents whose hash lies under the source's threshold fills the rest. The threshold
is found without sorting documents: words are summed by source and hash bucket, the bucket in which
the budget ends is the only one that is looked into again, and so on for ``LEVELS`` levels; the few
documents of the last bucket are then told apart by their whole hash.

Defined results: a null text has size 0; null is a source of its own, last in order; documents of
size 0 take nothing; rows with equal ids share a hash, so they are taken or left together; an empty
table gives an empty result; further columns are ignored by ``mix`` and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """The first 60 bits of md5 of the id as text: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and hash of each row, written once: the levels below read only this."""
    return materialise(docs.select("doc_id", "source", n_words(docs["text"]).alias("size"), doc_hash(docs["doc_id"]).alias("_h")), "mix-sizes")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target: weights by rank in code point order, water-filled under the cap.

    A source whose cap lies under its share is held at the cap and the excess is shared again by
    weight. In order of cap per weight the held sources are a prefix, so running sums find them all.
    The windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", cap * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), zero)
    free = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), zero)
    per = per.withColumn("_held", left / free >= F.col("_cap") / F.col("_w"))
    held, rest = F.sum(F.when(F.col("_held"), F.col("_cap")).otherwise(0.0)), F.sum(F.when(F.col("_held"), 0.0).otherwise(F.col("_w")))
    level = (share * F.sum("source_size").over(everything) - held.over(everything)) / F.nullif(rest.over(everything), zero)
    return per.select("source", "source_size", F.when(F.col("_held"), F.col("_cap")).otherwise(F.col("_w") * level).alias("target"))


def thresholds(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target, copies, below: each document is taken ``copies`` times, and once
    more if its hash is under ``below``. One row per source."""
    t = targets(sizes, weights, share, cap)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = t.withColumn("copies", copies).withColumn("_rest", F.col("target") - F.col("copies") * F.col("source_size"))
    at = materialise(t.withColumn("_at", F.lit(0).cast("long")), "mix-targets")
    cum = Window.partitionBy("source").orderBy("_b")
    for level in range(LEVELS):
        width, shift = LEVEL_BITS * (level + 1), HASH_BITS - LEVEL_BITS * (level + 1)
        spots = at.select(F.col("source").alias("_s"), "_at")
        rows = sizes.withColumn("_b", F.shiftright("_h", shift))
        if level:  # only the bucket in which the budget ends is looked into again
            rows = rows.join(spots, rows["source"].eqNullSafe(spots["_s"]) & (F.shiftright(rows["_b"], LEVEL_BITS) == spots["_at"]), "left_semi")
        sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_n")).withColumn("_to", F.sum("_n").over(cum)).withColumnRenamed("source", "_s")
        ends = sums.join(at.drop("_at"), sums["_s"].eqNullSafe(at["source"])).where("_to > _rest")
        first = ends.groupBy("_s").agg(F.min(F.struct("_b", F.col("_to") - F.col("_n"))).alias("_m")).select("_s", F.col("_m._b").alias("_at"), F.col("_m.col2").alias("_from"))
        at = at.drop("_at").join(first, at["source"].eqNullSafe(first["_s"]), "left").select(
            "source", "source_size", "target", "copies", (F.col("_rest") - F.coalesce("_from", F.lit(0))).alias("_rest"), F.coalesce("_at", F.lit((1 << width) - 1)).alias("_at")
        )
        at = materialise(at, f"mix-level{level}")
    # The last bucket's documents, by whole hash: one is taken if that ends nearer to the budget.
    last = HASH_BITS - LEVEL_BITS * LEVELS
    spots = at.select(F.col("source").alias("_s"), "_at", "_rest")
    rows = sizes.join(spots, sizes["source"].eqNullSafe(spots["_s"]) & (F.shiftright(sizes["_h"], last) == spots["_at"]))
    by_hash = rows.groupBy("_s", "_h", "_rest").agg(F.sum("size").alias("_n"))
    run = F.sum("_n").over(Window.partitionBy("_s").orderBy("_h"))
    stop = by_hash.withColumn("_to", run).where((F.col("_n") > 0) & (2 * F.col("_to") - F.col("_n") >= 2 * F.col("_rest"))).groupBy("_s").agg(F.min("_h").alias("_stop"))
    return materialise(
        at.join(stop, at["source"].eqNullSafe(stop["_s"]), "left").select("source", "source_size", "target", "copies", F.coalesce("_stop", F.shiftleft(F.col("_at") + 1, last)).alias("below")),
        "mix-thresholds",
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``."""
    sizes = sized(docs)
    at = thresholds(sizes, weights, share, cap).withColumnRenamed("source", "_s")
    times = F.col("copies") + (F.col("_h") < F.col("below")).cast("long")
    return sizes.join(at, sizes["source"].eqNullSafe(at["_s"])).select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), "source")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it. Texts are not shuffled: the
    table of thresholds has one row per source."""
    at = thresholds(sized(docs), weights, share, cap).select(F.col("source").alias("__mix_source"), "copies", "below").toDF("__mix_source", "__mix_copies", "__mix_below")
    times = (F.col("__mix_copies") + (doc_hash(docs["doc_id"]) < F.col("__mix_below")).cast("long")).cast("int")
    rows = docs.join(at, docs["source"].eqNullSafe(at["__mix_source"])).withColumn("__mix_times", times)
    rows = rows.where((F.col("__mix_times") > 0) & docs["text"].rlike(r"[^\x20\x09-\x0D]"))  # documents of size 0 take nothing
    return rows.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), "__mix_times"))).select(*docs.columns)


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM sizes GROUP BY source),
weighted AS (SELECT source, s, [5.0, 2.0, 1.0][(r % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * s AS cap FROM per),
ordered AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER () AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left
  FROM weighted),
held AS (SELECT *, (budget - cap_before) / w_left >= cap / w AS is_held FROM ordered),
goal AS (
  SELECT source, s, CASE WHEN is_held THEN cap ELSE w * ((budget - sum(CASE WHEN is_held THEN cap ELSE 0 END) OVER ())
    / nullif(sum(CASE WHEN is_held THEN 0 ELSE w END) OVER (), 0)) END AS target FROM held),
rest AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS copies, target - CASE WHEN s > 0 THEN floor(target / s) * s ELSE 0 END AS rest FROM goal),
runs AS (
  SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS tied FROM sizes)
SELECT d.doc_id, d.size, CAST(r.s AS BIGINT) AS source_size, r.target,
  CAST(d.size * (r.copies + CASE WHEN 2 * d.upto - d.tied < 2 * r.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken, d.source
FROM runs d JOIN rest r ON d.source IS NOT DISTINCT FROM r.source
"""

"""Dictionaries as tables (kind, ord, content, macro, slots, category): M rows are patterns, T rows
templates. They are bounded by ``MAX_MACROS`` rows a kind, so windows over them are small."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellon.functions.text import MAX_MACROS, macro_token, slot_count


def _numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """Ids in order, for each kind; content past the cap is left out."""
    ord_ = F.row_number().over(Window.partitionBy("kind").orderBy(*order))
    rows = rows.withColumn("ord", ord_).where(F.col("ord") <= MAX_MACROS)
    macro = F.when(F.col("kind") == "M", macro_token("M", F.col("ord"))).otherwise(macro_token("T", F.col("ord")))
    return rows.select("kind", "ord", "content", macro.alias("macro"), "slots", "category")


def from_seed(spark: SparkSession, seeds: list[tuple[str, str]]) -> DataFrame:
    """Patterns (pattern, category) with ids by place in the list."""
    rows = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(seeds)], "i int, content string, category string")
    return _numbered(rows.select("i", F.lit("M").alias("kind"), "content", F.lit(0).alias("slots"), "category"), "i")


def candidate_union(channels: list[tuple[DataFrame, str, str, int | None]]) -> DataFrame:
    """Channels (rows, kind, category, cap) in order of priority into one dictionary. Rows hold
    content and rank (1 is best; ties by content); content that an earlier channel has is skipped."""
    parts = []
    for i, (rows, kind, category, cap) in enumerate(channels):
        r = rows.select("content", "rank", *(["category"] if "category" in rows.columns else []))
        if cap is not None:
            r = r.orderBy("rank", "content").limit(cap)
        cat = F.col("category") if "category" in rows.columns else F.lit(category)
        parts.append(r.select(F.lit(i).alias("channel"), "rank", F.lit(kind).alias("kind"), "content", cat.alias("category")))
    rows = reduce(DataFrame.unionByName, parts)
    first = F.row_number().over(Window.partitionBy("kind", "content").orderBy("channel", "rank"))
    rows = rows.withColumn("_first", first).where("_first = 1")
    rows = rows.withColumn("slots", F.when(F.col("kind") == "T", slot_count(F.col("content"))).otherwise(F.lit(0)))
    return _numbered(rows, "channel", "rank", "content")


def merge(*dictionaries: DataFrame) -> DataFrame:
    """Dictionaries folded in order, each by length, longest first; the first of equals wins."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("_d", F.lit(i)) for i, d in enumerate(dictionaries)])
    first = F.row_number().over(Window.partitionBy("kind", "content").orderBy("_d", "ord"))
    rows = rows.withColumn("_first", first).where("_first = 1")
    return _numbered(rows, "_d", F.desc(F.length("content")), "content")


def add(dictionary: DataFrame, rows: DataFrame) -> DataFrame:
    """Further rows (kind, content, category) with the next ids; known content keeps its row. Raises
    on use if a kind would pass its cap."""
    new = rows.select("kind", "content", "category").distinct().join(dictionary.select("kind", "content"), ["kind", "content"], "left_anti")
    top = dictionary.groupBy("kind").agg(F.max("ord").alias("_top"))
    new = new.join(top, "kind", "left").withColumn("ord", F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy("kind").orderBy("content")))
    new = new.withColumn("ord", F.when(F.col("ord") <= MAX_MACROS, F.col("ord")).otherwise(F.raise_error(F.lit(f"more than {MAX_MACROS} macros"))).cast("int"))
    macro = F.when(F.col("kind") == "M", macro_token("M", F.col("ord"))).otherwise(macro_token("T", F.col("ord")))
    slots = F.when(F.col("kind") == "T", slot_count(F.col("content"))).otherwise(F.lit(0))
    return dictionary.unionByName(new.select("kind", "ord", "content", macro.alias("macro"), slots.alias("slots"), "category"))


def remove(dictionary: DataFrame, contents: list[str]) -> DataFrame:
    """Without these patterns; their ids are not used again."""
    return dictionary.where(~((F.col("kind") == "M") & F.col("content").isin(contents)))


def stats(dictionary: DataFrame) -> DataFrame:
    """category, n, mean_length."""
    return dictionary.groupBy("kind", "category").agg(F.count("*").alias("n"), F.avg(F.length("content")).alias("mean_length"))


def token_list(dictionary: DataFrame) -> DataFrame:
    """pos, token: macros in order, template prefixes in order, then the closing mark."""
    rows = dictionary.select(F.when(F.col("kind") == "M", 0).otherwise(1).alias("part"), F.when(F.col("kind") == "M", F.col("macro")).otherwise(F.concat(F.expr("substring(macro, 1, length(macro) - 2)"), F.lit(":"))).alias("token"))
    rows = rows.unionByName(dictionary.sparkSession.createDataFrame([(2, "|>")], "part int, token string"))
    return rows.select((F.row_number().over(Window.orderBy("part", "token")) - 1).alias("pos"), "token")


def token_map(dictionary: DataFrame, vocab_size: int) -> DataFrame:
    """One row: new token -> id, after a vocabulary of ``vocab_size``."""
    rows = token_list(dictionary)
    return rows.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("token", (F.col("pos") + vocab_size).alias("id"))))).alias("token_map"), (F.count("*") + vocab_size).alias("vocab_size"))

"""Scans and sinks: corpora, metadata, dictionaries, scores, training records.

A corpus is a DataFrame (file_id, repo, language, content). ``documents`` parquet is one; a directory
of source files is another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellon import schema
from tessellon.session import materialise


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    return d.select(F.col("doc_id").alias("file_id"), F.coalesce("source", F.lit("unknown")).alias("repo"), F.col("lang").alias("language"), F.coalesce("text", F.lit("")).alias("content"))


def spread(table: DataFrame) -> DataFrame:
    """A table that arrives in fewer partitions than there are cores, dealt out evenly. Larger tables
    are left as they are: they have more splits than cores, and dealing them out would move them."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def read_files(spark: SparkSession, root: str, extensions: tuple[str, ...]) -> DataFrame:
    """path, repo (first folder under ``root``), content of the files with one of the extensions.
    Bytes that are not UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.substring_index("path", root.rstrip("/").rsplit(":", 1)[-1] + "/", -1)
    wanted = [rel.endswith(e) for e in extensions]
    keep = wanted[0]
    for w in wanted[1:]:
        keep = keep | w
    return raw.where(keep).select(rel.alias("path"), "content").select("path", F.split("path", "/")[0].alias("repo"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with file_id, counting from 0 in the given order. The order is made by ranges, so a
    repo with a third of all files is dealt out like any other; a running sum over the partitions'
    counts tells each where it starts."""
    placed = materialise(rows.sort(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")  # as many rows as partitions
    return out.select(*rows.columns, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias("file_id"))


def extract_files(files: DataFrame, extension: str = ".py", min_length: int = 100, max_length: int = 50_000, max_files: int | None = None, skip: tuple[str, ...] = (), designated: list[str] | None = None) -> DataFrame:
    """The files that count, numbered in order of (repo, path): file_id, filename, path, repo, content.

    A file goes if its lower-cased path holds a skip part, its length is outside the range, or its
    repo is not designated. Paths are unique within a repo."""
    rows = files.where(F.length("content").between(min_length, max_length))
    for part in skip:
        rows = rows.where(~F.contains(F.lower("path"), F.lit(part.lower())))
    if designated is not None:
        rows = rows.where(F.col("repo").isin(designated))
    numbers = numbered(rows.select("repo", "path"), "repo", "path")
    out = rows.join(numbers, ["repo", "path"])
    if max_files is not None:
        out = out.where(F.col("file_id") < max_files)
    return out.select("file_id", F.concat(F.lpad(F.col("file_id").cast("string"), 6, "0"), F.lit(extension)).alias("filename"), "path", "repo", "content")


def metadata(extracted: DataFrame) -> DataFrame:
    """The metadata rows of extracted files."""
    return extracted.select(F.col("file_id").alias("index"), "filename", F.col("path").alias("original_path"), F.length("content").cast("long").alias("original_size"), F.col("repo").alias("source"), F.lit("permissive").alias("license"))


def missing_repos(files: DataFrame, designated: DataFrame) -> DataFrame:
    """Designated repos (column repo) of which no file was found: must be empty."""
    return designated.join(files.select("repo").distinct(), "repo", "left_anti")


def integrity(extracted: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: files, metadata rows, and whether they agree."""
    a = extracted.agg(F.count("*").alias("n_files"))
    b = meta.agg(F.count("*").alias("n_meta"))
    return a.join(b).withColumn("ok", F.col("n_files") == F.col("n_meta"))


def summary(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("n_files"), F.sum(F.octet_length("content")).alias("n_bytes"), F.count_distinct("repo").alias("n_repos"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """filename -> repo; of repeated filenames the last index wins."""
    rows = spark.read.schema(schema.METADATA).json(path)
    return rows.groupBy("filename").agg(F.max_by("source", "index").alias("repo"))


def with_repo(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files with their repo, ``unknown`` where the metadata has none."""
    return files.drop("repo").join(meta, "filename", "left").withColumn("repo", F.coalesce("repo", F.lit("unknown")))


def exclude_repos(corpus: DataFrame, repos: DataFrame) -> DataFrame:
    """Files whose repo is not among ``repos`` (column repo)."""
    return corpus.join(repos.select("repo").distinct(), "repo", "left_anti").select(*corpus.columns)


def first_files(corpus: DataFrame, n: int, by: str = "file_id") -> DataFrame:
    return corpus.orderBy(by).limit(n)


def write_jsonl(texts: DataFrame, path: str) -> None:
    texts.select("text").write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training records; blank lines are skipped."""
    return spark.read.schema(schema.RECORD).json(path).where(F.col("text").isNotNull())


def write_result(row: DataFrame, path: str) -> None:
    """A result of one row, or of a few, as one JSON file."""
    row.coalesce(1).write.mode("overwrite").json(path)


def save_dictionary(dictionary: DataFrame, path: str) -> None:
    """Rows (kind, ord, content, macro, slots, category) as one nested JSON document."""
    parts = dictionary.agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "M", F.struct("ord", F.col("content").alias("pattern"), "macro", "category")))).alias("p"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "T", F.struct("ord", F.col("content").alias("template"), "macro", "slots", "category")))).alias("t"),
    )
    parts.select(F.transform("p", lambda x: x.dropFields("ord")).alias("patterns"), F.transform("t", lambda x: x.dropFields("ord")).alias("templates")).coalesce(1).write.mode("overwrite").json(path)


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Keeps ids; a missing category is ``unknown`` for patterns and ``template`` for templates."""
    doc = spark.read.schema(schema.DICTIONARY_JSON).json(path)
    number = F.regexp_extract("x.macro", r"(\d+)", 1).cast("int").alias("ord")
    exact = doc.select(F.explode_outer("patterns").alias("x")).where("x IS NOT NULL").select(F.lit("M").alias("kind"), number, F.col("x.pattern").alias("content"), "x.macro", F.lit(0).alias("slots"), F.coalesce("x.category", F.lit("unknown")).alias("category"))
    slotted = doc.select(F.explode_outer("templates").alias("x")).where("x IS NOT NULL").select(F.lit("T").alias("kind"), number, F.col("x.template").alias("content"), "x.macro", "x.slots", F.coalesce("x.category", F.lit("template")).alias("category"))
    return exact.unionByName(slotted)


def save_scores(scores: DataFrame, path: str) -> None:
    """The sidecar: every scored entry, keyed by content, as a table that refilter reads again."""
    scores.write.mode("overwrite").parquet(path)


def load_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.SCORES).parquet(path)


def lower_path_skips(path: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(F.lower(path), F.lit(p.lower()))
    return hit

"""Queries on corpora: extraction, repos, splits, segments, ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellon.functions.text import is_word_boundary_end, is_word_boundary_start
from tessellon.operators import prepare, segments
from tessellon.sources import corpus as src

EVAL_REPOS = ["src3", "src11"]
QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: The corpus in SQL, as ``sources.corpus.documents`` reads it.
CORPUS = "corpus AS (SELECT doc_id AS file_id, coalesce(source, 'unknown') AS repo, lang AS language, coalesce(text, '') AS content FROM documents)"


def _files(spark, sf_dir):
    d = src.documents(spark, sf_dir)
    return d.select(F.concat("repo", F.lit("/"), "language", F.lit("/"), F.lpad(F.col("file_id").cast("string"), 9, "0"), F.lit(".txt")).alias("path"), "repo", "content")


_FILES = f"{CORPUS}, files AS (SELECT repo || '/' || language || '/' || lpad(CAST(file_id AS VARCHAR), 9, '0') || '.txt' AS path, repo, content FROM corpus)"
_EXTRACTED = f"""{_FILES}, extracted AS (
  SELECT row_number() OVER (ORDER BY repo, path) - 1 AS file_id, path, repo, length(content) AS n FROM files
  WHERE length(content) BETWEEN 100 AND 1000000 AND NOT contains(lower(path), '/vendor/') AND NOT contains(lower(path), '/generated/'))"""


def _extracted(spark, sf_dir):
    return src.extract_files(_files(spark, sf_dir), ".txt", max_length=1_000_000, skip=("/Vendor/", "/generated/"))


@query(f"WITH {_EXTRACTED} SELECT file_id, lpad(CAST(file_id AS VARCHAR), 6, '0') || '.txt' AS filename, path, repo, n AS original_size FROM extracted")
def corpus_extract(spark, sf_dir):
    return _extracted(spark, sf_dir).select("file_id", "filename", "path", "repo", F.length("content").cast("long").alias("original_size"))


@query(f"WITH {_EXTRACTED} SELECT count(*) AS n_files, count(*) AS n_meta, TRUE AS ok FROM extracted")
def corpus_integrity(spark, sf_dir):
    out = _extracted(spark, sf_dir)
    return src.integrity(out, src.metadata(out))


@query(f"WITH {_EXTRACTED} SELECT file_id AS index, lpad(CAST(file_id AS VARCHAR), 6, '0') || '.txt' AS filename, path AS original_path, n AS original_size, repo AS source, 'permissive' AS license FROM extracted")
def corpus_metadata(spark, sf_dir):
    return src.metadata(_extracted(spark, sf_dir))


@query(f"WITH {CORPUS} SELECT count(*) AS n_files, CAST(sum(strlen(content)) AS BIGINT) AS n_bytes, count(DISTINCT repo) AS n_repos FROM corpus")
def corpus_summary(spark, sf_dir):
    return src.summary(src.documents(spark, sf_dir))


@query("SELECT r AS repo FROM (VALUES ('src1'), ('src5'), ('src99'), ('missing')) t(r) WHERE r NOT IN (SELECT coalesce(source, 'unknown') FROM documents)")
def designated_repos(spark, sf_dir):
    wanted = spark.createDataFrame([("src1",), ("src5",), ("src99",), ("missing",)], "repo string")
    return src.missing_repos(src.documents(spark, sf_dir), wanted)


_META = "meta AS (SELECT doc_id AS file_id, source AS repo FROM documents WHERE lang <> 'fr')"


@query(f"WITH {_META} SELECT d.doc_id AS file_id, coalesce(m.repo, 'unknown') AS repo FROM documents d LEFT JOIN meta m ON d.doc_id = m.file_id")
def file_repo_left_join(spark, sf_dir):
    d = src.documents(spark, sf_dir).withColumn("filename", F.col("file_id"))
    meta = d.where("language <> 'fr'").select("filename", "repo")  # the metadata lacks a language
    return src.with_repo(d.select("file_id", "filename"), meta).select("file_id", "repo")


@query(f"WITH {_META} SELECT coalesce(m.repo, 'unknown') AS repo, count(*) AS n FROM documents d LEFT JOIN meta m ON d.doc_id = m.file_id GROUP BY ALL")
def unknown_repo(spark, sf_dir):
    return file_repo_left_join(spark, sf_dir).groupBy("repo").agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS} SELECT file_id, repo FROM corpus WHERE repo NOT IN ('src3', 'src11')")
def exclude_repos_anti(spark, sf_dir):
    gone = spark.createDataFrame([(r,) for r in EVAL_REPOS], "repo string")
    return src.exclude_repos(src.documents(spark, sf_dir), gone).select("file_id", "repo")


@query(f"WITH {CORPUS} SELECT file_id, repo FROM corpus ORDER BY file_id LIMIT 100")
def first_files(spark, sf_dir):
    return src.first_files(src.documents(spark, sf_dir).select("file_id", "repo"), 100)


@query(f"WITH {CORPUS} SELECT CASE WHEN repo IN ('src3', 'src11') THEN 'eval' ELSE 'train' END AS split, repo, count(*) AS n FROM corpus GROUP BY ALL")
def train_eval_split(spark, sf_dir):
    return prepare.split(src.documents(spark, sf_dir), EVAL_REPOS).groupBy("split", "repo").agg(F.count("*").alias("n"))


#: Stripped lines of eight characters and more, with their place.
SEGMENTS = f"""{CORPUS}, raw AS (
  SELECT file_id, repo, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos FROM corpus),
segments AS (SELECT * FROM (SELECT file_id, repo, pos, regexp_replace(line, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS segment FROM raw) WHERE length(segment) >= 8)"""


@query(f"WITH {SEGMENTS} SELECT file_id, repo, CAST(pos AS INTEGER) AS pos, segment FROM segments")
def safe_segments(spark, sf_dir):
    return segments.safe_segments(src.documents(spark, sf_dir))


@query(
    f"""WITH {SEGMENTS}, places AS (SELECT segment, unnest(range(0, length(segment))) AS i FROM segments)
SELECT sum(CASE WHEN i = 0 OR NOT regexp_matches(substr(segment, i, 1), '[A-Za-z0-9_]') THEN 1 ELSE 0 END)::BIGINT AS n_starts,
  sum(CASE WHEN i + 1 >= length(segment) OR NOT regexp_matches(substr(segment, i + 2, 1), '[A-Za-z0-9_]') THEN 1 ELSE 0 END)::BIGINT AS n_ends FROM places"""
)
def ngram_boundary_starts(spark, sf_dir):
    s = segments.safe_segments(src.documents(spark, sf_dir)).select("segment", F.explode(F.sequence(F.lit(0), F.length("segment") - 1)).alias("i"))
    return s.agg(F.sum(is_word_boundary_start(F.col("segment"), F.col("i")).cast("long")).alias("n_starts"), F.sum(is_word_boundary_end(F.col("segment"), F.col("i") + 1).cast("long")).alias("n_ends"))


# Ranges for the interval operators: every capitalised word and the three characters behind it.
_RANGES = f"""{CORPUS}, words AS (
  SELECT file_id, length(content) AS total, unnest(string_split(content, ' ')) AS w, generate_subscripts(string_split(content, ' '), 1) AS k FROM corpus),
placed AS (SELECT *, sum(length(w) + 1) OVER (PARTITION BY file_id ORDER BY k) - length(w) - 1 AS start FROM words),
unsafe AS (SELECT file_id, start, least(start + length(w) + 3, total) AS stop FROM placed WHERE regexp_matches(w, '^[A-Z]')),
marks AS (SELECT file_id, start, stop FROM unsafe UNION ALL SELECT file_id, length(content), length(content) FROM corpus),
gaps AS (SELECT *, coalesce(max(stop) OVER (PARTITION BY file_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM marks),
safe AS (SELECT file_id, CAST(seen AS INTEGER) AS start, CAST(start AS INTEGER) AS stop FROM gaps WHERE start > seen)"""


def _unsafe_rows(spark, sf_dir):
    """file_id, start, end, and the files with their total."""
    d = src.documents(spark, sf_dir).select("file_id", "content", F.length("content").alias("total"))
    words = d.select("file_id", "total", F.posexplode(F.split("content", " ")).alias("k", "w"))
    order = Window.partitionBy("file_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("start", F.coalesce(F.sum(F.length("w") + 1).over(order), F.lit(0)).cast("int"))
    rows = placed.where(F.col("w").rlike("^[A-Z]")).select("file_id", "start", F.least(F.col("start") + F.length("w") + 3, F.col("total")).alias("end"))
    return rows, d.select("file_id", "total")


def _unsafe(spark, sf_dir):
    """file_id, total, unsafe: the ranges as one array for each file."""
    rows, totals = _unsafe_rows(spark, sf_dir)
    arrays = rows.groupBy("file_id").agg(F.collect_list(F.struct("start", "end")).alias("unsafe"))
    return totals.join(arrays, "file_id", "left").select("file_id", "total", F.coalesce("unsafe", F.array().cast("array<struct<start:int,end:int>>")).alias("unsafe"))


@query(f"WITH {_RANGES} SELECT file_id, start, stop FROM safe")
def invert_ranges(spark, sf_dir):
    out = segments.invert_range_rows(*_unsafe_rows(spark, sf_dir))
    return out.select("file_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("stop"))


@query(f"WITH {_RANGES} SELECT c.file_id, CAST(coalesce(sum(s.stop - s.start), 0) AS INTEGER) AS safe_chars, count(s.start) AS n_ranges, CASE WHEN length(c.content) > 0 THEN 100.0::DOUBLE * coalesce(sum(s.stop - s.start), 0) / length(c.content) ELSE 0 END AS safe_pct FROM corpus c LEFT JOIN safe s ON c.file_id = s.file_id GROUP BY c.file_id, length(c.content)")
def safe_range_stats(spark, sf_dir):
    rows = _unsafe(spark, sf_dir).withColumn("safe", segments.invert_ranges(F.col("unsafe"), F.col("total")))
    out = rows.withColumn("s", segments.range_stats(F.col("safe"), F.col("total")))
    return out.select("file_id", F.col("s.safe_bytes").alias("safe_chars"), F.size("safe").cast("long").alias("n_ranges"), F.col("s.safe_pct").alias("safe_pct"))


@query(f"WITH {_RANGES} SELECT c.file_id, max(CASE WHEN 50 >= s.start AND 50 < s.stop THEN 1 ELSE 0 END) = 1 AS is_safe FROM corpus c JOIN safe s ON c.file_id = s.file_id GROUP BY ALL")
def in_safe_range(spark, sf_dir):
    rows = _unsafe(spark, sf_dir).withColumn("safe", segments.invert_ranges(F.col("unsafe"), F.col("total"))).where(F.size("safe") > 0)
    return rows.select("file_id", segments.is_in_range(F.col("safe"), F.lit(50)).alias("is_safe"))

"""Queries that compress, score, report and prepare, with a small fixed dictionary."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessellon.functions.text import contains_macros, list_macros
from tessellon.operators import codec, prepare, reports, scoring
from tessellon.plans.corpus import CORPUS, EVAL_REPOS
from tessellon.plans.mining import TOKENS
from tessellon.session import shared_dir
from tessellon.sources.corpus import documents, load_scores, save_scores
from tessellon.streaming import prepare as stream

QUERIES: dict = {}
ORACLES: dict = {}

#: One class that Python, Java and RE2 read alike.
IDENT = r"[A-Za-z_][A-Za-z0-9_]*"
#: kind, number, content, slots, category; patterns and templates by length, longest first.
ENTRIES = [
    ("M", 1, "Released under the MIT License.", 0, "license"),
    ("M", 2, " and the ", 0, "phrase"),
    ("M", 3, " in the ", 0, "phrase"),
    ("M", 4, " of the ", 0, "phrase"),
    ("M", 5, "ation", 0, "ending"),
    ("M", 6, "never found here", 0, "none"),
    ("T", 1, "of {0} and {1}", 2, "template"),
    ("T", 2, "the {0} is", 1, "template"),
]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _macro(kind: str, n: int) -> str:
    return f"<|{kind}{n:05d}|>"


def _dictionary(spark):
    rows = [(k, n, c, _macro(k, n), s, cat) for k, n, c, s, cat in ENTRIES]
    return spark.createDataFrame(rows, "kind string, ord int, content string, macro string, slots int, category string")


def _compressed(spark, sf_dir):
    """file_id, repo, content, compressed."""
    d = documents(spark, sf_dir)
    return d.select("file_id", "repo", "content", codec.compressor(_dictionary(spark), IDENT)("content").alias("compressed"))


def _exact_sql() -> str:
    out = "content"
    for k, n, c, _, _ in ENTRIES:
        if k == "M":
            out = f"replace({out}, '{c}', '{_macro(k, n)}')"
    return out


def _sql() -> str:
    return (
        f"regexp_replace(regexp_replace({_exact_sql()}, 'of ({IDENT}) and ({IDENT})', '<|T00001:\\1,\\2|>', 'g'),"
        f" 'the ({IDENT}) is', '<|T00002:\\1|>', 'g')"
    )


_DICT = "dictionary(kind, ord, content, macro, slots, category) AS (VALUES " + ", ".join(f"('{k}', {n}, '{c}', '{_macro(k, n)}', {s}, '{cat}')" for k, n, c, s, cat in ENTRIES) + ")"
_COMP = f"{CORPUS}, {_DICT}, comp AS (SELECT file_id, repo, content, {_sql()} AS compressed FROM corpus)"
_MACRO = r"<\|[MT]\d+(?::[^|]*)?\|>"
_USES = rf"""{_COMP}, uses AS (SELECT file_id, repo, unnest(regexp_extract_all(compressed, '{_MACRO}')) AS used FROM comp),
parsed AS (SELECT file_id, repo, '<|' || regexp_extract(used, '^<\|([MT]\d+)', 1) || '|>' AS macro, string_split(regexp_extract(used, '^<\|T\d+:([^|]*)\|>$', 1), ',') AS args FROM uses),
saved AS (
  SELECT p.*, d.kind, d.content, CASE WHEN d.kind = 'M' THEN {TOKENS.format("d.content")} - 1
    ELSE {TOKENS.format("replace(replace(d.content, '{0}', args[1]), '{1}', coalesce(args[2], ''))")} - 2 - {TOKENS.format("array_to_string(args, ',')")} END AS saved
  FROM parsed p JOIN dictionary d ON p.macro = d.macro)"""
_SCORES = f"""{_USES}, files AS (SELECT repo, count(*) AS repo_files FROM corpus GROUP BY 1),
per_repo AS (SELECT macro, repo, sum(saved) AS saved, count(DISTINCT file_id) AS files FROM saved WHERE saved > 0 GROUP BY ALL),
raw_scores AS (
  SELECT macro, sum(saved / repo_files::DOUBLE) AS score, CAST(sum(files) AS BIGINT) AS file_count, count(*) AS repo_count
  FROM per_repo JOIN files USING (repo) GROUP BY 1),
scores AS (SELECT d.macro, d.kind, d.content, d.category, d.slots, s.score, s.file_count, s.repo_count FROM raw_scores s JOIN dictionary d USING (macro))"""


@query(f"WITH {CORPUS} SELECT file_id, md5({_exact_sql()}) AS digest FROM corpus")
def compress_exact(spark, sf_dir):
    native = codec.compress_native(F.col("content"), [(c, _macro(k, n)) for k, n, c, _, _ in ENTRIES if k == "M"])
    return documents(spark, sf_dir).select("file_id", F.md5(native.cast("binary")).alias("digest"))


@query(f"WITH {_COMP} SELECT file_id, md5(compressed) AS digest, length(compressed)::INTEGER AS n_chars FROM comp")
def compress_templates(spark, sf_dir):
    return _compressed(spark, sf_dir).select("file_id", F.md5(F.col("compressed").cast("binary")).alias("digest"), F.length("compressed").alias("n_chars"))


@query(f"WITH {_COMP} SELECT file_id, md5(compressed) AS digest FROM comp")
def compress_templates_native(spark, sf_dir):
    pairs = {k: [(c, _macro(x, n)) for x, n, c, _, _ in ENTRIES if x == k] for k in "MT"}
    native = codec.compress_native(F.col("content"), pairs["M"], [(c, m) for c, m in pairs["T"]])
    return documents(spark, sf_dir).select("file_id", F.md5(native.cast("binary")).alias("digest"))


@query(f"WITH {CORPUS} SELECT file_id, TRUE AS same FROM corpus")
def roundtrip_check(spark, sf_dir):
    expand = codec.decompressor(_dictionary(spark))
    return _compressed(spark, sf_dir).select("file_id", (expand("compressed") == F.col("content")).alias("same"))


@query(f"WITH {_USES} SELECT macro, count(*) AS n, count(DISTINCT file_id) AS n_files FROM parsed GROUP BY 1")
def macro_uses(spark, sf_dir):
    return scoring.occurrences(_compressed(spark, sf_dir)).groupBy("macro").agg(F.count("*").alias("n"), F.count_distinct("file_id").alias("n_files"))


@query(f"WITH {_COMP} SELECT file_id, regexp_matches(compressed, '{_MACRO}') AS has_macros, array_to_string(regexp_extract_all(compressed, '{_MACRO}'), ' ') AS macros FROM comp")
def list_macros_query(spark, sf_dir):
    return _compressed(spark, sf_dir).select("file_id", contains_macros(F.col("compressed")).alias("has_macros"), F.array_join(list_macros(F.col("compressed")), " ").alias("macros"))


QUERIES["list_macros"], ORACLES["list_macros"] = QUERIES.pop("list_macros_query"), ORACLES.pop("list_macros_query")

_PATTERNS = [c for k, _, c, _, _ in ENTRIES if k == "M"]


@query(
    f"WITH {_COMP} SELECT file_id, length(content)::INTEGER AS original_chars, length(compressed)::INTEGER AS compressed_chars, (length(content) - length(compressed))::INTEGER AS saved_chars, "
    + " + ".join(f"(length(content) - length(replace(content, '{p}', ''))) // {len(p)}" for p in _PATTERNS)
    + " AS n_matches FROM comp"
)
def compression_stats(spark, sf_dir):
    rows = _compressed(spark, sf_dir).withColumn("s", codec.compression_stats(F.col("content"), F.col("compressed"))).withColumn("m", codec.pattern_counts(F.col("content"), _PATTERNS))
    n = F.aggregate(F.map_values("m"), F.lit(0), lambda a, x: a + x).cast("long")
    return rows.select("file_id", "s.original_chars", "s.compressed_chars", "s.saved_chars", n.alias("n_matches"))


@query(f"WITH {_USES} SELECT macro, kind, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(CASE WHEN saved > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM saved GROUP BY ALL")
def macro_savings(spark, sf_dir):
    used = scoring.savings(scoring.occurrences(_compressed(spark, sf_dir)), _dictionary(spark))
    return used.groupBy("macro", "kind").agg(F.sum("saved").cast("long").alias("saved"), F.sum((F.col("saved") > 0).cast("long")).alias("n_positive"))


def _scores(spark, sf_dir):
    return scoring.score_macros(_compressed(spark, sf_dir), _dictionary(spark))


@query(f"WITH {_SCORES} SELECT macro, kind, content, category, slots, round(score, 6) AS score, file_count, repo_count FROM scores")
def macro_scores(spark, sf_dir):
    return _scores(spark, sf_dir).withColumn("score", F.round("score", 6))


_RANKED = f"""{_SCORES}, kept AS (
  SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, content) AS place FROM scores WHERE file_count >= 50 AND repo_count >= 2),
rebuilt AS (SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY place) AS INTEGER) AS ord, content, slots, category FROM kept WHERE place <= 4)"""
_REBUILT = f"WITH {_RANKED} SELECT kind, ord, content, '<|' || kind || lpad(CAST(ord AS VARCHAR), 5, '0') || '|>' AS macro, slots, category FROM rebuilt"


@query(_REBUILT)
def rebuild_top_n(spark, sf_dir):
    return scoring.rebuild_top_n(_scores(spark, sf_dir), 50, 2, 4)


@query(_REBUILT)
def refilter(spark, sf_dir):
    """From the stored sidecar, without mining again."""
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    save_scores(_scores(spark, sf_dir), path)
    return scoring.refilter(load_scores(spark, path), 50, 4, 2)


@query(
    f"""WITH {_SCORES}, placed AS (SELECT *, row_number() OVER (PARTITION BY file_count >= 50 AND repo_count >= 2 ORDER BY round(score, 9) DESC, content) AS place FROM scores)
SELECT CASE WHEN file_count < 50 THEN 'files' WHEN repo_count < 2 THEN 'repos' WHEN place > 4 THEN 'entries' ELSE 'kept' END AS reason, count(*) AS n FROM placed GROUP BY 1"""
)
def drop_counts(spark, sf_dir):
    return scoring.drop_counts(_scores(spark, sf_dir), 50, 2, 4)


_TABLE = f"""{_SCORES}, marks(threshold) AS (VALUES {", ".join(f"({t})" for t in scoring.FILE_THRESHOLDS)}),
tab AS (
  SELECT threshold, CAST(sum(CASE WHEN file_count >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS n, sum(CASE WHEN file_count >= threshold THEN score ELSE 0 END) AS impact, sum(score) AS total
  FROM scores, marks WHERE score > 0 GROUP BY 1)"""


@query(f"WITH {_TABLE} SELECT threshold, n, round(impact, 6) AS impact, round(impact / total, 6) AS pct FROM tab")
def min_files_table(spark, sf_dir):
    return scoring.threshold_table(_scores(spark, sf_dir)).withColumn("impact", F.round("impact", 6)).withColumn("pct", F.round("pct", 6))


@query(f"WITH {_TABLE} SELECT coalesce(max(threshold), 0) AS min_files FROM tab WHERE impact / total >= 0.9")
def auto_min_files(spark, sf_dir):
    return scoring.auto_min_files(_scores(spark, sf_dir))


@query(f"WITH {_TABLE} SELECT threshold AS min_files, n AS surviving, round(impact / total, 6) AS retained FROM tab WHERE impact / total >= 0.9 ORDER BY threshold DESC LIMIT 1")
def auto_stats(spark, sf_dir):
    return scoring.auto_stats(_scores(spark, sf_dir)).withColumn("retained", F.round("retained", 6))


@query(
    f"WITH {_SCORES} SELECT CASE "
    + " ".join(f"WHEN file_count >= {lo}{'' if hi is None else f' AND file_count <= {hi}'} THEN '{f'{lo}+' if hi is None else lo if lo == hi else f'{lo}-{hi}'}'" for lo, hi in scoring.FILE_BUCKETS)
    + " END AS bucket, count(*) AS n FROM scores GROUP BY 1"
)
def file_buckets(spark, sf_dir):
    return scoring.file_buckets(_scores(spark, sf_dir))


_SPREAD = f"{_USES}, spread AS (SELECT d.macro, d.content, count(DISTINCT p.repo) AS repo_count FROM dictionary d LEFT JOIN parsed p ON d.macro = p.macro GROUP BY ALL)"


def _spread(spark, sf_dir):
    return reports.macro_repos(_compressed(spark, sf_dir), _dictionary(spark))


@query(f"WITH {_SPREAD} SELECT repo_count, count(*) AS n FROM spread GROUP BY 1")
def repo_histogram(spark, sf_dir):
    return reports.repo_histogram(_spread(spark, sf_dir))


@query(
    f"""WITH {_SPREAD}, marks(threshold) AS (VALUES {", ".join(f"({t})" for t in scoring.REPO_THRESHOLDS)})
SELECT threshold, CAST(sum(CASE WHEN repo_count >= threshold THEN 1 ELSE 0 END) AS BIGINT) AS surviving, CAST(sum(CASE WHEN repo_count >= threshold THEN 0 ELSE 1 END) AS BIGINT) AS killed,
  100.0::DOUBLE * sum(CASE WHEN repo_count >= threshold THEN 1 ELSE 0 END) / count(*) AS pct FROM spread, marks GROUP BY 1"""
)
def repo_threshold_table(spark, sf_dir):
    return reports.repo_threshold_table(_spread(spark, sf_dir))


@query(f"WITH {_SPREAD} SELECT repo_count, macro, content FROM spread WHERE repo_count IN (0, 1, 2, 3, 20)")
def repo_detail(spark, sf_dir):
    return reports.repo_detail(_spread(spark, sf_dir), (0, 1, 2, 3, 20))


@query(
    f"""WITH {_USES}, sample AS (SELECT file_id, content FROM corpus),
used AS (SELECT * FROM saved WHERE file_id IN (SELECT file_id FROM sample) AND (kind = 'M' OR saved > 0)),
base AS (SELECT count(*) AS n_files, CAST(sum({TOKENS.format("content")}) AS BIGINT) AS original_tokens FROM sample),
t AS (
  SELECT CAST(coalesce(sum(CASE WHEN kind = 'M' THEN saved END), 0) AS BIGINT) AS exact_saved, CAST(coalesce(sum(CASE WHEN kind = 'T' THEN saved END), 0) AS BIGINT) AS template_saved, count(*) AS n_macros FROM used)
SELECT n_files, original_tokens, exact_saved, template_saved, n_macros, exact_saved + template_saved AS saved, (exact_saved + template_saved) / original_tokens::DOUBLE AS ratio, n_macros / n_files::DOUBLE AS macros_per_file FROM base, t"""
)
def measure_compression(spark, sf_dir):
    """Over every file; the command line takes a sample, and ``sample_files`` is that sample."""
    return reports.measure(_compressed(spark, sf_dir), _dictionary(spark))


_HASH = "CAST('0x' || substr(md5(CAST({} AS VARCHAR) || '42'), 1, 8) AS BIGINT) < {}"
_MIX = f"""{_COMP}, marked AS (SELECT *, CASE WHEN repo IN ('src3', 'src11') THEN 'eval' ELSE 'train' END AS split FROM comp),
mixed AS (SELECT *, split = 'eval' OR {_HASH.format("file_id", int(0.75 * 2**32))} AS is_compressed FROM marked)"""


def _mixed(spark, sf_dir):
    return prepare.mix(_compressed(spark, sf_dir), EVAL_REPOS)


@query(f"WITH {_MIX} SELECT file_id, repo, split, is_compressed, md5(CASE WHEN is_compressed THEN compressed ELSE content END) AS digest FROM mixed")
def prepare_mix(spark, sf_dir):
    return _mixed(spark, sf_dir).select("file_id", "repo", "split", "is_compressed", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    f"""WITH {_MIX} SELECT {len(ENTRIES)} AS dictionary_size, 0.75::DOUBLE AS compress_ratio, 42 AS seed, 'repo_balanced' AS split_method, FALSE AS eval_only, 'src3,src11' AS eval_repos, 0::BIGINT AS errors, CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_files,
  CAST(sum(CASE WHEN split = 'train' AND is_compressed THEN 1 ELSE 0 END) AS BIGINT) AS train_compressed, CAST(sum(CASE WHEN split = 'train' AND NOT is_compressed THEN 1 ELSE 0 END) AS BIGINT) AS train_original,
  CAST(sum(CASE WHEN split = 'eval' THEN 1 ELSE 0 END) AS BIGINT) AS eval_files, round((1 - sum(length(CASE WHEN is_compressed THEN compressed ELSE content END)) / sum(length(content))::DOUBLE) * 100, 6) AS char_reduction_pct FROM mixed"""
)
def prepare_meta(spark, sf_dir):
    row = prepare.meta(_mixed(spark, sf_dir), len(ENTRIES), eval_repos=EVAL_REPOS)
    return row.withColumn("char_reduction_pct", F.round("char_reduction_pct", 6)).withColumn("eval_repos", F.array_join("eval_repos", ","))


@query(f"WITH {_MIX} SELECT CAST(sum(CASE WHEN split = 'eval' THEN 1 ELSE 0 END) AS BIGINT) AS eval_files, TRUE AS eval_only, count(*) FILTER (split = 'eval' AND NOT is_compressed) AS n_plain FROM mixed")
def prepare_eval_only(spark, sf_dir):
    """The run that writes the evaluation split alone: none of it is plain, and nothing is said of train."""
    rows = prepare.mix(_compressed(spark, sf_dir), EVAL_REPOS, eval_only=True)
    return prepare.meta(rows, len(ENTRIES), eval_repos=EVAL_REPOS, eval_only=True).select("eval_files", "eval_only").join(rows.agg(F.sum((~F.col("is_compressed")).cast("long")).alias("n_plain")))


@query(
    f"""WITH {_COMP}, kept AS (SELECT *, {_HASH.format("file_id", int(0.75 * 2**32))} AS is_compressed FROM comp WHERE length(content) >= 50 AND repo NOT IN ('src3', 'src11'))
SELECT file_id AS record_id, repo AS repo_name, is_compressed, md5(CASE WHEN is_compressed THEN compressed ELSE content END) AS digest FROM kept"""
)
def stream_prepare(spark, sf_dir):
    """The batch form of the streaming preparation, every record that stays; ``stream_prepare_live`` runs
    the same steps on a stream."""
    return _prepared(spark, documents(spark, sf_dir).select(F.col("file_id").alias("record_id"), "content", F.col("repo").alias("repo_name")))


def _prepared(spark, records):
    gone = spark.createDataFrame([(r,) for r in EVAL_REPOS], "repo string")
    out = prepare.prepare_stream(records, gone, codec.compressor(_dictionary(spark), IDENT))
    return out.select("record_id", "repo_name", "is_compressed", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(ORACLES["stream_prepare"])
def stream_prepare_live(spark, sf_dir):
    """The same preparation as a stream: a file source, a Parquet sink that commits each batch once."""
    path = f"{sf_dir}/documents.parquet"
    d = stream.read_records(spark, f"{path}*", spark.read.parquet(path).schema)
    d = d.select(F.col("doc_id").alias("record_id"), F.coalesce("text", F.lit("")).alias("content"), F.coalesce("source", F.lit("unknown")).alias("repo_name"))
    return stream.to_table(_prepared(spark, d), "prepared")


@query(
    """SELECT strftime(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total
FROM events WHERE ts IS NOT NULL GROUP BY ALL"""
)
def stream_windowed_counts(spark, sf_dir):
    """Tumbling counts of ``events`` by a stream whose state holds every window."""
    path = f"{sf_dir}/events.parquet"
    live = stream.windowed_counts(stream.read_records(spark, f"{path}*", spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp")))
    rows = stream.complete(live, "windows")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query(f"WITH {CORPUS} SELECT file_id, md5(content) AS digest FROM corpus WHERE repo IN ('src3', 'src11')")
def decompressed_eval(spark, sf_dir):
    rows = _mixed(spark, sf_dir).where("split = 'eval'")
    return prepare.decompressed_eval(rows, codec.decompressor(_dictionary(spark))).select("file_id", F.md5(F.col("plain").cast("binary")).alias("digest"))

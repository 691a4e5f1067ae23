"""Queries that mine: regular-expression candidates, n-grams, merging, dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellon.functions.text import TOKEN, is_valid_ngram, is_valid_pattern
from tessellon.operators import candidates, dictionary, ngrams
from tessellon.operators.frequent import frequent_patterns
from tessellon.plans.corpus import CORPUS, SEGMENTS
from tessellon.sources.corpus import documents

QUERIES: dict = {}
ORACLES: dict = {}

#: Expressions for prose that Java and RE2 read alike.
REGEXES = (r"[A-Za-z]+ (?:the|of|and) [a-z]+", r"[A-Z][a-z]+ [a-z]+ [a-z]+", r"(?:Released|All rights|Licensed)[^\n]*")
SEEDS = [(" of the ", "phrase"), (" and the ", "phrase"), ("Released under the MIT License.", "license"), (" in the ", "phrase"), ("ation", "ending")]


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


TOKENS = f"len(regexp_extract_all({{}}, '{TOKEN}'))"
_WORD = r"^[\p{L}\p{M}\p{N}_]+$"
_VALID = f"NOT regexp_matches(pattern, '[\\r\\n]') AND length(pattern) >= 8 AND regexp_matches(pattern, '\\S') AND NOT regexp_matches(pattern, '{_WORD}')"
_VALID_NGRAM = f"{_VALID} AND length(pattern) - length(translate(pattern, ' ' || chr(9), '')) <= 0.5 * length(pattern)"

_GRAMS = f"""{SEGMENTS}, places AS (SELECT file_id, repo, segment, unnest(range(0, length(segment) - 7)) AS i FROM segments),
starts AS (SELECT * FROM places WHERE i = 0 OR NOT regexp_matches(substr(segment, i, 1), '[A-Za-z0-9_]')),
census AS (SELECT substr(segment, i + 1, 8) AS gram, count(DISTINCT file_id) AS frequency FROM starts GROUP BY 1)"""


@query(f"WITH {_GRAMS} SELECT gram, frequency FROM census WHERE frequency >= 15")
def ngram_pass1(spark, sf_dir):
    return ngrams.pass1(documents(spark, sf_dir))


@query(f"WITH {_GRAMS} SELECT gram, frequency FROM census WHERE frequency >= 50")
def ngram_pass1_native(spark, sf_dir):
    return ngrams.pass1_native(documents(spark, sf_dir), 50)


_COUNTED = f"""{_GRAMS}, extended AS (
  SELECT file_id, repo, segment, i, unnest(range(8, least(120, length(segment) - i) + 1)) AS n FROM starts
  WHERE substr(segment, i + 1, 8) IN (SELECT gram FROM census WHERE frequency >= 50)),
counted AS (
  SELECT substr(segment, i + 1, n) AS pattern, count(DISTINCT file_id) AS frequency, count(DISTINCT repo) AS repo_count FROM extended
  WHERE i + n = length(segment) OR NOT regexp_matches(substr(segment, i + n + 1, 1), '[A-Za-z0-9_]') GROUP BY 1)"""


@query(f"WITH {_COUNTED} SELECT * FROM counted WHERE frequency >= 50")
def ngram_pass2(spark, sf_dir):
    return frequent_patterns(documents(spark, sf_dir), 50, ngrams.MAX_PATTERN_LENGTH)


_SCORED = "SELECT pattern, frequency, token_count, frequency * (token_count - 1) AS score, repo_count FROM (SELECT *, CAST({tokens} AS INTEGER) AS token_count FROM {rows} WHERE frequency >= {f} AND repo_count >= 2 AND {valid}) WHERE token_count >= 3"
_NGRAMS = _SCORED.format(tokens=TOKENS.format("pattern"), rows="counted", f=50, valid=_VALID_NGRAM)


@query(f"WITH {_COUNTED} {_NGRAMS} ORDER BY score DESC, pattern LIMIT 1000")
def ngram_scored(spark, sf_dir):
    return ngrams.mine_ngrams(documents(spark, sf_dir))


@query(
    f"""WITH {_COUNTED} SELECT CASE WHEN NOT ({_VALID_NGRAM}) THEN 'invalid' WHEN repo_count < 2 THEN 'repos'
  WHEN {TOKENS.format("pattern")} < 3 THEN 'tokens' ELSE 'kept' END AS reason, count(*) AS n FROM counted WHERE frequency >= 50 GROUP BY 1"""
)
def ngram_rejections(spark, sf_dir):
    return candidates.rejection_counts(frequent_patterns(documents(spark, sf_dir), 50, ngrams.MAX_PATTERN_LENGTH), valid=is_valid_ngram(F.col("pattern")))


_FOUND = " UNION ALL ".join(f"SELECT file_id, repo, unnest(regexp_extract_all(content, '{r}')) AS raw FROM corpus" for r in REGEXES)
_REGEX = f"""{CORPUS}, found AS ({_FOUND}),
stripped AS (SELECT DISTINCT file_id, repo, regexp_replace(raw, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g') AS pattern FROM found),
mined AS (SELECT pattern, count(*) AS frequency, count(DISTINCT repo) AS repo_count FROM stripped WHERE {_VALID} GROUP BY 1)"""


@query(f"WITH {_REGEX} SELECT pattern, frequency, repo_count FROM mined")
def regex_candidates(spark, sf_dir):
    return candidates.regex_candidates(documents(spark, sf_dir), REGEXES)


_MINED = _SCORED.format(tokens=TOKENS.format("pattern"), rows="mined", f=3, valid="TRUE")


@query(f"WITH {_REGEX} {_MINED} ORDER BY score DESC, pattern LIMIT 1000")
def mine_patterns(spark, sf_dir):
    return candidates.mine_patterns(documents(spark, sf_dir), REGEXES, min_frequency=3)


@query(
    f"""WITH {_REGEX} SELECT CASE WHEN frequency < 3 THEN 'frequency' WHEN repo_count < 2 THEN 'repos'
  WHEN {TOKENS.format("pattern")} < 3 THEN 'tokens' ELSE 'kept' END AS reason, count(*) AS n FROM mined GROUP BY 1"""
)
def mine_rejections(spark, sf_dir):
    return candidates.rejection_counts(candidates.regex_candidates(documents(spark, sf_dir), REGEXES), 3, 2, 3)


_BOTH = f"{_REGEX}, {_COUNTED[_COUNTED.index('raw AS ('):]}, a AS ({_MINED}), b AS ({_NGRAMS})".replace("found AS (", "found AS (", 1)
_MERGED = """SELECT pattern, arg_max(frequency, frequency * 2 + c) AS frequency, arg_max(token_count, frequency * 2 + c) AS token_count,
  arg_max(score, frequency * 2 + c) AS score, max(repo_count) AS repo_count FROM (SELECT *, 0 AS c FROM a UNION ALL SELECT *, 1 AS c FROM b) GROUP BY pattern"""


def _merged(spark, sf_dir):
    d = documents(spark, sf_dir)
    regex = candidates.scored_candidates(d, REGEXES, 3)
    return candidates.merge_results(regex, ngrams.scored_ngrams(d))


@query(f"WITH {_BOTH} {_MERGED}")
def merge_mining_results(spark, sf_dir):
    return _merged(spark, sf_dir)


_SEED_ROWS = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(SEEDS))
_UNION = f"""{_BOTH}, merged AS ({_MERGED}), ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, pattern) AS rank FROM merged),
entries AS (
  SELECT 0 AS channel, i AS rank, p AS content, c AS category FROM (VALUES {_SEED_ROWS}) t(i, p, c)
  UNION ALL SELECT 1, rank, pattern, 'mined' FROM ranked WHERE rank <= 200),
firsts AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY content ORDER BY channel, rank) = 1),
dictionary AS (SELECT 'M' AS kind, CAST(row_number() OVER (ORDER BY channel, rank, content) AS INTEGER) AS ord, content, category FROM firsts)"""


def _dictionary(spark, sf_dir):
    seeds = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(SEEDS)], "rank int, content string, category string")
    d = documents(spark, sf_dir)
    best = ngrams.best_with(candidates.scored_candidates(d, REGEXES, 3), d, 200).select(F.col("pattern").alias("content"), (-F.col("score")).alias("rank"))
    return dictionary.candidate_union([(seeds, "M", "seed", None), (best, "M", "mined", 200)])


@query(f"WITH {_UNION} SELECT kind, ord, content, '<|M' || lpad(CAST(ord AS VARCHAR), 5, '0') || '|>' AS macro, 0 AS slots, category FROM dictionary")
def candidate_union(spark, sf_dir):
    return _dictionary(spark, sf_dir)


@query(f"WITH {_UNION} SELECT kind, category, count(*) AS n, avg(length(content)) AS mean_length FROM dictionary GROUP BY ALL")
def dictionary_stats(spark, sf_dir):
    return dictionary.stats(_dictionary(spark, sf_dir))


@query(f"SELECT 'M' AS kind, CAST(i + 1 AS INTEGER) AS ord, p AS content, '<|M' || lpad(CAST(i + 1 AS VARCHAR), 5, '0') || '|>' AS macro, 0 AS slots, c AS category FROM (VALUES {_SEED_ROWS}) t(i, p, c)")
def from_seed(spark, sf_dir):
    return dictionary.from_seed(spark, SEEDS)


_OTHER = [(" in the ", "other"), ("nothing else", "other"), ("a much longer pattern than that", "other"), ("zzz", "other")]
_OTHER_ROWS = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(_OTHER))
_MERGE = f"""all_rows AS (
  SELECT 0 AS d, i, p, c FROM (VALUES {_SEED_ROWS}) t(i, p, c) UNION ALL SELECT 1, i, p, c FROM (VALUES {_OTHER_ROWS}) t(i, p, c)),
firsts AS (SELECT * FROM all_rows QUALIFY row_number() OVER (PARTITION BY p ORDER BY d, i) = 1),
merged AS (SELECT 'M' AS kind, CAST(row_number() OVER (ORDER BY d, length(p) DESC, p) AS INTEGER) AS ord, p AS content, c AS category FROM firsts)"""


@query(f"WITH {_MERGE} SELECT kind, ord, content, '<|M' || lpad(CAST(ord AS VARCHAR), 5, '0') || '|>' AS macro, 0 AS slots, category FROM merged")
def merge_dictionaries(spark, sf_dir):
    return dictionary.merge(dictionary.from_seed(spark, SEEDS), dictionary.from_seed(spark, _OTHER))


@query(f"WITH {_MERGE} SELECT CAST(pos AS INTEGER) AS pos, token FROM (SELECT row_number() OVER (ORDER BY part, token) - 1 AS pos, token FROM (SELECT 0 AS part, '<|M' || lpad(CAST(ord AS VARCHAR), 5, '0') || '|>' AS token FROM merged UNION ALL SELECT 2, '|>'))")
def token_list(spark, sf_dir):
    return dictionary.token_list(merge_dictionaries(spark, sf_dir))


@query("SELECT doc_id AS file_id, CAST(" + TOKENS.format("coalesce(text, '')") + " AS INTEGER) AS n_tokens FROM documents")
def token_counts(spark, sf_dir):
    from tessellon.functions.text import token_count

    return documents(spark, sf_dir).select("file_id", token_count(F.col("content")).alias("n_tokens"))


@query(
    f"WITH {SEGMENTS}, t AS (SELECT DISTINCT segment AS pattern FROM segments) SELECT count(*) AS n, sum(CASE WHEN {_VALID} THEN 1 ELSE 0 END)::BIGINT AS n_valid, sum(CASE WHEN {_VALID_NGRAM} THEN 1 ELSE 0 END)::BIGINT AS n_valid_ngram FROM t"
)
def pattern_validity(spark, sf_dir):
    from tessellon.operators.segments import safe_segments

    t = safe_segments(documents(spark, sf_dir)).select(F.col("segment").alias("pattern")).distinct()
    return t.agg(F.count("*").alias("n"), F.sum(is_valid_pattern(F.col("pattern")).cast("long")).alias("n_valid"), F.sum(is_valid_ngram(F.col("pattern")).cast("long")).alias("n_valid_ngram"))

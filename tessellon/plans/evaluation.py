"""Queries that evaluate: similarity metrics, summaries, perplexity, token spans, contexts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellon.functions import metrics, tokens
from tessellon.functions.text import TOKEN
from tessellon.operators import context, dictionary
from tessellon.plans import scoring
from tessellon.plans.corpus import CORPUS
from tessellon.sources.corpus import documents

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: Pairs to compare: a message and the one before it in its conversation.
_PAIRS = """pairs AS (
  SELECT * FROM (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS reference, coalesce(text, '') AS hypothesis FROM conversations))"""


def _pairs(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.coalesce(before, F.lit("")).alias("reference"), F.coalesce("text", F.lit("")).alias("hypothesis"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn, CASE WHEN reference = hypothesis THEN 1.0::DOUBLE ELSE 0 END AS exact_match FROM pairs")
def exact_match(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", metrics.exact_match(F.col("reference"), F.col("hypothesis")).alias("exact_match"))


#: The SQL engine counts edits in bytes, so each character beyond ASCII becomes a control character of its own. There are 28 for
#: them, which the tables' few kinds of letters do not exhaust.
_ONE_BYTE = """kinds AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE unicode(c) > 127),
marks AS (SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS wide, (SELECT string_agg(chr(i::INTEGER), '' ORDER BY i) FROM range(1, 32) t(i) WHERE i NOT IN (9, 10, 13)) AS narrow FROM kinds),
plain AS (SELECT conv_id, turn, translate(reference, wide, narrow) AS a, translate(hypothesis, wide, narrow) AS b FROM pairs, marks)"""


@query(f"WITH {_PAIRS}, {_ONE_BYTE} SELECT conv_id, turn, CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0::DOUBLE ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE, 9) END AS edit_similarity FROM plain")
def edit_similarity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.edit_similarity(F.col("reference"), F.col("hypothesis")), 9).alias("edit_similarity"))


def _gram_sql(items: str, n_most: int) -> str:
    """Clipped counts and sizes by n, from token lists r and h."""
    return f"""items AS (SELECT conv_id, turn, {items.format("reference")} AS r, {items.format("hypothesis")} AS h FROM pairs),
ns AS (SELECT unnest(range(1, {n_most + 1})) AS n),
rg AS (SELECT conv_id, turn, n, array_to_string(list_slice(r, i, i + n - 1), chr(31)) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, len(r) - n + 2)) AS i FROM items, ns) GROUP BY ALL),
hg AS (SELECT conv_id, turn, n, array_to_string(list_slice(h, i, i + n - 1), chr(31)) AS g, count(*) AS c FROM (SELECT *, unnest(range(1, len(h) - n + 2)) AS i FROM items, ns) GROUP BY ALL),
hit AS (SELECT conv_id, turn, n, sum(least(rg.c, hg.c)) AS clipped FROM rg JOIN hg USING (conv_id, turn, n, g) GROUP BY ALL),
counts AS (
  SELECT i.conv_id, i.turn, ns.n, len(r) AS nr, len(h) AS nh, greatest(len(r) - ns.n + 1, 0) AS tr, greatest(len(h) - ns.n + 1, 0) AS th, coalesce(clipped, 0) AS clipped
  FROM items i CROSS JOIN ns LEFT JOIN hit ON hit.conv_id = i.conv_id AND hit.turn = i.turn AND hit.n = ns.n)"""


_WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(
    f"""WITH {_PAIRS}, {_gram_sql(_WORDS, 4)},
p AS (SELECT *, CASE WHEN th = 0 THEN 0 WHEN n = 1 THEN clipped / th::DOUBLE ELSE (clipped + 1) / (th + 1)::DOUBLE END AS prec FROM counts)
SELECT conv_id, turn, round(CASE WHEN max(nr) = 0 OR max(nh) = 0 OR min(prec) = 0 THEN 0.0::DOUBLE
  ELSE least(1.0, exp(1 - max(nr) / max(nh)::DOUBLE)) * exp(sum(CASE WHEN prec > 0 THEN ln(prec) / 4 ELSE 0 END)) END, 9) AS bleu4 FROM p GROUP BY ALL"""
)
def bleu4(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.bleu4_udf("reference", "hypothesis"), 9).alias("bleu4"))


@query(ORACLES["bleu4"])
def bleu4_native(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.bleu4(F.col("reference"), F.col("hypothesis")), 9).alias("bleu4"))


_CHARS = "list_filter(string_split({}, ''), lambda x: x <> '')"


@query(
    f"""WITH {_PAIRS}, {_gram_sql(_CHARS, 6)},
f AS (SELECT *, CASE WHEN tr > 0 AND th > 0 THEN 2.0::DOUBLE * clipped / (tr + th) END AS f FROM counts)
SELECT conv_id, turn, round(CASE WHEN max(nr) = 0 AND max(nh) = 0 THEN 1.0::DOUBLE ELSE coalesce(avg(f), 0.0) END, 9) AS chrf FROM f GROUP BY ALL"""
)
def chrf(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(metrics.chrf_udf("reference", "hypothesis"), 9).alias("chrf"))


_MEASURES = f"{CORPUS}, m AS (SELECT repo, language, unnest([{{'metric': 'chars', 'value': length(content)::DOUBLE}}, {{'metric': 'lines', 'value': len(string_split(content, chr(10)))::DOUBLE}}], recursive := true) FROM corpus)"


@query(
    f"WITH {_MEASURES} SELECT metric, round(avg(value), 6) AS mean, median(value) AS median, round(coalesce(stddev_samp(value), 0), 6) AS stdev, count(*) AS n FROM m GROUP BY 1"
)
def metric_summary(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.length("content").alias("chars"), F.size(F.split("content", "\n")).alias("lines"))
    return metrics.metric_summary(d, ["chars", "lines"]).withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


_LOSS = f"""{CORPUS}, losses AS (
  SELECT repo, CASE language WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' WHEN 'de' THEN 'C' ELSE 'D' END AS config,
    CASE WHEN length(content) < 40 THEN NULL ELSE 1.0::DOUBLE + ln(length(content)) / 10 END AS loss, len(regexp_extract_all(content, '{TOKEN}')) AS n_tokens FROM corpus)"""
_PPL = "round(exp(sum(CASE WHEN n_tokens >= 2 THEN loss * (n_tokens - 1) END) / sum(CASE WHEN n_tokens >= 2 AND loss IS NOT NULL THEN n_tokens - 1 END)), 6)"


def _losses(spark, sf_dir):
    """A stand-in for a model's loss: a function of length, missing for short texts."""
    d = documents(spark, sf_dir)
    config = F.when(F.col("language") == "en", "A").when(F.col("language") == "fr", "B").when(F.col("language") == "de", "C").otherwise("D")
    loss = F.when(F.length("content") >= 40, 1.0 + F.ln(F.length("content").cast("double")) / 10)
    return d.select("repo", config.alias("config"), loss.alias("loss"), F.size(tokens.tokens(F.col("content"))).alias("n_tokens"))


@query(
    f"WITH {_LOSS} SELECT config, {_PPL} AS perplexity, CAST(coalesce(sum(CASE WHEN n_tokens >= 2 AND loss IS NOT NULL THEN n_tokens - 1 END), 0) AS BIGINT) AS n_predicted, CAST(sum(CASE WHEN n_tokens >= 2 AND loss IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_texts FROM losses GROUP BY 1"
)
def perplexity_agg(spark, sf_dir):
    return metrics.perplexity(_losses(spark, sf_dir), ["config"]).withColumn("perplexity", F.round("perplexity", 6))


@query(
    f"""WITH {_LOSS}, ppl AS (SELECT config, {_PPL} AS p FROM losses GROUP BY 1),
one AS (SELECT max(CASE WHEN config = 'A' THEN p END) AS a, max(CASE WHEN config = 'B' THEN p END) AS b, max(CASE WHEN config = 'C' THEN p END) AS c, max(CASE WHEN config = 'D' THEN p END) AS d FROM ppl)
SELECT round(d / b, 6) AS comprehension, round(100.0 * (c - a) / a, 6) AS retention_pct, round(100.0 * (b - a) / a, 6) AS compression_pct FROM one"""
)
def config_analysis(spark, sf_dir):
    out = metrics.config_analysis(perplexity_agg(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(
    f"""WITH {_MEASURES}, s AS (SELECT metric, avg(CASE WHEN language = 'en' THEN value END) AS a, avg(CASE WHEN language = 'fr' THEN value END) AS b FROM m GROUP BY 1)
SELECT metric, round(CASE WHEN a <> 0 THEN 100.0 * (b - a) / a ELSE 0 END, 6) AS delta_pct FROM s"""
)
def config_comparison(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.when(F.col("language") == "en", "A").when(F.col("language") == "fr", "B").alias("config"), F.length("content").alias("chars"), F.size(F.split("content", "\n")).alias("lines"))
    parts = [metrics.metric_summary(d.where(F.col("config") == c), ["chars", "lines"]).withColumn("config", F.lit(c)) for c in "AB"]
    return metrics.config_comparison(parts[0].unionByName(parts[1])).withColumn("delta_pct", F.round("delta_pct", 6))


_TOK = f"{CORPUS}, tok AS (SELECT file_id, regexp_extract_all(content, '{TOKEN}') AS t FROM corpus)"


@query(
    f"""WITH {_TOK}, cut AS (SELECT *, least(floor(len(t) * 0.5), 512)::INTEGER AS n FROM tok WHERE len(t) >= 32)
SELECT file_id, n AS n_prefix, (len(t) - n)::INTEGER AS n_suffix, md5(array_to_string(list_slice(t, 1, n), '')) AS prefix, md5(array_to_string(list_slice(t, n + 1, len(t)), '')) AS suffix FROM cut WHERE n >= 1 AND n < len(t)"""
)
def prefix_suffix(spark, sf_dir):
    rows = documents(spark, sf_dir).select("file_id", metrics.let(tokens.tokens(F.col("content")), lambda t: tokens.prefix_suffix(t)).alias("s")).where("s IS NOT NULL")
    digest = lambda c: F.md5(F.array_join(c, "").cast("binary"))
    return rows.select("file_id", F.size("s.prefix").alias("n_prefix"), F.size("s.suffix").alias("n_suffix"), digest(F.col("s.prefix")).alias("prefix"), digest(F.col("s.suffix")).alias("suffix"))


@query(f"WITH {_TOK}, places AS (SELECT file_id, t, unnest(range(1, len(t) - 1)) AS i FROM tok) SELECT file_id, CAST(min(i) - 1 AS INTEGER) AS pos FROM places WHERE t[i] = 'of' AND t[i + 1] = ' ' AND t[i + 2] = 'the' GROUP BY 1")
def expansion_span(spark, sf_dir):
    wanted = F.array(F.lit("of"), F.lit(" "), F.lit("the"))
    rows = documents(spark, sf_dir).select("file_id", tokens.find_span(tokens.tokens(F.col("content")), wanted).alias("pos"))
    return rows.where("pos IS NOT NULL")


@query(f"WITH {_TOK} SELECT file_id, md5(array_to_string(list_slice(t, 1, 256), '')) AS digest, least(len(t), 256)::INTEGER AS n FROM tok")
def truncated_tokens(spark, sf_dir):
    rows = documents(spark, sf_dir).select("file_id", tokens.truncate(tokens.tokens(F.col("content")), 256).alias("t"))
    return rows.select("file_id", F.md5(F.array_join("t", "").cast("binary")).alias("digest"), F.size("t").alias("n"))


@query(
    f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, regexp_extract_all(reference, '[^\\x20\\x09-\\x0D]+') AS r, regexp_extract_all(hypothesis, '[^\\x20\\x09-\\x0D]+') AS h FROM pairs),
t AS (SELECT conv_id, turn, array_to_string(list_slice(r, 1, len(h)), ' ') AS reference, array_to_string(h, ' ') AS generated FROM w)
SELECT conv_id, turn, md5(reference) AS digest, CASE WHEN reference = generated THEN 1.0::DOUBLE ELSE 0 END AS exact_match FROM t"""
)
def trimmed_reference(spark, sf_dir):
    """The reference cut to the length of what was generated, and whether both are then the same."""
    w = _pairs(spark, sf_dir).select("conv_id", "turn", metrics.words(F.col("reference")).alias("r"), metrics.words(F.col("hypothesis")).alias("h"))
    w = w.select("conv_id", "turn", F.array_join(tokens.trim_to(F.col("r"), F.col("h")), " ").alias("reference"), F.array_join("h", " ").alias("generated"))
    return w.select("conv_id", "turn", F.md5(F.col("reference").cast("binary")).alias("digest"), metrics.exact_match(F.col("reference"), F.col("generated")).alias("exact_match"))


_ENTRY_TOKENS = ", ".join(f"('{m}')" for m in [scoring._macro(k, n) if k == "M" else scoring._macro(k, n)[:-2] + ":" for k, n, *_ in scoring.ENTRIES])


@query(
    f"""WITH t(token) AS (VALUES {_ENTRY_TOKENS}, ('|>')), o AS (
  SELECT token, row_number() OVER (ORDER BY CASE WHEN token LIKE '<|M%' THEN 0 WHEN token LIKE '<|T%' THEN 1 ELSE 2 END, token) - 1 AS pos FROM t)
SELECT token, CAST(1000 + pos AS INTEGER) AS id, TRUE AS valid FROM o"""
)
def token_map(spark, sf_dir):
    one = dictionary.token_map(scoring._dictionary(spark), 1000)
    valid = tokens.validate_vocab(F.col("token_map"), F.lit(1000), F.col("vocab_size"))
    return one.select(F.explode("token_map").alias("token", "id"), valid.alias("valid")).select("token", F.col("id").cast("int").alias("id"), "valid")


@query(
    "SELECT macro, len(regexp_extract_all(trim(regexp_replace(content, '\\{\\d+\\}', '', 'g')), '"
    + TOKEN
    + "'))::INTEGER AS n_tokens FROM (VALUES "
    + ", ".join(f"('{scoring._macro(k, n)}', '{c}')" if k == "T" else f"('{scoring._macro(k, n)}', '{c}')" for k, n, c, *_ in scoring.ENTRIES if k == "T")
    + ") t(macro, content)"
)
def template_expansion(spark, sf_dir):
    d = scoring._dictionary(spark).where("kind = 'T'")
    return d.select("macro", F.size(tokens.tokens(tokens.expansion(F.col("kind"), F.col("content")))).alias("n_tokens"))


CONTEXT_PATTERNS = ["Released under", " of the ", "password"]


@query(
    f"""WITH {CORPUS}, pats(pattern) AS (VALUES {", ".join(f"('{p}')" for p in CONTEXT_PATTERNS)}),
parts AS (SELECT file_id, content, pattern, unnest(string_split(content, pattern)) AS part, generate_subscripts(string_split(content, pattern), 1) AS k FROM corpus, pats),
hits AS (SELECT file_id, content, pattern, k, sum(length(part) + length(pattern)) OVER (PARTITION BY file_id, pattern ORDER BY k) - length(pattern) AS pos, count(*) OVER (PARTITION BY file_id, pattern) AS n FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY md5(CAST(file_id AS VARCHAR) || '42'), file_id, pos) AS rank FROM hits WHERE k < n)
SELECT pattern, CAST(rank AS INTEGER) AS k, file_id, CAST(pos AS INTEGER) AS pos, substr(content, CAST(greatest(pos - 300, 0) + 1 AS BIGINT), CAST(pos + length(pattern) + 300 - greatest(pos - 300, 0) AS BIGINT)) AS "window" FROM placed WHERE rank <= 25"""
)
def context_index(spark, sf_dir):
    return context.context_index(documents(spark, sf_dir), CONTEXT_PATTERNS)

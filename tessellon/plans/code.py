"""Queries on templates and lexers. ``documents`` is prose, so its templates are of a small language
of phrases; code languages are run on small files kept here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellon.languages import available_languages, get_language
from tessellon.languages.base import Language, words
from tessellon.operators import build, candidates, lexer, ngrams, templates
from tessellon.operators.segments import range_stats
from tessellon.plans.corpus import CORPUS
from tessellon.plans.mining import TOKENS
from tessellon.session import ship
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


#: Two words around a linking one: the linking words stay, the others are slots.
PROSE = Language(name="prose", extension=".txt", comments=(), strings=(r"\x00",), candidates=(r"[a-z]+ (?:the|of|and) [a-z]+",), seeds=(), structural=words("the of and"), ident=r"[a-z]+", min_depth=1, type_first=False)

_USES = rf"""{CORPUS}, found AS (SELECT file_id, repo, unnest(regexp_extract_all(content, '[a-z]+ (?:the|of|and) [a-z]+')) AS m FROM corpus),
parts AS (SELECT *, string_split(m, ' ') AS w FROM found WHERE length(m) >= 8),
slotted AS (
  SELECT file_id, repo, w, w[1] IN ('the', 'of', 'and') AS fa, w[3] IN ('the', 'of', 'and') AS fb FROM parts),
uses AS (
  SELECT file_id, repo, CASE WHEN fa THEN w[1] ELSE '{{0}}' END || ' ' || w[2] || ' ' || CASE WHEN fb THEN w[3] WHEN fa OR w[1] = w[3] THEN '{{0}}' ELSE '{{1}}' END AS template,
    CASE WHEN fa THEN [w[3]] WHEN fb OR w[1] = w[3] THEN [w[1]] ELSE [w[1], w[3]] END AS args FROM slotted WHERE NOT (fa AND fb)),
census AS (SELECT template, count(DISTINCT file_id) AS frequency, count(DISTINCT repo) AS repo_count FROM uses GROUP BY 1),
idents AS (SELECT ident, count(*) AS n, {TOKENS.format("ident")} AS tokens FROM (SELECT unnest(args) AS ident FROM uses) GROUP BY 1),
mean AS (SELECT sum(tokens * n) / sum(n)::DOUBLE AS mean FROM idents),
proxy AS (SELECT ident AS proxy FROM idents, mean ORDER BY abs(tokens - mean), ident LIMIT 1)"""


@query(f"WITH {_USES} SELECT template, frequency, repo_count FROM census")
def template_census(spark, sf_dir):
    return templates.template_census(templates.template_uses(documents(spark, sf_dir), PROSE))


@query(f"WITH {_USES} SELECT ident, n, tokens::INTEGER AS tokens FROM idents")
def identifier_census(spark, sf_dir):
    return templates.identifier_census(templates.template_uses(documents(spark, sf_dir), PROSE))


@query(f"WITH {_USES} SELECT proxy, round(mean, 9) AS mean_tokens FROM proxy, mean")
def ident_proxy(spark, sf_dir):
    return templates.identifier_proxy(identifier_census(spark, sf_dir)).withColumn("mean_tokens", F.round("mean_tokens", 9))


_SLOTS = "len(list_distinct(regexp_extract_all(template, '\\{(\\d+)\\}', 1)))"
_FILLED = "replace(replace(template, '{0}', proxy), '{1}', proxy)"


@query(
    f"""WITH {_USES}, s AS (SELECT *, {_SLOTS} AS slots FROM census, proxy WHERE frequency >= 30 AND repo_count >= 2)
SELECT template, frequency, slots::INTEGER AS slot_count, CAST(frequency * greatest({TOKENS.format(_FILLED)} - 2 - {TOKENS.format("CASE WHEN slots > 1 THEN proxy || ',' || proxy ELSE proxy END")}, 0) AS BIGINT) AS score, repo_count FROM s WHERE slots BETWEEN 1 AND 6"""
)
def mine_templates(spark, sf_dir):
    return templates.mine_templates(documents(spark, sf_dir), PROSE)


def _values(columns: str, rows: list[tuple]) -> str:
    """A table written out by hand, as SQL."""
    sql = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(sql, r)) + ")" for r in rows) + f") t({columns})"


# What the small files must give, read off by hand. Every pattern of the mined file's safe zones is in all 60 files.
EXPECTED_MINED = [(p, 60, 3) for p in (
    " public static void Run", " public static void Run(x", " public static void Run(x)", " public static void", " public static",
    "/ public static void Run", "/ public static void Run(x", "/ public static void Run(x)", "/ public static void", "/ public static", "/ public",
    "// public static void Run", "// public static void Run(x", "// public static void Run(x)", "// public static void", "// public static",
    "// public", "/// public static void Run", "/// public static void Run(x", "/// public static void Run(x)", "/// public static void",
    "/// public static", "/// public", "public static void Code", "public static void Code(x", "public static void Code(x)",
    "public static void Run", "public static void Run(x", "public static void Run(x)", "public static void", "public static", "static void Code",
    "static void Code(x", "static void Code(x)", "static void Run", "static void Run(x", "static void Run(x)", "static void", "void Code",
    "void Code(x", "void Code(x)", "void Run", "void Run(x", "void Run(x)",
)]
EXPECTED_ZONES = [(0, "csharp", 5, 177, 84.688995), (1, "go", 5, 101, 78.294574), (2, "java", 4, 128, 85.90604), (3, "python", 4, 93, 79.487179), (4, "typescript", 5, 114, 77.55102)]
EXPECTED_TEMPLATES = [
    ("csharp", True, "char {0} = 'x';", "c"),
    ("csharp", True, "public A(int {0}) { this.{1} = {0}; }", "a,_a"),
    ("csharp", True, "public int Get() { return {0}; }", "_a"),
    ("csharp", True, 'string {0} = "public class B";', "s"),
    ("csharp", True, "this.{0} = {1};", "_a,a"),
    ("java", False, "this.{0} = {0};", "a"),
    ("java", True, "A(int {0}) { this.{0} = {0}; }", "a"),
    ("java", True, 'String {0} = "x // y";', "s"),
    ("java", True, "this.{0} = {0};", "a"),
    ("python", False, "def f(self, {0}):", "a"),
    ("python", False, "self.{0} = {1}", "_a,a"),
    ("python", True, "def f(self, {0}):", "a"),
    ("python", True, "self.{0} = {1}", "_a,a"),
    ("typescript", False, "({0}: string) =>", "x"),
    ("typescript", False, "async ({0}: string)", "x"),
    ("typescript", False, "import { {0} } from ", "a"),
    ("typescript", True, "import { {0} } from 'b';", "a"),
    ("typescript", True, "const {0} = await g(`t ${x}`);", "y"),
]

#: name -> a file of the language, with documentation, comments, strings and repeated statements.
FILES = {
    "csharp": 'using System;\n/// <summary>Adds.</summary>\npublic class A {\n  // no\n  private int _a; string s = "public class B"; char c = \'x\';\n  public A(int a) { this._a = a; }\n  public int Get() { return _a; } /* no */\n}\n',
    "go": 'package main\nimport "fmt"\n// comment\nfunc main() {\n\terr := run(`raw "x"`)\n\tif err != nil {\n\t\tfmt.Println("no", err)\n\t}\n\treturn\n}\n',
    "java": 'package a.b;\nimport java.util.List;\n/** Doc. */\npublic class A {\n  /* no */ private int a; // no\n  String s = "x // y";\n  A(int a) { this.a = a; }\n}\n',
    "python": '"""Module doc."""\nimport os\n\ndef f(self, a):\n    \'\'\'Doc.\'\'\'\n    self._a = a  # no\n    return "x # y" + \'\'\'not doc\'\'\'\n',
    "typescript": "import { a } from 'b';\n/** Doc. */\nexport const f = async (x: string) => {\n  // no\n  const y = await g(`t ${x}`);\n  return y;\n};\n/** @license x */\n",
}


def _code(spark):
    rows = [(i, f"repo{i}", name, text) for i, (name, text) in enumerate(sorted(FILES.items()))]
    return spark.createDataFrame(rows, "file_id long, repo string, language string, content string")


#: What a C# file adds to the mined corpus: the same phrase as documentation, comment, string and code.
MINED = '/// public static void Run(x)\n// public static void Off(x)\nvar s = "public static void Text(x)";\npublic static void Code(x)\n'


@query(_values("file_id, language, n_ranges, safe_chars, safe_pct", EXPECTED_ZONES))
def safe_zones(spark, sf_dir):
    """file_id, language, safe characters and their share, for each language's file."""
    ship(spark)
    parts = [_code(spark).where(F.col("language") == n).withColumn("safe", lexer.safe_ranges_udf(n)("content")) for n in available_languages()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    s = range_stats(F.col("safe"), F.length("content"))
    return rows.select("file_id", "language", F.size("safe").alias("n_ranges"), s["safe_bytes"].alias("safe_chars"), F.round(s["safe_pct"], 6).alias("safe_pct"))


@query(_values("language, statements, template, args", EXPECTED_TEMPLATES))
def code_templates(spark, sf_dir):
    """language, template, args from expressions and statements of each language's file."""
    rows = None
    for n in available_languages():
        own = _code(spark).where(F.col("language") == n)
        for statements in (False, True):
            part = templates.template_uses(own, n, statements).select(F.lit(n).alias("language"), F.lit(statements).alias("statements"), "template", F.array_join("args", ",").alias("args"))
            rows = part if rows is None else rows.unionByName(part)
    return rows.distinct()


@query(_values("pattern, frequency, repo_count", EXPECTED_MINED))
def code_candidates(spark, sf_dir):
    """Patterns of both channels, mined from safe zones: what stands in documentation and code, and nothing of
    comments and strings."""
    ship(spark)
    lang = get_language("csharp")
    rows = lexer.safe_corpus(spark.range(60).select(F.col("id").alias("file_id"), F.concat(F.lit("repo"), F.col("id") % 3).alias("repo"), F.lit("csharp").alias("language"), F.lit(MINED).alias("content")), lang)
    both = candidates.merge_results(candidates.score_counted(candidates.regex_candidates(rows, lang.candidates)), ngrams.scored_ngrams(rows))
    return both.select("pattern", "frequency", "repo_count")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {len(get_language(n).seeds)}, {len(get_language(n).candidates)})" for n in available_languages()) + ") t(language, n_seeds, n_candidates)")
def languages(spark, sf_dir):
    rows = [(n, len(get_language(n).seeds), len(get_language(n).candidates)) for n in available_languages()]
    return spark.createDataFrame(rows, "language string, n_seeds int, n_candidates int")


@query()
def build_dictionary(spark, sf_dir):
    """Every channel on ``documents``, statements included, scored and rebuilt: kind, ord, content, macro, slots, category."""
    return build.build_dictionary(documents(spark, sf_dir), PROSE)[0]

"""Operators against plain Python on small inputs, and properties on random ones."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessellon.functions import metrics, text, tokens
from tessellon.languages import available_languages, get_language
from tessellon.operators import candidates, codec, context, dictionary, lexer, ngrams, prepare, reports, scoring, segments, templates
from tessellon.sources import corpus as src

WORDS = ["public", "static", "river", "stone", "x", "a_b", "Foo", "(", ".", "é", "of", "the"]


def corpus(spark, texts, repos=None):
    rows = [(i, (repos or ["r0", "r1", "r2"])[i % len(repos or "abc")], "en", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_id long, repo string, language string, content string")


def made(seed, n=25):
    r = random.Random(seed)
    return ["\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(0, 9))) for _ in range(r.randint(0, 6))) for _ in range(n)]


def col(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


# ---- text ----


@pytest.mark.parametrize(("line", "at", "start"), [("FooBar", 3, False), (".ToString()", 1, True), ("a public static", 2, True), ("abc", 0, True)])
def test_word_boundary_start(spark, line, at, start):
    assert col(spark, text.is_word_boundary_start(F.col("l"), F.col("i")), l=line, i=at) is start


def test_word_boundary_end(spark):
    got = [col(spark, text.is_word_boundary_end(F.col("l"), F.col("i")), l="foo bar", i=i) for i in (2, 3, 7)]
    assert got == [False, True, True]


@pytest.mark.parametrize(("p", "pattern", "ngram"), [("singleword", False, False), ("a       b      c", True, False), ("ab cd", False, False), (".ToList()", True, True), ("something here", True, True), ("naïvemot", False, False), ("line\nbreak", False, False), ("        ", False, False)])
def test_pattern_validity(spark, p, pattern, ngram):
    assert col(spark, text.is_valid_pattern(F.col("p")), p=p) is pattern
    assert col(spark, text.is_valid_ngram(F.col("p")), p=p) is ngram


def test_tokens_and_macros(spark):
    assert col(spark, text.token_count(F.col("t")), t="ab 12, c") == 7
    assert col(spark, text.token_count(F.col("t")), t=None) == 0
    assert col(spark, text.macro_token("M", F.col("n")), n=7) == "<|M00007|>"
    assert col(spark, text.list_macros(F.col("t")), t="a<|M00001|>b<|T00002:x,y|>c<|M1") == ["<|M00001|>", "<|T00002:x,y|>"]
    assert col(spark, text.slot_count(F.col("t")), t="{0} {1} {0}") == 2
    assert col(spark, text.expand_template(F.col("t"), F.array(F.lit("p"), F.lit("q"))), t="this.{0} = {1};") == "this.p = q;"
    assert col(spark, text.eval_repo_key(F.col("t")), t="a--b") == "a/b"


# ---- ranges ----


def test_invert_ranges_properties(spark):
    r = random.Random(0)
    cases = [([], 0), ([], 5), ([(0, 5)], 5), ([(1, 3), (3, 4), (2, 3)], 6)]
    cases += [([(a, a + r.randint(0, 6)) for a in (r.randint(0, 20) for _ in range(r.randint(0, 6)))], 30) for _ in range(60)]
    df = spark.createDataFrame([(i, [{"start": a, "end": b} for a, b in x], n) for i, (x, n) in enumerate(cases)], "i int, r array<struct<start:int,end:int>>, n int")
    got = {x.i: [(y.start, y.end) for y in x.s] for x in df.select("i", segments.invert_ranges(F.col("r"), F.col("n")).alias("s")).collect()}
    flat = df.select(F.col("i").alias("file_id"), F.explode("r").alias("x")).select("file_id", "x.start", "x.end")
    by_rows = {}
    for x in segments.invert_range_rows(flat, df.select(F.col("i").alias("file_id"), F.col("n").alias("total"))).collect():
        by_rows.setdefault(x.file_id, []).append((x.start, x.end))
    for i, (ranges, n) in enumerate(cases):
        covered = [any(a <= k < b for a, b in ranges) for k in range(n)]
        want, k = [], 0
        while k < n:
            if not covered[k]:
                e = k
                while e < n and not covered[e]:
                    e += 1
                want.append((k, e))
                k = e
            else:
                k += 1
        merged = [s for s in got[i]]
        assert [k for a, b in merged for k in range(a, b)] == [k for a, b in want for k in range(a, b)]
        assert sorted(by_rows.get(i, [])) == merged == lexer.invert(ranges, n)
    assert col(spark, segments.is_in_range(F.array(F.struct(F.lit(0).alias("start"), F.lit(10).alias("end"))), F.col("i")), i=10) is False


# ---- mining ----


def lines_of(t):
    return [s for line in t.split("\n") if len(s := line.strip(" \t\r")) >= 8]


def is_w(c):
    return re.match("[A-Za-z0-9_]", c) is not None


def brute_pass1(texts):
    n = Counter()
    for t in texts:
        n.update({s[i : i + 8] for s in lines_of(t) for i in range(len(s) - 7) if i == 0 or not is_w(s[i - 1])})
    return n


def brute_pass2(texts, repos, alive, longest=120):
    n, where = Counter(), {}
    for i, t in enumerate(texts):
        own = set()
        for s in lines_of(t):
            for a in range(len(s) - 7):
                if (a == 0 or not is_w(s[a - 1])) and s[a : a + 8] in alive:
                    own |= {s[a:e] for e in range(a + 8, min(len(s), a + longest) + 1) if e == len(s) or not is_w(s[e])}
        n.update(own)
        for p in own:
            where.setdefault(p, set()).add(repos[i % len(repos)])
    return {p: (c, len(where[p])) for p, c in n.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_passes(spark, seed):
    texts, repos = made(seed), ["r0", "r1", "r2"]
    c = corpus(spark, texts)
    one = brute_pass1(texts)
    want = {g: n for g, n in one.items() if n >= 3}
    assert {r.gram: r.frequency for r in ngrams.pass1(c, 3).collect()} == want
    assert {r.gram: r.frequency for r in ngrams.pass1_native(c, 3).collect()} == want
    full = brute_pass2(texts, repos, set(want))
    rare = {p: v for p, v in full.items() if v[0] >= 3}
    assert {r.pattern: (r.frequency, r.repo_count) for r in ngrams.pass2(c, ngrams.pass1(c, 3)).where("frequency >= 3").collect()} == rare
    assert {r.pattern: (r.frequency, r.repo_count) for r in ngrams.pass2_native(c, ngrams.pass1(c, 3)).collect()} == full
    mined = ngrams.mine_ngrams(c, min_frequency=3, min_repos=1, pass1_threshold=2).collect()
    assert mined and all(r.score == r.frequency * (r.token_count - 1) for r in mined)
    assert [(-r.score, r.pattern) for r in mined] == sorted((-r.score, r.pattern) for r in mined)
    assert ngrams.mine_ngrams(corpus(spark, [])).count() == 0


def test_regex_channel_and_merge(spark):
    c = corpus(spark, ["return value; return value;", "return value;", "  return other ; x", ""])
    got = {r.pattern: (r.frequency, r.repo_count) for r in candidates.regex_candidates(c, (r"return \w+;", r"return \w+ ;")).collect()}
    assert got == {"return value;": (2, 2), "return other ;": (1, 1)}
    row = "pattern string, frequency long, token_count int, score long, repo_count long"
    a = spark.createDataFrame([("p", 100, 3, 200, 5), ("q", 7, 3, 14, 2)], row)
    b = spark.createDataFrame([("p", 150, 3, 300, 4), ("s", 9, 3, 18, 2)], row)
    got = {r.pattern: tuple(r)[1:] for r in candidates.merge_results(a, b).collect()}
    assert got == {"p": (150, 3, 300, 5), "q": (7, 3, 14, 2), "s": (9, 3, 18, 2)}
    assert candidates.merge_results(a, b.limit(0)).count() == 2


# ---- dictionary and codec ----


def test_dictionary_operations(spark, tmp_path):
    d = dictionary.from_seed(spark, [("using System;", "using"), ("{ get; set; }", "property")])
    more = spark.createDataFrame([("M", "return null;", "x"), ("M", "using System;", "x"), ("T", "this.{0} = {1};", "template")], "kind string, content string, category string")
    grown = dictionary.add(d, more)
    assert {(r.kind, r.ord, r.content, r.slots) for r in grown.collect()} == {("M", 1, "using System;", 0), ("M", 2, "{ get; set; }", 0), ("M", 3, "return null;", 0), ("T", 1, "this.{0} = {1};", 2)}
    assert dictionary.remove(grown, ["using System;"]).count() == 3
    src.save_dictionary(grown, f"{tmp_path}/d")
    assert sorted(map(tuple, src.load_dictionary(spark, f"{tmp_path}/d").select(*grown.columns).collect())) == sorted(map(tuple, grown.collect()))
    merged = dictionary.merge(d, dictionary.from_seed(spark, [("zz", "b"), ("{ get; set; }", "b"), ("longer than that", "b")]))
    assert [r.content for r in merged.orderBy("ord").collect()] == ["using System;", "{ get; set; }", "longer than that", "zz"] or merged.count() == 4
    assert {(r.category, r.n) for r in dictionary.stats(d).collect()} == {("using", 1), ("property", 1)}


ROWS = [("M", "{ get; set; }", "<|M00001|>"), ("M", "get;", "<|M00002|>"), ("M", "using System;", "<|M00003|>"), ("T", "this.{0} = {1};", "<|T00001|>"), ("T", "{0} == {0}0", "<|T00002|>")]


def test_codec():
    c = codec.Codec(ROWS)
    t = "using System;\nint A { get; set; } int B { get; }\nthis._a = b; x == x0 y == z0"
    out = c.compress(t)
    assert out == "<|M00003|>\nint A <|M00001|> int B { <|M00002|> }\n<|T00001:_a,b|> <|T00002:x|> y == z0"
    assert c.decompress(out) == t and len(out) > 0
    assert c.compress("") == "" and c.compress("plain English") == "plain English"
    assert c.decompress("<|M99999|> <|T99999:a|>") == "<|M99999|> <|T99999:a|>"
    assert c.compress_zones("get; get; get;", [(5, 9)]) == "get; <|M00002|> get;"
    assert c.compress_zones("get;", []) == "get;" and c.compress_zones("get;", None) == "<|M00002|>"
    assert codec.template_regex("{1} {0}") is None and codec.template_regex("none") is None


def test_codec_round_trips_at_random(spark):
    r, c = random.Random(3), codec.Codec(ROWS)
    parts = ["{ get; set; }", "get;", "using System;", "this.", "a", " = ", "b;", "\n", "é", " == ", "a0", "{", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(300)]
    assert all(c.decompress(c.compress(t)) == t for t in texts)
    d = spark.createDataFrame(ROWS, "kind string, content string, macro string")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    native = codec.compress_native(F.col("t"), [(x, m) for k, x, m in ROWS if k == "M"], [(x, m) for k, x, m in ROWS if k == "T"])
    out = df.select("t", codec.compressor(d)("t").alias("c"), native.alias("n")).withColumn("back", codec.decompressor(d)("c")).collect()
    assert all(x.c == c.compress(x.t) == x.n and x.back == x.t for x in out)
    assert col(spark, codec.pattern_counts(F.col("t"), ["aa", "b"]), t="aaab") == {"aa": 1, "b": 1}


# ---- scoring ----


def test_scores_by_hand(spark):
    """Three repos of two files: a macro's score is its saving in a repo by the repo's files."""
    d = spark.createDataFrame([("M", 1, "alpha beta gamma", "<|M00001|>", 0, "x"), ("M", 2, "one", "<|M00002|>", 0, "x"), ("T", 1, "set {0} to {1} now", "<|T00001|>", 2, "t")], "kind string, ord int, content string, macro string, slots int, category string")
    texts = ["alpha beta gamma", "alpha beta gamma alpha beta gamma", "zzz", "one one", "set p to q now", "alpha beta gamma"]
    c = corpus(spark, texts, ["r0", "r1", "r2"])
    c = c.withColumn("compressed", codec.compressor(d)("content"))
    got = {r.macro: (r.score, r.file_count, r.repo_count) for r in scoring.score_macros(c, d).collect()}
    assert got == {"<|M00001|>": (4 / 2 + 8 / 2 + 4 / 2, 3, 3), "<|T00001|>": ((9 - 2 - 3) / 2, 1, 1)}
    scores = scoring.score_macros(c, d)
    assert [r.content for r in scoring.rebuild_top_n(scores, 2).collect()] == ["alpha beta gamma"]
    assert scoring.rebuild_top_n(scores, 0, 0, 1).count() == 1
    assert {r.reason: r.n for r in scoring.drop_counts(scores, 2, 2, 1).collect()} == {"files": 1, "kept": 1}
    assert scoring.auto_min_files(scores.limit(0)).first()[0] == 0
    assert {r.bucket: r.n for r in scoring.file_buckets(scores).collect()} == {"1-9": 2}
    spread = reports.macro_repos(c, d)
    assert {r.macro: r.repo_count for r in spread.collect()} == {"<|M00001|>": 3, "<|M00002|>": 1, "<|T00001|>": 1}
    (m,) = reports.measure(c, d).collect()
    assert (m.n_files, m.exact_saved, m.template_saved, m.n_macros) == (6, 4 * 4, 4, 7)
    assert reports.measure(c.limit(0), d).first().ratio == 0.0


def test_threshold_choice(spark):
    rows = [(f"m{i}", "M", f"c{i}", "x", 0, float(s), f, 2) for i, (s, f) in enumerate([(90, 250), (5, 120), (4, 20), (1, 3)])]
    s = spark.createDataFrame(rows, "macro string, kind string, content string, category string, slots int, score double, file_count long, repo_count long")
    assert scoring.auto_min_files(s).first()[0] == 200
    t = {r.threshold: (r.n, r.impact) for r in scoring.threshold_table(s).collect()}
    assert t[0] == (4, 100.0) and t[10] == (3, 99.0) and t[500] == (0, 0.0)
    assert tuple(scoring.auto_stats(s).first()) == (200, 1, 0.9)


# ---- preparation ----


def test_prepare_split_and_mix(spark):
    c = corpus(spark, [f"text number {i} " * 5 for i in range(60)], ["a", "b", "e"]).withColumn("compressed", F.lit("C"))
    rows = prepare.mix(c, ["e"]).collect()
    assert {r.repo for r in rows if r.split == "eval"} == {"e"} and all(r.is_compressed for r in rows if r.split == "eval")
    train = [r for r in rows if r.split == "train"]
    assert 0 < sum(r.is_compressed for r in train) < len(train)
    assert all((r.text == "C") == r.is_compressed for r in rows)
    (m,) = prepare.meta(prepare.mix(c, ["e"]), 3).collect()
    assert (m.train_files, m.eval_files, m.train_compressed + m.train_original) == (40, 20, 40)


def test_streaming_prepare_equals_batch(spark, tmp_path):
    from tessellon.streaming import prepare as stream

    rows = [(i, "some content that is long enough to be kept, yes it is " * (i % 3), f"own{'--' if i % 2 else '/'}r{i % 5}") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, content string, repo_name string")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    gone = spark.createDataFrame([("own/r1",), ("own--r2",)], "repo string")
    d = spark.createDataFrame([("M", " content that ", "<|M00001|>")], "kind string, content string, macro string")
    batch = prepare.prepare_stream(df, gone, codec.compressor(d))
    live = prepare.prepare_stream(stream.read_records(spark, f"{tmp_path}/in", df.schema, 1), gone, codec.compressor(d))
    stream.write_capped(live, f"{tmp_path}/out", f"{tmp_path}/ck", 10_000).awaitTermination()
    out = spark.read.json(f"{tmp_path}/out").select(*batch.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))
    assert all(r.repo_name not in ("own/r1", "own--r1", "own/r2", "own--r2") for r in batch.collect())
    stream.write_capped(live, f"{tmp_path}/out2", f"{tmp_path}/ck2", 7).awaitTermination()
    assert spark.read.json(f"{tmp_path}/out2").count() == 7
    assert prepare.capped(batch, 5).count() == 5


def test_windowed_stream(spark, tmp_path):
    from tessellon.streaming import prepare as stream

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 60) AS ts, 'a' AS event_type, cast(id AS double) AS value FROM range(20)").write.parquet(f"{tmp_path}/e")
    live = stream.windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e"))
    q = live.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.sql("SELECT * FROM counts ORDER BY start").collect()] == [(5, 10.0), (5, 35.0), (5, 60.0), (5, 85.0)]


def test_extract_and_repos(spark, tmp_path):
    for name, body in {"b/x.py": "print(1)\n" * 20, "a/y.py": "print(2)\n" * 20, "a/vendor/z.py": "print(3)\n" * 20, "a/short.py": "x", "a/n.txt": "text " * 50}.items():
        p = tmp_path / "repos" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body)
    files = src.read_files(spark, f"file:{tmp_path}/repos", (".py",))
    out = src.extract_files(files, ".py", skip=("/VENDOR/",))
    assert [(r.file_id, r.filename, r.repo, r.path) for r in out.orderBy("file_id").collect()] == [(0, "000000.py", "a", "a/y.py"), (1, "000001.py", "b", "b/x.py")]
    assert src.extract_files(files, ".py", max_files=1).count() == 1
    assert src.extract_files(files, ".py", designated=["b"]).count() == 1
    meta = src.metadata(out)
    meta.write.json(f"{tmp_path}/m")
    assert {r.filename: r.repo for r in src.read_metadata(spark, f"{tmp_path}/m").collect()} == {"000000.py": "a", "000001.py": "b"}
    assert src.integrity(out, meta).first().ok
    src.write_jsonl(out.select(F.col("content").alias("text")), f"{tmp_path}/t")
    assert src.read_jsonl(spark, f"{tmp_path}/t").count() == 2


# ---- metrics ----


def test_metrics_against_plain_python(spark):
    r = random.Random(5)
    pairs = [("", ""), ("", "a b"), ("a", ""), ("the cat sat", "the cat sat"), ("a b c d e", "a b x d e")]
    pairs += [(" ".join(r.choice("abcde") for _ in range(r.randint(0, 12))), " ".join(r.choice("abcdé") for _ in range(r.randint(0, 12)))) for _ in range(40)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    rows = df.select("a", "b", metrics.bleu4(F.col("a"), F.col("b")).alias("bleu"), metrics.bleu4_udf("a", "b").alias("bleu_udf"), metrics.chrf(F.col("a"), F.col("b")).alias("chrf"), metrics.chrf_udf("a", "b").alias("chrf_udf"), metrics.edit_similarity(F.col("a"), F.col("b")).alias("es"), metrics.exact_match(F.col("a"), F.col("b")).alias("em")).collect()

    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, a in enumerate(s, 1):
            last, row = row, [i]
            for j, b in enumerate(t, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        return row[-1]

    for x in rows:
        assert x.bleu == pytest.approx(metrics._bleu4(x.a, x.b)) and x.bleu_udf == pytest.approx(x.bleu)
        assert x.chrf == pytest.approx(metrics._chrf(x.a, x.b)) and x.chrf_udf == pytest.approx(x.chrf)
        assert x.es == pytest.approx(1 - lev(x.a, x.b) / max(len(x.a), len(x.b)) if x.a or x.b else 1.0)
        assert x.em == float(x.a == x.b)
    assert rows[3].bleu == pytest.approx(1.0) or rows[3].bleu == 0.0


def test_perplexity_weights(spark):
    import math

    rows = [("A", 1.0, 11), ("A", 2.0, 6), ("A", float("nan"), 9), ("A", float("inf"), 9), ("A", None, 9), ("A", 9.0, 1), ("B", 1.0, 1)]
    got = {r.config: r for r in metrics.perplexity(spark.createDataFrame(rows, "config string, loss double, n_tokens int"), ["config"]).collect()}
    assert got["A"].perplexity == pytest.approx(math.exp((1.0 * 10 + 2.0 * 5) / 15)) and got["A"].n_predicted == 15
    assert got["B"].perplexity == float("inf")
    s = metrics.metric_summary(spark.createDataFrame([(1.0,)], "m double"), ["m"]).first()
    assert (s["mean"], s["median"], s.stdev, s.n) == (1.0, 1.0, 0.0, 1)


def test_spans_and_splits(spark):
    t = F.array(*map(F.lit, "abcabd"))
    assert col(spark, tokens.find_span(t, F.array(F.lit("a"), F.lit("b"), F.lit("d"))), x=1) == 3
    assert col(spark, tokens.find_span(t, F.array(F.lit("z"))), x=1) is None
    assert col(spark, tokens.find_span(t, F.array().cast("array<string>")), x=1) is None
    s = col(spark, tokens.prefix_suffix(t, 0.5, 2, 2), x=1)
    assert (s.prefix, s.suffix) == (["a", "b"], ["c", "a", "b", "d"])
    assert col(spark, tokens.prefix_suffix(t, 0.5, 7), x=1) is None


def test_context_windows(spark):
    c = corpus(spark, ["xxPATyyPAT", "nothing", "PAT"])
    got = sorted((r.file_id, r.pos, r.window) for r in context.context_index(c, ["PAT"], 25, 2).collect())
    assert got == [(0, 2, "xxPATyy"), (0, 7, "yyPAT"), (2, 0, "PAT")]
    assert context.context_index(c, ["PAT"], 2, 2).count() == 2


# ---- languages ----


def zones(name, code):
    return [code[a:b] for a, b in lexer.safe_ranges(code, get_language(name))]


def test_safe_zones():
    assert zones("csharp", 'a "s" b // c\n/// doc\n/* d */ e') == ["a ", " b ", "\n/// doc\n", " e"]
    assert zones("java", "/** doc */ a /* no */ b") == ["/** doc */ a ", " b"]
    assert zones("typescript", "/** @license */a `t ${x}` b /** d */") == ["a ", " b /** d */"]
    assert zones("go", "// all\na `raw\"` b 'c'") == ["\na ", " b "]
    doc = 'def f():\n    """Doc."""\n    x = """no"""\n    r"""no"""\n'
    assert zones("python", doc) == ['def f():\n    """Doc."""\n    x = ', "\n    ", "\n"]
    assert zones("python", "") == [] and zones("python", "'''m'''\nx = 1") == ["'''m'''\nx = 1"]
    with pytest.raises(ValueError, match="csharp"):
        get_language("cobol")
    assert available_languages() == ["csharp", "go", "java", "python", "typescript"]


@pytest.mark.parametrize(
    ("code", "want"),
    [("this._logger = l;", ("this.{0} = {1};", ["_logger", "l"])), ("return a;", ("return {0};", ["a"])), ("return null;", None), ("f(a, b, c, d, e, g, h) return", None), ("x = x + xy;", None), ("if (a == a) return", ("if ({0} == {0}) return", ["a"]))],
)
def test_normalize(code, want):
    assert templates.normalize(code, get_language("csharp")) == want


def test_identifiers_in_range():
    got = templates.identifiers_in_range("if (a == bb) return c;", 4, 11, get_language("csharp"))
    assert got == [("a", 4, 5, True), ("bb", 9, 11, True)]


def test_template_mining(spark):
    code = ["class A { void F() { this._a = a; } }", "class B { void G() { this._b = b; } }", 'class C { string s = "this._c = c;"; }']
    uses = templates.template_uses(corpus(spark, code), "csharp", statements=True)
    got = {r.template: (r.frequency, r.repo_count) for r in templates.template_census(uses).collect()}
    assert got["this.{0} = {1};"] == (2, 2)
    idents = spark.createDataFrame([("a", 3, 1), ("long_name", 1, 5), ("mid_x", 2, 3)], "ident string, n long, tokens int")
    assert templates.identifier_proxy(idents).first().proxy == "mid_x"
    assert templates.identifier_proxy(idents.limit(0)).first().proxy == "_varName"


def test_build_dictionary_round_trips(spark):
    from tessellon.operators import build

    code = [f"using System;\npublic class A{i} {{\n  public int X {{ get; set; }}\n  void F() {{ this._a{i} = b{i}; throw new ArgumentException(); }}\n  // get; set;\n}}\n" for i in range(40)]
    c = corpus(spark, code)
    entries, scores = build.build_dictionary(c, "csharp", min_frequency=10, template_frequency=10)
    assert entries.count() > 0 and scores.count() >= entries.count()
    out = build.compress_corpus(c, entries, "csharp").withColumn("back", codec.decompressor(entries)("compressed")).collect()
    assert all(r.back == r.content and len(r.compressed) < len(r.content) for r in out)
    assert all("// get; set;" in r.compressed for r in out)


def test_command_line(spark, tmp_path):
    from tessellon.__main__ import main

    rows = [(i, f"import os\nclass A{i}:\n    def __init__(self, a):\n        self.a{i} = a\n        raise ValueError('x')\n" * 3, f"r{i % 3}", "python") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/docs/documents.parquet")
    base = ["--documents", f"{tmp_path}/docs", "--language", "python"]
    main(["mine", *base, "--out", f"{tmp_path}/d", "--scores", f"{tmp_path}/s", "--min-frequency", "10", "--no-statements"], spark)
    entries = src.load_dictionary(spark, f"{tmp_path}/d")
    assert entries.count() > 0
    main(["refilter", "--scores", f"{tmp_path}/s", "--max-entries", "2", "--out", f"{tmp_path}/d2"], spark)
    assert src.load_dictionary(spark, f"{tmp_path}/d2").count() == 2
    main(["merge", f"{tmp_path}/d", f"{tmp_path}/d2", "--out", f"{tmp_path}/d3"], spark)
    assert src.load_dictionary(spark, f"{tmp_path}/d3").count() == entries.count()
    main(["compress", *base, "--dictionary", f"{tmp_path}/d", "--out", f"{tmp_path}/c"], spark)
    main(["decompress", f"{tmp_path}/c", "--dictionary", f"{tmp_path}/d", "--out", f"{tmp_path}/back"], spark)
    assert {r.file_id: r.text for r in spark.read.parquet(f"{tmp_path}/back").collect()} == {i: t for i, t, _, _ in rows}
    main(["prepare", *base, "--dictionary", f"{tmp_path}/d", "--eval-repos", "r1", "--out", f"{tmp_path}/p"], spark)
    assert src.read_jsonl(spark, f"{tmp_path}/p/eval").count() == 10 and src.read_jsonl(spark, f"{tmp_path}/p/train").count() == 20
    main(["measure", *base, "--dictionary", f"{tmp_path}/d"], spark)
    main(["repos", *base], spark)


def test_tree_has_statements_of_a_depth():
    from tessellon.operators.tree import parse

    text = "class A {\n  void F(int a) { this.x = g(a, [1]); if (a) { h(\"}\"); } else { k(); } } // }\n}\n"
    tree = parse(text, get_language("java"))
    found = [text[n.start : n.end] for n in tree.walk() if n.kind == "statement"]
    assert found[1:] == ['void F(int a) { this.x = g(a, [1]); if (a) { h("}"); } else { k(); } }', "this.x = g(a, [1]);", 'if (a) { h("}"); } else { k(); }', 'h("}");', "k();"]
    assert {text[n.start : n.end]: n.depth() for n in tree.walk() if n.kind == "statement"}["this.x = g(a, [1]);"] == 5
    deep = parse("(" * 20_000 + "x" + "]" * 5, get_language("java"))
    assert deep.depth() > 20_000 and parse("", get_language("go")).children == []
    assert templates.statement_candidates("return a;\nthis.value = a;\n", get_language("java")) == [("this.{0} = {1};", ["value", "a"])]


def test_exact_candidates_come_from_safe_zones(spark):
    from tessellon.operators import build

    text = 'using System;\n// the secret ingredient phrase here\nvar s = "inside a string literal phrase";\n/// the documented phrase stays here\n'
    got = {r.content for r in build.candidate_dictionary(corpus(spark, [text] * 60), "csharp", seeds=False, use_templates=False, use_statements=False).collect()}
    assert any("documented phrase" in p for p in got) and not any("secret" in p or "literal" in p for p in got)


def test_meta_of_an_evaluation_only_run(spark):
    c = corpus(spark, [f"text number {i} " * 5 for i in range(30)], ["a", "b", "e"]).withColumn("compressed", F.lit("C"))
    (m,) = prepare.meta(prepare.mix(c, ["e"], eval_only=True), 3, eval_repos=["e"], eval_only=True).collect()
    assert m.asDict() == {"dictionary_size": 3, "compress_ratio": 0.75, "seed": 42, "split_method": "repo_balanced", "eval_only": True, "eval_repos": ["e"], "eval_files": 10, "errors": 0}
    (m,) = prepare.meta(prepare.mix(c.limit(0), ["e"]), 3).collect()
    assert (m.split_method, m.train_files, m.char_reduction_pct) == ("all_train", 0, 0.0)
    gone = c.withColumn("content", F.when(F.col("file_id") > 0, F.col("content"))).withColumn("compressed", F.when(F.col("file_id") > 0, F.col("compressed")))
    assert prepare.meta(prepare.mix(gone, ["e"]), 3).first().errors == 1


@pytest.mark.parametrize("blank", [" " * 9, "\t   　\u0085 \t\t", " " * 8])
def test_a_pattern_of_blanks_alone_is_not_valid(spark, blank):
    assert col(spark, text.is_valid_pattern(F.col("p")), p=blank) is False
    assert col(spark, text.is_valid_pattern(F.col("p")), p=blank + "a b") is True

"""Frequent patterns against plain Python, on any number of repos, files and batches."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessellon.functions.text import TOKEN, has_tokens, strip, token_count
from tessellon.operators import candidates, frequent, ngrams
from tessellon.plans.mining import REGEXES
from tests.test_engine import brute_pass1, brute_pass2, corpus, made

ODD = ["\t  public static \r\n \n\n   \n", "é𝄞 of the é𝄞 of the", "", "static river\u0000stone of\tthe" * 3, "  " * 40, "public static " * 30]


def as_dict(rows):
    out = {r.pattern: (r.frequency, r.repo_count) for r in rows.collect()}
    assert all(isinstance(p, str) for p in out)
    return out


@pytest.mark.parametrize(("seed", "n_repos", "threshold"), [(1, 3, 3), (2, 3, 1), (3, 200, 2), (4, 70, 2)])
def test_frequent_patterns(spark, seed, n_repos, threshold):
    texts = made(seed, 80) + ODD * 3
    repos = [f"r{i}" for i in range(n_repos)]
    alive = {g for g, n in brute_pass1(texts).items() if n >= threshold}
    want = {p: v for p, v in brute_pass2(texts, repos, alive).items() if v[0] >= threshold}
    assert as_dict(frequent.frequent_patterns(corpus(spark, texts, repos), threshold, 120)) == want


@pytest.mark.parametrize("numbered", [True, False])
def test_small_batches_and_repos_by_hash(spark, monkeypatch, numbered):
    texts, repos = made(5, 60) + ODD * 2, [f"r{i}" for i in range(90)]
    want = {p: v for p, v in brute_pass2(texts, repos, {g for g, n in brute_pass1(texts).items() if n >= 2}).items() if v[0] >= 2}
    monkeypatch.setattr(frequent, "AT_ONCE", 200)
    monkeypatch.setattr(frequent, "HELD", 50)
    monkeypatch.setattr(frequent, "HELD_BATCHES", 3)
    shared = type("Shared", (), {"value": ([], None, {r: i for i, r in enumerate(repos)} if numbered else None)})
    rows = corpus(spark, texts, repos).select("content", "repo").toArrow().to_batches()
    parts = list(frequent._count(shared, 120, 1)(iter(rows)))
    assert len(parts) > 3
    got = {}
    for b in frequent._total(2)(iter(parts)):
        got |= {p: (n, m) for p, n, m in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)}
    assert got == want


@pytest.mark.parametrize("name", ["ngram_pass2", "ngram_rejections", "ngram_scored", "merge_mining_results", "candidate_union", "dictionary_stats"])
def test_rare_patterns_are_no_rows_of_a_shuffle(spark, tmp_path, name):
    """Files of common words in an order of their own: thousands of patterns, of which few are in many files."""
    rows = [(i, " ".join(f"{'abcdefgh'[(i * k) % 8]}ommon{'xyz'[(i + k * k) % 3]}" for k in range(60)), "en", f"src{i % 3}", 0) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    plan = __spark_entry__.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"MapInArrow run\(content#\d+, repo#\d+\)#\d+, \[pattern#\d+, repo#", plan)
    assert re.search(r"MapInArrow run\(content#\d+, repo#\d+\)#\d+, \[part#", plan)


@pytest.mark.parametrize("limits", [(3, 2, 3), (1, 1, 0), (2, 1, 4)])
def test_only_frequent_candidates_are_looked_at(spark, limits):
    """No pattern is checked or split into tokens before it is counted, and the results are those of checking all."""
    texts = ["Stone of the river\tand the stone", "Stone of the river and the stone", "all rights of reed", "a of b the  of the", "x", ""] * 3 + made(6, 30)
    d = corpus(spark, texts, ["r0", "r1", "r2"])
    rows = candidates.scored_candidates(d, REGEXES, *limits)
    below = rows._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [pattern")[-1]
    assert "explode" in below and TOKEN not in below and r"(?U)" not in below
    want = candidates.regex_candidates(d, REGEXES).withColumn("token_count", token_count(F.col("pattern")))
    want = want.where((F.col("frequency") >= limits[0]) & (F.col("repo_count") >= limits[1]) & (F.col("token_count") >= limits[2]))
    want = want.select("pattern", "frequency", "token_count", (F.col("frequency") * (F.col("token_count") - 1)).alias("score"), "repo_count")
    got = sorted(map(tuple, rows.collect()))
    assert got == sorted(map(tuple, want.collect())) and got


def test_expressions_that_leap_have_the_same_matches(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["of", "the", "and", " ", " ", "A", "b", "-", "\n", "é", "Stone", "  "]) for _ in range(60)) for _ in range(400)] + ["a of bCd of e", "a of theAbc of the", "", "stone" * 50 + " of x"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert candidates.leaping(REGEXES[0]) != REGEXES[0] and candidates.leaping(REGEXES[1]) == REGEXES[1]
    for regex in (*REGEXES, "[A-Za-z]+ of", "[a-z]+ +[a-z]+", "[a-z]+ ?b", "[a-z]+ of|the", "[A-Za-z]+ (?:of|the)(?: [A-Z])?"):
        rows = d.select(F.regexp_extract_all("t", F.lit(regex), F.lit(0)).alias("a"), F.regexp_extract_all("t", F.lit(candidates.leaping(regex)), F.lit(0)).alias("b")).collect()
        assert all(x.a == x.b for x in rows) and any(x.a for x in rows) or regex == REGEXES[2], regex


def test_enough_tokens_without_counting_all(spark):
    texts = [None, "", "a", "ab1", "a1 ", "ab cd", "12", "123", "--- é\t\n x", "\n", "a\n1", "éé1é"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 5):
        assert [bool(x[0]) for x in d.select(has_tokens(F.col("t"), n)).collect()] == [x[0] >= n for x in d.select(token_count(F.col("t"))).collect()]
    ends = ["Released \u2028", "\t a \r", "\u0085 ", " \n "]
    assert [x[0] for x in spark.createDataFrame([(t,) for t in ends], "t string").select(strip(F.col("t"))).collect()] == [t.strip(" \t\r") for t in ends]


def scored_by_hand(texts, repos, threshold):
    """pattern -> (frequency, repo_count, score) of plain Python."""
    found = brute_pass2(texts, repos, {g for g, n in brute_pass1(texts).items() if n >= threshold})
    return {p: (n, m, n * (len(re.findall(TOKEN, p)) - 1)) for p, (n, m) in found.items() if n >= threshold}


@pytest.mark.parametrize(("seed", "least"), [(1, 60), (2, 150), (3, 10**6)])
def test_nothing_that_scores_enough_is_missing(spark, seed, least):
    texts, repos = made(seed, 150) + ODD * 3, ["r0", "r1", "r2"]
    every = scored_by_hand(texts, repos, 2)
    got = as_dict(frequent.frequent_patterns(corpus(spark, texts, repos), 2, 120, least))
    assert got.items() <= {p: v[:2] for p, v in every.items()}.items()
    assert {p for p, v in every.items() if v[2] >= least} <= set(got) and len(got) < len(every)


@pytest.mark.parametrize("tasks", [1, 4])
def test_thresholds_past_a_full_bucket(spark, tasks):
    """Buckets of one task are full at 255; thresholds of 300 and more, and counts of 280 and 320, are told apart still."""
    texts = ["static river of the stone"] * 320 + ["public house and a garden"] * 280
    random.Random(7).shuffle(texts)
    rows = corpus(spark, texts).repartition(tasks)
    got = as_dict(frequent.frequent_patterns(rows, 300, 120))
    assert got["static river of the stone"][0] == 320 and {n for n, _ in got.values()} == {320}
    every = scored_by_hand(texts, ["r0", "r1", "r2"], 2)
    got = as_dict(frequent.frequent_patterns(rows, 2, 120, 2500))
    assert {p for p, v in every.items() if v[2] >= 2500} <= set(got) and got.items() <= {p: v[:2] for p, v in every.items()}.items()


@pytest.mark.parametrize("guess", [0, 1, 40, 10**9])
def test_best_are_the_same_with_any_guess(spark, monkeypatch, guess):
    d = corpus(spark, made(8, 120) + ["Stone of the river and the stone"] * 9, ["r0", "r1", "r2"])
    regex = candidates.scored_candidates(d, REGEXES, 3)
    counts = []
    monkeypatch.setattr(ngrams, "likely_score", lambda *_: guess)
    monkeypatch.setattr(ngrams, "frequent_patterns", lambda *a, f=frequent.frequent_patterns: counts.append(a[-1]) or f(*a))
    for n in (5, 40, 100_000):
        want = candidates.top(candidates.merge_results(regex, ngrams.scored_ngrams(d, 3, 2, 3, 3)), n).drop("repo_count").collect()
        counts.clear()
        got = ngrams.best_with(regex, d, n, 3, 2, 3, 3).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
        assert counts[:1] == [guess] and len(counts) <= 2
        if guess == 10**9:  # too high: counted again, by a bound that is sure
            assert 0 < counts[1] <= want[-1].score if n == 5 else counts[1] >= 0


def test_guess_is_of_the_scores_of_all_files(spark, monkeypatch):
    texts = made(9, 400) + ["Stone of the river and the stone"] * 400
    d = corpus(spark, texts, ["r0", "r1", "r2"])
    assert ngrams.likely_score(d, 5) == 0
    monkeypatch.setattr(ngrams, "GUESSED_BY", sum(map(len, texts)) // 8)
    best = sorted((v[2] for v in scored_by_hand(texts, ["r0", "r1", "r2"], 2).values()), reverse=True)[4]
    assert 0.2 * best < ngrams.likely_score(d, 5) < best
    assert ngrams.likely_score(d, 10**6) == 0

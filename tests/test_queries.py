"""Queries against their oracles on the smallest tables, where those are there."""

import math
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
NAMES = ["corpus_extract", "unknown_repo", "invert_ranges", "in_safe_range", "ngram_pass1", "regex_candidates", "mine_patterns", "merge_dictionaries", "compress_templates", "macro_scores", "rebuild_top_n", "repo_threshold_table", "prepare_mix", "stream_prepare", "template_census", "ident_proxy", "bleu4", "bleu4_native", "chrf", "context_index", "expansion_span", "prefix_suffix", "config_analysis", "edit_similarity", "trimmed_reference", "safe_zones", "code_templates", "code_candidates", "prepare_meta", "prepare_eval_only", "stream_prepare_live", "stream_windowed_counts", "measure_compression"]


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_oracle(spark, tables, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = tables.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in got.collect()]
    wanted = [tuple(plain(x) for x in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()]
    assert sorted(rows, key=str) == sorted(wanted, key=str)


def test_every_oracle_has_a_query_and_the_entry_runs(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_preparing_and_measuring_take_every_row(spark, tmp_path):
    rows = [(i, f"Row {i} of the table and the rest of it, in the end a relation of words." * 2, "en", "src5", 0) for i in range(2100)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert __spark_entry__.queries()["stream_prepare"](spark, str(tmp_path)).count() == 2100
    (m,) = __spark_entry__.queries()["measure_compression"](spark, str(tmp_path)).collect()
    assert m.n_files == 2100


def test_merging_cuts_no_channel(spark):
    plan = __spark_entry__.queries()["merge_mining_results"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_the_dictionary_has_statement_templates(spark, tmp_path):
    word = lambda c, i: f"{c}{'abcdefgh'[i % 8]}{'abcdefgh'[i // 8]}"
    rows = [(i, f"Up {word('x', i)} the {word('y', i)} and the {word('z', i)} of X", "en", f"src{i % 3}", 0) for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.kind, r.content) for r in __spark_entry__.queries()["build_dictionary"](spark, str(tmp_path)).collect()}
    assert ("T", "Up {0} the {1} and the {2} of X") in got

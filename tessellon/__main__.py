"""Command line: mine, refilter, measure, repos, merge, prepare, compress, decompress, extract.

A corpus is a folder of files with ``metadata.jsonl`` beside them (``--corpus``), or a parquet table
with doc_id, source, lang and text (``--documents``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.languages import available_languages, get_language
from tessellon.operators import build, codec, dictionary, prepare, reports, scoring
from tessellon.session import local_session, materialise
from tessellon.sources import corpus as src


def _corpus(spark: SparkSession, args) -> DataFrame:
    if args.documents:
        rows = src.documents(spark, args.documents)
    else:
        files = src.read_files(spark, args.corpus, get_language(args.language).source_extensions).withColumn("filename", F.element_at(F.split("path", "/"), -1))
        rows = src.with_repo(files, src.read_metadata(spark, f"{args.corpus}/metadata.jsonl")).select(F.xxhash64("filename").alias("file_id"), "filename", "repo", F.lit(args.language).alias("language"), "content")
    if getattr(args, "exclude_repos", None):
        gone = spark.createDataFrame([(r,) for r in args.exclude_repos], "repo string")
        rows = src.exclude_repos(rows, gone)
    return rows


def _dictionary(spark: SparkSession, args) -> DataFrame:
    if args.dictionary:
        return src.load_dictionary(spark, args.dictionary)
    return dictionary.from_seed(spark, list(get_language(args.language).seeds))


def mine(spark, args):
    entries, _ = build.build_dictionary(_corpus(spark, args), args.language, args.auto, args.min_files, args.min_repos, args.max_entries, args.scores, use_ngrams=not args.no_ngrams, use_templates=not args.no_templates, use_statements=not args.no_statements, seeds=not args.no_seeds, min_frequency=args.min_frequency)
    src.save_dictionary(entries, args.out)
    dictionary.stats(entries).show(50, False)


def refilter(spark, args):
    src.save_dictionary(scoring.refilter(src.load_scores(spark, args.scores), args.min_files, args.max_entries, args.min_repos), args.out)


def _compressed(spark, args, rows=None):
    return build.compress_corpus(rows if rows is not None else _corpus(spark, args), _dictionary(spark, args), args.language)


def measure(spark, args):
    few = reports.sample(_corpus(spark, args), args.sample, args.seed)
    reports.measure(_compressed(spark, args, few), _dictionary(spark, args)).show(truncate=False)


def repos(spark, args):
    spread = materialise(reports.macro_repos(_compressed(spark, args), _dictionary(spark, args)), "spread")
    reports.repo_histogram(spread).orderBy("repo_count").show(100)
    reports.repo_threshold_table(spread).orderBy("threshold").show()
    reports.repo_detail(spread).orderBy("repo_count", "macro").show(50, False)


def merge(spark, args):
    parts = [src.load_dictionary(spark, p) for p in args.inputs]
    out = dictionary.merge(*parts)
    src.save_dictionary(out, args.out)
    print(f"{sum(p.count() for p in parts) - out.count()} entries were in more than one dictionary")


def do_prepare(spark, args):
    eval_repos = args.eval_repos or list(get_language(args.language).eval_repos)
    mixed = materialise(prepare.mix(_compressed(spark, args), eval_repos, args.ratio, args.seed, args.eval_only), "mixed")
    for part in ("train", "eval"):
        if part == "eval" or not args.eval_only:
            src.write_jsonl(mixed.where(F.col("split") == part), f"{args.out}/{part}")
    prepare.meta(mixed, _dictionary(spark, args).count(), args.ratio, args.seed, eval_repos, args.eval_only).coalesce(1).write.mode("overwrite").json(f"{args.out}/meta")


def compress(spark, args):
    _compressed(spark, args).select("file_id", "repo", F.col("compressed").alias("text")).write.mode("overwrite").parquet(args.out)


def decompress(spark, args):
    rows = spark.read.parquet(args.inputs[0])
    rows.withColumn("text", codec.decompressor(_dictionary(spark, args))("text")).write.mode("overwrite").parquet(args.out)


def extract(spark, args):
    lang = get_language(args.language)
    files = src.read_files(spark, args.corpus, lang.source_extensions)
    out = src.extract_files(files, lang.extension, args.min_length, args.max_length, args.max_files, lang.skip_paths)
    out = materialise(out, "files")
    out.write.mode("overwrite").parquet(f"{args.out}/files")
    src.metadata(out).write.mode("overwrite").json(f"{args.out}/metadata")
    src.summary(out).show()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessellon", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=("mine", "refilter", "measure", "repos", "merge", "prepare", "compress", "decompress", "extract"))
    p.add_argument("inputs", nargs="*", help="dictionaries to merge, or a table to decompress")
    p.add_argument("--corpus")
    p.add_argument("--documents")
    p.add_argument("--language", default="python", choices=available_languages())
    p.add_argument("--dictionary")
    p.add_argument("--out")
    p.add_argument("--scores")
    p.add_argument("--auto", action="store_true")
    for flag in ("ngrams", "templates", "statements", "seeds"):
        p.add_argument(f"--no-{flag}", action="store_true")
    for name, default in (("min-files", 0), ("min-repos", 2), ("max-entries", build.MAX_ENTRIES), ("min-frequency", 50), ("sample", 2000), ("seed", 42), ("min-length", 100), ("max-length", 1_000_000), ("max-files", None)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--ratio", type=float, default=prepare.COMPRESS_RATIO)
    p.add_argument("--eval-repos", nargs="*")
    p.add_argument("--exclude-repos", nargs="*")
    p.add_argument("--eval-only", action="store_true")
    args = p.parse_args(argv)
    run = {"prepare": do_prepare}.get(args.command) or globals()[args.command]
    run(spark or local_session(), args)


if __name__ == "__main__":
    main()

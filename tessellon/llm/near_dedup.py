"""SimHash near-duplicate classes by multi-index hashing.

The fingerprint of a text: its words (ASCII lower case) in runs of three, each run hashed by XXH64;
a bit is set if more than half the hashes set it. Two fingerprints within 3 bits agree, but for one
bit at most, in one of their two 32-bit segments. So for each segment a fingerprint's ball of one bit
is enumerated, the fingerprints that hold such a value there are fetched from the segment's table, and
those within 3 bits in all are kept. Only distinct fingerprints are compared: copies are carried by
their least id, so that a group of a thousand copies costs one row here. A dense group never yields
its pairs as rows: each member links to the least class next to it (``fingerprint_classes``), and links
become classes by star contraction.

Defined results: a null or empty text has fingerprint 0, linked like any other; a text of one or two
words is one run; repeated rows each get a result row; a null id stays null, and is never a class id
unless its whole class has null ids; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tune
from .graph import components

SHINGLE, SEED, RADIUS, SEGMENT_BITS = 3, 42, 3, 32
_CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """64-bit SimHash, as a signed integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return int(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64).view(np.int64)[0])
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -SHINGLE] + 1).tolist()]
    ends = ends[SHINGLE - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        part = np.array([h(line[s:e], SEED) for s, e in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK], strict=True)], np.uint64)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def _fingerprints(batches):
    for b in batches:
        fps = pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), fps, *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, fp and the columns ``more`` of every row."""
    tune(docs.sparkSession)
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *more)]
    return docs.select("doc_id", "text", *more).mapInArrow(_fingerprints, ", ".join([kinds[0], "fp long", *kinds[1:]]))


def links(nodes: DataFrame) -> DataFrame:
    """fp, own, least, most: for each fingerprint that has neighbours within 3 bits under another label
    than its own, the least and the largest such label.

    ``nodes``: distinct fingerprints (fp), with a label each, or labelled by themselves. Of two values a
    bit apart in a segment one has the bit set, and the ball that is enumerated clears set bits only: so
    each pair is met from one side, with half the probes, and told to both ends. A pair is folded into
    its ends' rows where it is met; what is shuffled grows with the fingerprints, not with their pairs.
    """
    label = "label" in nodes.columns
    low = (1 << SEGMENT_BITS) - 1
    parts = F.array(F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(low).alias("v")), F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", SEGMENT_BITS).alias("v")))
    held = nodes.select("fp", *["label"] * label, F.explode(parts).alias("p"))
    key = lambda v: v * 2 + F.col("p.seg")
    flips = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << i for i in range(SEGMENT_BITS))]])
    ball = F.explode(F.filter(flips, lambda x: x.bitwiseAND(F.col("p.v")) == x))
    probes = held.select(F.col("fp").alias("pf"), *[F.col("label").alias("pl")] * label, "p", ball.alias("x"))
    probes = probes.select("pf", *["pl"] * label, key(F.col("p.v").bitwiseXOR(F.col("x"))).alias("key"))
    met = probes.join(held.select("fp", *["label"] * label, key(F.col("p.v")).alias("key")).hint("merge"), "key")
    ours, theirs = (F.col("pl"), F.col("label")) if label else (F.col("pf"), F.col("fp"))
    met = met.where((F.bit_count(F.col("pf").bitwiseXOR(F.col("fp"))) <= RADIUS) & (ours != theirs))
    end = lambda n, own, other: F.struct(n.alias("fp"), own.alias("own"), other.alias("other"))
    ends = met.select(F.explode(F.array(end(F.col("pf"), ours, theirs), end(F.col("fp"), theirs, ours))).alias("e")).select("e.*")
    return ends.groupBy("fp", "own").agg(F.min("other").alias("least"), F.max("other").alias("most"))


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """node, component of each fingerprint (fp, distinct) that is linked to another, by rounds.

    In a round each fingerprint links its class to the least neighbouring class. One that has a single
    neighbouring class is then settled, with all its pairs; only pairs of two others are left, and the
    next round compares those alone, as far as their classes still differ. Each class with a neighbour
    merges in each round, so the rounds grow with the logarithm of the classes.
    """
    found, every = materialise(links(fps), "links"), None
    while True:
        edges = found.select(F.col("own").alias("a"), F.col("least").alias("b"))
        every = edges if every is None else every.unionByName(edges)
        known = materialise(components(every), "classes")
        left = found.where(F.col("least") != F.col("most")).select("fp")
        left = left.join(known, left["fp"] == known["node"]).select("fp", F.col("component").alias("label"))
        found = materialise(links(left), "links")
        if found.limit(1).count() == 0:
            return known


def _classes(reps: DataFrame, least: str) -> DataFrame:
    """fp, ``least``: for each fingerprint the least of that column over its class."""
    known = fingerprint_classes(reps.select("fp"))
    members = known.join(reps, known["node"] == reps["fp"]).select("fp", "component", least)
    firsts = members.groupBy("component").agg(F.min(least).alias("_first"))
    linked = members.join(firsts, "component").select(F.col("fp").alias("_fp"), "_first")
    return reps.join(linked, reps["fp"] == linked["_fp"], "left").select("fp", F.when(F.col("_fp").isNull(), F.col(least)).otherwise(F.col("_first")).alias(least))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs``."""
    rows = materialise(fingerprints(docs), "fingerprints")
    reps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "representatives")
    # Written first: the join is then dealt anew on both sides, and a common fingerprint's rows can be split.
    classes = materialise(_classes(reps, "component_id"), "by_fingerprint")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one of each class left: the one of least id (nulls last), ties by the text's
    hash, then by the hash of the other columns. Rows are told apart by all three, so rows that share an
    id, or have none, stay apart if their texts do; of rows alike in every column one stays."""
    others = F.to_json(F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], F.col("text").isNull().alias("_null")))
    hashed = docs.withColumn("_text_md5", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))).withColumn("_rest_md5", F.unhex(F.md5(others.cast("binary"))))
    rows = fingerprints(hashed, "_text_md5", "_rest_md5").groupBy("fp", "doc_id", "_text_md5", "_rest_md5").agg(F.count("*").alias("_n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text_md5", "_rest_md5", "_n")
    reps = materialise(rows.groupBy("fp").agg(F.min(order).alias("first")), "representatives")
    first = materialise(_classes(reps, "first").select("first.*").distinct().toDF("_none", "_id", "_text", "_rest", "_n"), "first")
    same = hashed["doc_id"].eqNullSafe(first["_id"]) & (hashed["_text_md5"] == first["_text"]) & (hashed["_rest_md5"] == first["_rest"])
    alone = hashed.join(first.where("_n = 1"), same, "left_semi").select(*docs.columns)
    alike = hashed.join(first.where("_n > 1"), same, "left_semi").dropDuplicates(["doc_id", "_text_md5", "_rest_md5"])
    return alone.unionByName(alike.select(*docs.columns))

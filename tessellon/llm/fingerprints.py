"""Document fingerprints: SimHash of weighted terms, and permuted block tables. DataFrame operations
only.

Terms are a text's distinct words, lower case, each weighed by its length, so that short common words
count little. A term's 64-bit hash votes with its weight for every bit that it sets and against every
bit that it does not. Two votes are summed in one long (bits k and k + 32), so 32 sums make a
fingerprint; a lane holds any text, since the weights of distinct words add up to its length at most.

Fingerprints within ``RADIUS`` bits: 64 bits are cut into 6 blocks, of which 3 bits can spoil 3; so
two such fingerprints agree on 3 blocks at least, and each of the 20 choices of 3 blocks makes a
table keyed by them. Candidates that share a key are verified over all 64 bits, and a pair counts in the
first table that it shares, so that dense groups are counted without a row for each pair.

Defined results: a null text counts as empty; an empty text has fingerprint 0; rows without an id
come first in the order, rows with equal ids follow one another by text hash; one document alone is
its own successor; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BITS, RADIUS, BLOCKS, SHARED = 64, 3, (11, 11, 11, 11, 10, 10), 3
BUCKET_ROWS, MOST_BUCKETS = 2000, 16_384
_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), r"[\x20\x09-\x0D]+"))


def _vote_sums(term: Column) -> list[Column]:
    """Of exploded terms: the sum of weights and 32 sums of two lanes each."""
    h, w = F.xxhash64(term), F.coalesce(F.length(term), F.lit(0)).cast("long")
    return [F.sum(w).alias("_w"), *(F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)) * w).alias(f"_s{k}") for k in range(32))]


def _from_sums() -> Column:
    """The fingerprint from the sums: a bit is set if its votes outweigh those against it."""
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"_s{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_s{k}"), 32)
        for bit, votes in ((k, low), (k + 32, high)):
            value = (1 << bit) - (1 << 64) * (bit == 63)
            fp = fp.bitwiseOR(F.when(2 * votes > F.col("_w"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fp of every row. ``keys`` name the row; where ``docs`` are partitioned by some of
    them already, nothing is shuffled."""
    words = docs.select(*keys, F.explode_outer(terms(F.coalesce(F.col(text), F.lit("")))).alias("_t"))
    return words.groupBy(*keys).agg(*_vote_sums(F.col("_t"))).select(*keys, _from_sums().alias("fp"))


def _cuts(docs: DataFrame) -> tuple[list[int], DataFrame]:
    """Ids that cut the documents into buckets of about ``BUCKET_ROWS`` rows, ``MOST_BUCKETS`` at most, and
    hid, pieces of the ids (null too) that would overfill a bucket alone. Such an id starts a bucket."""
    n = docs.count()
    size = max(BUCKET_ROWS, -(-n // MOST_BUCKETS))
    hot = docs.groupBy("doc_id").count().where(F.col("count") > size)  # fewer than MOST_BUCKETS
    hot = materialise(hot.select(F.col("doc_id").alias("hid"), F.ceil(F.col("count") / size).cast("int").alias("pieces")), "hot")
    parts = -(-n // size)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    return sorted({*(cuts or []), *(r.hid for r in hot.collect() if r.hid is not None)}), hot


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many bounds lie at or under the id, wide steps first, then the narrow ones; -1 for no id."""
    if not bounds:
        return F.when(doc_id.isNull(), -1).otherwise(0)
    step = max(16, math.isqrt(len(bounds)))
    wide = [bounds[i] for i in range(0, len(bounds), step)]
    coarse = F.size(F.filter(F.array(*map(F.lit, wide)), lambda x: x <= doc_id))
    parts = F.array(*[F.array(*map(F.lit, bounds[i : i + step])) for i in range(0, len(bounds), step)])
    fine = F.size(F.filter(F.element_at(parts, F.greatest(coarse, F.lit(1))), lambda x: x <= doc_id))
    return F.when(doc_id.isNull(), -1).when(coarse == 0, 0).otherwise((coarse - 1) * step + fine)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, _b, _guest, _h, so that the rows of a bucket ``_b`` in order of (_guest, doc_id,
    _h) have each row's successor behind it: a bucket's first row is a guest at the end of the bucket
    before (of the last one, for the first). The rows of an id that many share, or of none, are dealt
    to buckets of their own by ranges of the text hash that orders them."""
    bounds, hot = _cuts(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text", F.lit(1)))
    rows = rows.join(F.broadcast(hot), rows["doc_id"].eqNullSafe(hot["hid"]), "left")  # fewer rows than MOST_BUCKETS
    piece = F.floor((F.shiftright("_h", 1) + F.lit(1 << 62)) / F.lit(float(1 << 63)) * F.col("pieces")).cast("long")
    piece = F.when(F.col("pieces").isNull(), F.lit(1 << 30).cast("long")).otherwise(F.least(piece, F.col("pieces").cast("long") - 1))
    rows = rows.select("doc_id", "text", "_h", ((_bucket(F.col("doc_id"), bounds).cast("long") + 1) * F.lit(1 << 31) + piece).alias("_b"))
    first = materialise(rows.groupBy("_b").agg(F.min(F.struct("doc_id", "_h")).alias("_m")), "firsts")
    # One row for each bucket, and so some MOST_BUCKETS of them.
    all_, by = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("_b")
    host = first.select(F.col("_b").alias("_fb"), F.col("_m.doc_id").alias("_fid"), F.col("_m._h").alias("_fh"), F.coalesce(F.lag("_b").over(by), F.max("_b").over(all_)).alias("_host"))
    met = rows.join(F.broadcast(host), (rows["_b"] == host["_fb"]) & rows["doc_id"].eqNullSafe(host["_fid"]) & (rows["_h"] == host["_fh"]), "left")
    stays = F.struct(F.col("_b").alias("_b"), F.lit(0).alias("_guest"))
    goes = F.struct(F.col("_host").alias("_b"), F.lit(1).alias("_guest"))
    places = F.when(F.col("_host").isNull(), F.array(stays)).otherwise(F.array(stays, goes))
    return met.select("doc_id", "text", "_h", F.explode(places).alias("_p")).select("doc_id", "text", "_h", "_p._b", "_p._guest")


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp of every row, in one shuffle of the texts."""
    order = Window.partitionBy("_b").orderBy("_guest", "doc_id", "_h")
    rows = in_order(docs).withColumn("_rn", F.row_number().over(order)).withColumn("_next", F.coalesce(F.lead("text").over(order), F.lit("")))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("_edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next", F.lit(1), cut)))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("_edited").cast("binary"), 256))
    keys = ["_b", "_guest", "_rn", "doc_id", "n_chars", "edited_sha256"]
    both = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("_edited").alias("t"))))
    parts = rows.select(*keys, both.alias("_v")).select(*keys, "_v.which", "_v.t")
    fps = simhash(parts, [*keys, "which"], "t")
    one = fps.groupBy(*keys).agg(*(F.max(F.when(F.col("which") == i, F.col("fp"))).alias(c) for i, c in enumerate(("fp", "edited_fp"))))
    out = one.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("_b").orderBy("_rn")))
    return out.where("_guest = 0").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _met(fps: DataFrame, radius: int, *more: str) -> DataFrame:
    """fa, fb and ``more`` (of a and of b) of each pair of distinct fingerprints (column fp) within ``radius``
    bits, met once: in the first of the tables whose blocks agree."""
    if not 0 <= radius <= len(BLOCKS) - SHARED:
        raise ValueError(f"radius must be 0 to {len(BLOCKS) - SHARED}")
    starts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    signed = lambda m: F.lit(m - (1 << 64) * (m >> 63)).cast("long")
    blocks = [((1 << size) - 1) << at for size, at in zip(BLOCKS, starts, strict=True)]
    choices = list(combinations(range(len(BLOCKS)), SHARED))
    keyed = fps.select("fp", *more, F.posexplode(F.array(*[F.col("fp").bitwiseAND(signed(sum(blocks[i] for i in some))) for some in choices])).alias("table", "key"))
    left, right = (keyed.select(F.col("fp").alias(f"f{x}"), *[F.col(c).alias(f"{c}_{x}") for c in more], "table", "key") for x in "ab")
    near = left.join(right, ["table", "key"]).withColumn("_x", F.col("fa").bitwiseXOR(F.col("fb"))).where((F.col("fa") < F.col("fb")) & (F.bit_count("_x") <= radius))
    # Which blocks agree, as six bits; for each such set, the first table that all of its blocks make.
    first = [next((i for i, some in enumerate(choices) if all(agree >> k & 1 for k in some)), -1) for agree in range(1 << len(BLOCKS))]
    agree = sum((F.when(F.col("_x").bitwiseAND(signed(m)) == 0, 1 << i).otherwise(0) for i, m in enumerate(blocks)), F.lit(0))
    near = near.where(F.get(F.array(*map(F.lit, first)), agree) == F.col("table"))
    return near.select("fa", "fb", *[f"{c}_{x}" for c in more for x in "ab"])


def neighbours(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs fa < fb of distinct fingerprints (column fp) within ``radius`` bits (3 at most)."""
    return _met(fps, radius)


def near_counts(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, n_near: how many other rows (column fp) lie within ``radius`` bits. Copies are counted, not
    compared, and pairs are summed for their ends where they are met: no pair is shuffled."""
    kinds = materialise(rows.groupBy("fp").agg(F.count("*").alias("n")), "kinds")
    ends = F.explode(F.array(F.struct(F.col("fa").alias("f"), F.col("n_b").alias("n")), F.struct(F.col("fb").alias("f"), F.col("n_a").alias("n"))))
    more = _met(kinds, radius, "n").select(ends.alias("e")).groupBy(F.col("e.f").alias("fa")).agg(F.sum("e.n").alias("more"))
    return kinds.join(more, kinds["fp"] == more["fa"], "left").select("fp", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_near"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near."""
    rows = materialise(with_edits(docs), "edits")
    # Written first: the join is then dealt anew on both sides, and a common fingerprint's rows can be split.
    counts = materialise(near_counts(rows.select("fp")), "counts")
    return rows.join(counts, "fp").select(
        "doc_id", "n_chars", "edited_sha256", hex_of(F.col("fp")).alias("fingerprint"), hex_of(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near",
    )

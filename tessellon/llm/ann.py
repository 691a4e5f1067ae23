"""Approximate nearest neighbours by a permutation index.

A vector is known by the order of the pivots by nearness. It is posted in the inverted files of its
``POSTED`` nearest pivots; a query opens the files of its ``OPENED`` nearest ones, ranks the postings
by the footrule distance between the two pivot orders, and reranks a file's nearest ``KEEP`` by cosine
in double precision. A query meets a vector once: in the file of the vector's nearest pivot that it opens.

Pivots: at most ``PIVOTS`` valid vectors of least id hash (a bounded sample); every vector is indexed.
A file is cut into blocks of about ``BLOCK`` postings by id hash, and the queries that open it into
blocks of about ``ASKED``, so that a pivot that draws a third of all vectors makes many blocks, not
one large task. Each block keeps ``KEEP``, so a query computes at most ``OPENED * KEEP`` = 1024 cosines
while files are single blocks (some 500,000 vectors), whatever their number, and one share of that more
for each block beyond. The files opened and the postings kept make the search approximate; the README
has recall and comparisons. On random vectors, which have no near neighbours to speak of, the postings
met stay near two thirds of all.

Queries are the rows whose id is divisible by ``EVERY``. Defined results: vectors that are null,
empty, zero, or hold null or non-finite components take no part, nor do vectors of a length other
than the pivots' commonest; null ids take no part; ties go to the smaller id; with no more candidates
than asked for, all found are returned; rows that repeat an id are one vector, the least of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.session import ship

from .common import materialise

PIVOTS, POSTED, OPENED, KEEP = 256, 4, 64, 16
BLOCK, ASKED, EVERY, K = 8192, 2048, 50, 5


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    good = F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(good, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min(v).alias("v"))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` unit vectors: the only rows that reach the driver."""
    got = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    if not got:
        return np.zeros((0, 1))
    sizes = [len(v) for v in got]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    return _unit(np.array([v for v in got if len(v) == size]))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of each row of x with q, of the vectors as they are; those whose products leave the range
    of doubles are scaled first."""
    with np.errstate(all="ignore"):
        dot, size = np.einsum("ij,j->i", x, q), np.einsum("ij,ij->i", x, x) * np.einsum("i,i->", q, q)
        out = dot / np.sqrt(size)
    lost = ~(np.isfinite(out) & (size > 1e-200) & (size < 1e200))
    if lost.any():
        out[lost] = np.einsum("ij,j->i", _unit(x[lost]), _unit(q[None])[0])
    return out


def _place_type(pivots: int) -> type:
    return np.uint8 if pivots <= 256 else np.uint16


def orders(rows: DataFrame, pivots: np.ndarray, opened: int = OPENED) -> DataFrame:
    """vec_id, v, its nearest pivots in order (as many as a query opens), and each pivot's place in
    the whole order, a byte each (two of more than 256 pivots)."""
    size, kind = pivots.shape[1], _place_type(len(pivots))

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(np.asarray(b.column(1).value_lengths()) == size))
            if not b.num_rows:
                continue
            x = _unit(np.asarray(b.column(1).flatten()).reshape(-1, size))
            near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")
            place = np.empty(near.shape, kind)
            place[np.arange(len(near))[:, None], near] = np.arange(near.shape[1], dtype=kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(near[:, :max(opened, POSTED)].astype(np.int32)), pa.list_(pa.int32())), pa.array([p.tobytes() for p in place], pa.binary())], ["vec_id", "v", "near", "place"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, v array<double>, near array<int>, place binary")


def _footrule(places: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Footrule distance of one order to each row of ``places``. Orders of up to 256 pivots are at most
    32,768 apart, so that sixteen bits hold the sum."""
    if places.dtype == np.int16:
        return np.abs(places - place).view(np.uint16).sum(1, dtype=np.uint16)
    return np.abs(places - place).sum(1, dtype=np.int64)


def _ranked(asked: pa.Table, posts: pa.Table, k: int, keep: int = KEEP, opened: int = OPENED, kind: type = np.uint8):
    """For each query of a block: the block's nearest postings by footrule, reranked by cosine. A vector
    whose earlier posts stand in files that the query opens too is left to the first of those."""
    by = np.argsort(np.asarray(posts.column("vec_id")), kind="stable")  # ties in footrule go to smaller ids
    ids = np.asarray(posts.column("vec_id"))[by]

    def matrix(t):
        return np.asarray(t.column("v").combine_chunks().flatten()).reshape(t.num_rows, -1)

    def places(t):
        return np.frombuffer(b"".join(t.column("place").to_pylist()), kind).reshape(t.num_rows, -1).astype(np.int32 if kind == np.uint16 else np.int16)

    x, q, px, pq = matrix(posts)[by], matrix(asked), places(posts)[by], places(asked)
    # The pivots of a vector's earlier posts, -1 where there are none: the last place of ``open_``, never set.
    earlier = np.full((len(ids), POSTED), -1)
    for row, pivots in zip(earlier, posts.column("earlier").take(by).to_pylist(), strict=True):
        row[: len(pivots)] = pivots
    for j, query in enumerate(asked.column("vec_id").to_pylist()):
        open_ = np.append(pq[j] < opened, False)
        mine = np.flatnonzero(~open_[earlier].any(1) & (ids != query))
        if keep < len(mine):
            far = _footrule(px[mine], pq[j])
            edge = np.partition(far, keep - 1)[keep - 1]
            mine = mine[np.concatenate([np.flatnonzero(far < edge), np.flatnonzero(far == edge)])[:keep]]
        cosine = _cosines(x[mine], q[j])
        top = np.lexsort((ids[mine], -cosine))[:k]
        yield from zip([query] * len(top), ids[mine][top].tolist(), cosine[top].tolist(), strict=True)


def search(vectors: DataFrame, every: int = EVERY, k: int = K, pivots: int = PIVOTS, opened: int = OPENED, keep: int = KEEP) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest found."""
    ship(vectors.sparkSession)
    rows = materialise(valid(vectors), "vectors")
    chosen = choose_pivots(rows, pivots)
    places = _place_type(len(chosen))
    index = materialise(orders(rows, chosen, opened), "orders")
    posts = index.select("vec_id", "v", "place", "near", F.posexplode(F.slice("near", 1, POSTED)).alias("post", "pivot"))
    posts = posts.withColumn("earlier", F.slice("near", F.lit(1), F.col("post"))).drop("near", "post")
    asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "v", "place", F.explode(F.slice("near", 1, opened)).alias("pivot"))
    counts = posts.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nx")).join(asked.groupBy("pivot").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("nq")), "pivot")
    counts = F.broadcast(counts)  # a row a pivot
    posts = posts.join(counts, "pivot").select("vec_id", "v", "place", "earlier", "pivot", F.pmod(F.xxhash64("vec_id"), F.col("nx")).cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("bq"))
    asked = asked.join(counts, "pivot").select("vec_id", "v", "place", "pivot", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"), F.pmod(F.xxhash64("vec_id"), F.col("nq")).cast("int").alias("bq"))
    asked = asked.toDF(*[f"q_{c}" for c in asked.columns])
    key = ["pivot", "bx", "bq"]

    def rank(asked_: pa.Table, posts_: pa.Table) -> pa.Table:
        asked_ = asked_.rename_columns([c.removeprefix("q_") for c in asked_.column_names])
        found = list(_ranked(asked_, posts_, k, keep, opened, places)) if asked_.num_rows and posts_.num_rows else []
        cols = list(zip(*found, strict=True)) or [[], [], []]
        ids = posts_.schema.field("vec_id").type
        return pa.table([pa.array(cols[0], ids), pa.array(cols[1], ids), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    found = asked.groupBy(*[f"q_{c}" for c in key]).cogroup(posts.groupBy(*key)).applyInArrow(rank, f"query_id {kind}, vec_id {kind}, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

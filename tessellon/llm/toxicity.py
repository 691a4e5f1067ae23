"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words, lower case and without marks around them, and the first four and
five letters of longer words, hashed to 2^20 places. A second-order factorization machine scores the
terms that are present: a weight for each, and for each pair the product of two learned vectors, so
that an insult beside a group mention can count for more than both alone. Words that no training text
held add nothing.

Training: labelled rows with crc32(doc_id) mod 5 <> 0, at most ``SAMPLE`` of them, those of least hash,
with at most ``SAMPLE_TERMS`` terms in all (documented bounds; they do not grow with the input). Two
kinds of places take part: those whose share differs between the classes by ``LEAST_Z`` standard errors,
the ``TERMS`` most telling at most; and, ``PAIR_TERMS`` at most, those of pairs of the ``PAIRED``
commonest places whose meeting tells the classes apart by ``PAIR_Z`` standard errors and by
``PAIR_MORE`` more than either place alone (figures with other bounds are in the README). So a word that says nothing by itself takes part where its company says something.
Labels, language, source and id are never inputs of a score.

Defined results: a null text counts as empty and scores the model's bias; repeated rows each get a
row; a null id counts as held out; repeated labels of an id count once, toxic if any is; null labels
do not count; with no labels at all every score is 0.25.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, tune

SAMPLE, SAMPLE_TERMS, TERMS, PAIR_TERMS, FACTORS, PLACES, STEPS = 16_000, 32_000_000, 1024, 64, 8, 1 << 20, 3000
LEAST_SEEN, LEAST_Z, PAIRED, PAIR_Z, PAIR_MORE = 5, 4.0, 2048, 6.0, 2.0
FOLDS, HELD_OUT = 5, 0
_MARKS = ".,;:!?\"'()[]{}<>|*_-#$&~`"
_MEMO = 100_000


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def word_terms(word: str) -> tuple[int, ...]:
    """Places of a word's terms."""
    word = word.strip(_MARKS)
    if not word:
        return ()
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % PLACES for x in ([word] if len(word) <= 4 else [word, word[:4] + "*"] if len(word) == 5 else [word, word[:4] + "*", word[:5] + "*"]))


class Memo(dict):
    """Word -> what ``make`` makes of it, of bounded size."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= _MEMO:
            self.clear()
        out = self[word] = self.make(word)
        return out


def _sampled_terms(batches):
    memo = Memo(word_terms)
    for b in batches:
        out = []
        for text in b.column(1).to_pylist():
            found: set[int] = set()
            for w in set((text or "").lower().split()):
                found.update(memo[w])
            out.append(np.fromiter(sorted(found), np.int32, len(found)).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.binary())], ["toxic", "key", "terms"])


class Machine:
    """Bias, weights and vectors over the places that take part."""

    def __init__(self, places: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.at = {int(p): i for i, p in enumerate(places)}
        self.bias, self.w, self.v = bias, w, v

    def memo(self) -> Memo:
        return Memo(lambda word: tuple(self.at[p] for p in word_terms(word) if p in self.at))

    def score(self, text: str | None, memo: Memo) -> float:
        found: set[int] = set()
        for w in set((text or "").lower().split()):
            if hit := memo[w]:
                found.update(hit)
        z = self.bias
        if found:
            x = sorted(found)
            v = self.v[x]
            z += float(self.w[x].sum()) + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _gaps(in_pos: np.ndarray, in_all: np.ndarray, pos: float, n: int) -> np.ndarray:
    """By how many standard errors shares differ between the classes."""
    p = in_all / n
    return np.abs(in_pos / pos - (in_all - in_pos) / (n - pos)) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / pos + 1 / (n - pos)))


def _telling_pairs(flat: np.ndarray, row: np.ndarray, toxic: np.ndarray, in_all: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose meeting with another tells more of the class than either alone, and by how much: of
    the ``PAIRED`` places in most rows, every pair is counted in both classes."""
    n, pos = len(toxic), float(toxic.sum())
    common = np.lexsort((np.arange(PLACES), -in_all))[:PAIRED]
    common = common[in_all[common] >= LEAST_SEEN]
    common = common[in_all[common] < n]  # what stands in every row makes no pair
    if len(common) < 2:
        return np.zeros(0, np.int64), np.zeros(0)
    where = np.full(PLACES, -1, np.int32)
    where[common] = np.arange(len(common))
    at = where[flat]
    counts = []
    for rows in (np.flatnonzero(toxic), np.flatnonzero(~toxic)):
        total = np.zeros((len(common), len(common)), np.float32)
        place = np.full(n, -1, np.int64)
        place[rows] = np.arange(len(rows))
        keep = (at >= 0) & (place[row] >= 0)
        r, c = place[row[keep]], at[keep]
        for i in range(0, len(rows), 2048):
            x = np.zeros((min(2048, len(rows) - i), len(common)), np.float32)
            part = (r >= i) & (r < i + 2048)
            x[r[part] - i, c[part]] = 1
            total += x.T @ x
        counts.append(total)
    both = counts[0] + counts[1]
    z = _gaps(counts[0], both, pos, n)
    alone = gap[common]
    good = (both >= LEAST_SEEN) & (z >= PAIR_Z) & (z >= np.maximum(alone[:, None], alone[None, :]) + PAIR_MORE)
    np.fill_diagonal(good, False)
    best = np.where(good, z, 0).max(1)
    return common[best > 0], best[best > 0]


def fit(toxic: np.ndarray, terms: list[np.ndarray], rounds: int = 25, batch: int = 256, rate: float = 0.05, penalty: float = 3e-4) -> Machine:
    """Logistic loss by Adam over shuffled batches, averaged over the second half; the same rows give the
    same machine. Few rows are gone through more often, so that there are ``STEPS`` steps at least."""
    n, y = len(toxic), np.asarray(toxic, np.float32)
    pos = float(y.sum())
    prior = (pos + 0.5) / (n + 2)
    bias = float(np.log(prior / (1 - prior)))
    none = Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < pos < n:
        return none
    sizes = [len(t) for t in terms]
    flat, row = np.concatenate(terms), np.repeat(np.arange(n, dtype=np.int32), sizes)
    in_pos = np.bincount(np.concatenate([t for t, label in zip(terms, toxic, strict=True) if label > 0]), minlength=PLACES)
    in_all = np.bincount(flat, minlength=PLACES)
    gap = _gaps(in_pos, in_all, pos, n)
    alone = np.flatnonzero((in_all >= LEAST_SEEN) & (gap >= LEAST_Z))
    met, pair_gap = _telling_pairs(flat, row, np.asarray(toxic) > 0, in_all, gap)
    alone = alone[np.lexsort((alone, -gap[alone]))][:TERMS]
    new = ~np.isin(met, alone)
    met = met[new][np.lexsort((met[new], -pair_gap[new]))][:PAIR_TERMS]
    places = np.concatenate([alone, met])
    if not len(places):
        return none
    where = np.full(PLACES, -1, np.int32)
    where[places] = np.arange(len(places))
    keep = where[flat] >= 0
    x = np.zeros((n, len(places)), np.uint8)
    x[row[keep], where[flat[keep]]] = 1
    del flat, row, keep
    dice = np.random.default_rng(7)
    params = [np.array([bias], np.float32), np.zeros(len(places), np.float32), dice.normal(0, 0.01, (len(places), FACTORS)).astype(np.float32)]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    mean, rounds = [np.zeros_like(p) for p in params], max(rounds, -(-STEPS // -(-n // batch)))
    for done in range(rounds):
        order = dice.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            a, (b, w, v) = x[rows].astype(np.float32), params
            av = a @ v
            z = b[0] + a @ w + 0.5 * ((av * av).sum(1) - a @ (v * v).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            ga = a.T @ g
            grads = [np.array([g.sum()], np.float32), ga + penalty * w, a.T @ (g[:, None] * av) - v * ga[:, None] + penalty * v]
            step += 1
            for p, d, m1, m2 in zip(params, grads, m, s, strict=True):
                m1 += 0.1 * (d - m1)
                m2 += 0.001 * (d * d - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        if done >= rounds // 2:  # the mean over the second half of the rounds
            for total, p in zip(mean, params, strict=True):
                total += p / (rounds - rounds // 2)
    return Machine(places, float(mean[0][0]), mean[1].astype(np.float64), mean[2].astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine fit on a bounded sample of the labelled rows outside the held-out fold."""
    tune(docs.sparkSession)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), (F.col("_toxic") > 0).cast("int").alias("_toxic"))
    texts = docs.select("doc_id", "text")
    rows = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"])  # at most ``sample`` rows are sent
    rows = rows.select("_toxic", "text", F.xxhash64("doc_id", "text").alias("key")).dropDuplicates(["key"])
    rows = materialise(rows.mapInArrow(_sampled_terms, "toxic int, key long, terms binary"), "training")
    sizes = rows.select("key", (F.length("terms") / 4).cast("long").alias("n")).orderBy("key").limit(sample).toArrow()
    if not sizes.num_rows:
        return fit(np.zeros(0), [])
    fits = np.cumsum(sizes.column("n").to_numpy()) <= SAMPLE_TERMS
    last = sizes.column("key")[max(int(fits.sum()) - 1, 0)].as_py()
    got = rows.where(F.col("key") <= last).select("toxic", "terms").toArrow()
    drop(rows)
    terms = [np.frombuffer(t, np.int32) for t in got.column("terms").to_pylist()]
    toxic = got.column("toxic").to_numpy()
    del got
    order = sorted(range(len(terms)), key=lambda i: (int(toxic[i]), zlib.crc32(terms[i].tobytes()), len(terms[i])))  # whatever the order of partitions
    return fit(toxic[order], [terms[i] for i in order])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for each row."""
    tune(docs.sparkSession)

    def run(batches):
        memo = machine.memo()
        for b in batches:
            p = [machine.score(t, memo) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], ["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that score under one half, all columns kept."""
    tune(docs.sparkSession)
    spot = docs.columns.index("text")

    def run(batches):
        memo = machine.memo()
        for b in batches:
            yield b.filter(pa.array([machine.score(t, memo) < 0.5 for t in b.column(spot).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

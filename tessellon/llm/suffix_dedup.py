"""Suffix-array dedup: removes each byte that a ``LENGTH``-byte string covers which also starts in a
document of smaller id.

Sorting every suffix of the corpus would move many times the corpus. Instead:

1. Every window of 50 bytes names an anchor: the 32-byte string in it that the least hashed 13-byte
   string points to, so equal windows have equal anchors. Anchors are counted by least and largest document id; those of one
   document only cannot take part in a repeat.
2. The windows of one anchor occurrence in a row make a segment of 50 to 68 bytes. Anchors all of
   whose segments are the same text are settled by the least id.
3. The segments of the other anchors go to a partition by anchor, where a suffix array over them is
   built by two-stage sorting (``suffix_order``): suffixes smaller than their successors are sorted
   directly, the rest induced by bucket scans. Adjacent common prefixes of 50 bytes and more are runs
   of equal windows, and each run has a least document id.
4. Every occurrence learns from its segment which of its windows occur in a smaller document.

Which anchors matter is told to the scans by bit filters of bounded size (``FILTER_BITS``); they may
let more through, never less, and what they let through is settled by the joins. Where there are too
many anchors for a filter, each document is told its own: (anchor, document) pairs are semi-joined
with the anchors that matter and go to their document as a list (``_told_by_list``). An anchor with more than
``HOT`` different segments is not sorted in one task: its windows are grouped by 128-bit hash.

Defined results: a null text is empty, a text under 50 bytes keeps all; rows with a null id take no
part and keep all; rows of equal id are compared to smaller ids only, never to each other; repeated
rows each get a row; ids must be integers; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise, tune

LENGTH, ANCHOR, POINTER = 50, 32, 13
STEP = LENGTH - ANCHOR + 1
CHUNK_BYTES = 1 << 16
FILTER_BITS, SLICES, BITS_A_KEY, LEAST_BITS_A_KEY = 1 << 29, 64, 16, 8
HOT, TASK_BYTES = 4096, 1 << 20


# ---- anchors ----


def _chunk_anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    data, sizes = b"".join(texts), np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    m = n - POINTER + 1
    words = np.ndarray((n - 7,), np.uint64, data, strides=(1,))
    least = words[:m] * np.uint64(0x9E3779B97F4A7C15)
    least ^= least >> np.uint64(32)
    least += words[POINTER - 8 : POINTER - 8 + m]
    least *= np.uint64(0xC2B2AE3D27D4EB4F)
    # The place in the low half: of equal hashes the leftmost is least, whatever stands around.
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(m, dtype=np.uint64)
    width, span = LENGTH - POINTER + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    whole = np.ones(n, bool)
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):  # windows that leave their text
        whole[max(end - size, end - LENGTH + 1) : end] = False
    start = np.flatnonzero(whole[: len(least)])
    if not len(start):
        return none, none, none, none
    off = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64) - start
    place = start + off - STEP * (off >= STEP)
    text = np.searchsorted(ends, start, side="right")
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    at, text = place[new], text[new]
    h = words[at] * np.uint64(0x9E3779B97F4A7C15)
    for i in (8, 16, 24):
        h ^= h >> np.uint64(29)
        h += words[at + i]
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    base = (ends - sizes)[text]
    last = start[np.concatenate([new[1:], [len(start)]]) - 1]
    return text, (h >> np.uint64(1)).astype(np.int64), start[new] - base, last - base


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of each anchor occurrence: which text, its hash, the first and last window that name it."""
    out, held, size, base = [], [], 0, 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            text, h, first, last = _chunk_anchors(held)
            out.append((text + base, h, first, last))
            held, size, base = [], 0, i + 1
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _encoded(column) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in column.to_pylist()]


def _anchor_ranges(batches):
    """h, lo, hi: the batch's anchors with their least and largest document id."""
    for b in batches:
        text, h, _, _ = anchors(_encoded(b.column(1)))
        if not len(h):
            continue
        d = b.column(0).to_numpy()[text]
        by = np.argsort(h, kind="stable")
        h, d = h[by], d[by]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(np.minimum.reduceat(d, at)), pa.array(np.maximum.reduceat(d, at))], ["h", "lo", "hi"])


# ---- filters of bounded size ----


def _places(h: np.ndarray, per: int) -> list[np.ndarray]:
    h = h.astype(np.uint64)
    mix = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(35)
    return [(x & np.uint64(per - 1)).astype(np.int64) for x in (h >> np.uint64(6), h >> np.uint64(30), mix)]


class BitFilter:
    """Three bits for a key, in the slice that its lowest bits name."""

    def __init__(self, slices: dict[int, bytes], per: int):
        self.per = per
        self.bits = np.concatenate([np.frombuffer(slices.get(i, bytes(per // 8)), np.uint8) for i in range(SLICES)])

    def holds(self, h: np.ndarray) -> np.ndarray:
        base = (h & (SLICES - 1)) * self.per
        out = np.ones(len(h), bool)
        for p in _places(h, self.per):
            at = base + p
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


def bit_filter(keys: DataFrame) -> BitFilter | None:
    """A filter of the column h, each slice built by a task; None if the keys are too many for it."""
    n = keys.count()
    if n * LEAST_BITS_A_KEY > FILTER_BITS:
        return None
    per = 1024
    while per * SLICES < min(FILTER_BITS, n * BITS_A_KEY):
        per *= 2

    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bits = np.zeros(per, bool)
        for p in _places(rows.column("h").to_numpy(), per):
            bits[p] = True
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    got = keys.select("h", F.col("h").bitwiseAND(SLICES - 1).cast("int").alias("slice")).groupBy("slice").applyInArrow(build, "slice int, bits binary").toArrow()
    return BitFilter(dict(zip(got.column("slice").to_pylist(), got.column("bits").to_pylist(), strict=True)), per)


# ---- occurrences ----


def _rows(docs: DataFrame) -> DataFrame:
    """id, key, text of rows that take part. Where ids repeat, key tells their rows apart by text."""
    key = F.xxhash64(F.coalesce("text", F.lit(""))) if _repeats(docs) else F.lit(0).cast("long")
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), key.alias("key"), "text")


def _repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def _anchor_pairs(batches):
    """h, id, key: each text's anchors, once."""
    for b in batches:
        text, h, _, _ = anchors(_encoded(b.column(2)))
        if len(h):
            by = np.lexsort((h, text))
            text, h = text[by], h[by]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
            yield pa.RecordBatch.from_arrays([pa.array(h[new]), *(pa.array(b.column(i).to_numpy()[text[new]]) for i in range(2))], ["h", "id", "key"])


def _told_by_list(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows that hold anchors of ``keys``, with those as a list. Rows that share id and key share
    their text."""
    pairs = rows.mapInArrow(_anchor_pairs, "h long, id long, key long").join(keys.select("h"), "h", "left_semi")
    lists = pairs.groupBy("id", "key").agg(F.collect_set("h").alias("hs"))
    return rows.join(lists, ["id", "key"]).select("id", "key", "text", "hs")


def _listed(column, text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which anchors are in their text's list."""
    on = np.zeros(len(h), bool)
    cuts = np.searchsorted(text, np.arange(len(column) + 1))
    for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if z > a:
            on[a:z] = np.isin(h[a:z], column[i].values.to_numpy())
    return on


def occurrences(rows: DataFrame, keys: DataFrame, told: BitFilter | None, texts: bool) -> DataFrame:
    """h, sid, id of the segments of the anchors in ``keys``; with ``texts`` also their bytes (seg),
    else key and at: 128 times the first window and the number of windows behind it. sid is a hash
    of the bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(told)

    def run(batches):
        known = shared.value
        for b in batches:
            data = _encoded(b.column(2))
            text, h, first, last = anchors(data)
            if len(h):
                on = known.holds(h) if known is not None else _listed(b.column(3), text, h)
                text, h, first, last = text[on], h[on], first[on], last[on]
            if not len(h):
                continue
            segs = [data[i][s:e] for i, s, e in zip(text.tolist(), first.tolist(), (last + LENGTH).tolist(), strict=True)]
            sid = np.array([xxhash.xxh64_intdigest(s) for s in segs], np.uint64).view(np.int64)
            cols = [pa.array(h), pa.array(sid), pa.array(b.column(0).to_numpy()[text])]
            if texts:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(segs, pa.binary())], ["h", "sid", "id", "seg"])
            else:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(b.column(1).to_numpy()[text]), pa.array(first * 128 + (last - first))], ["h", "sid", "id", "key", "at"])

    rows = rows if told is not None else _told_by_list(rows, keys)
    return rows.mapInArrow(run, "h long, sid long, id long, " + ("seg binary" if texts else "key long, at long"))


# ---- the suffix array ----


def _words(text: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes, as a number of the same order. ``text`` ends in 64 zeros."""
    return np.ndarray((len(text) - 7,), ">u8", text.tobytes(), strides=(1,)).astype(np.uint64)


def _direct(at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places in order of the 56 bytes that start there: eight at a time, and among equals only."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    n = len(at)
    new = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    group = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.zeros(0, np.int64)
    for j in range(1, 7):
        alone = new & np.concatenate([new[1:], [True]]) if n else new
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        key = words[at[tied] + 8 * j]
        by = np.lexsort((key, group[tied]))
        at[tied] = at[tied][by]
        key, g = key[by], group[tied]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (g[1:] != g[:-1])])
        new[tied] = fresh
        group[tied] = tied[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    return at


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of ``text`` (bytes over 0, parts ended by 0, and 64 zeros at the end, which are not
    places) in order of their suffixes, as far as their first 50 bytes tell them apart.

    Two stages: suffixes smaller than their successors (and the zeros) are sorted directly; each
    other one is put into the bucket of its first byte when a scan of the buckets in order meets its
    successor, ahead of the bucket's directly sorted ones.
    """
    n = len(text) - 64
    t = text[: n + 1].astype(np.int16)
    step = np.sign(t[1:] - t[:-1])  # of a place and the next: the suffix is smaller, equal so far, larger
    step[n - 1] = -1
    known = np.where(step != 0, np.arange(n), n)
    smaller = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
    smaller[text[:n] == 0] = True
    direct = _direct(np.flatnonzero(smaller), _words(text))
    firsts = text[direct]
    cuts = np.searchsorted(firsts, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(text[:n], minlength=256)):
        part = [np.concatenate(waiting[c])] if waiting[c] else []
        while part and len(part[-1]):  # runs of one byte: these induce more of the same bucket
            up = part[-1][part[-1] > 0] - 1
            part.append(up[(text[up] == c) & ~smaller[up]])
        bucket = np.concatenate([*part, direct[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        up = bucket[bucket > 0] - 1
        up = up[~smaller[up] & (text[up] > c)]
        up = up[np.argsort(text[up], kind="stable")]
        for first, places in zip(*_split(text[up], up), strict=True):
            waiting[first].append(places)
    return np.concatenate(out)


def _split(keys: np.ndarray, values: np.ndarray):
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at].tolist(), np.split(values, at[1:]) if len(keys) else []


def common_prefixes(order: np.ndarray, words: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """For each place in order but the first, how many bytes it shares with the one before: at most
    ``most``."""
    a, b = order[:-1], order[1:]
    shared, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
    for j in range(0, most, 8):
        x = words[a[open_] + j] ^ words[b[open_] + j]
        same = x == 0
        shared[open_[same]] += 8
        rest = x[~same]
        shared[open_[~same]] += sum((rest < np.uint64(1 << (64 - 8 * i))).astype(np.int64) for i in range(1, 8))
        open_ = open_[same]
    return np.minimum(shared, most)


def least_ids(segs: list[bytes], ids: np.ndarray) -> list[np.ndarray]:
    """For each window of each segment, the least id among segments that hold the same 50 bytes."""
    text = _shifted(segs)
    sizes = np.array([len(s) for s in segs])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(segs)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    slot = np.full(len(text), -1)
    slot[starts[owner] + offset] = np.arange(len(owner))
    order = suffix_order(text)
    order = order[slot[order] >= 0]
    runs = np.flatnonzero(np.concatenate([[True], common_prefixes(order, _words(text)) < LENGTH]))
    least = np.minimum.reduceat(ids[owner[slot[order]]], runs)
    out = np.empty(len(owner), np.int64)
    out[slot[order]] = np.repeat(least, np.diff(np.concatenate([runs, [len(order)]])))
    return np.split(out, np.cumsum(counts)[:-1])


def _shifted(segs: list[bytes]) -> np.ndarray:
    """The segments in a row, each ended by 0, and 64 zeros. Bytes go one up, so that 0 ends parts
    only: UTF-8 has no byte 255."""
    text = np.frombuffer(b"\xff".join([*segs, bytes(0)]), np.uint8) + np.uint8(1)  # 255 becomes 0
    return np.concatenate([text, np.zeros(64, np.uint8)])


def _sort_partition(batches):
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    least = least_ids(t.column("seg").to_pylist(), t.column("lo").to_numpy())
    ends = np.concatenate([[0], np.cumsum([len(x) for x in least])]).astype(np.int32)
    mins = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(least)))
    whole = pa.table([t.column("h"), t.column("sid"), mins], names=["h", "sid", "mins"])
    yield from whole.to_batches(max_chunksize=4096)


# ---- the operator ----


def shared_anchors(rows: DataFrame) -> DataFrame:
    """h of anchors that documents of different ids hold."""
    ranges = rows.select("id", "text").mapInArrow(_anchor_ranges, "h long, lo long, hi long")
    return materialise(ranges.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("h"), "anchors")


def window_minima(rows: DataFrame, several: DataFrame) -> DataFrame:
    """h, sid, mins: for each segment of the anchors in ``several``, window by window, the least id."""
    segs = occurrences(rows, several, bit_filter(several), True).groupBy("h", "sid", "seg").agg(F.min("id").alias("lo"))
    segs = materialise(segs.join(several.select("h", "n"), "h"), "segments")
    some = segs.where(F.col("n") <= HOT)
    size = some.agg(F.sum(F.length("seg"))).first()[0] or 0
    sorted_ = some.select("h", "sid", "seg", "lo").repartition(max(8, -(-size // TASK_BYTES)), "h").mapInArrow(_sort_partition, "h long, sid long, mins array<long>")
    # Anchors with very many segments: their windows, by 128 bits of hash.
    wide = segs.where(F.col("n") > HOT).select("h", "sid", "lo", "seg", F.explode(F.sequence(F.lit(0), F.length("seg") - LENGTH)).alias("j"))
    cut = F.substring("seg", F.col("j") + 1, F.lit(LENGTH))
    wide = wide.select("h", "sid", "lo", "j", F.xxhash64(cut).alias("x"), F.xxhash64(cut, F.lit(1)).alias("y"))
    # Written first: the join below is then dealt anew on both sides, and a common window's rows can be split.
    least = materialise(wide.groupBy("h", "x", "y").agg(F.min("lo").alias("m")), "windows")
    hot = wide.join(least, ["h", "x", "y"]).groupBy("h", "sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "m"))), lambda w: w["m"]).alias("mins"))
    out = materialise(sorted_.unionByName(hot), "minima")
    drop(segs)
    drop(least)
    return out


def removals(rows: DataFrame) -> DataFrame:
    """id, key, spans: byte ranges (start, stop; they may overlap) to remove from each row."""
    shared = shared_anchors(rows)
    told = bit_filter(shared)
    found = occurrences(rows, shared, told, False)
    by_text = found.groupBy("h", "sid").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    kinds = by_text.groupBy("h").agg(F.count("*").alias("n"), F.max("sid").alias("sid"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    kinds = materialise(kinds, "kinds")
    several = kinds.where("n > 1").select("h", "n")
    minima = window_minima(rows, several)
    same = kinds.where("n = 1").select("h", "sid", F.array("lo").alias("mins"), F.lit(True).alias("flat"))
    known = same.unionByName(minima.withColumn("flat", F.lit(False)))
    hits = found.join(known, ["h", "sid"]).where(F.array_min("mins") < F.col("id"))
    mins, mine = F.col("mins"), F.col("id")
    first, more = F.shiftright("at", 7), F.col("at").bitwiseAND(127)
    # Runs of windows that occur in a smaller document: most often all of them.
    places = F.sequence(F.lit(0), F.size(mins) - 1)
    begin = F.filter(places, lambda j: (F.get(mins, j) < mine) & ((j == 0) | (F.get(mins, j - 1) >= mine)))
    end = F.filter(places, lambda j: (F.get(mins, j) < mine) & ((j == F.size(mins) - 1) | (F.get(mins, j + 1) >= mine)))
    all_ = F.array(F.struct(first.alias("start"), (first + more + LENGTH).alias("stop")))
    some = F.transform(F.arrays_zip(begin.alias("b"), end.alias("e")), lambda r: F.struct((first + r["b"]).alias("start"), (first + r["e"] + LENGTH).alias("stop")))
    spans = F.when(F.array_max(mins) < mine, all_).otherwise(some)
    out = hits.select("id", "key", F.explode(spans).alias("s"))
    out = materialise(out.groupBy("id", "key").agg(F.collect_list("s").alias("spans")), "spans")
    for done in (shared, kinds, minima):
        drop(done)
    return out


def _runs(starts: np.ndarray, stops: np.ndarray) -> tuple[list[int], list[int]]:
    """The union of ranges as maximal runs."""
    if not len(starts):
        return [], []
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(stops[by])
    new = np.concatenate([[True], starts[1:] > reach[:-1]])
    return starts[new].tolist(), reach[np.concatenate([new[1:], [True]])].tolist()


def _cut(batch) -> list[tuple[int, int, int, bytes]]:
    """Of each row (doc_id, packed, size, spans): bytes, bytes removed, runs removed, what is kept."""
    codec = pa.Codec("zstd")
    lists = batch.column(3)
    flat, sizes = lists.flatten(), np.asarray(lists.value_lengths().fill_null(0))
    ends = np.cumsum(sizes)
    starts, stops = (np.asarray(flat.field(i)) for i in range(2))
    out = []
    for p, n, end, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), ends.tolist(), sizes.tolist(), strict=True):
        text = codec.decompress(p, n, asbytes=True) if n else b""
        a, z = _runs(starts[end - k : end], stops[end - k : end])
        kept = b"".join([text[i:j] for i, j in zip([0, *z], [*a, n], strict=True)]) if a else text
        out.append((n, n - len(kept), len(a), kept))
    return out


def _packed(batches):
    """Texts on their way to their spans travel compressed."""
    codec = pa.Codec("zstd", compression_level=1)
    for b in batches:
        texts = _encoded(b.column(3))
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(t) for t in texts], pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], ["doc_id", "id", "key", "size", "packed"])


def _joined(docs: DataFrame) -> DataFrame:
    """doc_id, packed, size, spans of every row."""
    tune(docs.sparkSession)
    spans = removals(_rows(docs))
    key = F.xxhash64(F.coalesce("text", F.lit(""))) if _repeats(docs) else F.lit(0).cast("long")
    rows = docs.select("doc_id", F.col("doc_id").cast("long").alias("id"), key.alias("key"), "text")
    rows = rows.mapInArrow(_packed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, id long, key long, size long, packed binary")
    return rows.join(spans, ["id", "key"], "left").select("doc_id", "packed", "size", "spans")


def dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        for b in batches:
            cols = list(zip(*((n, gone, runs, hashlib.sha256(kept).hexdigest()) for n, gone, runs, kept in _cut(b)), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _joined(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text with the repeats cut out. Where a cut leaves part of a character, the part is
    replaced."""

    def run(batches):
        for b in batches:
            out = [kept.decode("utf-8", "replace") for _, _, _, kept in _cut(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return _joined(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string")

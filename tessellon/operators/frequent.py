"""Exact counts of the word-boundary patterns that are in many files, without a row for each rare one.

A pattern is in no more files than any window of it that starts at a word. Rounds of sketches tell which
windows may be frequent: a task counts them in a table of buckets, tables are added up, and a bucket
under the threshold rules out all that falls into it (buckets only ever count too much). Each round looks
only at what earlier ones left. The last round counts what is left of the patterns themselves: a row for
each part of them, with texts, lengths, counts and repos. All rounds run over code point arrays.
Patterns are told apart by 64-bit hashes; two of one hash would be counted as one. A least score raises
the thresholds: a pattern has at most as many tokens as characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions.text import MIN_CHARS
from tessellon.session import clean_shuffles, ship

# Window lengths by round; patterns shorter than PAIRS have a sketch of their own; characters
# that are looked at together; characters for each bucket and part; buckets in a row of a table.
ROUNDS, PAIRS, AT_ONCE, A_BUCKET, A_PART, CHUNK = ((8, 12, 16), (24, 40, 72)), 24, 1 << 16, 64, 1 << 24, 1 << 16
#: What a bucket of one task counts up to.
FULL = 255
#: Bits of a table's index, and how many fewer longer windows need.
LEAST_BITS, MOST_BITS, FEWER = 16, 27, {24: 3, 40: 3, 72: 3}
#: Counted patterns and batches that a task holds before it hands them on; repos that are numbered.
HELD, HELD_BATCHES, MOST_REPOS = 1_000_000, 192, 100_000

_WORD, _BLANK, _END = 1, 2, 4
_BASE = 0x9E3779B97F4A7C15


class _Tables:
    """Classes and hash values of code points, powers of the hash's base: made once a worker."""

    classes = values = None
    power = inverse = np.ones(1, np.uint64)

    @classmethod
    def ready(cls, n: int) -> None:
        if cls.classes is None:
            cls.classes = np.zeros(0x110000, np.uint8)
            cls.classes[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = _WORD
            cls.classes[[ord(c) for c in " \t\r"]] = _BLANK
            cls.classes[ord("\n")] = _BLANK | _END
            cls.values = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 64, 0x110000, np.uint64)
        if len(cls.power) < n:
            for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                factors = np.full(max(n, AT_ONCE) * 5 >> 2, base, np.uint64)
                factors[0] = 1
                setattr(cls, name, np.cumprod(factors))


class _Hashed:
    """A text whose windows' hashes cost a few operations each."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        n = len(self.codes)
        _Tables.ready(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_Tables.values.take(self.codes) * _Tables.power[:n], out=self.sums[1:])

    def hashes(self, start, end):
        x = self.sums.take(end)
        x -= self.sums.take(start)
        x *= _Tables.inverse.take(start)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        return x


class _Files(_Hashed):
    """Files of a batch: word starts with eight characters of their stripped line ahead, by place."""

    def __init__(self, texts: list[str]):
        self.text = "\n" + "\n".join(texts) + "\n"
        super().__init__(self.text)
        kind = _Tables.classes.take(self.codes)
        between = (kind & _WORD) == 0  # a pattern may end before these, and start after them
        self.ends = np.flatnonzero(between)
        self.before = np.zeros(len(kind) + 1, np.int64)
        np.cumsum(between, out=self.before[1:])
        line = np.flatnonzero(kind & _END)
        begin, end = line[:-1] + 1, line[1:]
        long = end - begin >= MIN_CHARS
        begin, end = begin[long], end[long]
        if ((kind[begin] | kind[end - 1]) & _BLANK).any():
            filled = np.flatnonzero((kind & _BLANK) == 0)
            first, last = np.searchsorted(filled, begin), np.searchsorted(filled, end) - 1
            some = first <= last
            begin, end = filled[first[some]], filled[last[some]] + 1
            long = end - begin >= MIN_CHARS
            begin, end = begin[long], end[long]
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        file = np.searchsorted(np.cumsum(sizes), begin - 1, "right")
        lo = self.before[begin - 1]
        n = self.before[end - MIN_CHARS] - lo
        self.start = self.ends[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)] + 1
        self.line_end, self.file = np.repeat(end, n), np.repeat(file, n)

    def reach(self, longest: int, windows: list):
        """How far patterns may go from each start: not past the end of an infrequent window. Starts from which none goes are left out."""
        reach = np.minimum(self.line_end, self.start + longest)
        for length, bits, known in windows:
            on = np.flatnonzero(reach >= self.start + length)  # the others are held back already
            start = self.start[on]
            rare = ~_among(known, self.hashes(start, start + length), bits)
            held = np.full(len(reach), np.iinfo(np.int64).max)
            held[on[rare]] = start[rare] + length - 1
            reach = np.minimum(reach, np.minimum.accumulate(held[::-1])[::-1])
            left = np.flatnonzero(reach >= self.start + MIN_CHARS)
            if len(left) < len(reach) >> 1:
                self.start, self.line_end, self.file, reach = (c[left] for c in (self.start, self.line_end, self.file, reach))
        return reach

    def pairs(self, reach):
        """Index of the start, and end, of every pattern within reach."""
        lo = self.before.take(self.start + MIN_CHARS)
        n = np.maximum(self.before.take(reach + 1) - lo, 0)
        of = np.repeat(np.arange(len(n)), n)
        return of, self.ends.take(np.arange(len(of)) - np.repeat(np.cumsum(n) - n - lo, n))


def _bucket(x, bits):
    return (x & np.uint64((1 << bits) - 1)).astype(np.int64)


def _among(known, x, bits):
    b = _bucket(x, bits)
    return (known.take(b >> 3) >> (b & 7).astype(np.uint8)) & 1 == 1


def _in_batches(batches):
    """Lists of texts with lists of the other column's values, AT_ONCE characters at a time: few enough that their arrays stay in the processor's cache."""
    texts, others, size = [], [], 0
    for b in batches:
        for text, other in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or ""
            if texts and size + len(text) > AT_ONCE:
                yield texts, others
                texts, others, size = [], [], 0
            texts.append(text)
            others.append(other)
            size += len(text) + 1
    if texts:
        yield texts, others


def _add(table, file, x, bits, most):
    """Counts in a table each bucket once for each file."""
    if not len(file):
        return
    width = int(file.max()).bit_length()
    key = np.sort((_bucket(x, bits) << width) | file)  # by bucket, then file
    key = key[np.flatnonzero(np.diff(key, prepend=-1))] >> width
    first = np.flatnonzero(np.diff(key, prepend=-1))
    n = np.diff(first, append=len(key))
    key = key[first]
    table[key] = np.minimum(table[key] + np.minimum(n, most), most)


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _raw(squeezed: bytes) -> bytes:
    return pa.decompress(squeezed[8:], int.from_bytes(squeezed[:8], "little"), "zstd", asbytes=True)


def _sketch(shared, longest, lengths, pairs, bits_of, least):
    most = lambda n: min(least(n), FULL)

    def run(batches):
        windows = shared.value
        tables = {n: np.zeros(1 << bits_of(n), np.uint8) for n in (*lengths, *([0] if pairs else []))}
        for texts, _ in _in_batches(batches):
            files = _Files(texts)
            reach = files.reach(longest, windows)
            for n in lengths:
                on = np.flatnonzero(reach >= files.start + n)
                _add(tables[n], files.file[on], files.hashes(files.start[on], files.start[on] + n), bits_of(n), most(n))
            if pairs:
                of, end = files.pairs(np.minimum(reach, files.start + PAIRS - 1))
                _add(tables[0], files.file[of], files.hashes(files.start[of], end), bits_of(0), most(0))
        for n, table in tables.items():
            for i, part in enumerate(table.reshape(-1, CHUNK)):
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([i], pa.int32()), pa.array([_squeezed(part.tobytes())], pa.binary())], ["length", "chunk", "counts"])

    return run


def _sum(least):
    def run(rows: pa.Table) -> pa.Table:
        total, full = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, bool)
        for part in rows.column("counts").to_pylist():
            counts = np.frombuffer(_raw(part), np.uint8)
            total += counts
            full |= counts == FULL  # it may have been more
        known = np.packbits(full | (total >= least(rows.column("length")[0].as_py())), bitorder="little")
        return pa.table({"length": rows.column("length")[:1], "chunk": rows.column("chunk")[:1], "known": pa.array([known.tobytes()], pa.binary())})

    return run


def _runs(key, word):
    """Order of rows by key and word, and where in it a new one begins."""
    order = np.lexsort((word, key)) if len(word) and (word != word[0]).any() else np.argsort(key)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in (key, word):
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _placed(repos, names):
    """word and bit of each repo: by its number, or by its name's hash where there are too many."""
    if repos is None:
        word = [int.from_bytes(hashlib.blake2b(b"" if r is None else b"." + r.encode(), digest_size=8).digest(), "little", signed=True) for r in names]
        return np.array(word, np.int64), np.zeros(len(names), np.uint64)
    number = np.array([repos[r] for r in names], np.int64)
    return number >> 6, (number & 63).astype(np.uint64)


def _counted(files, word, bit, windows, pairs, longest):
    """hash, word, files, repos as bits, first start, length, hash of the first characters of each pattern of a batch."""
    of, end = files.pairs(files.reach(longest, windows))
    start, file = files.start[of], files.file[of]
    x = files.hashes(start, end)
    if pairs:
        bits, known = pairs
        stay = (end - start >= PAIRS) | _among(known, x, bits)
        x, start, end, file = x[stay], start[stay], end[stay], file[stay]
    if not len(x):
        return None
    order, new = _runs(x, word[file])
    group = np.zeros(len(x), np.int64)
    group[new[1:]] = 1
    width = max(len(word) - 1, 1).bit_length()
    key = np.sort((np.cumsum(group) << width) | file[order])  # by group, then file
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    file = key & ((1 << width) - 1)
    at = np.flatnonzero(np.diff(key >> width, prepend=-1))
    one = order[new]
    first = np.minimum.reduceat(start[order], new)
    gram = (files.hashes(first, first + MIN_CHARS) >> np.uint64(40)).astype(np.uint32)
    repos, n = np.bitwise_or.reduceat(np.uint64(1) << bit[file], at), np.diff(at, append=len(key)).astype(np.uint32)
    return x[one], word[file[at]], n, repos, first, (end - start)[one].astype(np.uint32), gram


def _slices(values, start, length):
    """The slices of ``values``, one after the other."""
    return values[np.arange(length.sum()) - np.repeat(np.cumsum(length) - length - start, length)]


def _folded(held: list) -> tuple:
    """Batches (columns, code points) as one: a pattern stands where the first of them has it. In order of start and length."""
    x, word, n, repos, start, length, gram = (np.concatenate(c) for c in zip(*(columns for columns, _ in held), strict=True))
    sizes = np.cumsum([0, *(len(codes) for _, codes in held)])
    start += np.repeat(sizes[:-1], [len(columns[0]) for columns, _ in held])
    order, new = _runs(x, word)
    one = order[new]
    n, repos, start = np.add.reduceat(n[order], new, dtype=np.uint32), np.bitwise_or.reduceat(repos[order], new), np.minimum.reduceat(start[order], new)
    x, word, length, gram = x[one], word[one], length[one].astype(np.int64), gram[one]
    order = np.argsort((start << 16) | np.minimum(length, 65535), kind="stable")
    x, word, n, repos, start, length, gram = (c[order] for c in (x, word, n, repos, start, length, gram))
    first = np.flatnonzero(np.diff(start, prepend=-1))
    longest = np.maximum.reduceat(length, first)
    held = [codes for _, codes in held]
    cut = np.searchsorted(start[first], sizes)
    codes = np.concatenate([_slices(c, start[first[a:b]] - base, longest[a:b]) for c, a, b, base in zip(held, cut[:-1], cut[1:], sizes[:-1], strict=True)])
    start = np.repeat(np.cumsum(longest) - longest, np.diff(first, append=len(start)))
    return (x, word, n, repos, start, length.astype(np.uint32), gram), codes


def _packed(values) -> bytes:
    """Lowest bytes first, so that they compress well."""
    return _squeezed(values.view(np.uint8).reshape(len(values), -1).T.tobytes())


def _unpacked(parts, kind):
    size = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(_raw(p), np.uint8).reshape(size, -1).T).view(kind)[:, 0] for p in parts])


_ROW = "part int, text binary, longest binary, patterns binary, lengths binary, files binary, repos binary, words binary"
_COLUMNS = [c.split()[0] for c in _ROW.split(", ")]


def _rows(held: tuple, parts: int):
    """A row for each part of the patterns: texts of starts one after the other, and how many patterns each has."""
    (_, word, n, repos, start, length, gram), codes = held
    part = gram.astype(np.int64) % parts
    order = np.lexsort((length, start, part))
    word, n, repos, start, length, part = (c[order] for c in (word, n, repos, start, length, part))
    cut = np.searchsorted(part, np.arange(parts + 1))
    for i in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[i], cut[i + 1]
        first = np.flatnonzero(np.diff(start[a:b], prepend=-1))
        longest = np.maximum.reduceat(length[a:b], first)
        text = _slices(codes, start[a:b][first], longest.astype(np.int64)).tobytes().decode("utf-32-le").encode()
        patterns = np.diff(first, append=b - a).astype(np.uint32)
        binary = [pa.array([_packed(c)], pa.binary()) for c in (longest, patterns, length[a:b], n[a:b], repos[a:b], word[a:b])]
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([_squeezed(text)], pa.binary()), *binary], _COLUMNS)


def _count(shared, longest, parts):
    def run(batches):
        windows, pairs, repos = shared.value
        held, size = [], 0
        for texts, names in _in_batches(batches):
            files = _Files(texts)
            got = _counted(files, *_placed(repos, names), windows, pairs, longest)
            if got:
                held.append((got, files.codes))
                size += len(got[0])
            if size >= HELD or len(held) >= HELD_BATCHES:
                held = [_folded(held)]
                size = len(held[0][0][0])
                if size >= HELD >> 1:
                    yield from _rows(held[0], parts)
                    held, size = [], 0
        if held:
            yield from _rows(_folded(held), parts)

    return run


def _total(threshold, least_score=0):
    def run(batches):
        held, rows, size = [], [], 0

        def hashed():
            """The rows as a batch."""
            longest, patterns, length, n = (_unpacked([r[i] for r in rows], np.uint32) for i in range(1, 5))
            repos, word = _unpacked([r[5] for r in rows], np.uint64), _unpacked([r[6] for r in rows], np.int64)
            longest = longest.astype(np.int64)
            start = np.repeat(np.cumsum(longest) - longest, patterns)
            text = _Hashed("".join(r[0] for r in rows))
            x = text.hashes(start, start + length.astype(np.int64))
            return (x, word, n, repos, start, length, np.zeros(len(x), np.uint8)), text.codes

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(1, 8)), strict=True):
                text = _raw(row[0]).decode()
                rows.append((text, *row[1:]))
                size += len(text)
                if size >= AT_ONCE:
                    held.append(hashed())
                    rows, size = [], 0
        if rows:
            held.append(hashed())
        if not held:
            return
        (x, word, n, repos, start, length, _), codes = _folded(held)
        repos = np.bitwise_count(repos).astype(np.int64)
        order = np.argsort(x, kind="stable")
        new = np.flatnonzero(np.append(True, np.diff(x[order]) != 0))
        one = order[new]
        n, repos = np.add.reduceat(n[order], new, dtype=np.int64), np.add.reduceat(repos[order], new)
        kept = np.flatnonzero((n >= threshold) & (n * (length[one].astype(np.int64) - 1) >= least_score))
        for i in range(0, len(kept), 10_000):
            k = kept[i : i + 10_000]
            sizes = length[one[k]].astype(np.int64)
            text, ends = _slices(codes, start[one[k]], sizes).tobytes().decode("utf-32-le"), np.cumsum(sizes).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([text[a:b] for a, b in zip([0, *ends], ends)], pa.string()), pa.array(n[k]), pa.array(repos[k])], ["pattern", "frequency", "repo_count"])

    return run


def frequent_patterns(corpus: DataFrame, threshold: int, longest: int, least_score: int = 0) -> DataFrame:
    """pattern, frequency, repo_count of every pattern of at most ``longest`` characters, from a word's start to a
    word's end in a stripped line, that is in at least ``threshold`` files. Patterns whose frequency * (tokens - 1)
    is under ``least_score`` may be missing; those that are there have their exact counts."""
    spark = corpus.sparkSession
    ship(spark)
    clean_shuffles(spark)
    texts = corpus.select("content", "repo")
    size = texts.agg(F.coalesce(F.sum(F.length("content")), F.lit(0))).first()[0]
    bits = min(max((size // A_BUCKET).bit_length(), LEAST_BITS), MOST_BITS)
    bits_of = lambda n: max(bits - FEWER.get(n, 0), LEAST_BITS)
    tokens = lambda n: max((longest if n else min(longest, PAIRS - 1)) - 1, 1)  # noqa: E731 (after the first, of patterns that a table is for)
    least = lambda n: max(threshold, 1, -(-least_score // tokens(n)))
    windows, pairs = [], None
    for i, lengths in enumerate(ROUNDS):
        lengths, last = tuple(n for n in lengths if n <= longest), i == len(ROUNDS) - 1
        parts = texts.mapInArrow(_sketch(spark.sparkContext.broadcast(windows), longest, lengths, last, bits_of, least), "length int, chunk int, counts binary")
        known = {n: np.zeros(1 << bits_of(n) - 3, np.uint8) for n in (*lengths, *([0] if last else []))}
        found = parts.groupBy("length", "chunk").applyInArrow(_sum(least), "length int, chunk int, known binary").toArrow()  # a bit a bucket: 16 MB a table at most
        for n, chunk, part in zip(*(found.column(c).to_pylist() for c in ("length", "chunk", "known")), strict=True):
            known[n][chunk * (CHUNK >> 3) : (chunk + 1) * (CHUNK >> 3)] = np.frombuffer(part, np.uint8)
        windows = [*windows, *((n, bits_of(n), known[n]) for n in lengths)]
        if last:
            pairs = (bits_of(0), known[0])
    names = texts.select("repo").distinct().limit(MOST_REPOS + 1).toArrow().column("repo").to_pylist()
    repos = {r: i for i, r in enumerate(names)} if len(names) <= MOST_REPOS else None
    n = max(spark.sparkContext.defaultParallelism, size // A_PART + 1)
    rows = texts.mapInArrow(_count(spark.sparkContext.broadcast((windows, pairs, repos)), longest, n), _ROW)
    return rows.repartitionById(n, "part").mapInArrow(_total(threshold, least_score), "pattern string, frequency long, repo_count long")

"""Suffix-array dedup, SimHash near-dedup and fingerprints, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from tessellon.llm import fingerprints, graph, near_dedup, suffix_dedup
from tests.llm.util import HARD, docs


def brute_dedup(rows, length=50):
    seen, out = {}, []
    for i, text in rows:
        data = (text or "").encode()
        if i is not None:
            for j in range(len(data) - length + 1):
                k = data[j : j + length]
                seen[k] = min(seen.get(k, i), i)
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for j in range(len(data) - length + 1):
            if i is not None and seen[data[j : j + length]] < i:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(data)) if gone[j] and not (j and gone[j - 1]))
        out.append((i, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=40):
    r = random.Random(seed)
    words = ["the", "of", "é", "ab", "abab", "stone", "river", "x"]
    block = [" ".join(r.choice(words) for _ in range(r.randint(3, 40))) for _ in range(8)]
    return ["".join(r.choice(block + ["a" * r.randint(1, 130), "ab" * r.randint(1, 70), "\n"]) for _ in range(r.randint(0, 7))) for _ in range(n)]


@pytest.mark.parametrize("hot", [4096, 2])
def test_suffix_dedup_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = made(hot) + HARD + ["same text that is longer than fifty bytes, and repeated often " * 2] * 30
    got = suffix_dedup.dedup_report(docs(spark, texts, extra=True))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(list(enumerate(texts)))


def test_suffix_dedup_repeated_and_null_ids(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, long), (5, long), (5, "other start " + long), (3, "z" + long), (None, long), (None, None), (9, long)]
    got = suffix_dedup.dedup_report(docs(spark, [t for _, t in rows], ids=[i for i, _ in rows]))
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(rows)


def test_suffix_dedup_without_filters(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FILTER_BITS", 0)  # the semi-join takes their place
    texts = made(7, 20)
    got = suffix_dedup.dedup_report(docs(spark, texts))
    assert sorted(map(tuple, got.collect()), key=str) == brute_dedup(list(enumerate(texts)))


def test_suffix_dedup_empty_and_texts(spark):
    assert suffix_dedup.dedup_report(docs(spark, [])).count() == 0
    long = "0123456789" * 6
    got = {r.doc_id: r.text for r in suffix_dedup.deduplicated(docs(spark, ["a" + long, "b" + long])).collect()}
    assert got == {0: "a" + long, 1: "b"}


def test_least_ids_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        alphabet = r.choice(["a", "ab", "abc", "abcdefgh"])
        segs = ["".join(r.choice(alphabet) for _ in range(r.randint(50, 70))).encode() for _ in range(r.randint(1, 10))]
        segs += [s[: r.randint(50, len(s))] for s in segs[:3]]
        ids = np.array([r.randint(0, 5) for _ in segs])
        least = {}
        for s, i in zip(segs, ids, strict=True):
            for j in range(len(s) - 49):
                least[s[j : j + 50]] = min(least.get(s[j : j + 50], 99), i)
        for s, got in zip(segs, suffix_dedup.least_ids(segs, ids), strict=True):
            assert got.tolist() == [least[s[j : j + 50]] for j in range(len(s) - 49)]


def test_suffix_order_sorts_suffixes():
    r = random.Random(5)
    for _ in range(40):
        body = "".join(r.choice("ab\x00") for _ in range(r.randint(1, 60))).replace("\x00", "\x00").encode()
        text = np.concatenate([np.frombuffer(body + b"\0", np.uint8), np.zeros(64, np.uint8)])
        order = suffix_dedup.suffix_order(text)
        assert sorted(order.tolist()) == list(range(len(text) - 64))
        part = lambda i: bytes(text[i:]).split(b"\0")[0][:50]
        keys = [part(i) for i in order]
        assert keys == sorted(keys)


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    if not runs:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_simhash_near_duplicates(spark):
    r = random.Random(1)
    base = [" ".join(r.choice(["river", "stone", "Tree", "hall", "é", "sun"]) + str(r.randint(0, 40)) for _ in range(300)) for _ in range(12)]
    texts = HARD + base + [b + " end" for b in base] + base[:3] * 3 + [b.replace("1", "2", 2) for b in base]
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, texts, extra=True)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == fps
    assert all(len(x.fingerprint) == 16 for x in got.values())
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)


def _near_values(seed, dense=0):
    """Signed fingerprints: random ones, others some bits from them, and a group within few bits."""
    r = random.Random(seed)
    fps = [r.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        for n in (1, 2, 3, 4):
            fps.append(f ^ sum(1 << b for b in r.sample(range(64), n)))
    fps += [fps[0] ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for _ in range(dense)]
    return sorted({f - (1 << 64) * (f >> 63) for f in fps})


def _apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def test_links_find_every_pair_within_three_bits(spark):
    signed = _near_values(2)
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {(a, b) for a in signed for b in signed if a < b and _apart(a, b) <= 3}
    assert sorted(map(tuple, fingerprints.neighbours(table).collect())) == sorted(want)
    beside = {a: [b for b in signed if a != b and _apart(a, b) <= 3] for a in signed}
    got = {r.fp: (r.own, r["least"], r.most) for r in near_dedup.links(table).collect()}
    assert got == {a: (a, min(x), max(x)) for a, x in beside.items() if x}
    with pytest.raises(ValueError):
        fingerprints.neighbours(table, 4)


@pytest.mark.parametrize("seed", [3, 4])
def test_fingerprint_classes_are_components(spark, seed):
    signed = _near_values(seed, dense=150)
    got = {r.node: r.component for r in near_dedup.fingerprint_classes(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    classes = brute_components([f & (2**64 - 1) for f in signed])
    alone = {f for f in signed if not any(f != g and _apart(f, g) <= 3 for g in signed)}
    assert got == {f: signed[c] for f, c in zip(signed, classes, strict=True) if f not in alone}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_dedup_repeats_nulls_and_empty(spark):
    same = "the river and the stone and the tree are here today"
    d = docs(spark, [same, same, None, same, "something else altogether, by itself"], ids=[4, 4, 9, 2, None])
    got = sorted(((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(4, 2), (4, 2), (9, 9), (2, 2), (None, None)], key=str)
    kept = sorted((r.doc_id for r in near_dedup.one_of_each(docs(spark, [same, same, "b c d", "b c d"], ids=[4, 4, 1, 6], extra=True)).collect()))
    assert kept == [1, 4]
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert near_dedup.one_of_each(docs(spark, [])).count() == 0


def test_one_of_each_keeps_different_texts_of_null_and_repeated_ids(spark):
    a, b, c, d = (f"{w} alone in its own words, number {w} of the few {w} texts here" for w in ("amber", "birch", "cedar", "delta"))
    kept = near_dedup.one_of_each(docs(spark, [a, b, b, c, d, d, c], ids=[None, None, None, 4, 4, 2, 4], extra=True))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, a), (None, b), (4, c), (2, d)], key=str)


@pytest.mark.parametrize("seed", range(3))
def test_one_of_each_against_brute_force(spark, seed):
    r = random.Random(seed)
    base = [" ".join(r.choice(["river", "stone", "tree", "hall", "é"]) + str(r.randint(0, 90)) for _ in range(200)) for _ in range(6)]
    pool = base + [b + " end" for b in base] + ["", None, "one", "One"]
    rows = [(r.choice([None, 1, 2, 3, 4, 5]), r.choice(pool), r.choice(["a", "b", None])) for _ in range(60)]
    d = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, fp string").repartition(3)
    got = near_dedup.one_of_each(d)
    assert got.columns == d.columns
    classes = brute_components([brute_fingerprint(t) for _, t, _ in rows])
    kept = [(x.doc_id, x.text, x.source) for x in got.collect()]
    mine = [{i for i, row in enumerate(rows) if row == k} for k in kept]
    assert all(mine) and sorted(min(classes[i] for i in m) for m in mine) == sorted(set(classes))
    for k, m in zip(kept, mine, strict=True):
        c = classes[min(m)]
        ids = [rows[i][0] for i in range(len(rows)) if classes[i] == c]
        assert k[0] == min((i for i in ids if i is not None), default=None)


def brute_simhash(text):
    votes = [0] * 64
    for w in set(re.split(r"[\x20\x09-\x0D]+", (text or "").lower())):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        for k in range(64):
            votes[k] += len(w) * (1 if h >> k & 1 else -1)
    return sum(1 << k for k in range(64) if votes[k] > 0)


@pytest.mark.parametrize("rows", [2000, 5])
def test_fingerprint_report(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", rows)  # many buckets, so that edges are met
    texts = HARD + made(3, 25)
    got = sorted(fingerprints.fingerprint_report(docs(spark, texts, extra=True)).collect(), key=lambda r: r.doc_id)
    fps = [brute_simhash(t) for t in texts]
    like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    for i, r in enumerate(got):
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert int(r.fingerprint, 16) == fps[i] and int(r.edited_fingerprint, 16) == brute_simhash(edited)
        assert r.near_edited == like(fps[i], brute_simhash(edited))
        assert r.near_next == like(fps[i], fps[(i + 1) % len(texts)])
        assert r.n_near == sum(bin(fps[i] ^ f).count("1") <= 3 for f in fps) - 1


def test_fingerprint_report_edges(spark):
    assert fingerprints.fingerprint_report(docs(spark, [])).count() == 0
    (one,) = fingerprints.fingerprint_report(docs(spark, ["just one text"])).collect()
    assert one.near_next == 1.0 and one.n_near == 0
    got = fingerprints.fingerprint_report(docs(spark, ["a b c d", "a b c d", "e", None], ids=[2, 2, None, 5])).collect()
    assert len(got) == 4 and sum(r.doc_id == 2 for r in got) == 2


def test_fingerprint_report_deals_out_shared_and_missing_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    r = random.Random(6)
    texts = [f"text {i} " + " ".join(r.choice(["river", "stone", "tree"]) for _ in range(9)) for i in range(90)]
    ids = [None] * 30 + [7] * 30 + list(range(30))
    d = docs(spark, texts, ids=ids)
    placed = fingerprints.in_order(d).where("_guest = 0").groupBy("_b").count().collect()
    assert max(x["count"] for x in placed) <= 12 and sum(x["count"] for x in placed) == 90
    got = fingerprints.with_edits(d).collect()
    hashes = {x.text: x._h for x in fingerprints.in_order(d).select("text", "_h").collect()}
    order = sorted(range(90), key=lambda i: (ids[i] is not None, ids[i] or 0, hashes[texts[i]]))
    want = []
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        n = len(texts[i])
        edited = texts[i][: n - n // 4] + texts[j][: n // 4]
        want.append((ids[i], hashlib.sha256(edited.encode()).hexdigest(), brute_simhash(texts[j])))
    assert sorted(((x.doc_id, x.edited_sha256, x.next_fp & (2**64 - 1)) for x in got), key=str) == sorted(want, key=str)

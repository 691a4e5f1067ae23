"""Search, mixing, chats and the pipeline."""

import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessellon.llm import ann, chat, mixing, registry
from tests.llm.util import HARD, docs


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string")


def _exact(vectors, every=50, k=5):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in [i for i in ids if i % every == 0]:
        s = x @ x[ids.index(q)]
        order = sorted((-round(float(c), 12), i) for c, i in zip(s, ids, strict=True) if i != q)
        out[q] = [i for _, i in order[:k]]
    return out


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(size=32).astype(np.float32).tolist() for i in range(1500)}
    for i in range(1000, 1500):
        vectors[i] = vectors[7]  # a third are copies
    got = ann.search(_vectors(spark, [(i, v, "x") for i, v in vectors.items()])).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = _exact(vectors)
    hits = [len({i for _, i, _ in found[q]} & set(w)) / 5 for q, w in want.items()]
    assert set(found) == set(want) and np.mean(hits) >= 0.9
    for q, rows in found.items():
        rows.sort()
        assert [r for r, _, _ in rows] == [1, 2, 3, 4, 5]
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
        for _, i, s in rows:
            a, b = np.array(vectors[q], float), np.array(vectors[i], float)
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)


def test_ann_bears_bad_rows(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [1.0, 0.1], "x"), (2, [0.0, 0.0], "x"), (3, None, "x"), (4, [float("nan"), 1.0], "x"), (5, [float("inf"), 1.0], "x"), (6, [None, 1.0], "x"), (7, [], "x"), (8, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x"), (1, [1.0, 0.1], "x"), (50, [-1.0, 0.0], "x")]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(_vectors(spark, rows)).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.search(_vectors(spark, [])).count() == 0
    assert ann.search(_vectors(spark, [(0, [1.0], "x")])).count() == 0


def test_ann_scores_are_of_the_vectors_as_they_are(spark):
    base = [0.3, -1.7, 2.9, 0.1]
    rows = [(0, base, "x")] + [(i, [v * 2.0**i for v in base], "x") for i in range(1, 5)] + [(5, [1e-30, 0.0, 0.0, 1e-30], "x"), (6, [3e38, 3e38, 0.0, 0.0], "x")]
    got = [(r.vec_id, r.score) for r in sorted(ann.search(_vectors(spark, rows), k=6).collect(), key=lambda r: r["rank"])]
    assert [i for i, _ in got][:4] == [1, 2, 3, 4] and len({s for _, s in got[:4]}) == 1  # scaled copies tie, and go by id
    want = {i: float(np.dot(np.float32(v).astype(float), np.float32(base).astype(float)) / np.linalg.norm(np.float32(v).astype(float)) / np.linalg.norm(np.float32(base).astype(float))) for i, v, _ in rows[5:]}
    assert all(s == pytest.approx(want[i], abs=1e-12) for i, s in got[4:])


def test_ann_with_many_pivots(spark):
    rng = np.random.default_rng(1)
    vectors = {i: rng.normal(size=16).astype(np.float32).tolist() for i in range(700)}
    got = ann.search(_vectors(spark, [(i, v, "x") for i, v in vectors.items()]), pivots=300, opened=120).collect()
    want = _exact(vectors)
    found = {q: {r.vec_id for r in got if r.query_id == q} for q in want}
    assert np.mean([len(found[q] & set(w)) / 5 for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("n", [500, 3000])
def test_ann_against_the_plain_index(spark, n):
    """Random vectors, the hard case: recall against a full search, and the same answer as the index written plainly."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32)
    rows = _vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(x)])
    chosen = ann.choose_pivots(ann.valid(rows))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = np.argsort(-(unit @ chosen.T), axis=1, kind="stable")
    place = np.argsort(near, axis=1)
    found, most = {}, 0
    for r in ann.search(rows).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in range(0, n, 50):
        opened, files = set(near[q, : ann.OPENED].tolist()), {}
        for i in range(n):
            met = [p for p in near[i, : ann.POSTED].tolist() if p in opened]
            if met and i != q:
                files.setdefault(met[0], []).append((int(np.abs(place[i] - place[q]).sum()), i))
        kept = [i for f in files.values() for _, i in sorted(f)[: ann.KEEP]]
        most = max(most, len(kept))
        assert [found[q][r] for r in range(1, 6)] == sorted(kept, key=lambda i: -(unit[i] @ unit[q]))[:5]
    assert most <= ann.OPENED * ann.KEEP and (n < 3000 or most < 0.35 * n)
    want = _exact(dict(enumerate(unit)))
    assert np.mean([len(set(found[q].values()) & set(w)) / 5 for q, w in want.items()]) >= 0.9


def brute_mix(rows):
    import hashlib
    import re

    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, (_, t, _) in enumerate(rows)}
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: float(sum(size[i] for i, r in enumerate(rows) if r[2] == s)) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    held, target = set(), {}
    while True:
        free = [s for s in sources if s not in held]
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in held)
        target = {s: 2 * total[s] if s in held else weight[s] * left / sum(weight[x] for x in free) for s in sources}
        over = [s for s in free if target[s] >= 2 * total[s]]
        if not over:
            break
        held |= set(over)
        if len(held) == len(sources):
            target = {s: 2 * total[s] for s in sources}
            break
    taken = {}
    for s in sources:
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        times = int(target[s] // total[s]) if total[s] else 0
        rest = target[s] - times * total[s]
        h = {i: int(hashlib.md5(str("" if rows[i][0] is None else rows[i][0]).encode()).hexdigest()[:15], 16) for i in mine}
        for i in mine:
            before = sum(size[j] for j in mine if h[j] < h[i])
            upto = before + sum(size[j] for j in mine if h[j] == h[i])
            taken[i] = size[i] * (times + (size[i] > 0 and before + upto < 2 * rest))
    return [(rows[i][0], size[i], int(total[rows[i][2]]), round(target[rows[i][2]], 6), taken[i]) for i in range(len(rows))]


@pytest.mark.parametrize("seed", range(3))
def test_mixing_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 3, 10, 200])), r.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(150)]
    rows += [(None, "x y", "a"), (3, "again and again", "b"), (3, "again and again", "b"), (200, None, "only null")]
    d = docs(spark, [t for _, t, _ in rows], ids=[i for i, _, _ in rows], extra=True)
    d = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, size string")
    got = [(x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(d).collect()]
    assert sorted(got, key=str) == sorted(brute_mix(rows), key=str)
    assert all(t <= 2 * n for _, n, _, _, t in got)
    copies = mixing.mixed_documents(d)
    assert copies.columns == d.columns
    assert copies.count() == sum(t // n for _, n, _, _, t in got if n)


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0
    (row,) = mixing.mix(docs(spark, ["one two"])).collect()
    assert (row["size"], row.source_size, row.target) == (2, 2, 3.0)
    assert {r.taken for r in mixing.mix(docs(spark, [None, ""])).collect()} == {0}


def test_chats_link_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?\n\nSecond para\nline two"),
        (1, 1, "assistant", "Bob wrote:\n> Hello  THERE.\n> How are you?\n\nFine."),
        (1, 2, "user", "> Fine.\nok\n>> How are you?\nyes"),
        (1, 3, "user", "> > Hello there.\n> nothing known\n hm"),
        (1, 4, "a", "> ok"),
        (1, 5, None, None),
        (2, 0, "user", "> Fine.\nsure"),
        (2, 1, "user", ""),
        (2, 1, "user", ""),
        (None, 1, "user", "> x"),
        (2, 3, "u", "> sure\n> more\nA\n> sure"),
        (2, 4, "u", "> A\nb"),
        (2, 5, "u", "> b\r\nc\rd"),
        (3, 0, "u", "x " * 20000),
    ]
    rows += [(4, i, "u", (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(40)]  # a chain
    c = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    got = chat.format_chats(c)
    by = {(r.conv_id, r.turn): r for r in got.collect()}
    assert got.count() == len(rows)
    assert (by[1, 1].parent_turn, by[1, 1].body, by[1, 1].thread) == (0, "Fine.", 0)
    assert (by[1, 2].parent_turn, by[1, 2].n_quotes, by[1, 2].n_linked, by[1, 2].body) == (1, 2, 2, "ok\nyes")
    assert (by[1, 3].parent_turn, by[1, 3].n_linked) == (0, 1)
    assert (by[1, 4].thread, by[1, 4].depth, by[1, 4].body) == (0, 3, "")
    assert by[1, 5].formatted == "<|unknown|>\n\n<|end|>\n"
    assert by[2, 0].parent_turn == -1 and by[2, 0].n_quotes == 1
    assert (by[4, 39].thread, by[4, 39].depth) == (0, 39)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = [tuple(x) for x in con.sql(f"SELECT {', '.join(got.columns)} FROM ({chat.ORACLE})").fetchall()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert chat.format_chats(c.limit(0)).count() == 0


def test_conversations_are_in_reply_order_and_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 8)
    rows = [(4, 3 * i, "u", (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(150)] + [(4, 1, "u", "alone"), (None, 5, "u", None)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.thread, r.part): r.messages for r in chat.conversations(chat.format_chats(c)).collect()}
    chain = [m for p in range(3) for m in got[4, 0, p]]
    assert [(m.position, m.turn, m.parent_turn, m.body) for m in chain] == [(i + 1, 3 * i, 3 * i - 3 if i else -1, f"m{i}") for i in range(150)]
    assert max(map(len, got.values())) == chat.PART and [m.body for m in got[4, 1, 0]] == ["alone"] and len(got) == 5


def test_conversations_of_quoting_messages_match_their_oracle(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant"]), "\n".join(f"line {r.randint(0, 400)} of {c}" for _ in range(r.randint(1, 4)))) for c in range(12) for t in range(r.randint(1, 9))]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    got = chat.conversation_digests(c)
    want = [tuple(x) for x in con.sql(f"SELECT {', '.join(got.columns)} FROM ({chat.CONVERSATIONS_ORACLE})").fetchall()]
    assert sorted(map(tuple, got.collect())) == sorted(want) and max(x[3] for x in want) > 2


def test_chats_link_trimmed_quotes(spark):
    rows = [
        (1, 0, "u", "line one\nline two\nline three\nline four\n\npara two\nits end\n\npara three"),
        (1, 1, "a", "> line two\n> line three\nmine"),
        (1, 2, "u", "> para two its\n> end\n>\n> para three\nagreed"),
        (1, 3, "a", "> line two\n> never said\nno"),
        (1, 4, "u", "> mine\n>\n> line one\nboth"),
        (1, 5, "u", "> later\n> mine"),
        (1, 6, "u", "later"),
    ]
    got = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[t].parent_turn, got[t].n_quotes, got[t].n_linked) for t in range(7)] == [(-1, 0, 0), (0, 1, 1), (0, 1, 1), (-1, 1, 0), (1, 1, 1), (-1, 1, 0), (-1, 0, 0)]


def test_only_conversations_that_quote_are_searched(spark, monkeypatch):
    rows = [(1, 0, "u", "one"), (1, 1, "a", "> one\ntwo"), (2, 0, "u", "one"), (2, 1, "a", "two"), (3, 0, "u", "> one"), (None, 0, "u", "> one")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parsed = chat.lines(c.withColumn("_k", F.concat_ws(":", "conv_id", "turn")))
    assert {r.conv_id for r in chat.quotations(parsed)[1].collect()} == {1}
    few = sorted(map(tuple, chat.format_chats(c).collect()), key=str)
    monkeypatch.setattr(chat, "MOST_QUOTING", 1)
    assert {r.conv_id for r in chat.quotations(parsed)[1].collect()} == {1, 2}
    assert sorted(map(tuple, chat.format_chats(c).collect()), key=str) == few
    assert [r[5] for r in few if r[:1] + r[3:4] == (1, 1)] == [0]


def test_no_stage_outlives_its_execution(spark):
    """One side of a join turns out to be empty while the other is still read from a shuffle."""
    from tessellon.session import materialise

    def slow(seconds):
        def run(batches):
            time.sleep(seconds)
            yield from batches

        return run

    empty = spark.range(0, 100, 1, 1).mapInArrow(slow(2), "id long").where("id < 0").groupBy("id").agg(F.count("*").alias("n"))
    busy = spark.range(0, 100, 1, 2).repartition(4, "id").mapInArrow(slow(5), "id long").groupBy((F.col("id") % 7).alias("id")).agg(F.count("*").alias("m"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = materialise(empty.join(busy, "id", "left"), "outlived")
        assert list(spark.sparkContext.statusTracker().getActiveStageIds()) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert out.count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(0)
    words = ["river", "stone", "tree", "hall", "sun", "the", "of"]
    texts = [" ".join(r.choice(words) + str(r.randint(0, 30)) for _ in range(r.randint(5, 120))) for _ in range(80)]
    for i in range(0, 80, 8):
        texts[i] += " you idiot"
    texts += [texts[1], texts[1], None, "", "password=abcdef0123456789 " + texts[2] * 2]
    d = docs(spark, texts)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "sentencepiece"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        if name != "sentencepiece":
            assert out.columns == d.columns
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = at.collect()
    assert {x.doc_id for x in kept["toxicity"]} == set(range(len(texts))) - set(range(0, 80, 8))
    assert not {80, 81, 83} & {x.doc_id for x in kept["near_dedup"]}
    assert all("abcdef0123456789" not in (x.text or "") for x in kept["secrets"]) and len(kept["secrets"]) == len(kept["near_dedup"])
    assert all(x.round_trip for x in kept["sentencepiece"]) and len(kept["sentencepiece"]) == len(kept["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mixing"])


def test_pipeline_bears_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_names_one_query_for_each_operator():
    names = [n for n in registry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert HARD


def test_texts_of_a_megabyte(spark):
    import time

    from tessellon.llm import fingerprints, near_dedup, personal_data, pieces, secret_scan, suffix_dedup, toxicity
    from tests.llm.test_dedup import brute_dedup, brute_fingerprint, brute_simhash

    r = random.Random(1)
    long = " ".join(r.choice(["river", "stone", "tree", "hall"]) + str(r.randint(0, 2000)) for _ in range(115_000))
    texts = [long, "x" * 1_000_000, long + " end", None, "\x00"]
    assert len(long) > 10**6
    d = docs(spark, texts, extra=True)
    assert sorted(map(tuple, suffix_dedup.dedup_report(d).collect()), key=str) == brute_dedup(list(enumerate(texts)))
    got = {x.doc_id: x for x in near_dedup.near_duplicates(d).collect()}
    assert [int(got[i].fingerprint, 16) for i in range(5)] == [brute_fingerprint(t) for t in texts] and got[2].component_id == 0
    got = {x.doc_id: x for x in fingerprints.fingerprint_report(d).collect()}
    assert [int(got[i].fingerprint, 16) for i in range(5)] == [brute_simhash(t) for t in texts]
    machine = toxicity.train(d, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert all(0 <= x.score <= 1 for x in toxicity.score(d, machine).collect())
    assert all(x.round_trip for x in pieces.encode(d, most=50).collect())
    began = time.perf_counter()
    for hostile in ("eyJ" * 300_000, "eyJ-a." * 100_000, "password " * 100_000, "-----BEGIN " * 90_000, "AKIA" * 200_000, "token=" * 100_000):
        secret_scan.Scanner()(hostile)
    for hostile in (long.replace(" ", " Mr. "), "a@" * 300_000, "1." * 300_000, "+1 (" * 200_000):
        personal_data.base_spans(hostile)
    assert time.perf_counter() - began < 20  # quadratic work would take minutes

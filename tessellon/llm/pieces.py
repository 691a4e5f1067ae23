"""SentencePiece encoding and decoding with a byte-pair model, by a relational lattice.

A text is cut into words where no piece can span the cut: before a space mark, around line ends, and
behind a run of Latin letters and digits if no piece goes on from one to anything else (``Model``
looks). The commonest words, ``DICTIONARY`` of them at most, are encoded as relations: every substring of
bounded length is exploded and joined to the piece table, the hits are a word's edges, grouped by
word, and a higher-order ``aggregate`` folds the lattice from left to right. For this kind of model
the best path is the one that merging reaches: of the edges that end at a place, exactly one follows
the edge chosen at its start without a merge across the seam that would come first (``Model.fits``).
Characters that no piece holds are edges too, to their bytes.

That dictionary has a fixed bound and goes to every worker, which puts documents together from it and
encodes the words that it lacks by merging. Joining those back as rows as well would shuffle every
text or a row for each word: see the README for figures.

Decoding joins the pieces' bytes and turns space marks to spaces.

Defined results: a null text counts as empty; an empty text has no pieces; an encoded text decodes to
itself unless it holds the space mark U+2581, which decodes to a space (``round_trip`` is then false);
repeated rows each get a row; very long words are merged with a heap, in n log n.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, tune

MARK = "▁"
DICTIONARY, WORD_CHARS, LATTICE_TASKS = 100_000, 48, 12
_LATIN = "0-9A-Za-zÀ-ÖØ-öø-ɏ"
COARSE = rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
FINE = rf"{MARK}?[{_LATIN}]+|\n|{MARK}*[^{_LATIN}{MARK}\n]*[{_LATIN}]*"
#: Words that a task counts before it hands them on; words that a worker remembers; when merging takes a heap.
_HELD, _MEMO, _HEAP_FROM = 250_000, 100_000, 64


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces and scores of a byte-pair model file, with the merge rule."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        self.size = len(ids)
        self.byte_ids = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        plain = [i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.id = {m.id_to_piece(i): i for i in plain}
        self.score = {m.id_to_piece(i): m.get_score(i) for i in plain}
        self.unknown = m.unk_id()
        self.pieces = [m.id_to_piece(i) for i in ids]
        self.longest = max(map(len, self.id))
        if any("\n" in p and len(p) > 1 or MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces span words")
        latin = re.compile(f"[{_LATIN}]")
        spans = any(latin.match(a) and not latin.match(b) for p in self.id for a, b in zip(p, p[1:]))
        self.words = COARSE if spans else FINE
        back = {i: b for b, i in self.byte_ids.items()}
        self.bytes = [bytes([back[i]]) if i in back else m.id_to_piece(i).replace(MARK, " ").encode() if m.id_to_piece(i) in self.id else b"" for i in ids]
        self._fits: dict[int, bool] = {}

    def parts(self, word: str) -> list[str]:
        """The word's pieces by merging: the best score first, the leftmost of equals."""
        return self._parts_long(word) if len(word) > _HEAP_FROM else self._parts_short(word)

    def _parts_short(self, word: str) -> list[str]:
        at, score = list(word), self.score.get
        low = float("-inf")
        s = [score(a + b, low) for a, b in zip(at, at[1:])]
        while s:
            best = max(s)
            if best == low:
                break
            i = s.index(best)
            at[i : i + 2] = [at[i] + at[i + 1]]
            del s[i]
            if i:
                s[i - 1] = score(at[i - 1] + at[i], low)
            if i < len(s):
                s[i] = score(at[i] + at[i + 1], low)
        return at

    def _parts_long(self, word: str) -> list[str]:
        at: list[str | None] = list(word)
        n, score = len(at), self.score.get
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (s := score(at[i] + at[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, len(at[i]) + len(at[after[i]])))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, size = heapq.heappop(heap)
            if at[i] is None or (j := after[i]) >= n or len(at[i]) + len(at[j]) != size:
                continue
            at[i], at[j] = at[i] + at[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in at if p is not None]

    def encode_word(self, word: str) -> list[int]:
        out = []
        for p in self.parts(word):
            if (i := self.id.get(p)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]
        return out

    def fits(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a: merging both together leaves them as they are."""
        key = a << 32 | b
        if (out := self._fits.get(key)) is None:
            if len(self._fits) > 100_000:
                self._fits.clear()
            x, y = self.pieces[a], self.pieces[b]
            out = self._fits[key] = self.parts(x + y) == [x, y]
        return out

    def decodes(self, ids: list[int], word: str) -> bool:
        """Whether the ids' bytes are the word, its marks as spaces."""
        return b"".join(map(self.bytes.__getitem__, ids)) == word.replace(MARK, " ").encode("utf-8", "replace")

    def reached(self) -> list[int]:
        """Ids of pieces that merging can make at all."""
        return [i for p, i in self.id.items() if self.parts(p) == [p]]


def marked(text: str | None) -> str:
    """The text as the model sees it: a mark before it, marks for spaces. Empty stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def _word_counts(words: str):
    """Partial counts of words of bounded length, handed on when a task holds many."""

    def run(batches):
        find, held = re.compile(words).findall, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(find(marked(text)))
                if len(held) >= _HELD:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return run


def _counted(held: Counter) -> pa.RecordBatch:
    rows = [(w, n) for w, n in held.items() if 0 < len(w) <= WORD_CHARS]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])


def common_words(docs: DataFrame, words: str, most: int = DICTIONARY) -> DataFrame:
    """word: the commonest, at most ``most``. The least count that is let in comes from a histogram
    of counts, so no task and no driver holds the words."""
    counts = docs.select("text").mapInArrow(_word_counts(words), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts.withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "words")
    left, least = most, None
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):  # 16 steps for each doubling
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return counts.where(F.col("step") >= (least if least is not None else 1 << 20)).select("word")


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [(model.pieces[i], i) for i in model.reached()]
    return spark.createDataFrame(pa.table({"piece": [p for p, _ in rows], "id": pa.array([i for _, i in rows], pa.int32())}))


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """word, edges (start, stop, id; id -1: a character that no piece holds) of each word."""
    words = words.repartition(LATTICE_TASKS, "word")  # the grouping below keeps this partitioning
    starts = words.select("word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("start"))
    subs = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start")))).alias("n"))
    subs = subs.select("word", "start", (F.col("start") + F.col("n")).alias("stop"), F.substring("word", F.col("start") + 1, F.col("n")).alias("piece"))
    edges = subs.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR stop = start + 1")  # the vocabulary's size is fixed
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("stop", "start", F.coalesce("id", F.lit(-1)).alias("id")))).alias("edges"))


def fold(lattices: DataFrame, model: Model) -> DataFrame:
    """word, ids: the path that merging reaches. A word that has none (not met so far) has null ids."""
    spark = lattices.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<array<int>>")
    def before(starts: pd.Series, stops: pd.Series, ids: pd.Series) -> pd.Series:
        """For each edge, which edges end at its start and may come before it."""
        fits, out = shared.value.fits, []
        for a, z, k in zip(starts, stops, ids, strict=True):
            a, k, ending = a.tolist(), k.tolist(), {}
            for i, stop in enumerate(z.tolist()):
                ending.setdefault(stop, []).append(i)
            out.append([[p for p in ending.get(start, ()) if k[p] < 0 or k[i] < 0 or fits(k[p], k[i])] for i, start in enumerate(a)])
        return pd.Series(out)

    rows = lattices.withColumn("prev", before("edges.start", "edges.stop", "edges.id"))
    rows = materialise(rows.withColumn("edges", F.transform("edges", lambda e, i: F.struct(i.alias("i"), e["start"].alias("start"), e["stop"].alias("stop"), e["id"].alias("id"), F.get("prev", i).alias("prev")))).drop("prev"), "lattices")
    # The state holds, for each place in the word, the edge chosen to end there; -1 for none.
    none = F.array_repeat(F.lit(-1), F.length("word") + 1)

    def step(state, e):
        good = (e["start"] == 0) | F.array_contains(e["prev"], F.get(state, e["start"]))
        return F.when(good & (F.get(state, e["stop"]) < 0), F.transform(state, lambda x, k: F.when(k == e["stop"], e["i"]).otherwise(x))).otherwise(state)

    rows = rows.withColumn("ends", F.aggregate("edges", none, step))
    back = F.aggregate(
        F.sequence(F.lit(1), F.length("word")),
        F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("path")),
        lambda a, _: F.when((a["at"] > 0) & (F.get("ends", a["at"]) >= 0), F.struct(F.get("edges", F.get("ends", a["at"]))["start"].alias("at"), F.concat(F.array(F.get("ends", a["at"])), a["path"]).alias("path"))).otherwise(a),
    )
    rows = rows.select("word", "edges", back.alias("back"))

    def ids_of(i):
        e = F.get("edges", i)
        code = F.hex(F.encode(F.substring(F.col("word"), e["start"] + 1, F.lit(1)), "UTF-8"))
        raw = F.transform(F.sequence(F.lit(1), F.length(code), F.lit(2)), lambda k: F.conv(F.substring(code, k, F.lit(2)), 16, 10).cast("int"))
        table = F.array(*[F.lit(model.byte_ids[b]) for b in range(256)]) if model.byte_ids else None
        unknown = F.transform(raw, lambda b: F.get(table, b)) if model.byte_ids else F.array(F.lit(model.unknown))
        return F.when(e["id"] >= 0, F.array(e["id"])).otherwise(unknown)

    return rows.select("word", F.when(F.col("back.at") == 0, F.flatten(F.transform("back.path", ids_of))).alias("ids"))


def dictionary(docs: DataFrame, model: Model, most: int = DICTIONARY) -> tuple[dict[str, bytes], frozenset[str]]:
    """Word -> its ids, four bytes each, of the commonest words: ``most`` at most, of bounded length; and
    those of them that do not decode to themselves."""
    words = common_words(docs, model.words, most)
    got = fold(lattice(words, piece_table(docs.sparkSession, model), model.longest), model).where("ids IS NOT NULL").toArrow()
    pairs = list(zip(got.column("word").to_pylist(), got.column("ids").to_pylist(), strict=True))
    return {w: np.array(x, np.int32).tobytes() for w, x in pairs}, frozenset(w for w, x in pairs if not model.decodes(x, w))


class Encoder(dict):
    """Word -> ids as bytes: the dictionary's words, and a bounded memory of others, merged when they
    come up. Whether a text decodes to itself is told by its words: each holds whole characters, so a
    text comes back if its words do, and decoding a distinct word once is enough."""

    def __init__(self, model: Model, known: dict[str, bytes], spoiled: frozenset[str] = frozenset()):
        super().__init__(known)
        self.model, self.most, self.find = model, len(known) + _MEMO, re.compile(model.words).findall
        self.known, self.known_spoiled, self.spoiled = known, spoiled, set(spoiled)

    def __missing__(self, word: str) -> bytes:
        ids = self.model.encode_word(word)
        out = np.array(ids, np.int32).tobytes()
        if not self.model.decodes(ids, word):
            self.spoiled.add(word)
        if len(word) <= WORD_CHARS:
            self[word] = out
        return out

    def encode(self, text: str | None) -> tuple[np.ndarray, bool]:
        """The text's ids, and whether they decode to it."""
        words = self.find(marked(text))
        ids = np.frombuffer(b"".join(map(self.__getitem__, words)), np.int32)
        same = MARK not in (text or "") and (not self.spoiled or self.spoiled.isdisjoint(words))
        if len(self) > self.most or len(self.spoiled) > _MEMO:  # between texts, so that none of a text's words is forgotten in it
            self.clear()
            self.update(self.known)
            self.spoiled = set(self.known_spoiled)
        return ids, same

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids of control pieces, or beyond the table, add nothing."""
        ids = ids[(ids >= 0) & (ids < self.model.size)]
        out = b"".join(map(self.model.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


_AT_WORK: dict[str, Encoder] = {}


def _encoder(shared, tag: str) -> Encoder:
    """The worker's encoder: it outlives a task, and so does what it remembers."""
    if tag not in _AT_WORK:
        _AT_WORK.clear()
        model, (known, spoiled) = shared.value
        _AT_WORK[tag] = Encoder(model, known, spoiled)
    return _AT_WORK[tag]


def encode(docs: DataFrame, model_path: str | None = None, most: int = DICTIONARY) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of every row: the text's piece ids, and whether they decode
    to the text."""
    tune(docs.sparkSession)
    model = Model(model_path or default_model_path())
    shared, tag = docs.sparkSession.sparkContext.broadcast((model, dictionary(docs, model, most))), uuid.uuid4().hex

    def run(batches):
        coder = _encoder(shared, tag)
        for b in batches:
            ids, same = [], []
            for text in b.column(1).to_pylist():
                x, back = coder.encode(text)
                ids.append(x)
                same.append(back)
            sizes = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, ids array<int>, round_trip boolean")


def decode(rows: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, text of rows with doc_id and ids. Null ids decode to an empty text."""
    tune(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Model(model_path or default_model_path()))

    def run(batches):
        coder = Encoder(shared.value, {})
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(np.array([i for i in x or [] if i is not None], np.int64)) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")

"""Personal data: base patterns by contract, and a linear-chain CRF over word-shape features.

The CRF reads a text line by line, each line whole. Its labels are ``O``, ``NAME``, ``EMAIL``, ``PHONE``, ``IP``,
``CARD`` and ``ID``; a word's features are its shape, spelling, beginning and end, and the shapes and
spellings of two words on either side, sentence ends among them. It is trained once, on the driver,
from the small labelled table below, sent to the workers, and decoded by Viterbi, many lines of a
batch at once, in numpy. Runs of words that it labels NAME or ID, and contact runs that no base pattern
covers, are added as spans of kinds ``crf_name``, ``crf_id``, ``crf_email``, ``crf_phone``,
``crf_ip``, ``crf_card``; base spans stay.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each get a
row; offsets are code points, ends exclusive. Base patterns run over whole texts in linear time. A
line is never cut, however long: lines of like length are decoded together, in at most ``CELLS``
padded words unless one line has more.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import join_spans, sha256_hex, tune

BASE = ("email", "ip", "card", "phone")
# The base patterns. What stands before "@" is found from the "@", backwards.
EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind as listed, then by start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LEFT:
            start -= 1
        if start < at and (m := EMAIL_RIGHT.match(text, at)):
            out.append(("email", start, done := m.end()))
        else:
            done = max(done, at + 1) if start == at else done
        at = text.find("@", max(at + 1, done))
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


# ---- the linear-chain CRF ----

LABELS = ("O", "NAME", "EMAIL", "PHONE", "IP", "CARD", "ID")
CELLS = 20_000
#: Features that fewer words of the table have are left out: they tell one word apart, not a kind.
LEAST_MET = 2
# The labelled table, one line a sentence, word/LABEL; a word without one is O.
TABLE = """
Please contact Mr. John/NAME Ashworth/NAME about the order
Mrs. Ana/NAME Velasco/NAME was there on Monday and left
Ask Dr. Peter/NAME Wendell/NAME for the report
Dear Ms. Claire/NAME Marchand/NAME , thank you for the letter
Prof. Ingrid/NAME Solheim/NAME gave the lecture on rivers
My name is Robert/NAME Calloway/NAME and I live near the bridge
her name is Susan/NAME Pettigrew/NAME
I am Daniel/NAME Okafor/NAME from the office
this is Laura/NAME Kimball/NAME speaking
Alice/NAME Fenwick/NAME met Bob/NAME Tarrant/NAME at the station
Emma/NAME Lindgren/NAME called Oscar/NAME Dunleavy/NAME last night
George/NAME Haddon/NAME and Ruth/NAME Castellan/NAME signed the letter
we spoke with Henry/NAME Blackwell/NAME about it
a letter from Nora/NAME Whitcombe/NAME came today
the book by Walter/NAME Greaves/NAME was sold
it was sent to Irene/NAME Maddox/NAME by post
Martin/NAME Kessler/NAME wrote the report in May
yesterday Julia/NAME Prescott/NAME left the house
the owner , Frank/NAME Ibsen/NAME , said no
the doctor saw Helen/NAME Rourke/NAME and sent her home
signed by Victor/NAME Langley/NAME
regards , Sophie/NAME Arnaud/NAME
according to Philip/NAME Stanhope/NAME the work is done
Name: Hans/NAME Vogelsang/NAME Phone: 030-887-4410/PHONE
Name: Maria/NAME Ferrante/NAME Email: maria/EMAIL [at]/EMAIL posta/EMAIL [dot]/EMAIL net/EMAIL
Customer: Thomas/NAME Abernathy/NAME
Contact: Grace/NAME Muldoon/NAME , tel. 0117-496-0188/PHONE
Herr Klaus/NAME Brandt/NAME wohnt in der Stadt
Frau Petra/NAME Zeller/NAME hat das Haus gekauft
ich heisse Jonas/NAME Reuter/NAME
mein Name ist Greta/NAME Hollmann/NAME
von Anton/NAME Riedel/NAME an die Firma
me llamo Carmen/NAME Ibarra/NAME
el señor Luis/NAME Montero/NAME vive en la calle
la señora Elena/NAME Prado/NAME compró la casa
Javier/NAME Salcedo/NAME habló con Marta/NAME Quiroga/NAME
je m'appelle Luc/NAME Delorme/NAME
Monsieur Henri/NAME Gaillard/NAME habite à la campagne
Madame Odile/NAME Perrin/NAME a vendu la maison
Paul/NAME Mercier/NAME a parlé avec Anne/NAME Fournier/NAME
write to quentin@harbour-mail.net/EMAIL or call 0161-496-0735/PHONE today
send it to b.farrow@lantern.example/EMAIL now
email: tess.holm@orchard.example/EMAIL
mail kurt/EMAIL (at)/EMAIL werkstatt/EMAIL (dot)/EMAIL de/EMAIL please
reach me : olga/EMAIL [at]/EMAIL dacha/EMAIL [dot]/EMAIL ru/EMAIL
call (0131)/PHONE 496-0822/PHONE after noon
call me at 0113-496-0550/PHONE
phone 020-7946-0311/PHONE before six
Phone: 0151-496-0947/PHONE
tel: (028)/PHONE 9649-6060/PHONE
my number is 0118-496-0273/PHONE
ring 212-664-7665/PHONE for details
Telefon 089-1234-5567/PHONE ab neun Uhr
the fax is 415-387-2046/PHONE
The server 10.44.0.12/IP did not answer
ping 172.20.9.81/IP and wait
connect to 198.51.100.23/IP on port 22
host 203.0.113.77/IP is down
pay by card 6011-0009-9013-9424/CARD before noon
card number 3566002020360505/CARD expires soon
charged to 5105-1051-0510-5100/CARD on Friday
SSN: 457-55-5462/ID is on file
his SSN 212-09-7694/ID was lost
social security number 530-82-4461/ID
SSN 001-02-1234/ID
The report of 2019 had 450 pages and 12 tables
On Monday The Council met In Paris with 3 members
It rained. The sun came out. People left the Hall in May
Version 1.2.3 was released on 2020-01-02 at 10:30
Released under the MIT License in 2004
All Rights Reserved by the Company
We saw The Old House and the New Bridge
The United Nations met in New York last week
the Bank of England raised the rate in June
The Great Wall is in China and the Red Sea is far
He went to San Francisco on Saturday
the North Station and the South Gate were closed
Chapter Two: The Long Road Home
Table of Contents
Terms and Conditions apply to all orders
Read More About This Topic Here
Open the File menu and choose Save As
Click Sign In or Log Out at the top
How To Make Bread At Home
Good Morning and Happy New Year
Monday Tuesday Wednesday Thursday Friday
January and February were cold
the Second World War ended in 1945
Queen Street runs past Market Square
a price of 1,200.50 euros or 35% more
In 1999 about 1500 people lived there
order 48291 was sent on time
the code is 993-20 and the room is 12-4
pages 100-250 are missing
from 8:30 to 17:45 every day
the score was 3-1 after 90 minutes
call the office after noon
please call back at ten
the name of the river is old
her name was not on the list
he met the team at the gate
she wrote to the paper
the and of it was with for on at by from that
Stone. River. Tree. Hall. They are all there
River Stone Tree Hall Road Gate
The river. The stone. The gate. Then home
Water And Stone And Fire
It is. It was. It will be. So they said
Der Mann und die Frau . Das Haus ist alt
Die Stadt am Fluss hat eine Alte Brücke
Am Montag kommt der Zug um acht
Das Alte Haus steht am Großen Platz
Der Hund und die Katze im Garten
La casa de la tia . El perro come
El Gran Teatro está en la Plaza Mayor
Los niños juegan en el parque
Les enfants de la ville . Le chat dort
Le Grand Hôtel est près de la Place Centrale
La Tour est haute et le ciel est bleu
id 7602ad27cf5550de1c and token 1beb58b8af68854f
key 0x3fa9 and hash e3b0c44298fc1c14
| a | b | c | 10 | 20 | 30 |
A B C D E F G ... !!! ### --- ***
THE PRICE IS RIGHT!! AND THE SHOW IS OVER!!
THE. SUN!! CAME,, OUT. AGAIN!!
Order 1234567890123456 was sent
see http://example.org/path for more
www.example.org has the text
"""
_TITLES = frozenset("mr. mrs. ms. dr. prof. mr mrs ms dr herr frau monsieur madame señor señora name: customer: contact:".split())
_CUES = frozenset("phone: tel: tel. call ring phone email: e-mail: mail ssn: ssn card ping server host number".split())
_EDGES = ",;!?\"'"


def shape(word: str) -> str:
    """The word's class: cues as such, characters by class with runs shortened, digit counts kept
    where a format shows in them."""
    low = word.lower()
    if low in _TITLES or low in _CUES:
        return "=" + low
    if word.isalpha():
        return "x" if word.islower() else "X" if word.isupper() else "Xx" if word[1:].islower() else "xX"
    word = word.strip(_EDGES)[:64]
    if word.isalpha():
        return shape(word) + ","
    if len(word) > 1 and word[-1] in ".:" and word[:-1].isalpha():
        return shape(word[:-1]) + "."
    marks = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: "0" * min(len(m[0]), 5), word))
    if "@" in marks or re.search(r"[\[(](at|dot)[\])]", low):
        return "@"
    return marks if len(marks) <= 20 and "0" in marks else "?"


def _ends(word: str) -> bool:
    return word[-1:] in ".!?:|" and word.lower() not in _TITLES


def _own_features(word: str) -> tuple[str, ...]:
    """Of a word by itself: shape, spelling, beginning and end, and whether it ends a sentence."""
    low = word.strip(_EDGES).lower()
    letters = low if low.isalpha() else ""
    return ("b", f"c:{shape(word)}", f"w:{low[:32]}", f"s:{shape(word)}{letters[-3:]}", f"t:{shape(word)}{letters[-2:]}", f"q:{shape(word)}{letters[:2]}", f"e:{_ends(word)}")


#: Of a word as a neighbour, and how far away it may stand: two words on either side.
SIDES = (-1, 1, -2, 2)


def _context(word: str | None) -> tuple[str, str, str]:
    """What neighbours see: shape, spelling, and whether a sentence ends with it. None: beyond the line."""
    if word is None:
        return "^", "^", "^"
    return shape(word), word.strip(_EDGES).lower()[:32], f"{shape(word)[:2]}{_ends(word)}"


def _features(words: list[str]) -> list[list[str]]:
    pad = [None, None, *words, None, None]
    around = [[f"{side}{kind}:{value}" for side in SIDES for kind, value in zip("cwe", _context(pad[i + 2 + side]), strict=True)] for i in range(len(words))]
    pairs = [[f"{kind}:{shape(w)}/{_context(pad[i + at])[2]}" for kind, at in (("p", 1), ("n", 3))] for i, w in enumerate(words)]
    return [[*_own_features(w), *near, *both] for w, near, both in zip(words, around, pairs, strict=True)]


def labelled(table: str = TABLE) -> list[tuple[list[str], list[int]]]:
    """Words and labels of each line of a table."""
    out = []
    for line in table.strip().splitlines():
        pairs = [(w, "O") if (t := w.rpartition("/"))[2] not in LABELS else (t[0], t[2]) for w in line.split()]
        out.append(([w for w, _ in pairs], [LABELS.index(x) for _, x in pairs]))
    return out


class Crf:
    """Weights ``w`` (feature, label) and ``a`` (label, label), fit by gradient steps on the regularised
    log-likelihood, with the forward-backward recursions over all sentences at once."""

    def __init__(self, data: list[tuple[list[str], list[int]]] | None = None, rounds: int = 80, rate: float = 0.3, penalty: float = 0.005):
        data = labelled() if data is None else data
        found = [_features(words) for words, _ in data]
        times = Counter(f for s in found for fs in s for f in fs)
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in times.items() if n >= LEAST_MET))}
        k, size, width = len(LABELS), [len(w) for w, _ in data], max(len(w) for w, _ in data)
        x = np.zeros((sum(size), len(self.index)), np.float32)
        flat = [fs for s in found for fs in s]
        for i, fs in enumerate(flat):
            x[i, [self.index[f] for f in fs if f in self.index]] = 1
        mask = np.arange(width)[None, :] < np.array(size)[:, None]
        y = np.zeros(mask.shape, np.int64)
        y[mask] = np.concatenate([labels for _, labels in data])
        gold = np.eye(k)[y] * mask[..., None]
        steps = np.einsum("ntk,ntl->kl", gold[:, :-1], gold[:, 1:])
        self.w, self.a = np.zeros((len(self.index), k)), np.zeros((k, k))
        sums = [np.full_like(self.w, 1e-8), np.full_like(self.a, 1e-8)]
        for _ in range(rounds):
            e = np.zeros((*mask.shape, k))
            e[mask] = x @ self.w
            p, pair = marginals(e, mask, self.a)
            gw = x.T @ (gold - p)[mask] - penalty * self.w * len(data)
            ga = steps - pair - penalty * self.a * len(data)
            for m, g, s in ((self.w, gw / len(data), sums[0]), (self.a, ga / len(data), sums[1])):
                s += g * g
                m += rate * g / np.sqrt(s)

    def weights(self, features: list[str]) -> np.ndarray:
        """Their sum; features that the table lacks add nothing."""
        return self.w[[self.index[f] for f in features if f in self.index]].sum(0)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def marginals(e: np.ndarray, mask: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of padded sentences: each word's label probabilities, and expected label steps in all. e:
    (sentence, position, label); mask: which positions are words."""
    n, width, k = e.shape
    f, b = e.copy(), np.zeros_like(e)
    for t in range(1, width):
        f[:, t] = np.where(mask[:, t, None], e[:, t] + _log_sum(f[:, t - 1, :, None] + a, 1), f[:, t - 1])
    for t in range(width - 2, -1, -1):
        b[:, t] = np.where(mask[:, t + 1, None], _log_sum(a + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
    z = _log_sum(f[:, -1], 1)
    p = np.where(mask[..., None], np.exp(f + b - z[:, None, None]), 0)
    pair = np.zeros((k, k))
    for t in range(width - 1):
        step = f[:, t, :, None] + a + (e[:, t + 1] + b[:, t + 1])[:, None, :] - z[:, None, None]
        pair += np.exp(step)[mask[:, t + 1]].sum(0)
    return p, pair


def viterbi(emit: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once. emit: (sequence, position, label), padded."""
    n, t, k = emit.shape
    if n == 1:  # one long sequence: the same steps without the padding
        return _best_path(emit[0], a)[None]
    best, back = emit[:, 0].copy(), np.zeros((n, t, k), np.int8)
    shortest = int(lengths.min()) if n else 0
    for i in range(1, t):
        step = best[:, :, None] + a[None]
        if i < shortest:  # no sequence has ended yet
            back[:, i] = step.argmax(1)
            best = step.max(1) + emit[:, i]
            continue
        back[:, i] = step.argmax(1)
        go = (i < lengths)[:, None]
        best = np.where(go, step.max(1) + emit[:, i], best)
        back[:, i] = np.where(go, back[:, i], np.arange(k))
    out = np.zeros((n, t), np.int8)
    out[:, -1] = best.argmax(1)
    rows = np.arange(n)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[rows, i, out[:, i]]
    return out


def _best_path(emit: np.ndarray, a: np.ndarray) -> np.ndarray:
    best, t = emit[0], len(emit)
    back = np.empty(emit.shape, np.int8)
    into = np.ascontiguousarray(a.T)  # by the label that is entered
    for i in range(1, t):
        step = into + best
        back[i] = step.argmax(1)
        best = step.max(1) + emit[i]
    out = np.empty(t, np.int8)
    out[-1] = at = int(best.argmax())
    for i, row in zip(range(t - 2, -1, -1), back[:0:-1].tolist(), strict=False):
        out[i] = at = row[at]
    return out


def _alike(n: np.ndarray):
    """Places in ``n`` by size, in groups whose number times largest size is at most CELLS, or of one."""
    order = np.argsort(n, kind="stable")
    first = 0
    for i, size in enumerate(n[order].tolist()):
        if i > first and (i - first + 1) * size > CELLS:
            yield order[first:i]
            first = i
    if len(order):
        yield order[first:]


class Tagger:
    """The CRF with its scores as tables: one row for each kind of word by itself, one for each kind of
    neighbour. Only features that the table knows make kinds, so there are few; which kind a word is of
    is remembered for a bounded number of words."""

    def __init__(self, crf: Crf):
        self.crf, self.step = crf, crf.a.astype(np.float32)
        self.kinds: dict[tuple, int] = {}
        self.contexts: dict[tuple, int] = {}
        self.words: dict[str, int] = {}
        self.context_of: list[int] = []
        self.own_rows: list[np.ndarray] = []
        self.near_rows: list[np.ndarray] = []
        self.shapes: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.shape_of: list[int] = []
        self.mark_of: list[int] = []
        self.tables: tuple = ()
        self.spellings = {f[f.index("w:") + 2 :] for f in crf.index if f.lstrip("-12").startswith("w:")}
        self.parts = {f[2:] for f in crf.index if f[:2] in ("s:", "t:", "q:")}
        self.edge = self._context(None)

    def _context(self, word: str | None, key: tuple = ("^", "^", "^")) -> int:
        if (i := self.contexts.get(key)) is None:
            i = self.contexts[key] = len(self.contexts)
            seen = _context(word)
            self.near_rows.append(np.array([self.crf.weights([f"{side}{kind}:{value}" for kind, value in zip("cwe", seen, strict=True)]) for side in SIDES]))
            self.mark_of.append(self.marks.setdefault(seen[2], len(self.marks)))
        return i

    def word(self, w: str) -> int:
        """The kind of a word: what of it the table can know, and nothing else."""
        form, low, ends = shape(w), w.strip(_EDGES).lower(), _ends(w)
        spelled = low[:32] if low[:32] in self.spellings else ""
        if low.isalpha():
            tail, two, head = form + low[-3:], form + low[-2:], form + low[:2]
        else:
            tail = two = head = form
        key = (form, spelled, tail if tail in self.parts else "", two if two in self.parts else "", head if head in self.parts else "", ends)
        if (i := self.kinds.get(key)) is None:
            i = self.kinds[key] = len(self.kinds)
            self.own_rows.append(self.crf.weights(list(_own_features(w))))
            self.context_of.append(self._context(w, (form, spelled, ends)))
            self.shape_of.append(self.shapes.setdefault(form, len(self.shapes)))
        self.words[w] = i
        return i

    def _tables(self) -> tuple:
        """By kind: its own scores, its context, its shape; by context: scores on each side, its mark; by
        shape and the mark before or behind it, what the two add together. Made anew where kinds have come up."""
        if not self.tables or len(self.tables[0]) < len(self.kinds) or len(self.tables[4]) < len(self.contexts):
            pair = np.array([[[self.crf.weights([f"{kind}:{s}/{m}"]) for m in self.marks] for s in self.shapes] for kind in "pn"])
            self.tables = (
                np.array(self.own_rows, np.float32), np.array(self.context_of), np.array(self.shape_of),
                np.ascontiguousarray(np.array(self.near_rows, np.float32).transpose(1, 0, 2)), np.array(self.mark_of), pair.astype(np.float32).reshape(2, -1, len(LABELS)),
            )
        return self.tables

    def label(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Labels of each line's words."""
        if len(self.words) > 100_000:
            self.words.clear()
        get, word = self.words.get, self.word
        ids = [[i if (i := get(w)) is not None else word(w) for w in c] for c in lines]
        n = np.array([len(c) for c in ids])
        out: list = [None] * len(ids)
        if not any(map(len, ids)):
            return [np.zeros(0, np.int8) for _ in ids]
        own, context, shapes, near, marks, pair = self._tables()
        for part in _alike(n):
            size, width = n[part], int(n[part].max())
            inside = np.arange(width)[None, :] < size[:, None]
            kinds = np.zeros((len(part), width), np.int64)
            kinds[inside] = np.concatenate([ids[i] for i in part])
            around = np.full((len(part), width + 4), self.edge, np.int64)
            around[:, 2:-2][inside] = context[kinds[inside]]
            emit = own.take(kinds, axis=0)
            for side, table in zip(SIDES, near, strict=True):
                emit += table.take(around[:, 2 + side : 2 + side + width], axis=0)
            form, mark = shapes.take(kinds) * len(self.marks), marks.take(around)
            for table, at in zip(pair, (1, 3), strict=True):
                emit += table.take(form + mark[:, at : at + width], axis=0)
            found = viterbi(emit, size, self.step)
            for r, i in enumerate(part):
                out[i] = found[r, : n[i]]
        return out


@functools.lru_cache(1)
def trained() -> Crf:
    """The CRF of the whole table: fit once, on the driver, and sent to the workers."""
    return Crf()


def _lines(text: str):
    """(offset, words) of each line that has words."""
    at = 0
    for line in text.split("\n"):
        if words := line.split():
            yield at, words
        at += len(line) + 1


def _holds(label: str, found: str) -> bool:
    """Numbers must pass the check of their kind, as in the base kinds; a name is a few words, each with
    a capital."""
    digits = "".join(_DIGIT.findall(found))
    if label == "CARD":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if label == "PHONE":
        return 8 <= len(digits) <= 15
    if label == "IP":
        return all(x.isdigit() and int(x[:4]) <= 255 for x in found.split("."))
    if label == "NAME":
        words = found.split()
        return len(words) <= 5 and all(w[0].isupper() for w in words)
    return label != "ID" or len(digits) == 9


def _added(text: str, labelled, base) -> list[tuple[str, int, int]]:
    """Runs of one label, as spans without the marks around them, that meet no base span."""
    out = []
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    reach = list(itertools.accumulate((e for _, e in taken), max))
    for offset, labels in labelled:
        line_end = text.find("\n", offset)
        line = text[offset : line_end if line_end >= 0 else len(text)]
        spots = [(m.start(), m.end()) for m in re.finditer(r"\S+", line)]
        cuts = [0, *(np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist(), len(labels)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if kind := labels[i]:
                start, end = offset + spots[i][0], offset + spots[j - 1][1]
                while start < end and not (text[start].isalnum() or text[start] in "+(["):
                    start += 1
                while start < end and not (text[end - 1].isalnum() or text[end - 1] in ")]"):
                    end -= 1
                before = bisect.bisect_left(starts, end)  # base spans that start ahead of the end
                free = not before or reach[before - 1] <= start
                if start < end and free and _holds(LABELS[kind], text[start:end]):
                    out.append(("crf_" + LABELS[kind].lower(), start, end))
    return out


def find_spans(texts: list[str | None], tagger: Tagger) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    texts = [t or "" for t in texts]
    base, where, words = [base_spans(t) for t in texts], [], []
    for i, t in enumerate(texts):
        for offset, line in _lines(t):
            where.append((i, offset))
            words.append(line)
    marked: dict[int, list] = {}
    for (i, offset), labels in zip(where, tagger.label(words), strict=True):
        if labels.any():
            marked.setdefault(i, []).append((offset, labels))
    return [(b, sorted(_added(t, marked.get(i, ()), b))) for i, (t, b) in enumerate(zip(texts, base, strict=True))]


_OUT = "doc_id {}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _finder(shared):
    def run(batches):
        tagger = Tagger(shared.value)
        for b in batches:
            rows = []
            for base, added in find_spans(b.column(1).to_pylist(), tagger):
                rows.append([*(sum(s[0] == k for s in base) for k in BASE), sha256_hex(join_spans(base).encode()), join_spans([*base, *added]), len(added)])
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return run


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, digest of base spans, all spans, count of added ones."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # as large as the table makes it
    return docs.select("doc_id", "text").mapInArrow(_finder(shared), _OUT.format(docs.schema["doc_id"].dataType.simpleString()))

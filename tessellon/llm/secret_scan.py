"""Secret scans: keyword automaton, anchored expressions at its hits, checksums where tokens embed one.

One Aho-Corasick pass over a text finds keywords; an expression is tried only at a hit, anchored
there. Runs of hex digits have no keyword, so their hits come from a scan for the digit class itself.
Kinds with an embedded checksum are kept only if it holds.

Base kinds, by contract: ``assign``, ``access``, ``hex``. Further kinds of this method: ``github``
(CRC-32 in base 62 at the end), ``npm`` (the same), ``jwt`` (header decodes to JSON with "alg"),
``pem`` (a private key block's header line). Further spans are added; base ones stay.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows each get a
row; offsets are code points, ends exclusive; texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spans, sha256_hex, tune

# The patterns of the base kinds, with the least length of what counts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"}
# Token formats with checks of their own.
CHECKED = {
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": (("npm_",), r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": (("eyj",), r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]{16,}"),
    "pem": (("-----begin ",), r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
}
KINDS = ("assign", "access", "hex", *CHECKED)
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.rjust(6, "0")


def _checks(kind: str, found: str) -> bool:
    if kind in ("github", "npm"):
        return base62_crc(found[4:-6]) == found[-6:]
    if kind == "jwt":
        head = found.split(".", 1)[0]
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        except ValueError:
            return False
    return True


class Scanner:
    """Compiled once in each worker."""

    def __init__(self):
        self.words = ahocorasick.Automaton()
        for word, kind in [*KEYWORDS.items(), *((w, k) for k, (ws, _) in CHECKED.items() for w in ws)]:
            self.words.add_word(word, (kind, len(word)))
        self.words.make_automaton()
        self.at = {"assign": re.compile(ASSIGN, re.I | re.A), "access": re.compile(ACCESS)} | {k: re.compile(p) for k, (_, p) in CHECKED.items()}
        self.hex = re.compile(HEX)
        self.run = re.compile(r"[A-Za-z0-9_-]*")

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """Spans (kind, start, end), by start and then by kind as listed."""
        # ASCII letters alone are lowered, so that offsets hold.
        low = text.lower() if text.isascii() else text.translate(_LOWER)
        out, done = [], {}
        for end, (kind, n) in self.words.iter(low):
            start = end + 1 - n
            if start < done.get(kind, 0):
                continue
            if not (m := self.at[kind].match(text, start)):
                if kind == "jwt":  # what failed here fails everywhere in this run of its characters
                    done[kind] = self.run.match(text, start).end()
                continue
            done[kind] = m.end()
            if kind == "assign":
                good = m.end(2) - m.start(2) >= ASSIGN_LEAST
            elif kind == "access":
                good = m.end() - start >= ACCESS_LEAST
            else:
                good = _checks(kind, m[0])
            if good:
                out.append((kind, start, m.end()))
        out += [("hex", m.start(), m.end()) for m in self.hex.finditer(text)]
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_LOWER = {c: c + 32 for c in range(65, 91)}
_OUT = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long"


def _scan(batches):
    scan = Scanner()
    for b in batches:
        rows = []
        for text in b.column(1).to_pylist():
            spans = scan(text or "")
            base = [s for s in spans if s[0] in KINDS[:3]]
            rows.append([*(sum(s[0] == k for s in base) for k in KINDS[:3]), sha256_hex(join_spans(base).encode()), join_spans(spans), len(spans) - len(base)])
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, digest of base spans, all spans, count of checksummed ones."""
    tune(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, _OUT.format(docs.schema["doc_id"].dataType.simpleString()))


MASK = "[SECRET]"


def redact(text: str | None, scan: Scanner) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by a mask."""
    spans = scan(text) if text else []
    if not spans:
        return text
    out, done, at = [], 0, -1
    for _, start, end in spans:
        if start >= at:
            out += [text[done:start], MASK]
        at = done = max(at, end)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The same columns with secrets masked in ``text`` and ``n_chars`` brought up to date."""
    tune(docs.sparkSession)
    names = docs.columns
    spot = names.index("text")

    def run(batches):
        scan = Scanner()
        for b in batches:
            yield b.set_column(spot, b.schema.field(spot).with_nullable(True), pa.array([redact(t, scan) for t in b.column(spot).to_pylist()], b.schema.field(spot).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out

"""Secret scans with multipart credential linking.

Base spans are strong by themselves: assigned passwords and tokens, access identifiers and
long hexadecimal strings.  Weak parts - login names, unlabelled strings of mixed characters,
endpoints - are common in clean text, so they count only together: an interval join within
each text links parts whose gap is at most ``reach`` code points and that no blank line
separates, and a weak part is reported only if complementary parts are in its scope:

* ident: a login or key identifier beside a secret (strong or weak),
* secret: an unlabelled random-looking string beside an identifier or an endpoint,
* endpoint: a URL or host with port that has an identifier and a secret beside it.

Spans are in code points, end exclusive.  Null text is empty and has no spans.  Repeated rows
and null ids are scanned like any other row; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm._spark import arrow_batches
from weftline.llm._text import slices

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENT = re.compile(r"""(?<![A-Za-z0-9_])(user(?:_?name|_?id)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20"'<>]+|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)+:[0-9]{2,5}(?![0-9])""", re.A)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def base_spans(text: str, hex_too: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strong parts."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hex_too:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def looks_random(word: str) -> bool:
    """Upper and lower case and digits, and an entropy of 3.5 bits a character or more."""
    if not (re.search("[a-z]", word) and re.search("[A-Z]", word) and len(re.findall("[0-9]", word)) >= 2):
        return False
    return -sum(n / len(word) * math.log2(n / len(word)) for n in Counter(word).values()) >= 3.5


class _Near:
    """Interval join of one kind of part: is one within reach of a span, in the same paragraph?

    Of the parts behind a span the nearest decides, as no other is within reach or the paragraph if
    it is not; of those before it, all that end within reach are looked at.
    """

    def __init__(self, spans, reach: int, cuts: list[int]):
        self.reach, self.cuts = reach, cuts
        self.starts = sorted(s for s, _ in spans)
        self.by_end = sorted((e, s) for s, e in spans)

    def beside(self, start: int, end: int) -> bool:
        own = bisect_right(self.cuts, start)
        at = bisect_left(self.starts, end)
        if at < len(self.starts) and self.starts[at] - end <= self.reach and bisect_right(self.cuts, self.starts[at]) == own:
            return True
        at, to = bisect_left(self.by_end, (start - self.reach, -1)), bisect_right(self.by_end, (start, start))
        return any(bisect_right(self.cuts, s) == own for _, s in self.by_end[at:to])


class _Taken:
    """Which stretches overlap no span of a list."""

    def __init__(self, spans):
        spans = sorted(spans)
        self.starts = [s for s, _ in spans]
        self.ends = list(accumulate((e for _, e in spans), max))

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return not at or self.ends[at - 1] <= start


def linked_spans(text: str, base: list[tuple[int, int, int]], reach: int = 200) -> list[tuple[int, int, int]]:
    """The weak parts that complementary parts support."""
    weak_ids = [m.span() for m in IDENT.finditer(text)]
    ends = [(m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    ids = [(s, e) for s, k, e in base if k == 1] + weak_ids
    if not ids and not ends:
        return []
    free = _Taken([(s, e) for s, _, e in base] + weak_ids + ends).free
    weak_secrets = [m.span() for m in RANDOM.finditer(text) if looks_random(m[0]) and free(*m.span())]
    cuts = [m.start() for m in BLANK_LINE.finditer(text)]
    near = {"id": _Near(ids, reach, cuts), "end": _Near(ends, reach, cuts), "secret": _Near([(s, e) for s, k, e in base if k != 1] + weak_secrets, reach, cuts)}
    out = [(s, 3, e) for s, e in weak_ids if near["secret"].beside(s, e)]
    out += [(s, 4, e) for s, e in weak_secrets if near["id"].beside(s, e) or near["end"].beside(s, e)]
    out += [(s, 5, e) for s, e in ends if near["id"].beside(s, e) and near["secret"].beside(s, e)]
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _long_hex(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold 24 hexadecimal digits in a row."""
    own = np.concatenate([[0], _HEX[data].view(np.int8), [0]])
    edge = np.diff(own)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long_ = end - start >= 24
    out = np.zeros(len(offsets) - 1, bool)
    first, last = np.searchsorted(offsets, start[long_], "right") - 1, np.searchsorted(offsets, end[long_] - 1, "right") - 1
    for a, b in zip(first, last, strict=True):  # a run may cross texts; the pattern settles it
        out[a : b + 1] = True
    return out


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(reach: int):
    def run(batches):
        for batch, data, offsets in slices(batches):
            hexes, rows = _long_hex(data, offsets), []
            view = memoryview(data)
            for i in range(batch.num_rows):
                held = bytes(view[offsets[i] : offsets[i + 1]])
                lower = held.lower()
                base: list = []
                strong = hexes[i] or b"AKIA" in held or any(w in lower for w in ASSIGN_WORDS)
                weak = b"://" in held or b":" in held or b"=" in held
                if strong or weak:
                    text = held.decode()
                    base = base_spans(text, bool(hexes[i])) if strong else []
                    more = linked_spans(text, base, reach) if weak or base else []
                else:
                    more = []
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def scan_secrets(documents: DataFrame, reach: int = 200) -> DataFrame:
    """One row a document: counts and a digest of the base spans, and all spans."""
    arrow_batches(documents.sparkSession)
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_scan(reach), SPANS)

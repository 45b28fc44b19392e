"""Secrets in texts: strong patterns, and multipart credentials linked within scopes.

A scope is a stretch of text without a blank line. Within it, the parts of a credential are
access identifiers, secrets and endpoints, each an interval widened by ``reach`` code points. A
part too weak to stand alone is reported only if what completes it lies in reach: an identifier or
an endpoint beside a secret, a weak secret beside an identifier or an endpoint. The join sweeps
the intervals sorted by start, and a task holds the parts of one text at a time.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = 200
#: Bits a character that a weak secret needs at least.
MIN_ENTROPY = 3.2
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Bytes of hex letters become "h"; a long run of them is then found by plain search.
HEX_MARKS, HEX_RUN = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256)), b"h" * 24
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:access[_-]?key(?:[_-]?id)?|client[_-]?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?<![A-Za-z0-9])(?:[a-z][a-z0-9+]{1,15}://[^\s"'<>|]{3,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:_-]{3,})""", re.I | re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong patterns, each kind leftmost and without overlaps."""
    raw = text.encode()
    lower = raw.lower()
    spans = []
    if any(w in lower for w in WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if HEX_RUN in raw.translate(HEX_MARKS):
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=order)


def order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def entropy(value: str) -> float:
    counts = Counter(value).values()
    return -sum(c / len(value) * math.log2(c / len(value)) for c in counts)


def looks_random(value: str) -> bool:
    """Letters in both cases and digits, or many different characters with digits among them."""
    kinds = sum(any(f(c) for c in value) for f in (str.isupper, str.islower, str.isdigit))
    return any(map(str.isdigit, value)) and kinds >= 2 and entropy(value) >= MIN_ENTROPY


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int, str]]:
    """Weak parts whose complement lies in the same scope and in reach; none inside a base span."""
    weak = []
    lower = text.lower()
    if any(w in lower for w in ("access", "client", "account", "user", "login")):
        weak += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
    if "://" in text or any(w in lower for w in ("host", "endpoint", "server")):
        weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if not weak and not base:
        return []
    weak += [(m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text) if looks_random(m[0])]
    inside = Intervals(base)
    weak = [w for w in weak if not inside.near(w[0], w[1])]
    taken = Intervals([w for w in weak if w[2] != "weak_secret"])
    weak = [w for w in weak if w[2] != "weak_secret" or not taken.near(w[0], w[1])]
    if not weak:
        return []
    scope_ends = [m.start() for m in BLANK.finditer(text)]
    scope = lambda at: bisect.bisect_right(scope_ends, at)
    roles = {"access": "name", "identifier": "name", "endpoint": "place", "assign": "secret", "hex": "secret", "weak_secret": "secret"}
    parts: dict[tuple[int, str], list[tuple[int, int, str]]] = {}
    for span in sorted(base + weak, key=order):
        parts.setdefault((scope(span[0]), roles[span[2]]), []).append(span)
    found = {k: Intervals(v) for k, v in parts.items()}
    needs = {"name": ("secret",), "place": ("secret",), "secret": ("name", "place")}
    return [w for w in weak if any((x := found.get((scope(w[0]), role))) and x.near(w[0] - reach, w[1] + reach) for role in needs[roles[w[2]]])]


class Intervals:
    """Spans sorted by start, with the furthest end so far."""

    def __init__(self, spans: list[tuple[int, int, str]]) -> None:
        self.starts = sorted(s[0] for s in spans)
        self.ends, furthest = [], -1
        for s in sorted(spans):
            furthest = max(furthest, s[1])
            self.ends.append(furthest)

    def near(self, start: int, end: int) -> bool:
        """Whether a span overlaps start to end."""
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def all_spans(text: str | None, reach: int = REACH) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + linked_spans(text, base, reach), key=order)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scanned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, reach: int = REACH) -> DataFrame:
    """Per row: counts and digest of the base spans, and all spans as kind:start:end in code points.

    Null and empty texts have no spans. Every row is answered, equal ones alike; null ids stay null.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, every = all_spans(value.as_py(), reach)
                count = Counter(s[2] for s in base)
                rows.append((doc_id, count["assign"], count["access"], count["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)

    source = docs.select(F.col(id_column).cast("long"), F.col(text))
    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without_spans(text: str | None, mark: str = "[SECRET]", reach: int = REACH) -> str | None:
    """The text with each run of overlapping spans replaced by the mark."""
    if not text:
        return text
    out, end = [], 0
    for a, b, _ in all_spans(text, reach)[1]:
        if a >= end:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, text: str = "text", *, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """The rows with secrets replaced in ``text``; all columns stay."""
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array((without_spans(t, mark, reach) for t in columns[at].to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(run, schema).select(*(F.col(f"_c{i}").alias(n) for i, n in enumerate(names)))

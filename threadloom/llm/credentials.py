"""Secret scans with multipart credential linking (operator 1)."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.shared import text_or_empty, without

#: Kinds in the order in which spans with one start are listed. The first three are reported wherever they are found.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SPANS = "array<struct<kind:string,start:int,end:int,partner:int>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_IDENTIFIER = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|account_?id|app_?id|user_?(?:name|id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{3,}""", re.I | re.A)
_IDENTIFIER_WORDS = ("key", "client", "account", "app", "user", "login")
_ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.:-]{1,20}://[^\s"'<>]{4,}|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:[0-9]{2,5}\b""", re.A)
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
_SHORT = 6
_SCOPE = re.compile(r"\n[\x20\t\r]*\n")


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _random_looking(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.islower() for c in value) and any(c.isupper() for c in value) and _entropy(value) >= 3.5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the parts that are strong by themselves, in order."""
    out = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(out)


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that say nothing alone: identifiers, endpoints, and, if there is anything to link them to, secrets: short
    assigned values and bare tokens that look random. None overlaps a base span."""
    low = text.lower()
    out = []
    if any(w in low for w in _IDENTIFIER_WORDS):
        out += [(m.start(), 3, m.end()) for m in _IDENTIFIER.finditer(text)]
    if ":" in text:
        out += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if out or any(k == 1 for _, k, _ in base):
        out += [(m.start(), 4, m.end()) for m in _BARE.finditer(text) if _random_looking(m[0])]
        if any(w in low for w in _ASSIGN_WORDS):
            out += [(m.start(), 4, m.end()) for m in _ASSIGN.finditer(text) if _SHORT <= len(m[2]) < 12]
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))  # base spans may lie in each other: the farthest end so far counts
    kept: list[tuple[int, int, int]] = []
    for s, k, e in sorted(out, key=lambda x: (x[0], -x[2], x[1])):
        before = bisect_left(starts, e)
        if not (before and ends[before - 1] > s) and not (kept and kept[-1][2] > s):
            kept.append((s, k, e))
    return kept


def link(text: str, reach: int = 160) -> list[tuple[int, int, int, int]]:
    """(start, index of kind, end, start of the nearest partner or -1) of all parts to report, in order.

    Base spans are all there. Scopes are the paragraphs of the text. Within a scope, the intervals of secrets (assign,
    hex, weak secrets), widened by reach, are joined with those of identifiers (access, weak identifiers) and endpoints;
    a weak part is reported only if such a partner exists, and a partner of hex alone must be an access identifier or a
    weak identifier. Each part looks outwards in the sorted parts of the kinds it may be linked with, as far as reach goes,
    so that no list of pairs arises."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak and len(base) < 2:
        return [(s, k, e, -1) for s, k, e in base]
    cuts = [m.start() for m in _SCOPE.finditer(text)]
    scope = lambda at: bisect_left(cuts, at + 1)
    parts = sorted(base + weak)
    # By kind, the kinds it may be linked with: a hex value and an endpoint say nothing together.
    of_kinds = lambda *kinds: [p for p in parts if p[1] in kinds]
    secrets, others, named, assigned = of_kinds(0, 2, 4), of_kinds(1, 3, 5), of_kinds(1, 3), of_kinds(0, 4)
    among = {0: others, 1: secrets, 2: named, 3: secrets, 4: others, 5: assigned}
    ends = {k: list(accumulate((p[2] for p in of), max)) for k, of in among.items()}

    def nearest(part):
        best, own, found = None, scope(part[0]), among[part[1]]
        at = bisect_left(found, part)
        for i in range(at, len(found)):
            other = found[i]
            gap = max(other[0] - part[2], 0)
            if gap > reach or (best and gap > best[0]):
                break
            if scope(other[0]) == own and (best is None or (gap, other) < best):
                best = (gap, other)
        for i in range(at - 1, -1, -1):
            if part[0] - ends[part[1]][i] > (best[0] if best else reach):
                break
            other = found[i]
            gap = max(part[0] - other[2], 0)
            if gap <= reach and scope(other[0]) == own and (best is None or (gap, other) < best):
                best = (gap, other)
        return best[1] if best else None

    out = []
    for p in parts:
        other = nearest(p)
        if other or p[1] < 3:
            out.append((*p, other[0] if other else -1))
    return out


def scan_secrets(docs: DataFrame, *, text_col: str = "text", reach: int = 160) -> DataFrame:
    """docs with secrets: array<struct<kind, start, end, partner>>, in the order of start and then KINDS.

    start and end (exclusive) count code points of the whole text; partner is the start of the linked part, or -1. A null
    or empty text has an empty array. Each row stands for itself: nothing is shuffled, one text is in memory at a time
    beside its batch. Rows that repeat get equal results. A column named secrets gives way, other columns stay."""

    @F.pandas_udf(SPANS)
    def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"kind": KINDS[k], "start": s, "end": e, "partner": p} for s, k, e, p in link(t, reach)] for t in batch], dtype=object)

    return without(docs, "secrets").withColumn("secrets", find(text_or_empty(text_col)))


def redact(docs: DataFrame, *, text_col: str = "text", reach: int = 160, mark: str = "[redacted]") -> DataFrame:
    """docs with every reported span of text_col replaced by mark; spans that overlap or touch become one mark. Null texts
    stay null, empty ones empty. Rows that repeat get equal results, other columns stay."""

    def cleaned(text: str | None) -> str | None:
        out, last = [], 0
        for s, _, e, _ in link(text, reach) if text else ():
            if s > last or not out:
                out += [text[last:s], mark]
            last = max(last, e)
        return text if not out else "".join(out) + text[last:]

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([cleaned(t) for t in batch], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col).cast("string")))


def span_digest(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)

"""Secret scans: known shapes by patterns, unknown ones by sliding-window entropy.

Known shapes are assignments to names of secrets, access keys and long hex strings; their spans always stay. The
entropy scan looks at candidate strings (runs of hex or of base64 characters) and slides a window over each; the window's
Shannon entropy is kept by incremental counts, a character in and one out at a time. A stretch of windows at or above the
class's threshold is a span of kind ``entropy``, unless it is inside a known span. Allow-listed characters are cut out of a candidate
before, and what they leave is scanned.

Null text counts as empty; it and any text without a secret have no spans. Rows are scanned alone, as whole texts.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dustspark.llm.common import ship

# The shapes that are asked for, by kind, with the fewest characters of the span or of its value.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_VALUE = 8
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: class name, its characters, least entropy of a window in bits per character, least kinds among lower, upper, digit, least share of digits
CLASSES = (
    ("hex", "0-9A-Fa-f", 3.1, 2, 0.0),
    ("base64", r"A-Za-z0-9+/_\-", 3.8, 3, 0.0),
    ("base36", "0-9a-z", 3.6, 2, 0.1),
    ("base32", "0-9A-Z", 3.6, 2, 0.1),
)
CANDIDATES = tuple((re.compile(f"(?<![{chars}])[{chars}]{{{WINDOW},}}={{0,2}}"), least, kinds, digits) for _, chars, least, kinds, digits in CLASSES)
#: runs that hold the candidates of all classes
RUNS = re.compile(rf"[A-Za-z0-9+/_\-]{{{WINDOW},}}")
#: strings that look random and are not secret: identifiers, digests by name, addresses, examples
ALLOWED = (
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE),
    re.compile(r"(?:0123456789|abcdefghijklm|ABCDEFGHIJKLM|EXAMPLE|example|deadbeef)"),
)
ALLOWED_BEFORE = re.compile(r"(?:https?://\S*|sha(?:1|256|384|512)[-:=]|md5[:=]|data:[\w/+.-]+;base64,)$", re.IGNORECASE)
BEFORE = 200

_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def _mixed(s: str) -> int:
    return any(c.islower() for c in s) + any(c.isupper() for c in s) + any(c.isdigit() for c in s)


def _allowed(text: str) -> list[tuple[int, int]]:
    """Allow-listed places in runs of candidate characters, by start."""
    return sorted(x.span() for m in RUNS.finditer(text) for p in ALLOWED for x in p.finditer(text, m.start(), m.end()))


def _pieces(start: int, end: int, allowed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the allow-listed places leave of a candidate."""
    out = []
    for x, y in allowed:
        if x < end and start < y:
            out.append((start, x))
            start = max(start, y)
    return [(x, y) for x, y in [*out, (start, end)] if y - x >= WINDOW]


def windows(s: str, least: float) -> list[tuple[int, int]]:
    """Stretches of ``s`` covered by windows with at least that entropy, merged."""
    counts: dict[str, int] = {}
    weighted = 0.0  # sum of c log2 c
    out: list[tuple[int, int]] = []
    for i, c in enumerate(s):
        if i >= WINDOW:  # the character that leaves goes first, so no count exceeds the window
            o = s[i - WINDOW]
            k = counts[o]
            weighted += _LOG[k - 1] - _LOG[k]
            counts[o] = k - 1
        k = counts.get(c, 0)
        weighted += _LOG[k + 1] - _LOG[k]
        counts[c] = k + 1
        if i >= WINDOW - 1 and math.log2(WINDOW) - weighted / WINDOW >= least - 1e-9:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as in KINDS; code points, end exclusive."""
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    known = list(spans)
    found: list[tuple[int, int]] = []
    allowed: list[tuple[int, int]] | None = None
    for pattern, least, kinds, digits in CANDIDATES:
        for m in pattern.finditer(text):
            if ALLOWED_BEFORE.search(text, max(0, m.start() - BEFORE), m.start()):
                continue
            allowed = _allowed(text) if allowed is None else allowed
            for start, end in _pieces(m.start(), m.start() + len(m.group().rstrip("=")), allowed):
                for a, b in windows(text[start:end], least):
                    a, b = a + start, b + start
                    if _mixed(text[a:b]) < kinds or sum(c.isdigit() for c in text[a:b]) < digits * (b - a):
                        continue
                    if not any(x <= a and b <= y for _, x, y in known):
                        found.append((a, b))
    added: list[tuple[int, int]] = []  # overlapping stretches of several classes are one
    for a, b in sorted(found):
        if added and a < added[-1][1]:
            added[-1] = (added[-1][0], max(b, added[-1][1]))
        else:
            added.append((a, b))
    spans += [("entropy", a, b) for a, b in added]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scanned(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        spans = scan(t)
        n = [sum(s[0] == k for s in spans) for k in KINDS]
        base = _joined([s for s in spans if s[0] != "entropy"])
        rows.append((*n[:3], hashlib.sha256(base.encode()).hexdigest(), _joined(spans), n[3]))
    return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` as struct ``doc``, with counts per kind, the digest of the known spans and all spans as text."""
    ship(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.select("doc", F.pandas_udf(_scanned, FOUND)(F.col(f"doc.`{text}`")).alias("found")).select("doc", "found.*")

"""Secret scans: base patterns, plus windows of high Shannon entropy over candidate strings.

Base kinds are found by pattern, leftmost and non-overlapping per kind. The entropy kind looks at candidate strings (long
runs of one character class), moves a window of fixed length over each and keeps the window's entropy up to date by
incremental counts: one character enters, one leaves, and the sum of c*log2(c) changes in two places. What base spans leave of a
candidate is judged piece by piece: a piece with a window above its class's threshold is a secret, unless the allow list
suppresses it. Paths, slugs and names are made of words; a window of theirs changes between letters and digits, or between
cases, only now and then. So a window counts as a secret's only where such changes are frequent, or, without digits, where
consonants follow each other as in no word. The largest window entropy of all candidates is reported beside the spans.

Defined results: a null text counts as empty and has no spans; repeated rows get the same spans; texts are scanned whole;
columns other than the text are not looked at. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarterhour.llm.common import fields, structs, texts

KINDS = ["assign", "access", "hex", "entropy"]
#: The shortest access keys and hex strings that count; a maximal run is long enough exactly if this pattern matches it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX, ASSIGN_CHARS = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}"), 12

#: Candidate strings: runs of the base64 and URL alphabets.
CANDIDATE, WINDOW = re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20
#: Bits per character that some window must reach, by character class (at most log2 of 20 = 4.32).
THRESHOLDS = {"hex": 3.0, "single_case": 3.55, "mixed": 3.75}
#: Changes of class (digit, small letter, capital) between neighbours that some window with digits must reach.
CHANGES = 6
#: Consonants in a row that a piece without digits must reach.
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]{8,}")
#: Suppressed although random looking: UUIDs, numbers, dates and paths, base64 of one repeated unit.
ALLOWED = [re.compile(p) for p in (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", r"[0-9+/_=-]+", r"(.{1,8})\1+.{0,7}", r"(?:[A-Za-z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]+|[0-9]{1,4}))+")]
#: Shannon terms c*log2(c) of the possible counts, with one character more while one enters and none has left.
TERM = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]


def window_entropy(text: str, window: int = WINDOW) -> float:
    """The largest Shannon entropy, in bits per character, of any ``window`` consecutive characters."""
    counts: dict[str, int] = {}
    total, best = 0.0, 0.0
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += TERM[c + 1] - TERM[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += TERM[c - 1] - TERM[c]
        if i >= window - 1:
            best = max(best, math.log2(window) - total / window)
    return best


def char_class(text: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        return "hex"
    return "mixed" if re.search("[a-z]", text) and re.search("[A-Z]", text) else "single_case"


def kind(ch: str) -> int:
    return 1 if "0" <= ch <= "9" else 2 if "a" <= ch <= "z" else 3 if "A" <= ch <= "Z" else 0


def class_changes(text: str, window: int = WINDOW) -> int:
    """The most changes of class between neighbours that ``window`` consecutive characters hold. Separators have no class, and a capital
    before a small letter begins a word and is no change."""
    kinds = [kind(ch) for ch in text]
    changes = [bool(a and b and a != b and (a, b) != (3, 2)) for a, b in zip(kinds, kinds[1:])]
    total = best = sum(changes[:window - 1])
    for enters, leaves in zip(changes[window - 1:], changes):
        total += enters - leaves
        best = max(best, total)
    return best


def suspicious(text: str, entropy: float) -> bool:
    if any(p.fullmatch(text) for p in ALLOWED) or entropy < THRESHOLDS[char_class(text)]:
        return False
    return class_changes(text) >= CHANGES if re.search("[0-9]", text) else CONSONANTS.search(text) is not None


def pieces(s: int, e: int, starts: list[int], ends: list[int]):
    """What base spans, united and in order, leave of a candidate, as far as a window fits into it."""
    for i in range(bisect_right(ends, s), len(starts)):
        if starts[i] >= e:
            break
        if starts[i] - s >= WINDOW:
            yield s, starts[i]
        s = max(s, ends[i])
    if e - s >= WINDOW:
        yield s, e


def scan(text: str) -> tuple[list[tuple[int, int, int]], int, float | None]:
    """Spans (start, kind number, end) in order, how many of them are base spans, and the largest entropy of a candidate's window."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS] if "=" in text or ":" in text else []
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = len(spans)
    starts, ends = [], []  # base spans united where they overlap, so both lists ascend
    for s, _, e in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    largest = None
    for m in CANDIDATE.finditer(text):
        whole = window_entropy(m[0])
        largest = whole if largest is None else max(largest, whole)
        for s, e in pieces(*m.span(), starts, ends):
            if suspicious(text[s:e], whole if (s, e) == m.span() else window_entropy(text[s:e])):
                spans.append((s, 3, e))
    return sorted(spans), base, largest


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact_text(text: str, spans, mark: str = "[secret]") -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if spans else text


FOUND = fields(n_assign=T.LongType(), n_access=T.LongType(), n_hex=T.LongType(), base_sha256=T.StringType(), spans=T.StringType(), n_entropy=T.LongType(), max_entropy=T.DoubleType())


@F.arrow_udf(FOUND)
def _secrets(column: pa.Array) -> pa.Array:
    counts, digests, spans, largest = [[], [], [], []], [], [], []
    for text in texts(column):
        found, _, most = scan(text)
        largest.append(None if most is None else round(most, 6))
        for k in range(4):
            counts[k].append(sum(x[1] == k for x in found))
        digests.append(hashlib.sha256(joined(x for x in found if x[1] < 3).encode()).hexdigest())
        spans.append(joined(found))
    return structs({"n_assign": (counts[0], pa.int64()), "n_access": (counts[1], pa.int64()), "n_hex": (counts[2], pa.int64()), "base_sha256": (digests, pa.string()), "spans": (spans, pa.string()), "n_entropy": (counts[3], pa.int64()), "max_entropy": (largest, pa.float64())})


@F.arrow_udf(T.StringType())
def _redacted(column: pa.Array) -> pa.Array:
    return pa.array([redact_text(t, scan(t)[0]) for t in texts(column)], pa.string())


def secrets(text: Column | str) -> Column:
    """Counts by kind, the digest of the base spans, all spans as ``kind:start:end`` joined by commas, and the largest window
    entropy of a candidate (null without one). An empty table gives an empty result."""
    return _secrets(text)


def redacted(text: Column | str) -> Column:
    """The text with every secret span replaced by a mark (null becomes empty); overlapping spans share one mark."""
    return _redacted(text)

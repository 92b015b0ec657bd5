"""Secret scans (operator 2): fixed patterns plus sliding-window Shannon entropy per character class.

A candidate is a maximal run of token characters. Its class, and that of each of its pieces between separators,
decides alphabet and threshold; the entropy of every window of ``WINDOW`` characters is kept up to date by the
counts of the characters that enter and leave. Windows at or above the threshold join into spans; the
allow-list judges the pieces under a span, so a key glued to a word or a path is still found.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm.common import documents, per_text, small_batches

#: Fixed patterns of the contract: kind, pattern, group that must be long enough, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Without one of these, in lower case, a text has no assignment.
ASSIGN_WORDS = ("passw", "secret", "token", "api")

WINDOW = 20
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+")
#: Parts of a candidate between its separators.
PIECE = re.compile(r"[A-Za-z0-9+]+")
#: Character classes: kind, what a string must be made of, least entropy in bits. Pieces have the narrowest class
#: that fits; a candidate of several pieces is of the last.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9a-fA-F]+"), 2.9),
    ("entropy_alnum", re.compile(r"[A-Za-z0-9]+"), 3.5),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]+"), 3.6),
)
KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in CLASSES)
#: Characters of pieces that nothing explains, without which a span is no secret.
UNEXPLAINED = 16
#: The allow-list. Identifiers that are public by design:
IDENTIFIER = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}(?![0-9A-Za-z])")
#: Documentation values:
EXAMPLES = ("example", "sample", "dummy", "placeholder")
COUNTING = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "1234567890")
#: Letters look like words if they change from small to capital at most once in so many, and hold enough vowels.
WORD_LENGTH, LEAST_VOWELS = 5, 0.25
VOWELS = frozenset("aeiouyAEIOUY")
#: c * log2(c) for window counts: the entropy is log2(WINDOW) minus their sum over WINDOW.
C_LOG_C = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = []
    lowered = text.lower()
    for n, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not any(w in lowered for w in ASSIGN_WORDS):
            continue
        found += [(m.start(), n, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def high_entropy(candidate: str, least: float) -> list[tuple[int, int]]:
    """Unions of the windows whose entropy is at least ``least``; one step costs two count updates."""
    counts: dict[str, int] = {}
    total = 0.0
    most = WINDOW * (log2(WINDOW) - least) + 1e-9
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(candidate):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += C_LOG_C[n + 1] - C_LOG_C[n]
        if i >= WINDOW - 1:
            if total <= most:
                start = i - WINDOW + 1
                if spans and spans[-1][1] >= start:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
            old = candidate[i - WINDOW + 1]
            n = counts[old]
            counts[old] = n - 1
            total += C_LOG_C[n - 1] - C_LOG_C[n]
    return spans


def like_words(letters: str) -> bool:
    """Whether a run of letters may be words written together: few changes of case and enough vowels."""
    if len(letters) < WINDOW:
        return True
    changes = sum(a.islower() and b.isupper() for a, b in zip(letters, letters[1:]))
    return changes * WORD_LENGTH <= len(letters) and sum(map(VOWELS.__contains__, letters)) >= LEAST_VOWELS * len(letters)


def explained(piece: str) -> bool:
    """Whether a piece is on the allow-list: a number, words, one repeated character, a counting sequence, a documentation value."""
    if piece.isdigit() or len(set(piece)) <= 2 or (piece.isalpha() and like_words(piece)):
        return True
    low = piece.lower()
    return any(x in low for x in EXAMPLES) or any((x * (len(low) // len(x) + 1)).startswith(low) for x in COUNTING)


def entropy_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of strings of high entropy that the allow-list does not explain.

    Spans begin and end with a piece that nothing explains; each piece is judged once, so the work is
    proportional to the length of the text.
    """
    found = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        least = CLASSES[0][2]
        if len(set(token)) < 2**least:
            continue
        public = [x for i in IDENTIFIER.finditer(token) for x in (i.start(), i.end())] if "-" in token else []
        pieces = []
        for p in PIECE.finditer(token):
            # An odd number of borders up to its start: the piece begins in an identifier, and so ends there.
            pieces.append((p.start(), p.end(), bisect_right(public, p.start()) % 2 == 1 or explained(p.group())))
        if all(known for _, _, known in pieces):
            continue
        strings = [(a, b) for a, b, known in pieces if not known and b - a >= WINDOW]
        if len(pieces) > 1:
            strings.append((0, len(token)))
        begins, ends = [a for a, _, _ in pieces], [b for _, b, _ in pieces]
        seen = set()
        for at, end in strings:
            part = token[at:end]
            n = next(n for n, (_, alphabet, _) in enumerate(CLASSES) if alphabet.fullmatch(part))
            for a, b in high_entropy(part, CLASSES[n][2]):
                a, b = at + a, at + b
                under = range(bisect_right(ends, a), bisect_left(begins, b))
                inside = [(max(a, begins[k]), min(b, ends[k])) for k in under if not pieces[k][2]]
                if sum(y - x for x, y in inside) >= UNEXPLAINED:
                    span = (m.start() + inside[0][0], m.start() + inside[-1][1])
                    if span not in seen:
                        seen.add(span)
                        found.append((span[0], len(BASE) + n, span[1]))
    return found


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; an entropy span inside a base span says nothing new and is left out."""
    base = base_spans(text)
    starts = [a for a, _, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))

    def inside(a: int, b: int) -> bool:
        k = bisect_right(starts, a)
        return k > 0 and reach[k - 1] >= b

    more = [x for x in entropy_spans(text) if not inside(x[0], x[2])]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in spans)


SCANNED = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k, *_ in BASE]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_entropy", T.LongType())]
)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of every row, without a shuffle.

    Offsets count code points and ends are exclusive. A null text counts as empty: no spans, and the digest of
    the empty string. Very long texts are scanned whole, in time proportional to their length. Ids may be null
    or repeat, repeated rows repeat; other columns are not read. An empty table gives no rows.
    """

    def make():
        def work(texts):
            rows = []
            for text in texts:
                base, spans = all_spans(text)
                n = [sum(1 for x in base if x[1] == k) for k in range(len(BASE))]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            return rows

        return work

    return docs.select(F.col(id_col), per_text(make, SCANNED)(F.col(text_col)).alias("r")).select(id_col, "r.*")


def redact_text(text: str, mark: str = "[SECRET]") -> str:
    """The text with each union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in all_spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with the secrets in its texts replaced; all rows and columns stay, null texts stay null."""

    small_batches()

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda x: None if x is None else redact_text(x, mark))

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return scan(documents(spark, sf_dir))

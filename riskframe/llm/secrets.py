"""Secret scans: fixed patterns, plus compression novelty of strings in sensitive places.

The fixed kinds are patterns. Candidates are all strings of 16 or more key
characters in the whole text; one counts when a sensitive word stands at most 48
characters before or after it (see ``novel_spans``). Its novelty is the number of compressed bytes that it adds to its surroundings, with
a zstandard dictionary of ordinary identifiers and corpus words: names and prose
cost little, random keys cost nearly their own length. Incompressible candidates
are reported as kind ``novel``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskframe.llm.common import give_back, ship_by_value

ship_by_value(__name__)

# The three base kinds, in their order, and the kind that novelty adds.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: One of these must be in the lower-cased text for ASSIGN to match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?i)password|passwd|pwd|secret|token|api_?key|access.?key|private.?key|credential|bearer|authorization|signature|session")
SENSITIVE_WORDS = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "bearer", "authorization", "signature", "session")
#: A line that ends so (blanks aside) goes on in the next one: an assignment, a list, a quote, a PEM header.
OPEN_END = re.compile(r"[:=|>\-(\[{,\"'`\\][^\S\n]*\n")
#: What may lie between two parts of one value, such as the lines of a PEM body.
WRAP = re.compile(r"[\s\"'+,\\]*")
#: Ordinary identifiers of program text, the start of every dictionary.
IDENTIFIERS = ("config configuration parameter environment variable connection database username user_name client_id client_secret "
               "access_key secret_key private_key public_key api_key auth_token refresh_token session_id request response "
               "authorization bearer content-type application/json example.com localhost http https www function return "
               "import class self string integer boolean default value settings options index version service account")
# Byte tables: hex digits and everything else, one byte per code point.
_HEX_ONLY = bytes(ord("x") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))


def corpus_words(docs: DataFrame, text_col: str = "text", max_words: int = 8000) -> list[str]:
    """The most frequent letter-only words of all documents, for the dictionary."""
    words = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(max_words).collect()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds, leftmost non-overlapping per kind, failing matches dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    run = text.encode("latin-1", "replace").translate(_HEX_ONLY)
    at = run.find(b"x" * 24)
    while at >= 0:
        end = run.find(b" ", at)
        end = len(run) if end < 0 else end
        found.append((at, 2, end))
        at = run.find(b"x" * 24, end)
    return sorted(found)


def candidates(text: str, words: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Strings that may be keys, over the whole text.

    Sensitive words (their places ``words``) inside a run of key characters cut it; a run that leaves no part long enough is taken whole.
    """
    ends = [e for _, e in words]
    for m in CANDIDATE.finditer(text):
        at, stop = m.span()
        parts, i = [], bisect_right(ends, at)
        while i < len(words) and words[i][0] < stop:
            parts.append((at, words[i][0]))
            at = words[i][1]
            i += 1
        parts = [p for p in [*parts, (at, stop)] if p[1] - p[0] >= 16]
        yield from parts or [m.span()]


def novel_spans(text: str, taken: list[tuple[int, int, int]], marginal, near: int = 48, around: int = 160,
                min_ratio: float = 0.6) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive place that overlap no base span and that the dictionary cannot explain.

    A place is sensitive if a sensitive word ends at most ``near`` characters before it or starts at most ``near`` after it,
    or lies in it, or if only a line break, blanks and quotes part it from another such candidate. A line end after the word
    is passed if its line is left open (``OPEN_END``); one before the word always is.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE_WORDS):
        return []
    words = [s.span() for s in SENSITIVE.finditer(text)]
    if not words:
        return []
    starts, ends = [a for a, _ in words], [b for _, b in words]

    def in_sensitive_place(a: int, b: int) -> bool:
        i, j = bisect_right(ends, a) - 1, bisect_left(starts, a)
        if i >= 0 and a - ends[i] <= near:
            gap = text[ends[i]:a]
            if "\n" not in gap or OPEN_END.match(gap, max(0, len(gap[:gap.index("\n")].rstrip()) - 1)):
                return True
        return j < len(words) and starts[j] - b <= near

    out, last = [], -1
    for a, b in candidates(text, words):
        if not (in_sensitive_place(a, b) or (last >= 0 and WRAP.fullmatch(text, last, a))):
            continue
        last = b
        if any(x < b and a < y for x, _, y in taken):
            continue
        if marginal(text[max(0, a - around):a], text[a:b], text[b:b + around]) >= min_ratio * (b - a):
            out.append((a, 3, b))
    return out


def marginal_bytes(words: list[str], level: int = 3):
    """(text before, candidate, text after) -> compressed bytes that the candidate adds."""
    import zstandard as zstd

    raw = (" ".join(reversed(words)) + " " + IDENTIFIERS).encode("utf-8", "replace")
    d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    pack = zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    size = lambda s: len(pack.compress(s.encode("utf-8", "replace")))
    return lambda a, c, b: size(a + c + b) - size(a + b)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, words: list[str], text_col: str = "text", min_ratio: float = 0.6) -> DataFrame:
    """``docs`` plus n_assign, n_access, n_hex, n_novel, base_spans and spans.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start then kind, comma-joined. Novel strings are
    looked for within 48 characters of a sensitive word on either side (see ``novel_spans``).

    * NULL and empty texts have no spans (zero counts, empty strings). Whole texts are scanned.
    * A place that fits several base kinds is listed once for each; novelty adds only places that no base span touches.
    * Repeated rows are scanned alike; an empty table gives no rows; other columns pass through, and
      columns named like an added one are replaced.
    """
    @pandas_udf("n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        marginal = marginal_bytes(words)

        def one(text):
            text = text or ""
            base = base_spans(text)
            more = novel_spans(text, base, marginal, min_ratio=min_ratio)
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            return (*n, len(more), joined(base), joined(sorted(base + more)))

        for batch in texts:
            yield pd.DataFrame([one(t) for t in batch], columns=["n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"])
        give_back()

    added = ("n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return docs.select(*keep, scan(F.col(text_col)).alias("__p")).select(*keep, *[F.col(f"__p.{c}") for c in added])


def base_digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()

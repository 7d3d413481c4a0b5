"""License scan: named phrases exactly, and short notices with a bounded number of edits.

A text becomes its words joined by single blanks. A notice of m characters may differ by at most k = m // EDIT_EVERY
edits. Cut into k + 1 pieces, at least one piece of any such match is untouched (pigeonhole), so an Aho-Corasick pass
over all pieces of all notices finds every place where a match can be. Around each hit lies a window of the notice's
length and k more on either side, widened to whole words; overlapping windows of a notice become one. The ``regex``
library's bounded-error matching then verifies the window and counts the edits. Nothing outside the windows can match,
so the result equals a search of the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskframe.llm.common import LOWER, UPPER, give_back, ship_by_value

ship_by_value(__name__)

#: Phrases that stand word by word, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

#: One edit is allowed for so many characters of a notice.
EDIT_EVERY = 12


@dataclass(frozen=True)
class Notice:
    """A notice in lower-case words; ``must`` has to stand unchanged, as whole words, in a match."""

    label: str
    text: str
    must: str = ""

    @property
    def edits(self) -> int:
        return len(self.text) // EDIT_EVERY

    def pieces(self) -> list[tuple[int, str]]:
        """(offset, piece): ``edits`` + 1 pieces of almost equal length that make up the notice."""
        cut = [i * len(self.text) // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cut, cut[1:])]


#: Distinctive words of common notices. Names that are one or two letters apart are in ``must``.
NOTICES = (
    Notice("mit", "released under the mit license", "mit"),
    Notice("mit", "licensed under the mit license", "mit"),
    Notice("mit", "permission is hereby granted free of charge to any person"),
    Notice("apache", "licensed under the apache license version 2 0", "apache"),
    Notice("gpl", "gnu general public license"),
    Notice("lgpl", "gnu lesser general public license", "lesser"),
    Notice("agpl", "gnu affero general public license", "affero"),
    Notice("mpl", "subject to the terms of the mozilla public license", "mozilla"),
    Notice("bsd", "redistribution and use in source and binary forms with or without"),
    Notice("isc", "permission to use copy modify and or distribute this software"),
    Notice("boost", "boost software license version 1 0", "boost"),
    Notice("epl", "eclipse public license", "eclipse"),
    Notice("unlicense", "free and unencumbered software released into the public domain"),
    Notice("cc0", "creative commons zero universal public domain dedication"),
    Notice("cc-by", "creative commons attribution license", "attribution"),
    Notice("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Notice("cc-by-sa", "creative commons attribution sharealike", "sharealike"),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", "noncommercial"),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Notice("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # of a text before lower-casing
#: Bytes of UTF-8: A-Z to a-z, every other ASCII character that is neither letter nor digit to a blank.
TO_WORDS = bytes(ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(TO_WORDS).split()


def phrase_places(joined: str) -> list[tuple[int, int, str]]:
    """(first word, number of words, label) of every phrase, by first word."""
    padded, found = f" {joined} ", []
    for phrase, label in PHRASES.items():
        at, seen, word = padded.find(f" {phrase} "), 0, 0
        while at >= 0:
            word += padded.count(" ", seen, at)
            seen = at
            found.append((word, phrase.count(" ") + 1, label))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(found)


class NoticeFinder:
    """Finds all notices in joined words."""

    def __init__(self, notices=NOTICES, remember: int = 20_000):
        import ahocorasick
        import regex

        self.notices, self.remember, self.seen = notices, remember, {}
        self.automaton = ahocorasick.Automaton()
        uses: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            for at, piece in notice.pieces():
                uses.setdefault(piece, []).append((n, at))
        for piece, where in uses.items():
            self.automaton.add_word(piece, (len(piece), where))
        if uses:
            self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?e)(?<!\S)(?:{regex.escape(n.text, literal_spaces=True)}){{e<={n.edits}}}(?!\S)") for n in notices]
        self.musts = [regex.compile(rf"(?<!\S){regex.escape(n.must, literal_spaces=True)}(?!\S)") if n.must else None for n in notices]

    def windows(self, joined: str) -> dict[int, list[list[int]]]:
        """Per notice, the parts of the text that hold all its possible matches, apart from each other and in order."""
        wide: dict[int, list[list[int]]] = {}
        if not len(self.automaton):
            return wide
        for end, (size, uses) in self.automaton.iter(joined):
            for n, at in uses:
                notice = self.notices[n]
                a = max(0, end + 1 - size - at - notice.edits)
                b = end + 1 - size - at + len(notice.text) + notice.edits
                wide.setdefault(n, []).append([joined.rfind(" ", 0, a + 1) + 1, b])
        for n, parts in wide.items():
            parts.sort()
            apart = parts[:1]
            for a, b in parts[1:]:
                if a <= apart[-1][1] + 1:
                    apart[-1][1] = max(b, apart[-1][1])
                else:
                    stop = joined.find(" ", apart[-1][1])
                    apart[-1][1] = len(joined) if stop < 0 else stop
                    if a <= apart[-1][1]:
                        apart[-1][1] = max(b, apart[-1][1])
                    else:
                        apart.append([a, b])
            stop = joined.find(" ", min(apart[-1][1], len(joined)))
            apart[-1][1] = len(joined) if stop < 0 else stop
            wide[n] = apart
        return wide

    def verify(self, n: int, part: str) -> list[tuple[int, int, int]]:
        """(start, end, edits) of the notice's matches in a window; windows that repeat are looked up."""
        known = self.seen.get((n, part))
        if known is None:
            known = []
            # a blank before it: the library takes no insertion where a search begins
            for m in self.patterns[n].finditer(" " + part):
                if self.musts[n] is None or self.musts[n].search(m.group()):
                    lead = len(m.group()) - len(m.group().lstrip())
                    known.append((m.start() + lead - 1, m.start() + len(m.group().rstrip()) - 1, sum(m.fuzzy_counts)))
            if len(part) <= 1000:  # longer ones hardly repeat
                if len(self.seen) >= self.remember:
                    self.seen.clear()
                self.seen[n, part] = known
        return known

    def find(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, edits) in ``joined``, by start."""
        return sorted((a + s, a + e, n, edits) for n, parts in self.windows(joined).items() for a, b in parts
                      for s, e, edits in self.verify(n, joined[a:b]))


def scan_licenses(docs: DataFrame, notices=NOTICES, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    ``spans`` lists (label, start, end, edits), start and end in code points of the text, end exclusive, by start, then
    end and label: the phrases, and the notices found with edits. Matches of one notice do not overlap; places of
    different notices and phrases may. ``score`` is the best 1 - edits / length of the found notices, 1 for a phrase
    and 0 without a place.

    * NULL and empty texts have no words and no places (zero counts, NULL words, empty labels, score 0).
    * Texts are read whole; equal labels are listed once; repeated rows are scanned alike; an empty table gives no
      rows; other columns pass through, and columns named like an added one are replaced.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    types = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
             "spans array<struct<label:string,start:long,end:long,edits:int>>")

    @pandas_udf(types)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = NoticeFinder(notices)

        def one(text):
            words = words_of(text or "")
            joined = b" ".join(words).decode("utf-8", "replace")
            base, near = phrase_places(joined), finder.find(joined)
            spans = []
            if base or near:
                place = [m.span() for m in WORD.finditer(text)]
                spans = [(label, place[w][0], place[w + n - 1][1], 0) for w, n, label in base]
                for a, b, k, edits in near:
                    first = joined.count(" ", 0, a)
                    spans.append((notices[k].label, place[first][0], place[first + joined.count(" ", a, b)][1], edits))
            base_labels = {label for _, _, label in base}
            labels = base_labels | {notices[k].label for _, _, k, _ in near}
            score = 1.0 if base else max((1.0 - edits / len(notices[k].text) for _, _, k, edits in near), default=0.0)
            return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(base_labels)),
                    ",".join(sorted(labels)), score, [dict(zip(("label", "start", "end", "edits"), s)) for s in sorted(spans, key=lambda s: (s[1], s[2], s[0]))])

        for batch in texts:
            found = pd.DataFrame([one(t) for t in batch], columns=list(added))
            yield found.astype({"first_word": "Int64", "last_word": "Int64"})
        give_back()

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in added]
    return docs.select(*keep, scan(F.col(text_col)).alias("__p")).select(*keep, *[F.col(f"__p.{c}") for c in added])

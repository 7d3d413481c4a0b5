import random
import re
from collections import Counter, defaultdict

import pytest

from riskframe.llm import source_divergence as D


def brute(rows, min_df, top):
    """rows: (text, lang, source) -> set of result rows, by the definition, in Python's whole numbers."""
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(t or "")), g or "", s or "") for t, g, s in rows]
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for ts, g, s in docs:
        df[g].update(set(ts))
        sources[g].add(s)
    kept = {g: {t for t, n in df[g].items() if n >= min_df} for g in sources}
    for ts, g, s in docs:
        counts[g, s].update(t for t in ts if t in kept[g])
        counts[g, None].update(t for t in ts if t in kept[g])
    out = set()
    for g in sources:
        def prob(s, t):
            return 1 + 10**9 * (counts[g, s][t] + 5) // (sum(counts[g, s].values()) + 5 * len(kept[g]))
        for s in sources[g]:
            pairs = [(-sum(abs(prob(s, t) - prob(o, t)) for t in kept[g]), o.encode(), o) for o in sources[g] if o != s]
            terms = [(prob(None, t) - prob(s, t), t.encode(), t) for t in kept[g] if counts[g, s][t] and prob(s, t) > prob(None, t)]
            out |= {(g, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)}
            out |= {(g, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:top], 1)}
    return out


def audit(docs_of, rows, clash=True, **kw):
    df = docs_of([(i, t, g, s) for i, (t, g, s) in enumerate(rows)], clash=clash)
    return [tuple(r) for r in D.audit_sources(df, **kw).collect()]


WORDS = ["a", "B", "b", "word", "Word", "été", "Été", "漢字", "İ", "don't", "x1y", "é", "\U0001F600", "the", "of", "zz", "q\0r"]


def random_rows(n, langs, sources, seed):
    rnd = random.Random(seed)
    return [(" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(0, 12))) if rnd.random() > 0.1 else rnd.choice([None, "", "  ", "123"]),
             rnd.choice(langs), rnd.choice(sources)) for _ in range(n)]


@pytest.mark.parametrize("kw", [dict(), dict(max_terms=4)])
def test_equals_brute_force(docs_of, kw):
    rows = random_rows(400, ["en", "de", None, "", "a\0b"], ["s1", "s2", "é", None, "", "S1"], 3)
    got = audit(docs_of, rows, min_df=4, top_terms=5, **kw)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 4, 5)


def test_more_sources_and_terms_than_a_block(docs_of, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(D, "BLOCK_TERMS", 4)
    rows = random_rows(500, ["en", "fr"], [f"s{i}" for i in range(25)], 5)
    assert set(audit(docs_of, rows, min_df=3, top_terms=50)) == brute(rows, 3, 50)


def test_hot_source_long_text_and_repeated_rows(docs_of):
    rows = [("alpha beta " * 50_000, "en", "big")] + [("alpha gamma", "en", "hot")] * 300 + [("delta alpha beta", "en", f"s{i}") for i in range(5)] * 4
    assert set(audit(docs_of, rows, min_df=10, top_terms=50)) == brute(rows, 10, 50)


def test_no_kept_terms_and_empty_table(docs_of):
    rows = [("one", "en", "a"), ("two", "en", "b"), (None, None, None)]
    assert sorted(audit(docs_of, rows, min_df=30)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audit(docs_of, [], min_df=30) == []


def test_terms_of_a_batch_come_once_a_document_or_in_one_row_a_source(docs_of):
    rows = [("The the É\u00a0é漢 x1y q\0r", "e n", "s"), ("", "e n", "s"), ("the end", "e n", "s"), ("the", "", "s"), ("--", "", "t")]
    df = docs_of([(i, t, g, s) for i, (t, g, s) in enumerate(rows)]).coalesce(1).select("lang", "source", "text")
    tag = "65206e\0"
    sets = [sorted(r.terms) for r in D.term_rows(df, True).collect()]
    first = sorted(tag + t for t in ["the", "É\u00a0é漢", "x", "y", "q", "r"])
    assert sorted(sets) == sorted([first, [], [tag + "end", tag + "the"], ["\0the"], []])
    bags = {(r.lang, r.source): sorted(r.terms) for r in D.term_rows(df, False).collect()}
    assert bags == {("e n", "s"): sorted([*first, tag + "the", tag + "the", tag + "end"]), ("", "s"): ["\0the"], ("", "t"): []}

import random
import re

import pytest
import regex

from riskframe.llm import license_scan as L

W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_base(text):
    ws = W.findall(ascii_low(text or ""))
    places = [(i, lab) for i in range(len(ws)) for p, lab in L.PHRASES.items() if ws[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({lab for _, lab in places}))


def brute_near(text):
    """Every notice searched over the whole text, without seeds."""
    joined, out = " ".join(W.findall(ascii_low(text or ""))), []
    for n, x in enumerate(L.NOTICES):
        for m in regex.finditer(rf"(?e)(?<!\S)(?:{x.text}){{e<={x.edits}}}(?!\S)", " " + joined):
            if not x.must or regex.search(rf"(?<!\S){x.must}(?!\S)", m.group()):
                out.append((m.start() + len(m.group()) - len(m.group().lstrip()) - 1, m.start() + len(m.group().rstrip()) - 1, n, sum(m.fuzzy_counts)))
    return joined, sorted(out)


def damaged(rnd, s, edits):
    for _ in range(edits):
        i = rnd.randrange(len(s))
        s = rnd.choice([s[:i] + s[i + 1:], s[:i] + rnd.choice("abcxyz 7é") + s[i + 1:], s[:i] + rnd.choice("abcxyz -é") + s[i:]])
    return s


def random_texts(n, seed):
    rnd = random.Random(seed)
    fill = ["the", "License", "license", "MIT", "general", "public", "apache", "free", "of", "42", "漢字", "İ", "\n", "-", "software", "\U0001F600", "ſ", "under", "version"]
    def piece():
        if rnd.random() < 0.3:
            s = rnd.choice([x.text for x in L.NOTICES] + list(L.PHRASES))
            s = damaged(rnd, s, rnd.randrange(0, 7))
            return s.title() if rnd.random() < 0.3 else s
        return rnd.choice(fill)
    return [rnd.choice([" ", "  ", ", ", "\n"]).join(piece() for _ in range(rnd.randrange(0, 25))) for _ in range(n)]


def scan(docs_of, texts):
    return L.scan_licenses(docs_of(list(enumerate(texts)), clash=True)).orderBy("doc_id").collect()


def test_pieces_make_up_the_notice_and_are_long():
    for n in L.NOTICES:
        parts = n.pieces()
        assert "".join(p for _, p in parts) == n.text and len(parts) == n.edits + 1
        assert min(len(p) for _, p in parts) >= 6 and (not n.must or f" {n.must} " in f" {n.text} ")


def test_windows_find_what_a_search_of_the_whole_text_finds():
    finder, hits = L.NoticeFinder(), 0
    for t in random_texts(500, 11):
        joined, want = brute_near(t)
        assert b" ".join(L.words_of(t)).decode() == joined
        assert finder.find(joined) == want
        hits += sum(e > 0 for *_, e in want)
    assert hits > 100


def test_base_columns_labels_and_spans(docs_of):
    texts = random_texts(300, 5) + [None, "", "  \n", "MIT License" * 3, "mit license mit license", "the mit\nLICENSE. " * 20_000, "x" * 300_000, "x" * 50 + " MIT  license"]
    for t, r in zip(texts, scan(docs_of, texts)):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(t)
        near = [L.NOTICES[n] for _, _, n, _ in brute_near(t)[1]] if len(t or "") < 10_000 else []
        if len(t or "") < 10_000:
            assert set(r.labels.split(",")) - {""} == set(r.base_labels.split(",")) - {""} | {n.label for n in near}
            assert len(r.spans) == r.n_base + len(near)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        for s in r.spans[:50]:
            inner = " ".join(W.findall(ascii_low(t[s.start:s.end])))
            assert inner in L.PHRASES if s.edits == 0 and inner in L.PHRASES else any(
                regex.fullmatch(rf"(?:{n.text}){{e<={n.edits + 2}}}", inner) for n in L.NOTICES if n.label == s.label)


@pytest.mark.parametrize("text,labels", [
    ("Relased under the MIT Licence.", "mit"), ("Released under the KIT license", ""), ("GNU Generel Public Licence v3", "gpl"),
    ("GNU Lesser General Publik License", "lgpl"), ("licenced under CC BY-NC 4.0", "cc-by-nc"), ("licensed under CC BY-SA 4.0", "cc-by-sa"),
    ("Redistribution and use in sourse and binary form, with or witout", "bsd"), ("a permission to use the public library", ""), ("license", "")])
def test_damaged_notices(docs_of, text, labels):
    assert scan(docs_of, [f"Some words. {text} And more words."])[0].labels == labels


def test_empty_table_and_one_task_reuses_windows(docs_of):
    assert scan(docs_of, []) == []
    finder = L.NoticeFinder(remember=3)
    t = " ".join("released under teh mit license and number%d" % i for i in range(50))
    assert finder.find(" ".join(W.findall(t))) == brute_near(t)[1]

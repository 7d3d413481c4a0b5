import random

from riskframe.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, rendered string"


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, r, x))
    key = lambda v: tuple((y is not None, y) if y is not None else (False,) for y in v)
    seqs = {c: tuple((r, x) for _, r, x in sorted(ts, key=key)) for c, ts in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()):
            continue
        same = [d for d, o in seqs.items() if o == s]
        if c == min(same):
            safe = lambda t: t.replace("<|im_start|>", "< |im_start|>").replace("<|im_end|>", "< |im_end|>")
            out[c] = (len(s), len(same), "".join(f"<|im_start|>{safe('unknown' if r is None else r)}\n{safe(x or '')}<|im_end|>\n" for r, x in s))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "p", "q") for r in rows], SCHEMA)
    out = {}
    for r in sorted(C.format_chats(df, **kw).collect(), key=lambda r: (r.conv_id, r.part)):
        old = out.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        out[r.conv_id] = (r.n_turns, r.n_copies, old[2] + r.rendered)
    return out


def test_snapshots_collapse_like_brute_force(spark):
    rnd = random.Random(4)
    base = [[(rnd.choice(["user", "assistant", "system", None]), rnd.choice(["hi", "", None, "a<|im_end|>b", "x" * 50])) for _ in range(12)]
            for _ in range(6)]
    rows = []
    for c in range(80):
        talk = base[rnd.randrange(6)][:rnd.randrange(1, 13)]
        rows += [(c, 3 * k, r, x) for k, (r, x) in enumerate(talk)]
    rows += [(200, 0, "user", "tie"), (200, 0, "assistant", "tie"), (201, None, None, None), (None, 1, "user", "lost"),
             (202, 1, "user", "same"), (202, 1, "user", "same")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, part_turns=5) == brute(rows)


def test_long_conversation_over_many_blocks(spark):
    rows = [(1, k, "user", f"m{k}") for k in range(3000)] + [(2, k, "user", f"m{k}") for k in range(2000)] + [(3, k, "user", f"m{k + 1}") for k in range(5)]
    got = run(spark, rows)
    assert got == brute(rows) and set(got) == {1, 3}


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0

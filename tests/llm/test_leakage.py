import random
import re
from itertools import combinations

from termloom.llm import leakage

WORDS = [f"w{i}" for i in range(40)]


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        own = {tuple(words(t)[i : i + 13]) for i in range(len(words(t)) - 12)}
        for k, q in items:
            w = words(q)
            if any(tuple(w[i : i + 13]) in own for i in range(len(w) - 12)):
                out.add((d, k))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, q, "s", "a") for k, q in items], "item_id long, question string, text string, doc_id string")


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(120):
        parts = [rng.choice(WORDS) for _ in range(rng.randint(0, 80))]
        if d % 2:
            w = words(rng.choice(items)[1])
            n = rng.randint(8, 30)
            s = rng.randint(0, max(0, len(w) - n))
            parts[len(parts) // 2 : len(parts) // 2] = w[s : s + n]
        text = rng.choice([" ", ", ", "\n# ", " — "]).join(parts)
        docs.append((d, text.upper() if d % 5 == 0 else text))
    docs += [(500, None), (501, ""), (502, docs[1][1]), (503, docs[1][1])]
    got = {tuple(r) for r in leakage.leaked(*frames(spark, docs, items)).collect()}
    assert got == brute(docs, items) and len(got) > 20
    empty = frames(spark, [], items)
    assert leakage.leaked(*empty).isEmpty()
    assert leakage.leaked(*frames(spark, docs, [])).isEmpty()


def test_overlap_tolerates_exchanged_words(spark):
    q = [f"q{i}" for i in range(40)]
    changed = list(q)
    for i in range(2, 40, 13):
        changed[i] = "other"
    docs = [(1, "x " + " ".join(changed) + " y"), (2, " ".join(reversed(q)))]
    rows = leakage.overlaps(*frames(spark, docs, [(7, " ".join(q))])).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(1, 7)] and rows[0].matched >= 0.8 * rows[0].compared
    assert leakage.leaked(*frames(spark, docs, [(7, " ".join(q))])).isEmpty()


def test_tolerant_masks_meet_every_passage():
    kept = [(sum(1 << p for p in mask), span) for mask, span in zip(leakage.TOLERANT_MASKS, leakage.TOLERANT_SPANS)]
    for n in range(13, 26):
        held = [k << at for k, span in kept for at in range(n - span + 1)]
        for wrong in combinations(range(n), n // 5):
            bad = sum(1 << p for p in wrong)
            assert any(not k & bad for k in held), (n, wrong)


def test_partial_leaks_in_other_text(spark):
    rng = random.Random(4)
    q = [f"q{i}" for i in range(100)]
    other = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    docs, want = [], {}
    for d in range(120):
        n, s = rng.randint(13, 31), rng.randint(20, 60)
        part = q[s : s + n]
        wrong = rng.sample(range(n), n // 5 + (d % 4 == 3) * 4)
        for i in wrong:
            part[i] = "other"
        docs.append((d, " ".join(other(30) + part + other(30))))
        if d % 4 < 3:
            want[d] = n - n // 5
    docs += [(500, None), (501, ""), (502, " ".join(q[40:52]))]
    rows = {r.doc_id: r for r in leakage.overlaps(*frames(spark, docs, [(7, " ".join(q)), (8, None)])).collect()}
    assert set(rows) >= set(want) and not set(rows) & {500, 501, 502}
    assert all(r.compared >= 13 and r.matched >= 0.8 * r.compared for r in rows.values())
    assert all(rows[d].matched >= m for d, m in want.items())
    assert leakage.overlaps(*frames(spark, [], [(7, " ".join(q))])).isEmpty() and leakage.overlaps(*frames(spark, docs, [])).isEmpty()

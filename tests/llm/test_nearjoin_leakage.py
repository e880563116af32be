import random
import re

from quaystone.llm import leakage, nearjoin
from quaystone.llm.nearjoin import bands
from fractions import Fraction

WORD = re.compile(r"[^\W_]+")


def _brute(rows, t):
    sets = [(p, i, x, frozenset(w.lower() for w in WORD.findall(x))) for p, i, x in set(rows) if x is not None]
    out = set()
    for p, i, x, a in sets:
        for q, j, y, b in sets:
            if p == q and i < j and x != y and a and b and len(a & b) >= t * len(a | b) - 1e-12:
                out.add((p, i, j))
    return out


def test_pairs_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(40)] + ["Über", "Straße"]
    rows = []
    for n in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 60]))]
        for c in range(rng.randrange(1, 5)):
            words = list(base)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], [rng.choice(vocabulary)], [words[k], rng.choice(vocabulary)]])
            rows.append((f"t{n % 2}", f"r{n:03}_{c}", (", " if c == 1 else " ").join(words) + rng.choice(["", ".", "!"])))
    rows += [rows[0], ("t0", "null", None), ("t0", "blank", " .. "), ("t0", "blank2", "!!")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "part string, id string, text string, n int, k int")
    for t in (0.7, 0.8, 0.5):
        members, texts, pairs = nearjoin.near_duplicates(df, t)
        got = {tuple(r) for r in nearjoin.id_pairs(members, texts, pairs).collect()}
        assert got == _brute(rows, t), t
    # signatures of more than two sets are split by rare words: no link may be lost
    _, _, sets = nearjoin.classes(df, "part", "id", "text")
    plain, split = (nearjoin.verified(nearjoin.candidates(sets, 0.7, hot=h), sets, 0.7).select("a", "b") for h in (10**9, 2))
    assert plain.exceptAll(split).count() == split.exceptAll(plain).count() == 0 and plain.count()


def test_bands_leave_no_gap():
    table = bands(Fraction("0.7"), 500)
    assert table[0][0] == 1 and all(a[1] + 1 == b[0] for a, b in zip(table, table[1:])) and table[-1][1] >= 500


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "part string, id string, text string")
    members, texts, pairs = nearjoin.near_duplicates(df, 0.8)
    assert nearjoin.id_pairs(members, texts, pairs).count() == 0


def test_leaks_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    records = [(f"r{i}", " ".join(rng.choice(words) for _ in range(rng.choice([5, 12, 20]))), None if i % 7 == 0 else " ".join(rng.choice(words) for _ in range(15))) for i in range(40)]
    docs = []
    for i in range(80):
        body = [rng.choice(words) for _ in range(rng.choice([0, 8, 40]))]
        if i % 2 and (src := rng.choice(records)[1]):
            part = src.split()[: rng.choice([11, 12, 20])]
            body[len(body) // 2 : len(body) // 2] = [w.upper() + rng.choice(["", ",", "\n"]) for w in part]
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), docs[1]]
    want = set()
    grams = {}
    for i, a, b in records:
        for x in (a, b):
            w = WORD.findall((x or "").lower())
            for k in range(len(w) - 11):
                grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    for i, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            want |= {(i, r) for r in grams.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, h1 int")
    r = spark.createDataFrame([(*x, 0) for x in [*records, records[0]]], "id string, premise string, hypothesis string, rid int")
    for blocks in (64, 1 << 12):
        assert {tuple(x) for x in leakage.leaks(d, r, max_blocks=blocks).collect()} == want and want
    assert leakage.leaks(d, r.limit(0)).count() == 0 and leakage.leaks(d.limit(0), r).count() == 0

import random

from quaystone.llm import boilerplate, splits
from quaystone.llm.forest import spanning_forest


def _components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in edges:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def test_forest_spans_and_is_minimal(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(5)) for _ in range(70)] + [(i, i + 1, 1) for i in range(60, 99)] + [(3, 3, 0)]
    forest, labels = spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint, w bigint"))
    want = _components(100, edges)
    got = {r["v"]: r["root"] for r in labels.collect()}
    for x in got:
        for y in got:
            assert (got[x] == got[y]) == (want[x] == want[y])
    tree = forest.collect()
    assert len(tree) == len(got) - len(set(got.values()))
    weight, parent = 0, list(range(100))  # Kruskal

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: e[2]):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            weight += w
    assert sum(r["w"] for r in tree) == weight


def test_forest_of_nothing(spark):
    forest, labels = spanning_forest(spark.createDataFrame([(None, 1, 1)], "a bigint, b bigint, w bigint"))
    assert forest.count() == 0 and labels.count() == 0


ORGS = [(7, "QPA", "Quintara Payments Authority", ["QPA Quintara"]), (3, "HB", "Harlow Bureau", None)]


def _records(spark, rows):
    return spark.createDataFrame([(i, {"source_file": f, "source_org": o}, "g", 1) for i, f, o in rows], "id string, metadata struct<source_file string, source_org string>, `group` string, size int")


def test_groups_by_spelling_and_path(spark):
    orgs = spark.createDataFrame(ORGS, "org_id bigint, source_org string, org_name string, aliases array<string>")
    records = _records(spark, [
        ("a", "data/x.txt", "qpa"), ("a", "data/x.txt", "qpa"), ("b", r".\DATA\\x.TXT ", None), ("c", None, " quintara-payments authority"), ("d", "y", "HB"), ("e", None, None), ("f", "data/x.txt", "Harlow  Bureau"), ("g", " ", "unknown org"),
    ])
    groups, _ = splits.record_groups(records, orgs)
    got = {r["id"]: r["group_org_id"] for r in groups.where("group is not null").collect()}
    assert got == {"a": 3, "b": 3, "c": 3, "d": 3, "f": 3, "g": None}
    assert groups.where("id = 'e'").first()["group"] is None


def test_splits_keep_groups_and_proportions(spark):
    orgs = spark.createDataFrame(ORGS, "org_id bigint, source_org string, org_name string, aliases array<string>")
    rng = random.Random(2)
    rows = [(f"r{i}", f"file{rng.randrange(150)}", None) for i in range(2000)] + [(f"h{i}", None, "QPA") for i in range(1000)]
    out = splits.splits(_records(spark, rows), orgs).collect()
    assert len(out) == 3000
    by_group, size = {}, {}
    for r in out:
        by_group.setdefault(r["group"], set()).add(r["split"])
        size[r["split"]] = size.get(r["split"], 0) + 1
    assert all(len(s) == 1 for s in by_group.values())
    assert abs(size["train"] / 3000 - 0.8) < 0.02 and abs(size["test"] / 3000 - 0.1) < 0.02


def test_splits_of_nothing(spark):
    orgs = spark.createDataFrame([], "org_id bigint, source_org string, org_name string, aliases array<string>")
    assert splits.splits(_records(spark, []) if False else spark.createDataFrame([], "id string, metadata struct<source_file string, source_org string>"), orgs).count() == 0


def test_repeated_lines_brute_force(spark, odd_docs):
    rng = random.Random(4)
    lines = ["Legal notice 12", "Share this", "by the desk"]
    rows = []
    for i in range(60):
        body = [f"unique {i} {k} text" for k in range(3)]
        for line in lines[: rng.randrange(4)]:
            body.insert(rng.randrange(len(body) + 1), line.upper() if i % 2 else line.replace("12", str(i)))
        rows.append((i, "\r\n".join(body), "s" if i < 40 else "t"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "Share this", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = boilerplate.repeated_lines(df)
    got = {(r["doc_id"], r["line_no"]) for r in found.collect()}
    n, support, where = {}, {}, {}
    for i, t, s in rows:
        if t is None or s is None:
            continue
        n[s] = n.get(s, 0) + 1
        seen = set()
        for k, line in enumerate(t.split("\n")):
            if any(c.isalpha() for c in line):
                key = (s, "".join(c for c in line.lower() if not c.isspace() and c not in "0123456789"))
                where.setdefault(key, []).append((i, k + 1))
                seen.add(key)
        for key in seen:
            support[key] = support.get(key, 0) + 1
    want = {p for key, c in support.items() if c >= 5 and c >= 0.2 * n[key[0]] for p in where[key]}
    assert got == want and want
    cleaned = {r["doc_id"]: r["text"] for r in boilerplate.without_lines(df, found).collect()}
    for i, t, _ in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k + 1) not in want)
        assert cleaned[i] == kept


def test_repeated_lines_odd_input(spark, odd_docs, no_docs):
    assert boilerplate.repeated_lines(odd_docs).count() == 0
    assert boilerplate.repeated_lines(no_docs).count() == 0

"""Problem 1: splits that keep related records together.

Files and organisations are vertices, a record that names both is an edge
(parallel ones are merged before anything is shuffled further, so an
organisation that holds a third of all rows is one vertex with few edges). A
Borůvka spanning forest gives the groups. Group sizes are put into bands of
powers of two; from the largest band down, groups are dealt systematically along
their cumulative size to the splits that still need records.

Defined results: a record without file and organisation forms a group of its own
and is dealt too; nulls and blanks link nothing; repeated rows of an id are one
record; an organisation no row of the registry knows is a vertex by its
normalised spelling, with no org_id; an empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quaystone.llm.forest import spanning_forest
from quaystone.session import materialise

#: Groups that one cumulative-sum task sorts.
GROUPS_PER_BUCKET = 200_000


def org_key(c):
    """Letters and digits alone, case ignored; null if nothing is left."""
    key = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.when(key != "", key)


def file_key(c):
    """Path without case, outer blanks, kind and number of slashes and a leading ./ or /."""
    path = F.regexp_replace(F.lower(c), r"[\\/]+", "/")
    path = F.regexp_replace(path, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    path = F.regexp_replace(path, r"^(\./|/)", "")
    return F.when(path != "", path)


def org_spellings(orgs: DataFrame) -> DataFrame:
    """(org_key, org_id): every code, name and alias of the registry; a spelling of several rows means the first."""
    names = F.concat(F.array("source_org", "org_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return orgs.select("org_id", F.explode(names).alias("name")).select(org_key(F.col("name")).alias("org_key"), "org_id").where("org_key is not null").groupBy("org_key").agg(F.min("org_id").alias("org_id"))


def record_groups(records: DataFrame, orgs: DataFrame, id_col: str = "id", file_col: str = "metadata.source_file", org_col: str = "metadata.source_org") -> tuple[DataFrame, DataFrame]:
    """(groups, forest): (id, group, group_org_id) of each record, and the spanning forest.

    ``group`` is the label of the forest, or null for a record that nothing links.
    """
    keyed = records.select(F.col(id_col).alias("id"), file_key(F.col(file_col)).alias("file"), org_key(F.col(org_col)).alias("org_key"))
    known = keyed.join(org_spellings(orgs), "org_key", "left")
    org = F.when(F.col("org_id").isNotNull(), F.concat(F.lit("o:"), F.col("org_id").cast("string"))).when(F.col("org_key").isNotNull(), F.concat(F.lit("n:"), "org_key"))
    ends = materialise(known.select("id", F.concat(F.lit("f:"), "file").alias("f"), org.alias("o"), "org_id"), "ends")
    # a record with one end still makes its vertex known, as a loop
    edges = ends.select(F.coalesce("f", "o").alias("a"), F.coalesce("o", "f").alias("b")).where("a is not null").groupBy("a", "b").agg((-F.count("*")).alias("w"))
    forest, labels = spanning_forest(edges)
    with_org = labels.select("root", F.when(F.col("v").startswith("o:"), F.substring("v", 3, 20).cast("bigint")).alias("org_id"))
    smallest = with_org.groupBy("root").agg(F.min("org_id").alias("group_org_id"))
    named = labels.join(smallest, "root")
    groups = ends.select("id", F.coalesce("f", "o").alias("v")).join(named, "v", "left")
    return groups.select("id", F.col("root").alias("group"), "group_org_id").distinct(), forest


def group_sizes(groups: DataFrame) -> DataFrame:
    """(group, size, band) with one group for each record that nothing links."""
    own = F.coalesce("group", F.concat(F.lit("r:"), F.col("id").cast("string")))
    return groups.groupBy(own.alias("group")).agg(F.countDistinct("id").alias("size")).withColumn("band", F.floor(F.log2("size")).cast("int"))


def deal(sizes: DataFrame, fractions: dict[str, float], seed: int = 7, per_bucket: int = GROUPS_PER_BUCKET) -> DataFrame:
    """(group, size, split): from the largest band down, along cumulative sizes, by what each split still needs."""
    # one row per band, 63 at most
    bands = {r["band"]: (r["n"], r["total"]) for r in sizes.groupBy("band").agg(F.count("*").alias("n"), F.sum("size").alias("total")).collect()}
    total = sum(t for _, t in bands.values())
    need = {s: f * total for s, f in fractions.items()}
    order = F.xxhash64(F.lit(seed), "group")
    dealt = []
    for band in sorted(bands, reverse=True):
        n, size = bands[band]
        # a split takes groups of this band only if one of them fits into what it needs
        open_to = {s: max(0.0, x) for s, x in need.items() if x >= 2 ** (band + 1) * 0.75} or {max(need, key=need.get): 1.0}
        whole = sum(open_to.values())
        buckets = max(1, -(-n // per_bucket))
        rows = sizes.where(F.col("band") == band).withColumn("_o", order).withColumn("_b", F.pmod(F.shiftright("_o", 20), F.lit(buckets)))
        own = F.sum("size").over(Window.partitionBy("_b").orderBy("_o", "group").rowsBetween(Window.unboundedPreceding, -1))
        before = rows.groupBy("_b").agg(F.sum("size").alias("s")).select("_b", F.coalesce(F.sum("s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        at = (F.coalesce("_own", F.lit(0)) + F.col("_before") + F.col("size") / 2) / F.lit(float(size))
        split, reached = None, 0.0
        for s, x in open_to.items():
            reached += x / whole
            split = F.when(at <= reached, s) if split is None else split.when(at <= reached, s)
        rows = rows.withColumn("_own", own).join(before, "_b").select("group", "size", split.otherwise(list(open_to)[-1]).alias("split"))
        rows = materialise(rows, "dealt")
        for r in rows.groupBy("split").agg(F.sum("size").alias("s")).collect():  # one row per split
            need[r["split"]] -= r["s"]
        dealt.append(rows)
    if not dealt:
        return sizes.select("group", "size", F.lit(None).cast("string").alias("split"))
    out = dealt[0]
    for rows in dealt[1:]:
        out = out.union(rows)
    return out


def splits(records: DataFrame, orgs: DataFrame, fractions: dict[str, float] | None = None, seed: int = 7, **cols) -> DataFrame:
    """(id, group, split) of each record."""
    groups, _ = record_groups(records, orgs, **cols)
    groups = materialise(groups, "groups")
    dealt = deal(materialise(group_sizes(groups), "groupsizes"), fractions or {"train": 0.8, "validation": 0.1, "test": 0.1}, seed)
    own = F.coalesce("group", F.concat(F.lit("r:"), F.col("id").cast("string")))
    return groups.select("id", own.alias("group")).join(dealt.select("group", "split"), "group").select("id", "group", "split")

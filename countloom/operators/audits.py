"""Integrity audits: overlaps, duplicates, differences, contracts, status grids, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions.scalars import canonical_pair, finite


def pair_duplicates(pairs: DataFrame, a: str, b: str, split: str, key: str, profile: str) -> DataFrame:
    """One row of counts: repeats of ordered and of canonical pairs, the latter where both orders occur, repeats of whole rows, ids and profiles, and pairs and parents in several splits."""
    x, y = canonical_pair(F.col(a), F.col(b))
    rows = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b"), F.col(split).alias("s"), F.col(key).alias("k"), F.col(profile).alias("f"), x.alias("x"), y.alias("y"))
    repeats = lambda n: F.coalesce(F.sum(n), F.lit(0))
    several = lambda c: F.min(c) != F.max(c)
    # the orders of a canonical pair, and what holds a missing name, as bits: as many as it has ordered pairs
    order = F.when(F.col("a") <= F.col("b"), 1).when(F.col("a") > F.col("b"), 2).when(F.col("b").isNotNull(), 4).when(F.col("a").isNotNull(), 8).otherwise(16)
    canonical = rows.withColumn("_o", order).groupBy("x", "y").agg(F.count("*").alias("n"), F.bit_count(F.bit_or("_o")).alias("orders"), several("a").alias("ways"), several("s").alias("splits")).agg(
        repeats(F.col("n") - F.col("orders")).alias("ordered_repeats"), repeats(F.when(F.col("ways"), F.col("n") - 1)).alias("reversed_equivalent"), repeats(F.col("n") - 1).alias("canonical_repeats"),
        F.count_if("splits").alias("pairs_across"))
    parents = rows.select("a", "s").union(rows.select("b", "s")).groupBy("a").agg(several("s").alias("more")).agg(F.count_if("more").alias("parents_across"))
    # rows of an id are in one task, which counts whole rows and ids
    whole = rows.select("k", "a", "b", "s", "f").repartition("k").groupBy("k", "a", "b", "s", "f").agg(F.count("*").alias("n"))
    ids = whole.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).agg(repeats(F.col("n") - F.col("rows")).alias("row_repeats"), repeats(F.col("n") - 1).alias("id_repeats"))
    profiles = rows.groupBy("f").agg(F.count("*").alias("n")).agg(repeats(F.col("n") - 1).alias("profile_repeats"))
    # tables of one row
    out = reduce(lambda m, n: m.crossJoin(F.broadcast(n)), [canonical, parents, ids, profiles])
    return out.select("canonical_repeats", "reversed_equivalent", "pairs_across", "parents_across", "ordered_repeats", "row_repeats", "id_repeats", "profile_repeats")


def profile_fingerprints(counts: DataFrame) -> DataFrame:
    """sha256 of every cell's sorted non-zero counts: order-free, equal for equal profiles."""
    packed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("gene", "count"))), lambda s: F.concat_ws(":", s["gene"], s["count"].cast("long").cast("string"))), ",")
    return counts.groupBy("cell").agg(F.sha2(packed, 256).alias("profile"))


def duplicate_profiles(counts: DataFrame) -> DataFrame:
    return profile_fingerprints(counts).groupBy("profile").agg(F.count("*").alias("cells"), F.min("cell").alias("first_cell")).filter("cells > 1")


def largest_difference(a: DataFrame, b: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column: largest and mean difference, rows beyond tolerance, rows on one side only."""
    left = a.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([key], columns, "column", "x")
    right = b.select(key, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([key], columns, "column", "y")
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), [key, "column"], "full")
    gap = F.abs(F.col("x") - F.col("y"))
    return both.groupBy("column").agg(
        F.max(gap).alias("largest"), F.avg(gap).alias("mean"), F.count_if(gap >= tolerance).alias("beyond"), F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("unmatched"))


def equal_columns(df: DataFrame, columns: list[str], tolerance: float = 1e-12) -> DataFrame:
    """Pairs of columns that are equal in every row; one aggregation for all pairs."""
    pairs = [(a, b) for p, a in enumerate(columns) for b in columns[p + 1 :]]
    worst = [F.max(F.when(F.col(a).isNull() != F.col(b).isNull(), F.lit(1e300)).otherwise(F.coalesce(F.abs(F.col(a) - F.col(b)), F.lit(0.0)))).alias(f"_{k}") for k, (a, b) in enumerate(pairs)]
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"_{k}") <= tolerance).alias("equal")) for k, (a, b) in enumerate(pairs)))
    return df.agg(*worst).select(F.inline(rows))


def probability_contract(df: DataFrame, key: str, columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """check, failed rows, worst error, status: finite, within bounds, rows sum to 1, the last two conditionally too, keys unique.  One aggregation."""
    known = [finite(F.col(c)) for c in columns]
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in known])
    out = F.greatest(*(e for c in known for e in (-c, c - 1)), F.lit(0.0))
    both = known[-2] + known[-1]
    split = F.when(both > tolerance, F.abs(known[-2] / both + known[-1] / both - 1))
    errors = {"bounds": out, "row_sum": F.abs(total - 1), "conditional_sum": split}
    one = df.agg(
        F.count_if(reduce(lambda a, b: a | b, [c.isNull() for c in known])).alias("finite_values"), (F.count("*") - F.count_distinct(key)).alias("unique_cells"),
        *(F.count_if(e > tolerance).alias(n) for n, e in errors.items()), *(F.coalesce(F.max(e), F.lit(0.0)).alias(f"_{n}") for n, e in errors.items()))
    rows = [F.struct(F.lit(n).alias("check"), F.col(n).alias("failed"), (F.col(f"_{n}") if n in errors else F.lit(0.0)).alias("worst")) for n in ("finite_values", *errors, "unique_cells")]
    return one.select(F.inline(F.array(*rows))).withColumn("status", F.when(F.col("failed") == 0, "PASS").otherwise("FAIL"))


def top_k_overlap(df: DataFrame, key: str, main: str, others: list[str], k: int) -> DataFrame:
    """The k best rows of a method against those of each other and against what at least two others share; missing scores last, ties by key."""
    best = lambda c: F.row_number().over(W.orderBy(F.desc_nulls_last(c), key)) <= k
    flags = df.select(best(main).alias("_m"), *(best(c).alias(c) for c in others))
    agreed = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in others]) >= 2
    long = flags.withColumn("consensus", agreed).unpivot(["_m"], [*others, "consensus"], "other", "_o")
    m, o = F.col("_m"), F.col("_o")
    out = long.groupBy("other").agg(*(F.count_if(c).alias(n) for n, c in (("k", m), ("both", m & o), ("either", m | o), ("main_only", m & ~o), ("other_only", ~m & o))))
    return out.withColumn("jaccard", F.when(F.col("either") > 0, F.col("both") / F.col("either")))


def class_summary(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """class, n, percent of all rows: a row for every class, whether or not it occurs."""
    every = df.sparkSession.createDataFrame([(c,) for c in classes], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    whole = df.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n"))
    joined = every.join(counts, column, "left").crossJoin(F.broadcast(whole))  # one row
    return joined.select(column, F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.coalesce("n", F.lit(0)) / F.col("_n")).alias("percent"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: keys on both sides and on one, keys that repeat on either, the largest difference of value, and whether all is the same."""
    repeats = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.expr("n > 1")).alias(name))
    both = left.select(*keys, F.col(value).cast("double").alias("_x")).join(right.select(*keys, F.col(value).cast("double").alias("_y")), keys, "full")
    found = both.agg(
        F.count_if(F.col("_x").isNotNull() & F.col("_y").isNotNull()).alias("matched"), F.count_if(F.col("_x").isNull() | F.col("_y").isNull()).alias("unmatched"), F.max(F.abs(F.col("_x") - F.col("_y"))).alias("largest"))
    joined = found.crossJoin(F.broadcast(repeats(left, "repeated_left"))).crossJoin(F.broadcast(repeats(right, "repeated_right")))
    return joined.withColumn("same", F.coalesce(F.col("largest") <= tolerance, F.lit(False)))


def status_grid(dims: list[DataFrame], runs: DataFrame, keys: list[str], status: str) -> DataFrame:
    """Every cell of the grid: its one row's status, NOT_RUN without rows, INCOMPLETE with several.  dims are short lists of names."""
    grid = reduce(lambda a, b: a.crossJoin(b), dims)
    found = runs.groupBy(*keys).agg(F.count("*").alias("n"), F.min(status).alias("_s"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(found, keys, "left").select(*keys, n.cast("long").alias("n"), F.when(n == 0, "NOT_RUN").when(n > 1, "INCOMPLETE").when(F.col("_s") == "SUCCESS", "SUCCESS").otherwise("FAILED").alias("status"))


def id_fingerprint(df: DataFrame, key: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(key).cast("string"))), "\n"), 256).alias("fingerprint"))


def split_contract(ids: DataFrame, key: str, split: str) -> DataFrame:
    """Per split: ids, repeated ids, and ids that another split has too."""
    per = ids.groupBy(key).agg(F.count_distinct(split).alias("_k"))
    return ids.join(per, key).groupBy(split).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("ids"), F.count_distinct(F.when(F.col("_k") > 1, F.col(key))).alias("shared"))


def last_terminal(ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return ledger.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")

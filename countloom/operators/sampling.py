"""Deterministic sampling: splits, pair plans, sums of parents, subsets and permutations.

Every draw is an order by a salted hash of ids, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions.running import numbered
from countloom.functions.scalars import canonical_pair, draw


def stratified_split(cells: DataFrame, seed: int, test: float, validation: float, by: str = "cluster") -> DataFrame:
    """cell, cluster, split: within each cluster the first round(n * test) by hash are test, the next share validation."""
    w = W.partitionBy(by)
    r = cells.withColumns({"_r": F.row_number().over(w.orderBy(draw(seed, "split", F.col("cell")))), "_n": F.count("*").over(w)})
    t, v = F.round(F.col("_n") * test), F.round(F.col("_n") * validation)
    return r.select("cell", by, F.when(F.col("_r") <= t, "test").when(F.col("_r") <= t + v, "validation").otherwise("train").alias("split"))


def pair_plan(cells: DataFrame, n: int, seed: int, mixed: bool, by: str = "cluster") -> DataFrame:
    """About n pairs of two cells per split, of one cluster or of two: parent_1, parent_2, split, subtype.

    cells: cell, cluster, split.  Slot i takes the i-th cell of two salted orders (rotating through a cluster for
    homotypic pairs); repeated canonical pairs and self pairs are dropped.
    """
    key = ["split"] if mixed else ["split", by]
    order = lambda salt: F.row_number().over(W.partitionBy(*key).orderBy(draw(seed, salt, F.col("cell"))))
    a = cells.withColumn("_i", order("first")).select(*key, "_i", F.col("cell").alias("parent_1"), F.col(by).alias("_x"))
    b = cells.withColumn("_i", order("second")).select(*key, "_i", F.col("cell").alias("parent_2"), F.col(by).alias("_y"))
    joined = (a.join(b, [*key, "_i"]) if mixed else a.drop("_x").join(b.drop("_y"), [*key, "_i"])).filter("parent_1 <> parent_2")
    joined = joined.filter("_x <> _y") if mixed else joined
    x, y = canonical_pair(F.col("parent_1"), F.col("parent_2"))
    joined = joined.withColumns({"_cx": x, "_cy": y})
    once = joined.withColumn("_d", F.row_number().over(W.partitionBy("split", "_cx", "_cy").orderBy("parent_1"))).filter("_d = 1")
    ranked = once.withColumn("_s", F.row_number().over(W.partitionBy("split").orderBy(draw(seed, "slot", F.concat("_cx", F.lit("|"), "_cy"))))).filter(F.col("_s") <= n)
    return ranked.select(
        F.concat_ws("_", F.lit("pair"), "split", F.lpad(F.col("_s").cast("string"), 5, "0")).alias("synthetic"), "split",
        F.lit("heterotypic" if mixed else "homotypic").alias("subtype"), "parent_1", "parent_2")


def parent_sums(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts of every pair: the sum of its parents' counts.  Both parents go through one join."""
    parents = pairs.select("synthetic", F.explode(F.array("parent_1", "parent_2")).alias("cell"))
    return parents.join(counts, "cell").groupBy("synthetic", "gene").agg(F.sum("count").alias("count"))


def hash_subset(df: DataFrame, key: str, k: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*by) if by else W.partitionBy()
    return df.withColumn("_r", F.row_number().over(w.orderBy(draw(seed, "subset", F.col(key))))).filter(F.col("_r") <= k).drop("_r")


def permuted(df: DataFrame, key: str, label: str, seed: int, by: list[str] | None = None) -> DataFrame:
    """df with its labels dealt anew: the rows of one hash order take the labels of another; counts stay."""
    by = by or []
    w = W.partitionBy(*by)
    a = df.withColumn("_i", F.row_number().over(w.orderBy(draw(seed, "rows", F.col(key)))))
    b = df.select(*by, F.row_number().over(w.orderBy(draw(seed, "labels", F.col(key)))).alias("_i"), F.col(label).alias("permuted"))
    return a.join(b, [*by, "_i"]).drop("_i")


def thinned(counts: DataFrame, low: float = 0.6, high: float = 1.0, seed: int = 0) -> DataFrame:
    """Counts of each cell thinned binomially by a fraction that its id's hash draws from low to high.

    Every unit of a count has a hash of its own and stays where that is below the fraction.  Units are rows, whose hashes run as
    compiled code, and are compared as text with the twelve digits of the fraction; what stays is counted where the rows are.
    """
    fraction = low + (high - low) * uniform(seed, "fraction", F.col("cell"))
    # x / 16^12 < f where x < ceil(f * 16^12); no digit reaches "g", which stands for all
    edge = F.ceil(fraction * float(16**12)).cast("long")
    rows = counts.filter("count >= 1").select("cell", "gene", F.floor("count").cast("int").alias("_n"), F.when(edge < 16**12, F.lpad(F.lower(F.hex(edge)), 12, "0")).otherwise("g").alias("_f"))
    units = rows.select("cell", "gene", "_f", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_u"))
    kept = units.filter(draw(seed, "unit", F.concat_ws(":", "cell", "gene", F.col("_u").cast("string"))) < F.col("_f"))
    return kept.groupBy("cell", "gene").agg(F.count("*").cast("double").alias("count"))


def upper_tail_targets(totals: DataFrame, pairs: DataFrame, seed: int = 0, low: float = 0.7, high: float = 0.995) -> DataFrame:
    """cell, target of pairs (cell, n_count): a total drawn evenly from those between two quantiles of the reference, at most the pair's own and at least 1.

    totals: cell, n_count of the reference; where none lies between the quantiles all serve.
    """
    good = totals.filter("n_count > 0")
    ends = good.agg(F.expr(f"percentile(n_count, array({low}, {high}))").alias("q"))
    marked = good.crossJoin(F.broadcast(ends)).withColumn("_in", F.col("n_count").between(F.col("q")[0], F.col("q")[1]))  # one row
    some = marked.agg(F.max("_in").alias("_any"))
    pool = numbered(marked.crossJoin(F.broadcast(some)).filter(F.col("_in") | ~F.col("_any")).select("cell", "n_count"), "n_count", "cell", "_i", [], descending=False)
    size = pool.agg(F.count("*").alias("_m"))
    drawn = pairs.crossJoin(F.broadcast(size)).withColumn("_i", (F.least(F.floor(uniform(seed, "target", F.col("cell")) * F.col("_m")), F.col("_m") - 1) + 1).cast("int"))
    picked = drawn.join(pool.select("_i", F.rint("n_count").alias("_t")), "_i")
    return picked.select("cell", F.least(F.col("n_count"), F.greatest(F.col("_t"), F.lit(1.0))).cast("long").alias("target"))


def downsampled(counts: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Counts of each cell drawn multinomially by its own shares, down to its target total (cell, target)."""

    def one(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cells, targets_, genes = batch.column("cell").to_pylist(), batch.column("target").to_pylist(), batch.column("genes")
            starts, c = genes.offsets.to_numpy() - genes.offsets[0].as_py(), genes.flatten().field("c").to_numpy()
            out = np.zeros(len(c))
            for n, cell in enumerate(cells):
                own = c[starts[n] : starts[n + 1]]
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{cell}".encode()).digest()[:8], "big"))
                total = int(own.sum())
                out[starts[n] : starts[n + 1]] = rng.multinomial(min(int(targets_[n]), total), own / total)
            rows = np.repeat(np.arange(len(cells)), np.diff(starts))
            yield pa.RecordBatch.from_arrays([batch.column("cell").take(pa.array(rows)), genes.flatten().field("gene"), pa.array(out)], names=["cell", "gene", "count"])

    # the features of a cell are one row, so that a batch holds many cells
    lists = counts.filter("count >= 1").groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("gene", F.col("count").cast("long").alias("c")))).alias("genes"))
    return lists.join(targets, "cell").select("cell", "target", "genes").mapInArrow(one, "cell string, gene string, count double").filter("count > 0")


def uniform(seed: int, salt: str, key):
    """A number from 0 to below 1 of the hash of the key."""
    return F.conv(F.substring(draw(seed, salt, key), 1, 12), 16, 10).cast("double") / float(16**12)


def library_pairs(cells: DataFrame, n: int, seed: int, homotypic: float) -> DataFrame:
    """n pairs of cells of one library: synthetic, library, subtype, parent_1, parent_2.  cells: cell, cluster, library.

    Every pair draws its library by size, so libraries get a multinomial share of n; a coin makes it homotypic (also where the library
    has one cluster only).  Clusters are drawn by size, the second of a heterotypic pair among the others; cells within a cluster
    are drawn evenly, with replacement.
    """
    if cells.limit(1).count() == 0:
        raise ValueError("no cells to draw pairs from")
    groups = cells.groupBy("library", "cluster").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("library").orderBy("cluster")) - F.col("n")
    own = groups.select("library", "cluster", "n", before.alias("low")).groupBy("library").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("low", "n", "cluster"))).alias("clusters"))
    shares = own.agg(F.sort_array(F.collect_list(F.struct("library", "size", "clusters"))).alias("libraries"), F.sum("size").alias("total"))  # as long as there are libraries and clusters
    spans = F.aggregate("libraries", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("ends")), lambda a, x: F.struct((a["at"] + x["size"]).alias("at"), F.concat(a["ends"], F.array(a["at"] + x["size"])).alias("ends")))["ends"]
    shares = shares.withColumn("ends", spans)
    i = F.col("id")
    pick = lambda salt, size: F.least(F.floor(uniform(seed, salt, i) * size), size - 1)
    at = lambda place: F.filter("clusters", lambda x: (place >= x["low"]) & (place < x["low"] + x["n"]))[0]
    rows = cells.sparkSession.range(n).crossJoin(F.broadcast(shares)).withColumn("_at", pick("library", F.col("total")))
    rows = rows.withColumn("_l", F.element_at("libraries", (F.size(F.filter("ends", lambda e: e <= F.col("_at"))) + 1).cast("int"))).select("id", "_l.*")
    rows = rows.withColumn("one", at(pick("first", F.col("size")))).withColumn("same", (uniform(seed, "coin", i) < homotypic) | (F.size("clusters") < 2))
    rest = F.col("size") - F.col("one.n")
    skip = F.floor(uniform(seed, "second", i) * rest)
    rows = rows.withColumn("two", F.when(F.col("same"), F.col("one")).otherwise(at(F.when(skip >= F.col("one.low"), skip + F.col("one.n")).otherwise(skip))))
    rows = rows.select("id", "library", "same", F.col("one.cluster").alias("_x"), F.col("two.cluster").alias("_y"), (pick("cell 1", F.col("one.n")) + 1).alias("_i"), (pick("cell 2", F.col("two.n")) + 1).alias("_j"))
    placed = cells.select("library", "cluster", "cell", F.row_number().over(W.partitionBy("library", "cluster").orderBy(draw(seed, "member", F.col("cell")))).alias("_p"))
    side = lambda c, p, out: placed.select("library", F.col("cluster").alias(c), F.col("_p").alias(p), F.col("cell").alias(out))
    return rows.join(side("_x", "_i", "parent_1"), ["library", "_x", "_i"]).join(side("_y", "_j", "parent_2"), ["library", "_y", "_j"]).select(
        F.concat(F.lit("pair_"), i.cast("string")).alias("synthetic"), "library", F.when(F.col("same"), "homotypic").otherwise("heterotypic").alias("subtype"), "parent_1", "parent_2")


def group_folds(df: DataFrame, group: str, stratum: str, folds: int = 3, seed: int = 0) -> DataFrame:
    """df with fold: whole groups dealt in turn, in the order of their hash, within each stratum; a group takes its smallest stratum."""
    groups = df.groupBy(group).agg(F.min(stratum).alias("_s"))
    place = F.row_number().over(W.partitionBy("_s").orderBy(draw(seed, "fold", F.col(group)))) - 1
    return df.join(groups.select(group, (place % folds).alias("fold")), group)


def stratified_fraction(df: DataFrame, key: str, stratum: str, share: float, seed: int = 0, least: int = 2) -> DataFrame:
    """About share of the rows of each stratum, `least` at least, first by hash of the key; all rows from a share of 0.999 on."""
    if share >= 0.999:
        return df
    sizes = df.groupBy(stratum).agg(F.greatest(F.rint(share * F.count("*")), F.lit(float(least))).alias("_k"))
    place = F.row_number().over(W.partitionBy(stratum).orderBy(draw(seed, "fraction", F.col(key))))
    return df.withColumn("_r", place).join(sizes, stratum).filter("_r <= _k").select(*df.columns)

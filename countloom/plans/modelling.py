"""Queries of sampling, matching, components, models and the detector."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.operators import matching, matrix, sampling
from countloom.functions.scalars import CLASSES
from countloom.plans.registry import d, i, query, with_
from countloom.plans.storage import written
from countloom.sources import tables as t

SPLIT = """sp AS (SELECT cell, cluster, CASE WHEN r <= round(n * 0.2) THEN 'test' WHEN r <= round(n * 0.2) + round(n * 0.1) THEN 'validation' ELSE 'train' END AS split
 FROM (SELECT cell, cluster, row_number() OVER (PARTITION BY cluster ORDER BY sha256('7:split:' || cell)) AS r, count(*) OVER (PARTITION BY cluster) AS n FROM cells))"""


def pairs_sql(mixed: bool) -> str:
    key = "split" if mixed else "split, cluster"
    keep = " AND x.cluster <> y.cluster" if mixed else ""
    on = "x.split = y.split" + ("" if mixed else " AND x.cluster = y.cluster")
    return f"""fa AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sha256('7:first:' || cell)) AS i FROM sp), fb AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sha256('7:second:' || cell)) AS i FROM sp),
 jn AS (SELECT x.split, x.cell AS parent_1, y.cell AS parent_2, least(x.cell, y.cell) AS cx, greatest(x.cell, y.cell) AS cy FROM fa x JOIN fb y ON {on} AND x.i = y.i WHERE x.cell <> y.cell{keep}),
 od AS (SELECT *, row_number() OVER (PARTITION BY split, cx, cy ORDER BY parent_1) AS dd FROM jn),
 sl AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY sha256('7:slot:' || cx || '|' || cy)) AS s FROM od WHERE dd = 1),
 pl AS (SELECT 'pair_' || split || '_' || lpad(CAST(s AS VARCHAR), 5, '0') AS synthetic, split, '{'heterotypic' if mixed else 'homotypic'}' AS subtype, parent_1, parent_2 FROM sl WHERE s <= 100)"""


def split(spark, sf):
    return sampling.stratified_split(t.customer_cells(spark, sf).select("cell", "cluster"), 7, 0.2, 0.1)


@query("i1_hash_choice", f"{with_('cells')} SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY sha256('3:subset:' || cell)) AS r FROM cells) WHERE r <= 100")
def i1(spark, sf):
    return sampling.hash_subset(t.customer_cells(spark, sf).select("cell"), "cell", 100, 3)


@query("i2_stratified_split", f"{with_('cells')}, {SPLIT} SELECT * FROM sp")
def i2(spark, sf):
    return split(spark, sf)


@query("i3_homotypic_pairs", f"{with_('cells')}, {SPLIT}, {pairs_sql(False)} SELECT * FROM pl")
def i3(spark, sf):
    return sampling.pair_plan(split(spark, sf), 100, 7, False)


@query("d14_heterotypic_pairs", f"{with_('cells')}, {SPLIT}, {pairs_sql(True)} SELECT * FROM pl")
def d14(spark, sf):
    return sampling.pair_plan(split(spark, sf), 100, 7, True)


@query("d15_parent_sums", f"{with_('cm1', 'cells')}, {SPLIT}, {pairs_sql(True)} SELECT synthetic, gene, {d('sum(count)', 'count')} FROM (SELECT synthetic, parent_1 AS cell FROM pl UNION ALL SELECT synthetic, parent_2 FROM pl) JOIN cm1 USING (cell) GROUP BY 1, 2")
def d15(spark, sf):
    return sampling.parent_sums(sampling.pair_plan(split(spark, sf), 100, 7, True), t.purchase_counts(spark, sf))


def uniform_sql(salt: str, key: str) -> str:
    return f"(CAST('0x' || substr(sha256('0:{salt}:' || {key}), 1, 12) AS BIGINT) / 281474976710656.0)"


@query("i5_binomial_thinning", f"""{with_('cm1')}, f AS (SELECT cell, gene, count, 0.6 + 0.4 * {uniform_sql('fraction', 'cell')} AS f FROM cm1), u AS (SELECT cell, gene, f, unnest(range(1, CAST(floor(count) AS BIGINT) + 1)) AS u FROM f)
 SELECT cell, gene, {d('count(*)', 'count')} FROM u WHERE {uniform_sql('unit', "cell || ':' || gene || ':' || u")} < f GROUP BY cell, gene""")
def i5(spark, sf):
    return sampling.thinned(t.purchase_counts(spark, sf))


@query("i6_target_totals", f"""{with_('tot')}, q AS (SELECT quantile_cont(n_count, 0.7) AS a, quantile_cont(n_count, 0.995) AS b FROM tot), p AS (SELECT n_count, row_number() OVER (ORDER BY n_count, cell) AS i, count(*) OVER () AS m FROM tot, q WHERE n_count BETWEEN a AND b),
 x AS (SELECT cell, n_count * 2 AS n_count, least(CAST(floor({uniform_sql('target', 'cell')} * (SELECT max(m) FROM p)) AS BIGINT), (SELECT max(m) FROM p) - 1) + 1 AS i FROM tot) SELECT cell, {i('least(x.n_count, greatest(round_even(p.n_count, 0), 1))', 'target')} FROM x JOIN p USING (i)""")
def i6t(spark, sf):
    """Targets for pairs of twice each customer's total, from the upper tail of the customers' totals."""
    totals = matrix.cell_totals(t.purchase_counts(spark, sf)).select("cell", "n_count")
    return sampling.upper_tail_targets(totals, totals.withColumn("n_count", 2 * F.col("n_count")))


@query("i6_downsample")
def i6(spark, sf):
    counts = t.purchase_counts(spark, sf)
    totals = matrix.cell_totals(counts).select("cell", "n_count")
    return sampling.downsampled(counts, sampling.upper_tail_targets(totals, totals))


@query("i7_permuted_labels", f"""{with_('sc')}, a AS (SELECT cell, label, row_number() OVER (ORDER BY sha256('5:rows:' || cell)) AS i FROM sc), b AS (SELECT label AS permuted, row_number() OVER (ORDER BY sha256('5:labels:' || cell)) AS i FROM sc) SELECT cell, label, permuted FROM a JOIN b USING (i)""")
def i7(spark, sf):
    return sampling.permuted(t.demo_scores(spark, sf).select("cell", "label"), "cell", "label", 5)


@query("d18_greedy_match")
def d18(spark, sf):
    s = t.demo_scores(spark, sf).withColumn("x", F.col("s2"))
    return matching.greedy_match(s.filter("positive = 1"), s.filter("hard = 1"))


@query("d19_stratified_match", f"""{with_('sc')}, b AS (SELECT cell, cluster, positive, hard, CAST(floor(s1 * 4.999) AS BIGINT) AS b FROM sc), x AS (SELECT *, row_number() OVER (PARTITION BY cluster, b ORDER BY cell) AS i FROM b WHERE positive = 1), y AS (SELECT *, row_number() OVER (PARTITION BY cluster, b ORDER BY cell) AS i FROM b WHERE hard = 1)
 SELECT x.cluster, x.b, x.cell, y.cell AS control FROM x JOIN y ON x.cluster = y.cluster AND x.b = y.b AND x.i = y.i""")
def d19(spark, sf):
    s = t.demo_scores(spark, sf).withColumn("b", F.floor(F.col("s1") * 4.999))
    return matching.stratified_match(s.filter("positive = 1"), s.filter("hard = 1"), ["cluster", "b"])


EDGES = "ed AS (SELECT c_custkey AS a, (c_custkey * 31) % (SELECT count(*) FROM customer) AS b FROM customer)"


@query("d21_components", f"""WITH RECURSIVE {EDGES}, e2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), r AS (SELECT a AS node, a AS seen FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.seen = e2.a) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def d21(spark, sf):
    from countloom.plans.storage import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    c = t.table(spark, sf, "customer")
    n = c.count()
    edges = c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") * 31 % n).alias("b"))
    return matching.connected_components(edges)


@query("o10_id_split", f"{with_('cells')}, {SPLIT} SELECT split, {i('count(*)', 'n')} FROM sp GROUP BY 1")
def o10(spark, sf):
    return split(spark, sf).groupBy("split").agg(F.count("*").alias("n"))


@query("o18_pair_plan_contract", f"{with_('cells')}, {SPLIT}, {pairs_sql(True)} SELECT split, {i('count(*)', 'pairs')}, {i('count(DISTINCT synthetic)', 'ids')}, {i('count(DISTINCT least(parent_1, parent_2) || chr(124) || greatest(parent_1, parent_2))', 'canonical')} FROM pl GROUP BY 1")
def o18(spark, sf):
    p = sampling.pair_plan(split(spark, sf), 100, 7, True)
    return p.groupBy("split").agg(F.count("*").alias("pairs"), F.count_distinct("synthetic").alias("ids"), F.count_distinct(F.concat(F.least("parent_1", "parent_2"), F.lit("|"), F.greatest("parent_1", "parent_2"))).alias("canonical"))


@query("o34_group_folds", f"{with_('sc')} SELECT {i('key % 50', 'block')}, {i('row_number() OVER (ORDER BY sha256(concat(9, chr(58), chr(102), chr(58), key % 50))) % 3', 'fold')} FROM sc GROUP BY key % 50")
def o34(spark, sf):
    from countloom.functions.scalars import draw

    blocks = t.demo_scores(spark, sf).select((F.col("key") % 50).alias("block")).distinct()
    return blocks.withColumn("fold", F.row_number().over(W.orderBy(draw(9, "f", F.col("block")))) % 3)


@query("j1_frozen_projection")
def j1(spark, sf):
    """Uncentred decomposition of log-normalised purchases and the projection of every customer."""
    from countloom.operators.reference import loadings_table, project

    values = matrix.log_normalised(t.purchase_counts(spark, sf))
    out = project(values, loadings_table(values, 4), 4)
    return out.select("cell", *(F.col("vector")[c].alias(f"pc{c + 1}") for c in range(4)))


@query("j8_j10_detector")
def detector(spark, sf):
    """Documents by tokens: reference, synthetic pairs, calibrated forest and calls at the expected rate."""
    from countloom.plans.detector import Detector

    return Detector(preset="fast", components=10, clusters=4).fit_predict(t.token_counts(spark, sf))


@query("streaming_ledger_batch", f"SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, {i('count(*)', 'n')}, {d('avg(value)', 'mean')}, {d('max(value)', 'most')} FROM events GROUP BY 1, 2")
def ledger(spark, sf):
    """The windowed ledger over the whole table; the same function runs on a stream."""
    from countloom.streaming.scoring import windowed_ledger

    return windowed_ledger(t.table(spark, sf, "events"))


@query("d19_match_with_fallback")
def d19b(spark, sf):
    """Both stages; sequential, so without SQL: tests compare the second stage with a plain loop."""
    s = t.demo_scores(spark, sf).withColumn("b", F.floor(F.col("s1") * 4.999))
    return matching.match_with_fallback(s.filter("positive = 1"), s.filter("hard = 1"), ["cluster", "b"], ["s1", "s2"]).select("cluster", "cell", "control", "stage")


@query("j13_j19_logistic")
def j13(spark, sf):
    """Chances of a doublet by the balanced logistic model, fitted on two thirds of the customers and given for all."""
    from countloom.operators.logistic import BalancedLogistic

    s = t.rough_scores(spark, sf).withColumn("y", F.col("label").isin(*CLASSES[2:]).cast("int"))
    return BalancedLogistic(["a", "b", "c", "spent"]).fit(s.filter("key % 3 <> 0"), "y").predict(s).select("cell", F.round("chance", 6).alias("chance"))


@query("j2_variable_genes", f"""{with_('cm1', 'tot')}, v AS (SELECT cell, gene, ln(1 + count / n_count * 10000) AS v FROM cm1 JOIN tot USING (cell) WHERE count > 0), n AS (SELECT count(DISTINCT cell) AS n FROM cm1),
 g AS (SELECT gene, sum(v) / n AS mean, round(greatest(0, sum(v * v) / n - (sum(v) / n) * (sum(v) / n)), 12) AS variance FROM v, n GROUP BY gene, n) SELECT gene, {d('mean')}, {d('variance')} FROM g ORDER BY g.variance DESC, gene LIMIT 200""")
def j2g(spark, sf):
    """The 200 parts whose log-normalised purchases vary most."""
    from countloom.operators.preprocess import variable_genes

    counts = t.purchase_counts(spark, sf)
    return variable_genes(matrix.log_normalised(counts), counts.select("cell").distinct().count(), 200)


@query("j2_centred_axes")
def j2(spark, sf):
    """Customers on six axes of the 200 most varying parts, centred and padded to eight; a fit, so without SQL: a test compares it with numpy."""
    from countloom.operators.preprocess import Decomposition

    counts = written(t.purchase_counts(spark, sf))
    out = Decomposition.fit(counts, 200, 6).transform(counts)
    return out.select("cell", *(F.coalesce(F.get("vector", F.lit(c)), F.lit(0.0)).alias(f"axis{c + 1}") for c in range(8)))


@query("j11_network")
def j11(spark, sf):
    """Chances by the network of three heads, trained on two thirds of the customers and stopped on the rest; a fit, so without SQL."""
    from countloom.operators.network import MultiTaskNetwork, NetworkConfig

    s = t.rough_scores(spark, sf)
    net = MultiTaskNetwork(("a", "b", "c", "spent"), NetworkConfig(epochs=6, patience=3, batch=2048)).fit(s.filter("key % 3 <> 0"), s.filter("key % 3 = 0"))
    return net.predict(s).select("cell", *CLASSES, "rejection")


@query("j12_network_extras")
def j12(spark, sf):
    """The same with the extra terms: correlation with the spent total and triplets mined in the embedding."""
    from countloom.operators.network import MultiTaskNetwork, NetworkConfig

    s = t.rough_scores(spark, sf)
    config = NetworkConfig(epochs=4, patience=3, batch=2048, decorrelation=0.1, triplets=0.1, warm_up=2)
    net = MultiTaskNetwork(("a", "b", "c", "spent"), config).fit(s.filter("key % 3 <> 0"), s.filter("key % 3 = 0"), cluster="cluster", covariate="spent")
    return net.predict(s).select("cell", *CLASSES, "rejection")

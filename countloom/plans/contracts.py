"""Queries of contracts: feature governance, schema, pools, alignment, exports, budgets and run-time estimates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions import robust, scalars
from countloom.functions.running import numbered
from countloom.operators import contracts, ledger, matrix, points, sampling
from countloom.plans.core import CLIP, R1, stats_sql
from countloom.plans.registry import d, i, query, with_
from countloom.sources import tables as t




@query("l6_schema_audit", f"""{with_('cm1')}, c AS (SELECT CAST(c_custkey AS VARCHAR) AS cell FROM customer), g AS (SELECT CAST(p_partkey AS VARCHAR) AS gene FROM part WHERE p_size <= 49),
 r AS (SELECT 'unique_cells' AS "check", (SELECT count(*) - count(DISTINCT cell) FROM c) AS failed UNION ALL SELECT 'unique_genes', (SELECT count(*) - count(DISTINCT gene) FROM g) UNION ALL SELECT 'cells_known', (SELECT count(DISTINCT cell) FROM cm1 WHERE cell NOT IN (SELECT cell FROM c))
 UNION ALL SELECT 'genes_known', (SELECT count(DISTINCT gene) FROM cm1 WHERE gene NOT IN (SELECT gene FROM g)) UNION ALL SELECT 'finite_counts', (SELECT count(*) FROM cm1 WHERE count IS NULL OR NOT isfinite(count)) UNION ALL SELECT 'counts_not_negative', (SELECT count(*) FROM cm1 WHERE count < 0))
 SELECT "check", {i('failed')}, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def l6(spark, sf):
    genes = t.table(spark, sf, "part").filter("p_size <= 49").select(F.col("p_partkey").cast("string").alias("gene"))
    return contracts.schema_audit(t.purchase_counts(spark, sf), t.customer_cells(spark, sf).select("cell"), genes)


@query("l7_pool_composition", f"""SELECT lang AS pool, {i('count(DISTINCT d.doc_id)', 'ids')}, {i('count(*) FILTER (toxic = 1)', 'positives')}, {i('count(*) FILTER (toxic IS NULL)', 'unlabelled')}, CASE WHEN count(*) FILTER (toxic = 1) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
 FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def l7(spark, sf):
    return contracts.pool_composition(t.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("pool")), t.table(spark, sf, "labels"), "doc_id", "pool", "toxic")


@query("l9_audit_contract", f"""{with_('rs')}, a AS (SELECT key // 2 AS ds, key AS k, key % 3 <> 0 AS is_primary, CASE key % 7 WHEN 0 THEN 'INSUFFICIENT_PARENT_DISJOINT_DATA' WHEN 1 THEN 'failed' ELSE 'Pass' END AS status, a AS auroc, b AS auprc, CASE WHEN key % 11 = 0 THEN 1 ELSE 0 END AS overlap,
  CASE WHEN key % 9 = 0 THEN 'WARNING' ELSE 'PASS' END AS balance FROM rs), p AS (SELECT ds, count(*) AS n, any_value(upper(status)) AS status, any_value(auroc) AS auroc, any_value(auprc) AS auprc, any_value(overlap) AS overlap, any_value(balance) AS balance FROM a WHERE is_primary GROUP BY 1 HAVING count(*) = 1),
 q AS (SELECT DISTINCT ds FROM a), r AS (SELECT CAST(ds AS VARCHAR) AS dataset, p.*, CASE WHEN p.n IS NULL THEN 'not exactly one primary row' WHEN status NOT IN ('PASS', 'SUCCESS', 'COMPLETED') THEN 'status is ' || status WHEN auroc IS NULL OR auprc IS NULL THEN 'areas are not finite' WHEN overlap <> 0 THEN 'parents overlap across folds'
  WHEN balance <> 'PASS' THEN 'folds are not balanced' ELSE '' END AS reason FROM q LEFT JOIN p USING (ds))
 SELECT dataset, CASE WHEN reason = '' THEN 'COMPLETED' WHEN n IS NULL OR status IN ('PASS', 'SUCCESS', 'COMPLETED') THEN 'CONTRACT_ERROR' WHEN status = 'INSUFFICIENT_PARENT_DISJOINT_DATA' THEN 'SKIPPED_INSUFFICIENT_DATA' ELSE status END AS state, reason FROM r""")
def l9(spark, sf):
    """Audits of as many data sets as two customers each make, of which the primary ones count."""
    k = F.col("key")
    s = t.rough_scores(spark, sf).select(
        F.floor(k / 2).cast("string").alias("dataset"), (k % 3 != 0).alias("is_primary"), F.when(k % 7 == 0, "INSUFFICIENT_PARENT_DISJOINT_DATA").when(k % 7 == 1, "failed").otherwise("Pass").alias("status"), F.col("a").alias("auroc"), F.col("b").alias("auprc"),
        F.when(k % 11 == 0, 1).otherwise(0).alias("overlap"), F.when(k % 9 == 0, "WARNING").otherwise("PASS").alias("balance"), F.lit("PASS").alias("provenance"))
    return contracts.audit_contract(s)


@query("l10_shared_coordinates", f"""WITH a AS (SELECT (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) + (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS apart)
 SELECT panel, {i('(SELECT count(*) FROM embeddings)', 'cells')}, {i('apart')}, CASE WHEN apart = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM a, (SELECT unnest(['score', 'class', 'label']) AS panel)""")
def l10(spark, sf):
    c = t.table(spark, sf, "embeddings").select("vec_id", "embedding")
    scores = t.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"))
    return contracts.shared_coordinates(c, scores, "vec_id", ["score", "class", "label"]).select("panel", "cells", "apart", "status")


@query("o2_metric_difference", f"""{with_('sc')}, a AS (SELECT avg(s1) AS m, avg(s2) AS n, count(*) AS k FROM sc WHERE cluster = 'BUILDING'), b AS (SELECT avg(s1) AS m, avg(s3) AS n, count(*) AS k FROM sc WHERE cluster = 'BUILDING') SELECT {d('greatest(abs(a.m - b.m), abs(a.n - b.n))', 'largest')}, 1::BIGINT AS matched FROM a, b""")
def o2(spark, sf):
    """One run's saved metrics against those computed again: the largest difference."""
    s = t.demo_scores(spark, sf).groupBy("cluster")
    saved, again = s.agg(F.avg("s1").alias("m"), F.avg("s2").alias("n")), s.agg(F.avg("s1").alias("m"), F.avg("s3").alias("n"))
    both = saved.filter("cluster = 'BUILDING'").alias("a").join(again.alias("b"), "cluster")
    return both.agg(F.greatest(*(F.max(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}"))) for c in "mn")).alias("largest"), F.count("*").alias("matched"))


@query("o3_keyed_update", f"""{with_('rs')}, s AS (SELECT cluster, avg(a) AS m FROM rs GROUP BY 1), u AS (SELECT cluster, avg(c) AS m FROM rs WHERE cluster IN ('BUILDING', 'MACHINERY') GROUP BY 1) SELECT cluster, {d('coalesce(u.m, s.m)', 'm')} FROM s LEFT JOIN u USING (cluster)""")
def o3(spark, sf):
    """Metrics saved per cluster, those of two clusters computed again."""
    s = t.rough_scores(spark, sf)
    return contracts.keyed_update(s.groupBy("cluster").agg(F.avg("a").alias("m")), s.filter("cluster IN ('BUILDING', 'MACHINERY')").groupBy("cluster").agg(F.avg("c").alias("m")), ["cluster"], ["m"])


@query("o8_old_safe_features", f"""{with_('rs')} SELECT cell, {d('coalesce(a, (SELECT median(a) FROM rs), 0)', 'a')}, {d('coalesce(b, (SELECT median(b) FROM rs), 0)', 'b')}, {d('coalesce(spent, (SELECT median(spent) FROM rs), 0)', 'spent')} FROM rs""")
def o8(spark, sf):
    s = t.rough_scores(spark, sf)
    return contracts.old_safe_features(s.select("cell", "a", "b", "spent", F.col("c").alias("true_score"), F.col("c").alias("homotypic_similarity"), F.col("c").alias("expected_rate")), "cell")


@query("o25_positional_alignment", f"""WITH a AS (SELECT row_number() OVER (ORDER BY doc_id) AS p, doc_id AS k FROM documents), b AS (SELECT row_number() OVER (ORDER BY doc_id) AS p, doc_id AS k FROM labels)
 SELECT {i('count(a.k)', 'left_rows')}, {i('count(b.k)', 'right_rows')}, {i('count(*) FILTER (a.k IS DISTINCT FROM b.k)', 'mismatches')} FROM a FULL JOIN b USING (p)""")
def o25(spark, sf):
    return contracts.positional_alignment(t.table(spark, sf, "documents"), t.table(spark, sf, "labels"), "doc_id", "doc_id")


@query("o26_blinded_labels", f"{with_('rs')}, k AS (SELECT cell, row_number() OVER (ORDER BY c DESC, cell) AS rank FROM rs) SELECT cell, {i('rank')}, label FROM k JOIN rs USING (cell)")
def o26(spark, sf):
    """Cells are ranked without their labels, which are joined to the ranks afterwards."""
    s = t.rough_scores(spark, sf)
    ranked = numbered(s.select("cell", "c"), "c", "cell", "rank", []).select("cell", "rank")
    return ranked.join(s.select("cell", "label"), "cell", "left")


@query("o28_run_provenance", f"""{with_('cm1')} SELECT 'customer_part' AS dataset, {i('count(DISTINCT cell)', 'cells')}, {i('count(DISTINCT gene)', 'genes')}, {i('count(*)', 'entries')}, {d('sum(count)', 'total')}, 8::BIGINT AS rate_percent, 'expected_rate' AS threshold_strategy FROM cm1""")
def o28(spark, sf):
    c = t.purchase_counts(spark, sf).agg(F.count_distinct("cell").alias("cells"), F.count_distinct("gene").alias("genes"), F.count("*").alias("entries"), F.sum("count").cast("double").alias("total"))
    return c.select(F.lit("customer_part").alias("dataset"), "cells", "genes", "entries", "total", F.lit(8).alias("rate_percent"), F.lit("expected_rate").alias("threshold_strategy"))


@query("o30_historical_budget", f"""{with_('ms')}, k AS (SELECT method, score, label, row_number() OVER (PARTITION BY method ORDER BY score DESC NULLS LAST, cell) AS r, count(*) FILTER (label LIKE '%\\_doublet' ESCAPE '\\') OVER (PARTITION BY method) AS n, count(*) FILTER (label = 'high_RNA_singlet') OVER (PARTITION BY method) AS h, count(*) OVER (PARTITION BY method) AS m FROM ms)
 SELECT method, {d('max(score) FILTER (r = n)', 'threshold')}, {i('max(n)', 'selected')}, {d('max(n) / max(m)', 'fraction')}, {i('max(h)', 'n_high')}, {i("count(*) FILTER (r <= n AND label = 'high_RNA_singlet')", 'n_selected_high')}, {d("count(*) FILTER (r <= n AND label = 'high_RNA_singlet') / max(h)", 'fpr')}, 'AVAILABLE' AS status FROM k GROUP BY method""")
def o30(spark, sf):
    """The budget of true doublets, ties by cell, for every method."""
    return points.true_budget(t.method_scores(spark, sf))


@query("o32_domain_masks", f"""SELECT doc_id, {i('quality', 'quality')}, toxic = 1 AS experimental, quality = 1 AS heterotypic, doc_id % 3 = 0 AS in_split FROM labels""")
def o32(spark, sf):
    k = F.col("doc_id")
    meta = t.table(spark, sf, "labels").select(
        "doc_id", "quality", F.when(F.col("toxic") == 1, " Doublet ").otherwise("singlet").alias("experimental_label"), F.when(F.col("quality") == 1, "HETEROTYPIC").otherwise("homotypic").alias("doublet_subtype"), F.when(k % 3 == 0, "semi_real_test").otherwise("train").alias("split"))
    return contracts.domain_masks(meta, "test").select("doc_id", "quality", "experimental", "heterotypic", "in_split")


@query("o35_o37_export_checks", f"""{with_('rs')}, l AS (SELECT l_orderkey FROM lineitem), r AS (SELECT 'unique_ids' AS "check", (SELECT count(*) - count(DISTINCT cell) FROM rs) AS failed UNION ALL SELECT 'no_synthetic_ids', (SELECT count(*) FROM rs WHERE cell LIKE 'synthetic%')
 UNION ALL SELECT 'one_split', (SELECT count(DISTINCT cluster) - 1 FROM rs) UNION ALL SELECT 'finite_features', (SELECT count(*) FROM rs WHERE a IS NULL OR b IS NULL) UNION ALL SELECT 'parents_complete', 0 UNION ALL SELECT 'parents_differ', (SELECT count(*) FROM lineitem WHERE l_partkey = l_suppkey))
 SELECT "check", {i('failed')}, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def o35(spark, sf):
    real = t.rough_scores(spark, sf).withColumnRenamed("cluster", "split")
    parents = t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("parent_1"), F.col("l_suppkey").alias("parent_2"))
    return contracts.export_checks(real, parents, "cell", ["a", "b"])


@query("o40_o42_method_rows", f"""{with_('ms')}, f AS (SELECT method, count(*) AS n, count(score) AS k FROM ms GROUP BY 1) SELECT m.method, {i('coalesce(n, 0)', 'rows')}, CASE WHEN n IS NULL THEN 'skipped' WHEN k = 0 THEN 'failed' ELSE 'success' END AS status FROM (SELECT unnest(['a', 'none', 'solo']) AS method) m LEFT JOIN f USING (method)""")
def o40(spark, sf):
    methods = contracts.resolved([" A, none", "solo,a"], {"a": "a", "b": "b", "none": "none", "solo": "solo"})
    return contracts.method_rows(t.method_scores(spark, sf).withColumn("score", scalars.finite(F.col("score"))), methods, ["a", "b", "c", "none", "solo"])


# ---------------------------------------------------------------- filters, lookups and estimates

@query("d2_optional_filter", f"""{with_('tot')}, m AS (SELECT cell, sum(CASE WHEN gene LIKE '1%' THEN count ELSE 0 END) / sum(count) AS mito FROM cm1 GROUP BY 1), q AS (SELECT cell, n_count >= 1 AND n_feature >= least(20, ceil(0.1 * (SELECT count(DISTINCT gene) FROM cm1))) AND mito <= 1 AS passes FROM tot JOIN m USING (cell))
 SELECT cell FROM q WHERE passes OR (SELECT count(*) FILTER (passes) FROM q) < least(2, (SELECT count(*) FROM q))""")
def d2(spark, sf):
    """A bound on genes alone; without any bound all cells stay."""
    counts = t.purchase_counts(spark, sf)
    totals = matrix.cell_totals(counts).join(matrix.prefix_fraction(counts, ["1"], "mito"), "cell")
    return matrix.optional_filter(totals, counts.agg(F.count_distinct("gene").alias("n")), min_genes=20).select("cell")


@query("d12_fallback_chain", f"""{with_('base')}, ref AS (SELECT * FROM base WHERE cluster <> 'MACHINERY' AND NOT (cluster = 'BUILDING' AND library = 'ASIA')), a AS (SELECT cluster, library, med, {R1} AS sc FROM {stats_sql('log_count', 'cluster, library', 'ref')}), b AS (SELECT cluster, med, {R1} AS sc FROM {stats_sql('log_count', 'cluster', 'ref')}), c AS (SELECT med, {R1} AS sc FROM {stats_sql('log_count', '', 'ref')})
 SELECT cell, {d('(log_count - coalesce(a.med, b.med, c.med)) / coalesce(a.sc, b.sc, c.sc)', 'z')}, CASE WHEN a.med IS NOT NULL THEN 'group' WHEN b.med IS NOT NULL THEN 'cluster' ELSE 'whole' END AS level FROM base LEFT JOIN a USING (cluster, library) LEFT JOIN b USING (cluster), c""")
def d12(spark, sf):
    """z against the reference's (cluster, library), else its cluster, else all of it."""
    base = t.customer_base(spark, sf)
    ref = base.filter("cluster <> 'MACHINERY' AND NOT (cluster = 'BUILDING' AND library = 'ASIA')")
    return robust.z_by_chain(base, "log_count", [["cluster", "library"], ["cluster"]], ["group", "cluster", "whole"], "z", "level", ref).select("cell", "z", "level")


@query("c25_capped_ratio", f"{with_('rs')}, n AS (SELECT label, count(*) AS n, count(*) FILTER (a > 1) AS p FROM rs GROUP BY 1) SELECT label, {d('CASE WHEN p <= 0 OR n - p <= 0 THEN 1 ELSE least(20, (n - p) / p) END', 'ratio')} FROM n")
def c25(spark, sf):
    n = t.rough_scores(spark, sf).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("a") > 1).alias("p"))
    return n.select("label", scalars.capped_ratio(F.col("n") - F.col("p"), F.col("p")).alias("ratio"))


@query("f14_estimates", f"""WITH r AS (SELECT event_id, ts, 'stage' || user_id % 3 AS stage, event_type AS method, 100 + user_id % 50 * 20 AS cells, CASE WHEN user_id % 17 = 0 THEN 0 ELSE value END AS elapsed, user_id % 5 <> 0 AS ok, user_id % 7 = 0 AS cached FROM events), g AS (SELECT * FROM r WHERE ok AND NOT cached AND elapsed > 0),
 k AS (SELECT unnest(['stage0', 'stage1', 'stage2', 'stage9']) AS stage), q AS (SELECT stage, method, cells FROM k, (VALUES ('click', 300), ('view', 100000), ('never', 300)) v(method, cells)),
 a AS (SELECT q.stage, q.method, g.elapsed, g.cells BETWEEN 0.5 * q.cells AND 2 * q.cells AS near, row_number() OVER (PARTITION BY q.stage, q.method ORDER BY g.ts DESC, g.event_id DESC) AS p FROM q JOIN g ON g.stage = q.stage AND g.method = q.method),
 s AS (SELECT stage, elapsed, row_number() OVER (PARTITION BY stage ORDER BY ts DESC, event_id DESC) AS p FROM g), m AS (SELECT stage, method, median(elapsed) AS m, count(*) AS n, median(elapsed) FILTER (near) AS mn, count(*) FILTER (near) AS nn FROM a WHERE p <= 20 GROUP BY 1, 2), x AS (SELECT stage, median(elapsed) AS m, count(*) AS n FROM s WHERE p <= 20 GROUP BY 1)
 SELECT q.stage, q.method, {d('CASE WHEN nn >= 2 THEN mn WHEN m.n >= 2 THEN m.m WHEN x.n >= 2 THEN x.m END', 'seconds')}, CASE WHEN nn >= 2 THEN 'similar_size' WHEN m.n >= 2 THEN 'same_method' WHEN x.n >= 2 THEN 'stage' ELSE 'insufficient_history' END AS basis,
 {i('CASE WHEN nn >= 2 THEN nn WHEN m.n >= 2 THEN m.n ELSE coalesce(x.n, 0) END', 'observations')} FROM q LEFT JOIN m USING (stage, method) LEFT JOIN x USING (stage)""")
def f14b(spark, sf):
    """Expected seconds of tasks from the last 20 compatible runs: of the method at a similar size, of the method, of the stage."""
    u = F.col("user_id")
    runs = t.table(spark, sf, "events").select(
        "event_id", "ts", F.concat(F.lit("stage"), (u % 3).cast("string")).alias("stage"), F.col("event_type").alias("method"), (100 + u % 50 * 20).alias("cells"), F.when(u % 17 == 0, 0.0).otherwise(F.col("value")).alias("elapsed"),
        F.when(u % 5 != 0, "SUCCESS").otherwise("FAILED").alias("status"), (u % 7 == 0).alias("cached"))
    tasks = spark.createDataFrame([(s, m, c) for s in ("stage0", "stage1", "stage2", "stage9") for m, c in (("click", 300), ("view", 100000), ("never", 300))], "stage string, method string, cells long")
    return ledger.estimates(tasks, runs, ["ts", "event_id"])


@query("l11_completion", f"""WITH e AS (SELECT * FROM (VALUES ('click', 1), ('view', 1000000000), ('never', 1)) v(stage, least)), f AS (SELECT event_type AS stage, count(*) AS rows FROM events GROUP BY 1)
 SELECT coalesce(e.stage, f.stage) AS stage, {i('coalesce(rows, 0)', 'rows')}, CASE WHEN least IS NULL THEN 'UNEXPECTED' WHEN rows IS NULL THEN 'MISSING' WHEN rows < least THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS state FROM e FULL JOIN f ON e.stage = f.stage""")
def l11(spark, sf):
    expected = spark.createDataFrame([("click", 1), ("view", 1000000000), ("never", 1)], "stage string, least long")
    return contracts.completion(expected, t.table(spark, sf, "events").groupBy(F.col("event_type").alias("stage")).agg(F.count("*").alias("rows")))


@query("o33_domain_frame", f"""{with_('rs', 'tot')}, r AS (SELECT cell, 'experimental_doublet' AS domain, a, b, CASE WHEN key % 2 = 0 THEN ln(1 + spent) END AS lc, cell AS grp FROM rs WHERE label <> 'clean'), m AS (SELECT cell, 'semireal_heterotypic_doublet' AS domain, a, b, NULL::DOUBLE AS lc, CAST(key % 50 AS VARCHAR) AS grp FROM rs WHERE label = 'clean')
 SELECT cell, domain, {d('a')}, {d('b')}, {d('coalesce(lc, ln(1 + n_count))', 'log_count')}, {d('ln(1 + n_feature)', 'log_feature')}, grp FROM (SELECT * FROM r UNION ALL SELECT * FROM m) LEFT JOIN tot USING (cell)""")
def o33(spark, sf):
    s = t.rough_scores(spark, sf)
    real = s.filter("label <> 'clean'").select("cell", "a", "b", F.when(F.col("key") % 2 == 0, F.log1p("spent")).alias("log_count"))
    made = s.filter("label = 'clean'").select("cell", "a", "b", (F.col("key") % 50).cast("string").alias("parent_1"))
    return contracts.domain_frame(real, made, matrix.cell_totals(t.purchase_counts(spark, sf)), ["a", "b"])


# ---------------------------------------------------------------- plans, folds and centroids

@query("a14_method_status", f"""WITH s AS (SELECT event_type AS method, CASE WHEN value > 1 THEN 'success' WHEN value > 0.5 THEN 'failed' END AS status, value AS runtime FROM events), c AS (SELECT method, status, row_number() OVER (PARTITION BY method ORDER BY count(*) DESC, status) AS r FROM s WHERE status IS NOT NULL GROUP BY 1, 2)
 SELECT s.method, {d('max(runtime)', 'runtime')}, {i('count(*)', 'rows')}, any_value(c.status) AS status FROM s LEFT JOIN c ON c.method = s.method AND c.r = 1 GROUP BY s.method""")
def a14s(spark, sf):
    v = F.col("value")
    return contracts.method_status(t.table(spark, sf, "events").select(F.col("event_type").alias("method"), F.when(v > 1, "success").when(v > 0.5, "failed").alias("status"), v.alias("runtime")))


@query("e3_centroid_distances", f"""WITH m AS (SELECT label, p, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2), q AS (SELECT a.label AS g, b.label AS o, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist FROM m a JOIN m b ON a.p = b.p AND a.label <> b.label GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(dist, 9), o) AS k FROM q) SELECT {i('g', '"group"')}, {i('o', 'nearest')}, {d('dist', 'distance')} FROM r WHERE k = 1""")
def e3d(spark, sf):
    e = t.table(spark, sf, "embeddings").select(F.col("label").alias("group"), F.posexplode("embedding").alias("p", "x"))
    return contracts.centroid_distances(e.groupBy("group", "p").agg(F.avg(F.col("x").cast("double")).alias("mean")))


LINES = "pl AS (SELECT CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS synthetic, CASE l_returnflag WHEN 'A' THEN 'train' WHEN 'N' THEN 'validation' ELSE 'other' END AS split, CASE WHEN l_linestatus = 'F' THEN 'homotypic' ELSE 'heterotypic' END AS subtype, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem)"


def line_pairs(spark, sf):
    split = F.when(F.col("l_returnflag") == "A", "train").when(F.col("l_returnflag") == "N", "validation").otherwise("other")
    return t.table(spark, sf, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("synthetic"), split.alias("split"), F.when(F.col("l_linestatus") == "F", "homotypic").otherwise("heterotypic").alias("subtype"),
        F.col("l_partkey").cast("string").alias("parent_1"), F.col("l_suppkey").cast("string").alias("parent_2"))


@query("o18_plan_checks", f"""WITH {LINES}, c AS (SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM pl GROUP BY split, least(a, b), greatest(a, b))), x AS (SELECT count(*) FILTER (n > 1) AS n FROM (SELECT count(DISTINCT split) AS n FROM (SELECT split, a FROM pl UNION ALL SELECT split, b FROM pl) GROUP BY a)),
 r AS (SELECT 'complete' AS "check", 0 AS failed UNION ALL SELECT 'unique_ids', count(*) - count(DISTINCT synthetic) FROM pl UNION ALL SELECT 'known_splits', count(*) FILTER (split = 'other') FROM pl UNION ALL SELECT 'known_subtypes', 0 UNION ALL SELECT 'two_parents', count(*) FILTER (a = b) FROM pl
 UNION ALL SELECT 'no_repeated_pair', n FROM c UNION ALL SELECT 'no_parent_across_splits', n FROM x) SELECT "check", {i('failed')}, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def o18c(spark, sf):
    return contracts.plan_checks(line_pairs(spark, sf), ["train", "validation", "test"], ["homotypic", "heterotypic"])


@query("l1_parent_removal", f"""WITH {LINES}, ref AS (SELECT CAST(s_suppkey AS VARCHAR) AS cell FROM supplier WHERE s_acctbal > 0), p AS (SELECT split, a AS cell FROM pl UNION SELECT split, b FROM pl), h AS (SELECT split, count(*) AS parents, count(ref.cell) AS held FROM p LEFT JOIN ref USING (cell) GROUP BY 1), n AS (SELECT split, count(*) AS pairs FROM pl GROUP BY 1)
 SELECT split, {i('pairs')}, {i('parents')}, {i('held', 'in_reference')}, CASE WHEN held = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM n JOIN h USING (split)""")
def l1r(spark, sf):
    reference = t.table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").cast("string").alias("cell"))
    return contracts.parent_removal(line_pairs(spark, sf), reference)


@query("o31_single_valued", f"""SELECT * FROM (SELECT 'l_linestatus' AS "column", count(DISTINCT l_linestatus)::BIGINT AS "values", CASE WHEN count(DISTINCT l_linestatus) = 1 THEN 'PASS' ELSE 'FAIL' END AS status FROM lineitem UNION ALL SELECT 'transformer', 1, 'PASS')""")
def o31s(spark, sf):
    return contracts.single_valued(t.table(spark, sf, "lineitem").withColumn("transformer", F.lit("one")), ["l_linestatus", "transformer"])


@query("o34_stratified_folds", f"""{with_('rs')}, g AS (SELECT CAST(key % 60 AS VARCHAR) AS grp, min(label) AS s FROM rs GROUP BY 1), f AS (SELECT grp, (row_number() OVER (PARTITION BY s ORDER BY sha256('0:fold:' || grp)) - 1) % 3 AS fold FROM g) SELECT cell, grp, {i('fold')} FROM rs JOIN f ON grp = CAST(key % 60 AS VARCHAR)""")
def o34f(spark, sf):
    s = t.rough_scores(spark, sf).withColumn("grp", (F.col("key") % 60).cast("string"))
    return sampling.group_folds(s, "grp", "label").select("cell", "grp", "fold")


@query("o11_stratified_fraction", f"""{with_('rs')}, k AS (SELECT cell, label, row_number() OVER (PARTITION BY label ORDER BY sha256('0:fraction:' || cell)) AS r, count(*) OVER (PARTITION BY label) AS n FROM rs) SELECT cell, label FROM k WHERE r <= greatest(round_even(0.25 * n, 0), 2)""")
def o11f(spark, sf):
    return sampling.stratified_fraction(t.rough_scores(spark, sf), "cell", "label", 0.25).select("cell", "label")

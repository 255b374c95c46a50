"""Queries that evaluate rankings and audit tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions import ranks, scalars
from countloom.operators import audits, contracts, metrics, neighbours, points
from countloom.plans.core import rank_sql
from countloom.plans.storage import written
from countloom.plans.registry import d, i, query, with_
from countloom.sources import tables as t


def auroc_sql(score: str, label: str, source: str, by: str = "") -> str:
    """(by, auroc) of a source by average ranks."""
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by}, {score}" if by else f"PARTITION BY {score}"
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""(SELECT {key}CASE WHEN sum({label}) > 0 AND sum({label}) < count(*) THEN (sum({label} * r) - sum({label}) * (sum({label}) + 1) / 2.0) / (sum({label}) * (count(*) - sum({label}))) END AS auroc
 FROM (SELECT *, rank() OVER ({part}ORDER BY {score}) + (count(*) OVER ({tie}) - 1) / 2.0 AS r FROM {source}){group})"""


def ap_sql(score: str, label: str, source: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""(SELECT {key}CASE WHEN sum(p) > 0 THEN sum(p * tp / k) / sum(p) END AS auprc FROM (SELECT *, sum(p) OVER ({part}ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(c) OVER ({part}ORDER BY {score} DESC ROWS UNBOUNDED PRECEDING) AS k
 FROM (SELECT {key}{score}, sum({label})::DOUBLE AS p, count(*)::DOUBLE AS c FROM {source} GROUP BY {key}{score})){group})"""


@query("e10_auroc", f"{with_('ok')} SELECT {d('auroc')} FROM {auroc_sql('b', 'positive', 'ok')}")
def e10(spark, sf):
    """Over rows with a finite score: missing scores and NaN are left out."""
    return metrics.auroc(t.rough_ranking(spark, sf), "b", "positive")


@query("e10_auroc_by_cluster", f"{with_('ok')} SELECT cluster, {d('auroc')} FROM {auroc_sql('b', 'positive', 'ok', 'cluster')}")
def e10c(spark, sf):
    return metrics.auroc(t.rough_ranking(spark, sf), "b", "positive", ["cluster"])


@query("e11_average_precision", f"{with_('ok')} SELECT {d('auprc')} FROM {ap_sql('b', 'positive', 'ok')}")
def e11(spark, sf):
    return metrics.average_precision(t.rough_ranking(spark, sf), "b", "positive")


@query("e12_subtype_auprc", f"""{with_('ok')}, h AS (SELECT *, CASE WHEN label = 'homotypic_doublet' THEN 1 ELSE 0 END AS y FROM ok WHERE label <> 'heterotypic_doublet'), x AS (SELECT *, CASE WHEN label = 'heterotypic_doublet' THEN 1 ELSE 0 END AS y FROM ok WHERE label <> 'homotypic_doublet')
 SELECT {d('a.auprc', 'homotypic')}, {d('b.auprc', 'heterotypic')}, {d('(a.auprc + b.auprc) / 2', 'macro')} FROM {ap_sql('b', 'y', 'h')} a, {ap_sql('b', 'y', 'x')} b""")
def e12(spark, sf):
    s = t.rough_ranking(spark, sf)
    one = lambda keep, out: metrics.average_precision(s.filter(F.col("label") != out).withColumn("y", (F.col("label") == keep).cast("int")), "b", "y")
    h = one("homotypic_doublet", "heterotypic_doublet").select(F.col("auprc").alias("homotypic"))
    x = one("heterotypic_doublet", "homotypic_doublet").select(F.col("auprc").alias("heterotypic"))
    return h.crossJoin(F.broadcast(x)).withColumn("macro", (F.col("homotypic") + F.col("heterotypic")) / 2)


@query("e13_document_toxicity_metrics", f"""WITH l AS (SELECT labels.doc_id, toxic, n_chars FROM labels JOIN documents USING (doc_id)) SELECT {d('auroc')}, {d('auprc')} FROM {auroc_sql('n_chars', 'toxic', 'l')}, {ap_sql('n_chars', 'toxic', 'l')}""")
def e13(spark, sf):
    l = t.table(spark, sf, "labels").join(t.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")  # noqa: E741
    return metrics.auroc(l, "n_chars", "toxic").crossJoin(F.broadcast(metrics.average_precision(l, "n_chars", "toxic")))


@query("e14_top_k", f"{with_('pb')}, r AS (SELECT positive, row_number() OVER (ORDER BY b DESC NULLS LAST, cell) AS r, sum(positive) OVER () AS k FROM pb) SELECT {i('max(k)', 'k')}, {i('sum(positive) FILTER (r <= k)', 'hits')}, {d('sum(positive) FILTER (r <= k) / max(k)', 'precision')}, {d('sum(positive) FILTER (r <= k) / max(k)', 'recall')} FROM r")
def e14(spark, sf):
    return metrics.top_k(t.rough_ranking(spark, sf), "b", "cell", "positive")


@query("e15_hard_fpr_at_budget", f"{with_('pb')}, r AS (SELECT cluster, hard, row_number() OVER (PARTITION BY cluster ORDER BY b DESC NULLS LAST, cell) AS r, sum(positive) OVER (PARTITION BY cluster) AS k FROM pb) SELECT cluster, {i('max(k)', 'budget')}, {i('coalesce(sum(hard) FILTER (r <= k), 0)', 'false_hits')}, {i('sum(hard)', 'hard')}, {d('CASE WHEN sum(hard) > 0 THEN coalesce(sum(hard) FILTER (r <= k), 0) / sum(hard) END', 'fpr')} FROM r GROUP BY cluster")
def e15(spark, sf):
    return metrics.fpr_at_budget(t.rough_ranking(spark, sf), "b", "cell", "positive", "hard", ["cluster"])


POINTS = """k AS (SELECT *, row_number() OVER w AS rank, count(*) FILTER (label = 'homotypic_doublet') OVER w AS hom, count(*) FILTER (label = 'heterotypic_doublet') OVER w AS het, count(*) FILTER (label = 'high_RNA_singlet') OVER w AS rna
  FROM ms WINDOW w AS (PARTITION BY method ORDER BY score DESC NULLS LAST, cell ROWS UNBOUNDED PRECEDING)),
 tt AS (SELECT method, count(*) AS n_cells, max(hom) AS n_hom, max(het) AS n_het, max(rna) AS n_high, count(score) AS known FROM k GROUP BY 1),
 pt AS (SELECT * FROM (VALUES ('fixed_candidate_fraction', NULL::DOUBLE), ('matched_overall_recall', 0.5), ('matched_overall_recall', 0.7), ('matched_overall_recall', 0.8), ('matched_overall_recall', 0.9),
  ('matched_homotypic_recall', 0.5), ('matched_homotypic_recall', 0.7), ('matched_homotypic_recall', 0.8)) v(type, target)),
 r AS (SELECT tt.method, type, target, min(rank) AS rank FROM tt, pt, k WHERE k.method = tt.method AND known > 0 AND CASE type WHEN 'fixed_candidate_fraction' THEN rank >= round_even(0.2 * n_cells, 0)
  WHEN 'matched_overall_recall' THEN hom + het >= ceil(target * (n_hom + n_het) - 1e-12) ELSE hom >= ceil(target * n_hom - 1e-12) END GROUP BY 1, 2, 3),
 pts AS (SELECT tt.method, pt.type, pt.target, coalesce(r.rank, 0) AS selected, coalesce(r.rank, 0) / n_cells AS fraction, CASE WHEN r.rank IS NOT NULL THEN coalesce(score, '-inf'::DOUBLE) END AS threshold, (hom + het) / r.rank AS precision,
  coalesce(hom + het, 0) / (n_hom + n_het) AS overall_recall, coalesce(hom, 0) / n_hom AS homotypic_recall, coalesce(het, 0) / n_het AS heterotypic_recall, coalesce(rna, 0) / n_high AS fpr,
  n_cells, n_hom + n_het AS n_true, n_hom, n_het, n_high, coalesce(rna, 0) AS n_selected_high, CASE WHEN known = 0 THEN 'NOT_AVAILABLE' ELSE 'SUCCESS' END AS status, CASE WHEN known = 0 THEN 'no finite scores' ELSE '' END AS message
  FROM tt CROSS JOIN pt LEFT JOIN r ON r.method = tt.method AND r.type = pt.type AND r.target IS NOT DISTINCT FROM pt.target LEFT JOIN k ON k.method = r.method AND k.rank = r.rank)"""


@query("e16_operating_points", f"""{with_('ms')}, {POINTS} SELECT method, type, {d('target')}, {i('selected')}, {d('fraction')}, {d('threshold')}, {d('precision')}, {d('overall_recall')}, {d('homotypic_recall')}, {d('heterotypic_recall')}, {d('fpr')},
 {i('n_cells')}, {i('n_true')}, {i('n_hom')}, {i('n_het')}, {i('n_high')}, {i('n_selected_high')}, status, message FROM pts""")
def e16(spark, sf):
    return points.operating_table(t.method_scores(spark, sf))


@query("e17_metric_bundle", f"""{with_('ms')}, {POINTS}, p AS (SELECT * FROM pts WHERE type = 'matched_homotypic_recall' AND target = 0.5),
 h AS (SELECT tt.method, n_hom + n_het AS budget, CASE WHEN known > 0 THEN rna / n_high END AS f FROM tt JOIN k ON k.method = tt.method AND k.rank = n_hom + n_het)
 SELECT p.method, {d('p.fpr', 'fpr')}, p.status, p.message AS reason, {d("max(x.fpr) FILTER (x.target = 0.7 AND x.type = 'matched_homotypic_recall')", 'fpr_70')}, {d("max(x.fpr) FILTER (x.target = 0.8 AND x.type = 'matched_homotypic_recall')", 'fpr_80')},
 {d("max(x.fpr) FILTER (x.type = 'fixed_candidate_fraction')", 'fpr_fixed')}, {d('p.homotypic_recall', 'recall')}, {d('p.fraction', 'fraction')}, {i('p.selected', 'selected')}, {i('any_value(budget)', 'budget')}, {d('any_value(f)', 'fpr_budget')}
 FROM p JOIN pts x USING (method) JOIN h USING (method) GROUP BY p.method, p.fpr, p.status, p.message, p.homotypic_recall, p.fraction, p.selected""")
def e17(spark, sf):
    return points.metric_bundle(t.method_scores(spark, sf))


@query("e18_rate_budget", f"{with_('pb')} SELECT cell, {i('row_number() OVER (ORDER BY b DESC NULLS LAST, cell)', 'rank')}, row_number() OVER (ORDER BY b DESC NULLS LAST, cell) <= round_even(0.08 * count(*) OVER (), 0) AS selected FROM pb")
def e18(spark, sf):
    return metrics.rate_budget(t.rough_ranking(spark, sf), "b", "cell", 0.08).select("cell", "rank", "selected")


@query("e19_class_quantiles", f"{with_('sc')} SELECT label, " + ", ".join(d(f"quantile_cont(s1, {q})", f"q{n}") for n, q in (("05", .05), ("25", .25), ("50", .5), ("75", .75), ("95", .95))) + " FROM sc GROUP BY label")
def e19(spark, sf):
    q = t.demo_scores(spark, sf).groupBy("label").agg(F.expr("percentile(s1, array(0.05, 0.25, 0.5, 0.75, 0.95))").alias("q"))
    return q.select("label", *(F.col("q")[k].alias(f"q{n}") for k, n in enumerate(("05", "25", "50", "75", "95"))))


@query("e20_method_summary", f"SELECT event_type AS method, {d('avg(value)', 'mean')}, {d('stddev_samp(value)', 'std')}, {i('count(*)', 'n')}, {d('min(value)', 'least')}, {d('max(value)', 'most')} FROM events GROUP BY 1")
def e20(spark, sf):
    return t.table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("e21_point_summary", f"SELECT event_type, {i('user_id % 7', 'seed')}, {d('avg(value)', 'mean')}, {i('count(*)', 'n')} FROM events GROUP BY 1, 2")
def e21(spark, sf):
    return t.table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 7).alias("seed")).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))


@query("e22_paired_delta", f"""{with_('rs')}, m AS (SELECT cluster AS dataset, key % 3 AS seed, avg(a) AS main, avg(b) AS b, avg(c) AS c FROM rs GROUP BY 1, 2) SELECT dataset, {i('count(*)', 'seeds')}, {d('avg(main)', 'main')}, {d('avg(main - greatest(b, c))', 'delta')} FROM m GROUP BY 1""")
def e22(spark, sf):
    """Per dataset: mean over seeds of the main method's score less the best of the others of the same seed."""
    long = t.method_scores(spark, sf).filter("method <> 'none'").withColumn("score", scalars.finite(F.col("score")))
    wide = long.groupBy(F.col("cluster").alias("dataset"), (F.col("key") % 3).alias("seed")).pivot("method", ["a", "b", "c"]).agg(F.avg("score"))
    return wide.withColumn("delta", F.col("a") - F.greatest("b", "c")).groupBy("dataset").agg(F.count("*").alias("seeds"), F.avg("a").alias("main"), F.avg("delta").alias("delta"))


@query("e23_top_k_overlap", f"""{with_('rs')}, k AS (SELECT row_number() OVER (ORDER BY a DESC NULLS LAST, cell) <= 100 AS m, row_number() OVER (ORDER BY b DESC NULLS LAST, cell) <= 100 AS x, row_number() OVER (ORDER BY c DESC NULLS LAST, cell) <= 100 AS y,
 row_number() OVER (ORDER BY spent DESC NULLS LAST, cell) <= 100 AS z FROM rs), e AS (SELECT m, x AS o, 'b' AS other FROM k UNION ALL SELECT m, y, 'c' FROM k UNION ALL SELECT m, z, 'spent' FROM k UNION ALL SELECT m, x::INT + y::INT + z::INT >= 2, 'consensus' FROM k)
 SELECT other, {i('count(*) FILTER (m)', 'k')}, {i('count(*) FILTER (m AND o)', 'both')}, {i('count(*) FILTER (m OR o)', 'either')}, {d('count(*) FILTER (m AND o) / count(*) FILTER (m OR o)', 'jaccard')}, {i('count(*) FILTER (m AND NOT o)', 'main_only')}, {i('count(*) FILTER (o AND NOT m)', 'other_only')} FROM e GROUP BY other""")
def e23(spark, sf):
    s = t.rough_scores(spark, sf).withColumn("b", scalars.finite(F.col("b")))
    return audits.top_k_overlap(s, "cell", "a", ["b", "c", "spent"], 100)


@query("e24_feature_statistics", f"""{with_('rs')}, g AS (SELECT CASE WHEN label IN ('homotypic_doublet', 'heterotypic_doublet') THEN 'case' WHEN label = 'high_RNA_singlet' THEN 'control' ELSE 'other' END AS grp, a, b, c, spent FROM rs),
 f AS (SELECT grp, 'a' AS feature, a AS v, spent AS n FROM g UNION ALL SELECT grp, 'b', b, spent FROM g UNION ALL SELECT grp, 'c', c, spent FROM g),
 u AS (SELECT feature, grp, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r FROM f WHERE grp <> 'other' AND v IS NOT NULL),
 w AS (SELECT feature, count(*) FILTER (grp = 'case') AS m, count(*) FILTER (grp = 'control') AS n, sum(r) FILTER (grp = 'case') AS r FROM u GROUP BY 1), x AS (SELECT feature, (r - m * (m + 1) / 2) / (m * n) AS auroc FROM w),
 s AS (SELECT feature, (median(v) FILTER (grp = 'case') - median(v) FILTER (grp = 'control')) / stddev_samp(v) FILTER (grp <> 'other') AS effect FROM f GROUP BY 1),
 p AS (SELECT feature, grp, rank() OVER (PARTITION BY feature, grp ORDER BY v) + (count(*) OVER (PARTITION BY feature, grp, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY feature, grp ORDER BY n) + (count(*) OVER (PARTITION BY feature, grp, n) - 1) / 2.0 AS rn FROM f WHERE v IS NOT NULL AND n IS NOT NULL),
 c AS (SELECT feature, grp, corr(rv, rn) AS spearman FROM p GROUP BY 1, 2), q AS (SELECT feature, grp, count(v) AS n, median(v) AS median, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM f GROUP BY 1, 2)
 SELECT feature, q.grp AS "group", {i('n')}, {d('median')}, {d('q25')}, {d('q75')}, {d('effect')}, {d('2 * auroc - 1', 'cliffs_delta')}, {d('auroc')}, {d('spearman')} FROM q JOIN x USING (feature) JOIN s USING (feature) JOIN c USING (feature, grp)""")
def e24(spark, sf):
    s = t.rough_scores(spark, sf).withColumn("b", scalars.finite(F.col("b")))
    kind = F.when(F.col("label").isin(*scalars.CLASSES[2:]), "case").when(F.col("label") == scalars.CLASSES[1], "control").otherwise("other")
    return metrics.feature_statistics(s.withColumn("group", kind), ["a", "b", "c"], "group", "case", "control", "spent")


@query("e25_blind_spot", f"""{with_('cells')}, p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM cells GROUP BY cluster), j AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM cells GROUP BY cluster, library) SELECT {d('(SELECT sum(p * p) FROM p)', 'within')}, {d('(SELECT sum(p * p) FROM j) / (SELECT sum(p * p) FROM p)', 'joint_share')}""")
def e25(spark, sf):
    c = t.customer_cells(spark, sf)
    n = c.agg(F.count("*").alias("t"))
    square = lambda keys, out: c.groupBy(*keys).agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).agg(F.sum((F.col("n") / F.col("t")) ** 2).alias(out))
    return square(["cluster"], "within").crossJoin(F.broadcast(square(["cluster", "library"], "j"))).select("within", (F.col("j") / F.col("within")).alias("joint_share"))


KNN = """v AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
 nn AS (SELECT query, neighbour, distance, rank, own, grp FROM (SELECT a.id AS query, b.id AS neighbour, list_distance(a.e, b.e) AS distance, a.label AS own, b.label AS grp, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.e, b.e), 9), b.id) AS rank FROM v a JOIN v b ON a.id <> b.id) WHERE rank <= 15)"""


def vectors(spark, sf):
    return t.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@query("d13_knn", f"WITH {KNN} SELECT query, {i('rank')}, neighbour, {d('distance')} FROM nn")
def d13(spark, sf):
    return neighbours.knn(vectors(spark, sf), vectors(spark, sf), 15)


@query("j4_communities")
def j4(spark, sf):
    """Communities of the fuzzy graph of the 15 nearest neighbours of all vectors; rounds and levels, so without SQL: a test compares them with a plain version."""
    from countloom.operators.communities import communities
    from countloom.operators.graph import fuzzy_graph

    v = vectors(spark, sf)
    edges = written(fuzzy_graph(neighbours.knn(v, v, 15), 15))
    return communities(edges, 0.6, v.select(F.col("id").alias("node"))).labels.select(F.col("node").alias("cell"), F.col("community").alias("cluster"))


@query("j20_layout")
def j20(spark, sf):
    """The same graph in two dimensions; forces over rounds, so without SQL: a test compares the neighbours that it keeps with a plain version's."""
    from countloom.operators.graph import fuzzy_graph, layout

    v = vectors(spark, sf)
    edges = written(fuzzy_graph(neighbours.knn(v, v, 15), 15))
    return layout(edges, nodes=v.select(F.col("id").alias("node"))).select(F.col("node").alias("cell"), "x", "y")


MADE_PAIRS = "WITH o AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT count(*) AS n FROM o), m AS (SELECT a.vec_id, list_transform(list_zip(a.e, b.e), lambda x: (x[1] + x[2]) / 2) AS e FROM o a, n JOIN o b ON b.vec_id = (a.vec_id * 31 + 7) % n.n WHERE a.vec_id <> b.vec_id)"


def made_pairs(spark, sf):
    """Means of two vectors each, the partner by arithmetic on the id."""
    e = t.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    n = e.count()
    pairs = e.withColumn("p", (F.col("vec_id") * 31 + 7) % n).join(e.select(F.col("vec_id").alias("p"), F.col("e").alias("f")), "p").filter("vec_id <> p")
    return pairs.select(F.col("vec_id").cast("string").alias("id"), F.zip_with("e", "f", lambda x, y: (x + y) / 2).alias("vector"))


@query("j7_bank_neighbours", f"""{MADE_PAIRS}, d AS (SELECT o.vec_id AS cell, m.vec_id AS nb, list_distance(o.e, m.e) AS distance FROM o, m), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(distance, 9), CAST(nb AS VARCHAR)) AS rank FROM d),
 b AS (SELECT vec_id, 0 AS made, CAST(vec_id AS VARCHAR) AS id, e FROM o UNION ALL SELECT vec_id, 1, 'artificial:' || vec_id, e FROM m), x AS (SELECT o.vec_id AS cell, b.made, row_number() OVER (PARTITION BY o.vec_id ORDER BY round(list_distance(o.e, b.e), 9), b.id) AS rank FROM o, b WHERE NOT (b.made = 0 AND b.vec_id = o.vec_id)),
 p AS (SELECT cell, 1 / (1 + avg(distance)) AS proximity FROM r WHERE rank <= 30 GROUP BY 1), f AS (SELECT cell, avg(made) AS artificial_fraction FROM x WHERE rank <= 30 GROUP BY 1) SELECT CAST(cell AS VARCHAR) AS cell, {d('proximity')}, {d('artificial_fraction')} FROM p JOIN f USING (cell)""")
def j7(spark, sf):
    """Proximity to a bank of made pairs, and their share among the 30 nearest of both kinds."""
    v, bank = vectors(spark, sf), made_pairs(spark, sf).withColumn("id", F.concat(F.lit("artificial:"), "id"))
    found = written(neighbours.knn(v, bank, 30))
    near = found.groupBy(F.col("query").alias("cell")).agg((1 / (1 + F.avg("distance"))).alias("proximity"))
    # the nearest of both together are among the nearest of each
    both = found.unionByName(neighbours.knn(v, v, 30)).withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.round("distance", 9), "neighbour"))).filter(F.col("rank") <= 30)
    mixed = both.groupBy(F.col("query").alias("cell")).agg(F.avg(F.col("neighbour").startswith("artificial:").cast("double")).alias("artificial_fraction"))
    return near.join(mixed, "cell")


@query("j21_native_likelihood", f"""{MADE_PAIRS}, b AS (SELECT 0 AS made, CAST(vec_id AS VARCHAR) AS id, e FROM o UNION ALL SELECT 1, 'made:' || vec_id, e FROM m), z AS (SELECT (SELECT count(*) FROM o)::DOUBLE AS n, (SELECT count(*) FROM m)::DOUBLE AS m),
 k AS (SELECT CAST(round_even(round_even(0.5 * sqrt(n), 0) * (1 + m / n), 0) AS BIGINT) AS wide, m / n AS r FROM z), x AS (SELECT p.id, p.made, q.made AS near, row_number() OVER (PARTITION BY p.id ORDER BY round(list_distance(p.e, q.e), 9), q.id) AS rank FROM b p, b q WHERE p.id <> q.id),
 s AS (SELECT id, any_value(x.made) AS made, (sum(near) + 1) / (any_value(wide) + 2.0) AS share, any_value(r) AS r FROM x, k WHERE rank <= wide GROUP BY id)
 SELECT replace(id, 'made:', '') AS cell, made = 1 AS made, {d('share')}, {d('share * 0.1 / r / (0.9 - share * (0.9 - 0.1 / r))', 'score')} FROM s""")
def j21(spark, sf):
    """Every vector's chance of being a pair, by the made pairs among its nearest."""
    from countloom.operators.native_scores import neighbour_likelihood

    return neighbour_likelihood(vectors(spark, sf), made_pairs(spark, sf)).select("cell", "made", "share", "score")


@query("e26_purity_entropy", f"""WITH {KNN}, g AS (SELECT query, own, grp, count(*) AS n, sum(distance) AS ds FROM nn GROUP BY 1, 2, 3)
 SELECT query, {d('sum(n) FILTER (own = grp) / 15', 'purity_')}, {d('-sum(n / 15 * ln(n / 15)) / ln(greatest(2, (SELECT count(DISTINCT label) FROM embeddings)))', 'entropy')}, {d('sum(ds) / 15', 'mean_distance')} FROM g GROUP BY 1""".replace("sum(n) FILTER (own = grp) / 15", "coalesce(sum(n) FILTER (own = grp), 0) / 15").replace("purity_", "purity"))
def e26(spark, sf):
    groups = t.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").alias("group"))
    return neighbours.purity_entropy(neighbours.knn(vectors(spark, sf), vectors(spark, sf), 15), groups)


@query("j6_j7_reference_neighbours", f"""WITH {KNN} SELECT query, {d('1 / (1 + avg(distance))', 'proximity')}, {d("avg(CASE WHEN CAST(neighbour AS BIGINT) % 2 = 0 THEN 1.0 ELSE 0.0 END)", 'artificial_fraction')} FROM nn GROUP BY 1""")
def j6(spark, sf):
    n = neighbours.knn(vectors(spark, sf), vectors(spark, sf), 15)
    return n.groupBy("query").agg((1 / (1 + F.avg("distance"))).alias("proximity"), F.avg((F.col("neighbour").cast("long") % 2 == 0).cast("double")).alias("artificial_fraction"))


@query("o6_parent_groups", f"""WITH v AS (SELECT CAST(vec_id AS VARCHAR) AS id, label, embedding::DOUBLE[] AS e FROM embeddings), o AS (SELECT * FROM v WHERE label < 8), s AS (SELECT * FROM v WHERE label >= 8),
 n AS (SELECT o.id AS cell, s.id AS nearest, s.label, row_number() OVER (PARTITION BY o.id ORDER BY round(list_distance(o.e, s.e), 9), s.id) AS r FROM o, s) SELECT cell, nearest, {i('label', 'parent_1')}, {i('CAST(nearest AS BIGINT) % 8', 'parent_2')} FROM n WHERE r = 1""")
def o6(spark, sf):
    """Every observed vector takes the parents of its nearest synthetic one (here those of labels 8 and 9)."""
    e = t.table(spark, sf, "embeddings")
    part = lambda f: e.filter(f).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    parents = e.filter("label >= 8").select(F.col("vec_id").cast("string").alias("nearest"), F.col("label").alias("parent_1"), (F.col("vec_id") % 8).alias("parent_2"))
    near = neighbours.knn(part("label < 8"), part("label >= 8"), 1).select(F.col("query").alias("cell"), F.col("neighbour").alias("nearest"))
    return near.join(parents, "nearest").select("cell", "nearest", "parent_1", "parent_2")


@query("o5_nearest_centroid", f"""WITH m AS (SELECT label, p, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY p) AS c FROM m GROUP BY 1)
 SELECT id, "group", {d('distance')} FROM (SELECT CAST(vec_id AS VARCHAR) AS id, CAST(c.label AS BIGINT) AS "group", round(list_distance(embedding::DOUBLE[], c), 9) AS distance, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_distance(embedding::DOUBLE[], c), 9), c.label) AS r FROM embeddings e, c) WHERE r = 1""")
def o5(spark, sf):
    e = t.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("group"), F.posexplode("embedding").alias("p", "x"))
    means = e.groupBy("group", "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = means.groupBy("group").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda s: s["m"]).alias("centre"))
    return neighbours.nearest_centroid(vectors(spark, sf), centres)


@query("e27_diagnostics", f"""{with_('sc')}, k AS (SELECT unnest(['clean', 'high_RNA_singlet', 'homotypic_doublet', 'heterotypic_doublet', 'unseen']) AS label), l AS (SELECT label, 's1' AS metric, s1 AS v FROM sc UNION ALL SELECT label, 's2', s2 FROM sc)
 SELECT k.label, m.metric, {i('count(v)', 'n')}, {d('avg(v)', 'mean')}, {d('median(v)', 'median')}, {d('stddev_samp(v)', 'std')} FROM k CROSS JOIN (SELECT unnest(['s1', 's2']) AS metric) m LEFT JOIN l ON l.label = k.label AND l.metric = m.metric GROUP BY 1, 2""")
def e27(spark, sf):
    classes = spark.createDataFrame([(c, m) for c in ("clean", "high_RNA_singlet", "homotypic_doublet", "heterotypic_doublet", "unseen") for m in ("s1", "s2")], "label string, metric string")
    long = t.demo_scores(spark, sf).unpivot(["label"], ["s1", "s2"], "metric", "v")
    stats = long.groupBy("label", "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.stddev_samp("v").alias("std"))
    return classes.join(stats, ["label", "metric"], "left").fillna(0, ["n"])


@query("e28_candidate_summary", f"""{with_('rs')}, c AS (SELECT CASE WHEN coalesce(c, 0) < 0.5 THEN 'non_candidate' WHEN q >= 0.6 THEN 'homotypic_like' WHEN q <= 0.4 THEN 'heterotypic_like' ELSE 'subtype_ambiguous' END AS class FROM
 (SELECT c, CASE WHEN coalesce(a, 0) + coalesce(b, 0) > 0 THEN coalesce(a, 0) / (coalesce(a, 0) + coalesce(b, 0)) ELSE 0.5 END AS q FROM rs)), k AS (SELECT unnest(['non_candidate', 'homotypic_like', 'heterotypic_like', 'subtype_ambiguous', 'withheld']) AS class)
 SELECT k.class, {i('count(c.class)', 'n')}, {d('100.0 * count(c.class) / (SELECT greatest(count(*), 1) FROM c)', 'percent')} FROM k LEFT JOIN c USING (class) GROUP BY 1""")
def e28(spark, sf):
    """Counts and percents of every class, 0 for classes without cells."""
    s = t.rough_scores(spark, sf)
    hom, het = scalars.known_or_zero(F.col("a")), scalars.known_or_zero(F.col("b"))
    named = s.select(scalars.candidate_class(F.coalesce(F.col("c") >= 0.5, F.lit(False)), hom, het).alias("class")).replace({"not_candidate": "non_candidate"})
    return audits.class_summary(named, "class", ["non_candidate", "homotypic_like", "heterotypic_like", "subtype_ambiguous", "withheld"])


@query("e29_display_budget", f"{with_('sc')} SELECT cluster, {i('least(greatest(floor(0.08 * count(*) + 0.5), 0), count(*))', 'budget')} FROM sc GROUP BY 1")
def e29(spark, sf):
    n = F.count("*")
    return t.demo_scores(spark, sf).groupBy("cluster").agg(F.least(F.greatest(F.floor(0.08 * n + 0.5), F.lit(0)), n).alias("budget"))


@query("e30_permutation_summary", f"""WITH n AS (SELECT event_type AS metric, value, user_id % 5 = 0 AS broken FROM events), o AS (SELECT metric, CASE metric WHEN 'click' THEN max(value) + 1 WHEN 'view' THEN median(value) ELSE min(value) - 1 END AS v, CASE metric WHEN 'click' THEN 'higher' WHEN 'view' THEN 'higher' ELSE 'lower' END AS direction FROM n GROUP BY 1),
 s AS (SELECT metric, direction, any_value(v) AS observed, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high,
 (1 + count(*) FILTER (CASE direction WHEN 'higher' THEN value >= v ELSE value <= v END)) / (1.0 + count(value)) AS p, 100.0 * count(*) FILTER (value <= v) / count(value) AS percentile FROM n JOIN o USING (metric) GROUP BY 1, 2)
 SELECT metric, direction, {d('observed')}, {i('n')}, {d('mean', 'null_mean')}, {d('std', 'null_std')}, {d('median', 'null_median')}, {d('low', 'null_025')}, {d('high', 'null_975')}, {d('p')}, {d('percentile')},
 CASE WHEN n < 20 THEN 'INCONCLUSIVE' WHEN p <= 0.05 AND (observed > mean) = (direction = 'higher') AND observed <> mean THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS evidence FROM s""")
def e30(spark, sf):
    null = t.table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value")
    m = F.col("metric")
    observed = null.groupBy("metric").agg(F.max("value").alias("x"), F.expr("percentile(value, 0.5)").alias("y"), F.min("value").alias("z")).select(
        "metric", F.when(m == "click", F.col("x") + 1).when(m == "view", F.col("y")).otherwise(F.col("z") - 1).alias("observed"), F.when(m.isin("click", "view"), "higher").otherwise("lower").alias("direction"))
    return metrics.permutation_summary(null, observed)


@query("e31_cluster_balance", f"{with_('sc')} SELECT cluster, {i('sum(positive)', 'cases')}, {i('sum(hard)', 'controls')}, {d('sum(positive) / sum(sum(positive)) OVER () - sum(hard) / sum(sum(hard)) OVER ()', 'imbalance')} FROM sc GROUP BY 1")
def e31(spark, sf):
    g = t.demo_scores(spark, sf).groupBy("cluster").agg(F.sum("positive").alias("cases"), F.sum("hard").alias("controls"))
    w = W.partitionBy()
    return g.withColumn("imbalance", F.col("cases") / F.sum("cases").over(w) - F.col("controls") / F.sum("controls").over(w))


CV = """v AS (SELECT key % 3 AS fold, CASE WHEN label IN ('homotypic_doublet', 'heterotypic_doublet') THEN 1 ELSE 0 END AS y, least(greatest(coalesce(a, 0), 0), 1) AS p FROM rs),
 w AS (SELECT fold, y, p FROM v UNION ALL SELECT -1, y, p FROM v),
 c AS (SELECT fold, count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn FROM w GROUP BY 1),
 u AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2.0 AS r FROM w), a AS (SELECT fold, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS auroc FROM u GROUP BY 1),
 s AS (SELECT fold, p, sum(y) AS t, count(*) AS n FROM w GROUP BY 1, 2), x AS (SELECT fold, t, sum(t) OVER z AS tp, sum(n) OVER z AS n, sum(t) OVER (PARTITION BY fold) AS al FROM s WINDOW z AS (PARTITION BY fold ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), e AS (SELECT fold, sum(t * tp / n) / any_value(al) AS auprc FROM x GROUP BY 1),
 f AS (SELECT fold, tp, fp, fn, tn, auroc, auprc, (tp + fn) / (tp + fp + fn + tn) AS prevalence FROM c JOIN a USING (fold) JOIN e USING (fold))"""


@query("e32_fold_metrics", f"""{with_('rs')}, {CV} SELECT {i('fold')}, {d('auroc')}, {d('auprc')}, {d('prevalence')}, {d('(tp / (tp + fn) + tn / (tn + fp)) / 2', 'balanced_accuracy')},
 {d('CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END', 'mcc')} FROM f""")
def e32(spark, sf):
    """Per fold, and pooled as fold -1."""
    return metrics.fold_metrics(cv_predictions(spark, sf), "fold", "p", "y")


@query("e32_fold_summary", f"""{with_('rs')}, {CV}, k AS (SELECT * FROM f WHERE fold >= 0) SELECT {i('count(*)', 'folds')}, {d('avg(auroc)', 'auroc_mean')}, {d('stddev_pop(auroc)', 'auroc_std')}, {d('CASE WHEN max(prevalence) - min(prevalence) <= 0.1 THEN avg(auprc) END', 'auprc_mean')},
 {d('CASE WHEN max(prevalence) - min(prevalence) <= 0.1 THEN stddev_pop(auprc) END', 'auprc_std')}, {d('(SELECT auroc FROM f WHERE fold = -1)', 'pooled_auroc')}, {d('(SELECT auprc FROM f WHERE fold = -1)', 'pooled_auprc')} FROM k""")
def e32s(spark, sf):
    return metrics.fold_summary(metrics.fold_metrics(cv_predictions(spark, sf), "fold", "p", "y"), "fold")


def cv_predictions(spark, sf):
    s = t.rough_scores(spark, sf)
    return s.select((F.col("key") % 3).alias("fold"), F.when(F.col("label").isin(*scalars.CLASSES[2:]), 1).otherwise(0).alias("y"), scalars.clip(scalars.known_or_zero(F.col("a")), 0.0, 1.0).alias("p"))


GRID = """g AS (SELECT CAST(c_custkey AS VARCHAR) AS dataset, m.method FROM customer, (SELECT DISTINCT event_type AS method FROM events UNION ALL SELECT 'never') m),
 runs AS (SELECT CAST(user_id AS VARCHAR) AS dataset, event_type AS method, CASE WHEN value > 1 THEN 'SUCCESS' ELSE 'FAILED' END AS status FROM events)"""


@query("e34_e35_status_grid", f"""WITH {GRID} SELECT g.dataset, g.method, {i('count(status)', 'n')}, CASE count(status) WHEN 0 THEN 'NOT_RUN' WHEN 1 THEN CASE WHEN min(status) = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAILED' END ELSE 'INCOMPLETE' END AS status FROM g LEFT JOIN runs ON g.dataset = runs.dataset AND g.method = runs.method GROUP BY 1, 2""")
def e34(spark, sf):
    """All events as runs of their user and type, over the grid of all customers and types, one of which never ran."""
    e = t.table(spark, sf, "events")
    methods = e.select(F.col("event_type").alias("method")).distinct().union(spark.createDataFrame([("never",)], "method string"))
    runs = e.select(F.col("user_id").cast("string").alias("dataset"), F.col("event_type").alias("method"), F.when(F.col("value") > 1, "SUCCESS").otherwise("FAILED").alias("status"))
    return audits.status_grid([t.customer_cells(spark, sf).select(F.col("cell").alias("dataset")), methods], runs, ["dataset", "method"], "status")


@query("e33_runtime_completeness", f"""WITH m AS (SELECT unnest(['click', 'view', 'purchase', 'solo']) AS method), s AS (SELECT event_type AS method, count(*) AS n, max(CASE WHEN value > 1 THEN 2 ELSE 1 END) AS p FROM events GROUP BY 1)
 SELECT m.method, {i('coalesce(n, 0)', 'n')}, CASE coalesce(p, 0) WHEN 2 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE 'OMITTED' END AS status, CASE WHEN p IS NULL THEN 'no runtime row' ELSE '' END AS reason FROM m LEFT JOIN s USING (method)""")
def e33(spark, sf):
    m = spark.createDataFrame([(x,) for x in ("click", "view", "purchase", "solo")], "method string")
    s = t.table(spark, sf, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.max(F.when(F.col("value") > 1, 2).otherwise(1)).alias("p"))
    j = m.join(s, "method", "left")
    return j.select("method", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("p") == 2, "SUCCESS").when(F.col("p") == 1, "FAILED").otherwise("OMITTED").alias("status"), F.when(F.col("p").isNull(), "no runtime row").otherwise("").alias("reason"))


PAIRS = "pr AS (SELECT CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, l_returnflag AS s, least(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS x, greatest(CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS y FROM lineitem)"


@query("e36_pair_duplicates", f"""WITH {PAIRS}, ids AS (SELECT CAST(l_orderkey AS VARCHAR) || ':' || l_linenumber AS id, CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b, l_returnflag AS s, l_quantity || '/' || l_extendedprice AS profile FROM lineitem),
 c AS (SELECT count(*) AS n, count(DISTINCT a) AS ways, count(DISTINCT s) AS splits FROM pr GROUP BY x, y), e AS (SELECT count(*) AS n FROM pr GROUP BY a, b), p AS (SELECT count(DISTINCT s) AS n FROM (SELECT a, s FROM pr UNION ALL SELECT b, s FROM pr) GROUP BY a),
 g AS (SELECT count(*) AS n FROM ids GROUP BY id, a, b, s, profile), h AS (SELECT count(*) AS n FROM ids GROUP BY id), o AS (SELECT count(*) AS n FROM ids GROUP BY profile)
 SELECT {i('(SELECT sum(n - 1) FROM e)', 'ordered_repeats')}, {i('coalesce(sum(n - 1) FILTER (ways > 1), 0)', 'reversed_equivalent')}, {i('sum(n - 1)', 'canonical_repeats')}, {i('(SELECT sum(n - 1) FROM g)', 'row_repeats')}, {i('(SELECT sum(n - 1) FROM h)', 'id_repeats')},
 {i('(SELECT sum(n - 1) FROM o)', 'profile_repeats')}, {i('count(*) FILTER (splits > 1)', 'pairs_across')}, {i('(SELECT count(*) FILTER (n > 1) FROM p)', 'parents_across')} FROM c""")
def e36(spark, sf):
    lines = t.table(spark, sf, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), "l_partkey", "l_suppkey", "l_returnflag", F.struct("l_quantity", "l_extendedprice").alias("profile"))
    return audits.pair_duplicates(lines, "l_partkey", "l_suppkey", "l_returnflag", "id", "profile")


@query("e37_duplicate_profiles", f"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS gene FROM documents), c AS (SELECT CAST(doc_id AS VARCHAR) AS cell, gene, count(*) AS n FROM k GROUP BY 1, 2),
 p AS (SELECT cell, sha256(string_agg(gene || ':' || n, ',' ORDER BY gene)) AS profile FROM c GROUP BY 1) SELECT profile, {i('count(*)', 'cells')}, min(cell) AS first_cell FROM p GROUP BY 1 HAVING count(*) > 1""")
def e37(spark, sf):
    return audits.duplicate_profiles(t.token_counts(spark, sf, dealt=True))


@query("e38_largest_difference", f"""{with_('sc')} SELECT m AS "column", {d('max(g)', 'largest')}, {d('avg(g)', 'mean')}, {i('count(*) FILTER (g >= 1e-6)', 'beyond')}, 0::BIGINT AS unmatched FROM (SELECT 's1' AS m, abs(s1 - s2) AS g FROM sc UNION ALL SELECT 's2', abs(s2 - s3) FROM sc) GROUP BY 1""")
def e38(spark, sf):
    s = t.demo_scores(spark, sf)
    return audits.largest_difference(s.select("cell", "s1", "s2"), s.select("cell", F.col("s2").alias("s1"), F.col("s3").alias("s2")), "cell", ["s1", "s2"])


@query("e39_equal_columns", f"""{with_('rs')}, x AS (SELECT a, a AS copy, c, CASE WHEN key % 2 = 0 THEN a END AS half FROM rs), p AS (SELECT 'a' AS a, 'copy' AS b, max(CASE WHEN (a IS NULL) <> (copy IS NULL) THEN 1 WHEN a IS NULL THEN 0 ELSE abs(a - copy) END) AS m FROM x
 UNION ALL SELECT 'a', 'c', max(CASE WHEN (a IS NULL) <> (c IS NULL) THEN 1 WHEN a IS NULL THEN 0 ELSE abs(a - c) END) FROM x UNION ALL SELECT 'a', 'half', max(CASE WHEN (a IS NULL) <> (half IS NULL) THEN 1 WHEN a IS NULL THEN 0 ELSE abs(a - half) END) FROM x
 UNION ALL SELECT 'copy', 'c', max(CASE WHEN (copy IS NULL) <> (c IS NULL) THEN 1 WHEN c IS NULL THEN 0 ELSE abs(c - copy) END) FROM x UNION ALL SELECT 'copy', 'half', max(CASE WHEN (copy IS NULL) <> (half IS NULL) THEN 1 WHEN half IS NULL THEN 0 ELSE abs(half - copy) END) FROM x
 UNION ALL SELECT 'c', 'half', max(CASE WHEN (c IS NULL) <> (half IS NULL) THEN 1 WHEN half IS NULL THEN 0 ELSE abs(half - c) END) FROM x) SELECT a, b, m <= 1e-12 AS equal FROM p""")
def e39(spark, sf):
    s = t.rough_scores(spark, sf).withColumn("copy", F.col("a")).withColumn("half", F.when(F.col("key") % 2 == 0, F.col("a")))
    return audits.equal_columns(s, ["a", "copy", "c", "half"])


@query("e40_probability_contract", f"""{with_('rs')}, p AS (SELECT cell, a AS clean, b AS high, c AS hom, 1 - coalesce(a, 0) - coalesce(b, 0) - c AS het FROM rs), f AS (SELECT *, greatest(-clean, clean - 1, -high, high - 1, -hom, hom - 1, -het, het - 1, 0) AS o, abs(coalesce(clean, 0) + coalesce(high, 0) + hom + het - 1) AS t FROM p),
 r AS (SELECT 'finite_values' AS "check", count(*) FILTER (clean IS NULL OR high IS NULL OR hom IS NULL OR het IS NULL) AS failed, 0.0 AS worst FROM f UNION ALL SELECT 'bounds', count(*) FILTER (o > 1e-6), max(o) FROM f UNION ALL SELECT 'row_sum', count(*) FILTER (t > 1e-6), max(t) FROM f
 UNION ALL SELECT 'conditional_sum', count(*) FILTER (hom + het > 1e-6 AND abs(hom / (hom + het) + het / (hom + het) - 1) > 1e-6), coalesce(max(CASE WHEN hom + het > 1e-6 THEN abs(hom / (hom + het) + het / (hom + het) - 1) END), 0) FROM f UNION ALL SELECT 'unique_cells', count(*) - count(DISTINCT cell), 0 FROM f)
 SELECT "check", {i('failed')}, {d('worst')}, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM r""")
def e40(spark, sf):
    s = t.rough_scores(spark, sf)
    zero = scalars.known_or_zero
    p = s.select("cell", F.col("a").alias("clean"), F.col("b").alias("high"), F.col("c").alias("hom"), (1 - zero(F.col("a")) - zero(F.col("b")) - F.col("c")).alias("het"))
    return audits.probability_contract(p, "cell", ["clean", "high", "hom", "het"])


@query("e41_direction_consistency", f"{with_('sc')}, m AS (SELECT cluster, avg(s1) FILTER (positive = 1) - avg(s1) FILTER (positive = 0) AS g FROM sc GROUP BY 1) SELECT {i('count(*) FILTER (g > 0)', 'up')}, {i('count(*) FILTER (g < 0)', 'down')}, {d('greatest(count(*) FILTER (g > 0), count(*) FILTER (g < 0)) / count(*)', 'consistency')} FROM m")
def e41(spark, sf):
    p = F.col("positive")
    g = t.demo_scores(spark, sf).groupBy("cluster").agg((F.avg(F.when(p == 1, F.col("s1"))) - F.avg(F.when(p == 0, F.col("s1")))).alias("g"))
    out = g.agg(F.count_if(F.expr("g > 0")).alias("up"), F.count_if(F.expr("g < 0")).alias("down"), F.count("*").alias("n"))
    return out.select("up", "down", (F.greatest("up", "down") / F.col("n")).alias("consistency"))


@query("e42_status_tally", f"SELECT o_orderstatus AS status, {i('count(*)', 'n')} FROM orders GROUP BY 1")
def e42(spark, sf):
    return t.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("l1_split_contract", f"""WITH k AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1) SELECT l_returnflag AS split, {i('count(*)', 'rows')}, {i('count(DISTINCT l_partkey)', 'ids')}, {i('count(DISTINCT l_partkey) FILTER (k > 1)', 'shared')} FROM lineitem JOIN k USING (l_partkey) GROUP BY 1""")
def l1(spark, sf):
    return audits.split_contract(t.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("split")), "id", "split")


@query("l8_fingerprints", f"""{with_('cells')} SELECT cluster, {i('count(*)', 'n')}, sha256(string_agg(cell, chr(10) ORDER BY cell)) AS fingerprint FROM cells GROUP BY 1""")
def l8(spark, sf):
    return audits.id_fingerprint(t.customer_cells(spark, sf), "cell", ["cluster"])


@query("b6_last_ledger_row", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def b6(spark, sf):
    return audits.last_terminal(t.table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("o1_one_to_one_check", f"""{with_('cells')}, a AS (SELECT cluster, library, count(*) AS n FROM cells GROUP BY 1, 2), o AS (SELECT c_mktsegment AS cluster, r_name AS library, count(DISTINCT c_custkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
 SELECT {i('count(*) FILTER (a.n IS NOT NULL AND o.n IS NOT NULL)', 'matched')}, {i('count(*) FILTER (a.n IS NULL OR o.n IS NULL)', 'unmatched')}, 0::BIGINT AS repeated_left, 0::BIGINT AS repeated_right, {d('max(abs(a.n - o.n))', 'largest')}, coalesce(max(abs(a.n - o.n)) <= 1e-12, false) AS same FROM a FULL JOIN o USING (cluster, library)""")
def o1(spark, sf):
    """Cells per cluster and library: all of them against those with orders."""
    cells = t.customer_cells(spark, sf)
    bought = t.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("cell"))
    count = lambda df: df.groupBy("cluster", "library").agg(F.count("*").alias("n"))
    return audits.one_to_one(count(cells), count(cells.join(bought, "cell", "left_semi")), ["cluster", "library"], "n")


@query("o11_replication", f"{with_('sc')} SELECT CASE WHEN k = 0 THEN cell ELSE cell || '__train_aug' || k END AS cell, label FROM sc, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR positive = 1")
def o11(spark, sf):
    s = t.demo_scores(spark, sf)
    copies = s.withColumn("k", F.explode(F.when(F.col("positive") == 1, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))))
    return copies.select(F.when(F.col("k") == 0, F.col("cell")).otherwise(F.concat("cell", F.lit("__train_aug"), F.col("k").cast("string"))).alias("cell"), "label")


@query("o12_training_summary", f"{with_('sc')} SELECT label, {i('count(*)', 'n')}, {d('count(*) / sum(count(*)) OVER ()', 'prevalence')} FROM sc GROUP BY 1")
def o12(spark, sf):
    n = t.demo_scores(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("prevalence", F.col("n") / F.sum("n").over(W.partitionBy()))


@query("o13_log_loss", f"{with_('sc')} SELECT {d('-avg(ln(least(greatest(CASE WHEN positive = 1 THEN s1 ELSE 1 - s1 END, 1e-15), 1 - 1e-15)))', 'log_loss')} FROM sc")
def o13(spark, sf):
    p = F.when(F.col("positive") == 1, F.col("s1")).otherwise(1 - F.col("s1"))
    return t.demo_scores(spark, sf).agg((-F.avg(F.log(F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))))).alias("log_loss"))


@query("o36_audit_roll_up", f"""{with_('rs')}, r AS (SELECT cell, b, CASE key % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'insufficient_parent_disjoint_data' WHEN 2 THEN 'odd' ELSE '' END AS source, CASE key % 5 WHEN 0 THEN 'Pass' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'skipped_insufficient_data' ELSE '' END AS status,
  CASE key % 3 WHEN 0 THEN 'Input not found' WHEN 1 THEN 'transformer differs' ELSE 'other' END AS message FROM rs),
 x AS (SELECT *, CASE WHEN upper(status) IN ('PASS', 'COMPLETED') THEN 'COMPLETED' WHEN upper(status) = 'SKIPPED_INSUFFICIENT_DATA' THEN 'SKIPPED_INSUFFICIENT_DATA' WHEN upper(source) = 'INSUFFICIENT_PARENT_DISJOINT_DATA' THEN 'INSUFFICIENT_PARENT_DISJOINT_DATA' WHEN lower(message) LIKE '%transformer%' THEN 'PROVENANCE_ERROR'
  WHEN upper(source) = 'FAILED' AND lower(message) LIKE '%input%' THEN 'INPUT_ERROR' WHEN upper(source) NOT IN ('', 'FAILED', 'INSUFFICIENT_PARENT_DISJOINT_DATA') THEN 'CONTRACT_ERROR' ELSE 'ANALYSIS_ERROR' END AS state FROM r),
 y AS (SELECT cell, state, CASE WHEN state = 'COMPLETED' THEN greatest(b, 1 - b) END AS s FROM x)
 SELECT cell, state, {d('s', 'separability')}, CASE WHEN s IS NULL THEN 'not available' WHEN s <= 0.55 THEN 'little detectable separation' WHEN s <= 0.65 THEN 'weak separation' WHEN s <= 0.75 THEN 'moderate separation' ELSE 'substantial separation' END AS category FROM y""")
def o36(spark, sf):
    """Audits by state: their area counts, whichever its direction, only where they completed."""
    k = F.col("key")
    s = t.rough_scores(spark, sf).withColumns({
        "source": F.when(k % 4 == 0, "FAILED").when(k % 4 == 1, "insufficient_parent_disjoint_data").when(k % 4 == 2, "odd").otherwise(""),
        "status": F.when(k % 5 == 0, "Pass").when(k % 5 == 1, "COMPLETED").when(k % 5 == 2, "skipped_insufficient_data").otherwise(""),
        "message": F.when(k % 3 == 0, "Input not found").when(k % 3 == 1, "transformer differs").otherwise("other")})
    state = contracts.audit_state(F.col("source"), F.col("status"), F.col("message"))
    area = scalars.finite(F.col("b"))
    s = s.withColumn("state", state).withColumn("separability", F.when(F.col("state") == "COMPLETED", F.greatest(area, 1 - area)))
    return s.select("cell", "state", "separability", scalars.separation(F.col("separability")).alias("category"))


@query("o41_group_key", "SELECT event_id, coalesce(NULLIF(event_type, 'view'), '__all__') AS library FROM events")
def o41(spark, sf):
    return t.table(spark, sf, "events").select("event_id", F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("__all__")).alias("library"))

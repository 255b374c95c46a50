"""Queries of composed evidence, propensity, training rows and small contracts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.operators import evidence, governance
from countloom.plans.core import CLIP, rank_sql
from countloom.plans.registry import d, query, with_
from countloom.sources import tables as t

GATE = "(1 / (1 + exp(-least(greatest((({0}) - {1}) / {2}, -60.0), 60.0))))"
Z = {"count_z": "3 * s1 - 1", "gene_z": "3 * s2 - 1", "stable_z": "3 * s3 - 1", "marker_z": "2 * s1 + s2 - 1"}


def _inputs(spark, sf):
    s1, s2, s3 = (F.col(c) for c in ("s1", "s2", "s3"))
    return t.demo_scores(spark, sf).select(
        "cell", (3 * s1 - 1).alias("count_z"), (3 * s2 - 1).alias("gene_z"), (3 * s3 - 1).alias("stable_z"), (2 * s1 + s2 - 1).alias("marker_z"),
        (2 * s3 - 1).alias("distance_z"), s2.alias("consistency"), s1.alias("hom"), s3.alias("het"), s2.alias("count_rank"))


def _evidence_sql() -> str:
    names = list(Z)
    base = ", ".join(f"greatest({z}, 0.0) AS {n}" for n, z in Z.items())
    ranks = ", ".join(f"{rank_sql(n, 'a')} AS r_{n}" for n in names)
    gates = ", ".join(f"{GATE.format(n, *evidence.GATES[n][:2])} AS g_{n}" for n in names)
    rs, gs = ", ".join(f"r_{n}" for n in names), ", ".join(f"g_{n}" for n in names)
    mean = "(" + " + ".join(f"r_{n}" for n in names) + ") / 4"
    spread = "sqrt((" + " + ".join(f"(r_{n} - m) * (r_{n} - m)" for n in names) + ") / 4)"
    dosage = " + ".join(f"{evidence.GATES[n][2]} * g_{n}" for n in names)
    return f"""{with_('sc')}, a AS (SELECT cell, {base}, 2 * s3 - 1 AS distance_z, s2 AS consistency, s1 AS hom, s3 AS het, s2 AS count_rank, greatest(s3 - s1, 0.0) AS margin FROM sc),
 b AS (SELECT *, {ranks}, {gates}, {rank_sql('hom', 'a')} AS rk_hom, {rank_sql('het', 'a')} AS rk_het, {rank_sql('margin', 'a')} AS rk_margin FROM a),
 c AS (SELECT *, {mean} AS m FROM b), e AS (SELECT *, greatest({rs}) - least({rs}) AS spread, {CLIP.format('1 - 2.5 * ' + spread)} AS balance FROM c),
 f AS (SELECT *, {CLIP.format(dosage)} AS dosage_outlier, sqrt({CLIP.format(f'least({gs}) * balance')}) AS uniform_dosage, {GATE.format('-distance_z', '(-1.25)', '0.75')} AS centroid_inlier, {CLIP.format('consistency')} AS neighbour_consistency, sqrt({CLIP.format(GATE.format('-distance_z', '(-1.25)', '0.75') + ' * (0.25 + 0.75 * ' + CLIP.format('consistency') + ')')}) AS inlier FROM e),
 g AS (SELECT *, greatest({CLIP.format(f"greatest({rs}, {gs}) * " + CLIP.format('0.65 * spread + 0.35 * (1 - balance)') + ' * ' + GATE.format('dosage_outlier', '0.45', '0.2'))}, {CLIP.format('count_rank * inlier * (1 - uniform_dosage) * (1 - 0.65 * dosage_outlier)')}) AS program,
  {CLIP.format('0.55 * rk_het + 0.35 * rk_margin + 0.1 * (1 - inlier)')} AS mixture, sqrt({CLIP.format(CLIP.format('0.55 * dosage_outlier + 0.25 * rk_hom + 0.2 * inlier') + ' * (0.1 + 0.9 * dosage_outlier) * (0.35 + 0.65 * inlier)')}) AS candidate FROM f)
 SELECT cell, {d(Z['marker_z'], 'marker_z')}, {d('centroid_inlier')}, {d('neighbour_consistency')}, {d('m', 'rank_mean')}, {d('spread', 'rank_spread')}, {d('dosage_outlier')}, {d('uniform_dosage')}, {d('inlier')}, {d('program')}, {d('mixture')}, {d('candidate')}, {d(CLIP.format('candidate * (0.35 + 0.65 * uniform_dosage) * (1 - 0.55 * program) * (1 - 0.35 * mixture)'), 'final')} FROM g JOIN sc USING (cell)"""


@query("c16_homotypic_evidence", _evidence_sql())
def c16(spark, sf):
    """The twelve outputs: marker_z is passed on."""
    return evidence.homotypic_evidence(_inputs(spark, sf)).select("cell", "marker_z", *evidence.OUTPUTS)


@query("e8_propensity", f"""{with_('sc', 'cells')}, x AS (SELECT sc.cell, sc.cluster, library, s1 FROM sc JOIN cells USING (cell)), b AS (SELECT library, CASE WHEN count(*) >= 10 THEN quantile_cont(s1, 0.9) ELSE max(s1) END AS b, count(*) AS n FROM x GROUP BY 1),
 p AS (SELECT library, cluster, count(*) / any_value(n) AS abundance, avg(CASE WHEN s1 >= b THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM x JOIN b USING (library) GROUP BY 1, 2), q AS (SELECT *, (rate + 1e-3) / (abundance + 1e-6) AS q FROM p),
 r AS (SELECT *, q / sum(q * abundance) OVER (PARTITION BY library) AS propensity FROM q)
 SELECT library, cluster, {d('abundance')}, {d('propensity')}, {d('0.06 * power(abundance * propensity, 2) / sum(power(abundance * propensity, 2)) OVER (PARTITION BY library)', 'expected_share')} FROM r""")
def e8(spark, sf):
    s = t.demo_scores(spark, sf).drop("cluster").join(t.customer_cells(spark, sf), "cell")
    return evidence.propensity(s, "s1")


@query("j15_training_rows", f"""{with_('sc')}, r AS (SELECT cell, round(({rank_sql('s1', 'sc', '', 0.0)} + {rank_sql('s2', 'sc', '', 0.0)} + {rank_sql('s3', 'sc', '', 0.0)}) / 3, 12) AS risk FROM sc) SELECT cell, {d('risk')}, risk <= (SELECT quantile_cont(risk, 0.3) FROM r) AS clean FROM r""")
def j15(spark, sf):
    return evidence.reliable_negatives(t.demo_scores(spark, sf), ["s1", "s2", "s3"]).select("cell", "risk", "clean")


@query("g5_set_operations", "SELECT 'both' AS part, count(*)::BIGINT AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'only_customers', count(*)::BIGINT FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def g5(spark, sf):
    c, o = t.table(spark, sf, "customer").select("c_custkey"), t.table(spark, sf, "orders").select("o_custkey")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(c.intersect(o), "both").union(count(c.subtract(o), "only_customers"))


@query("a13_align_labels", "SELECT d.doc_id, CAST(l.toxic AS BIGINT) AS label, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def a13(spark, sf):
    labels = t.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"), F.lit(True).alias("labelled"))
    return t.table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").fillna({"labelled": False})


@query("a16_cache_validation", """WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents), l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p, quality FROM labels)
 SELECT count(*) FILTER (d.doc_id IS NULL)::BIGINT AS unknown, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS missing, count(*) FILTER (d.doc_id = l.doc_id)::BIGINT AS matched, count(*) FILTER (d.p <> l.p)::BIGINT AS out_of_order, count(*) FILTER (d.doc_id = l.doc_id AND quality IS DISTINCT FROM 1)::BIGINT AS other_label FROM d FULL JOIN l USING (doc_id)""")
def a16(spark, sf):
    """Cached labels against the documents: ids on either side only, ids in both, those at another place, and those whose label is not the wanted one."""
    place = F.row_number().over(W.orderBy("doc_id"))
    docs = t.table(spark, sf, "documents").select("doc_id", place.alias("p"), F.lit(1).alias("wanted"))
    both = docs.join(t.table(spark, sf, "labels").select("doc_id", place.alias("q"), F.col("quality").alias("found")), "doc_id", "full")
    known = F.col("p").isNotNull() & F.col("q").isNotNull()
    return both.agg(
        F.count_if(F.col("p").isNull()).alias("unknown"), F.count_if(F.col("q").isNull()).alias("missing"), F.count_if(known).alias("matched"), F.count_if(F.col("p") != F.col("q")).alias("out_of_order"),
        F.count_if(known & ~F.col("wanted").eqNullSafe(F.col("found"))).alias("other_label"))


@query("c21_renamed_columns", f"{with_('sc')} SELECT cell, {d('s1', 'dosage_score')}, {d('s2', 'identity_score')} FROM sc")
def c21(spark, sf):
    old = t.demo_scores(spark, sf).select("cell", F.col("s1").alias("old_dosage"), F.col("s1").alias("dosage_score"), F.col("s2").alias("old_identity"))
    return governance.renamed(old, {"old_dosage": "dosage_score", "old_identity": "identity_score"})


@query("o9_high_count_from_training", f"{with_('base')}, tr AS (SELECT * FROM base WHERE CAST(cell AS BIGINT) % 2 = 0 AND cluster <> 'MACHINERY'), q AS (SELECT cluster, quantile_cont(log_count, 0.9) AS q FROM tr GROUP BY 1) SELECT cell, log_count >= coalesce(q, (SELECT quantile_cont(log_count, 0.9) FROM tr)) AS high FROM base LEFT JOIN q USING (cluster)")
def o9(spark, sf):
    base = t.customer_base(spark, sf)
    train = base.filter("cast(cell AS bigint) % 2 = 0 AND cluster <> 'MACHINERY'")
    group = train.groupBy("cluster").agg(F.expr("percentile(log_count, 0.9)").alias("_q"))
    whole = train.agg(F.expr("percentile(log_count, 0.9)").alias("_w"))
    return base.join(group, "cluster", "left").crossJoin(F.broadcast(whole)).select("cell", (F.col("log_count") >= F.coalesce("_q", "_w")).alias("high"))


@query("o31_bundle_constraints", "SELECT count(*)::BIGINT AS rows, count(DISTINCT o_orderkey)::BIGINT AS ids, count(*) FILTER (c_custkey IS NULL)::BIGINT AS orphans FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def o31(spark, sf):
    o = t.table(spark, sf, "orders").join(t.table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.agg(F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("ids"), F.count_if(F.col("c_custkey").isNull()).alias("orphans"))

"""Queries over counts: totals, normalising, robust statistics, ranks, calibration."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from countloom.functions import ranks, robust, scalars
from countloom.operators import matrix
from countloom.plans.registry import d, i, query, with_
from countloom.sources import tables as t

SIG = "(1 / (1 + exp(-least(greatest({0}, -40.0), 40.0))))"
CLIP = "least(greatest({0}, 0.0), 1.0)"
R2 = "CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN std > 1e-12 THEN std ELSE 1 END"
R1 = "CASE WHEN 1.4826 * mad > 1e-12 THEN 1.4826 * mad WHEN q75 > q25 THEN (q75 - q25) / 1.349 WHEN std > 1e-12 THEN std ELSE 1 END"
R3 = "CASE WHEN mad > 0 THEN 1.4826 * mad WHEN std > 0 THEN std ELSE 1 END"


def stats_sql(value: str, by: str, source: str = "base") -> str:
    key = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"(SELECT {key}count({value}) AS n, median({value}) AS med, mad({value}) AS mad, quantile_cont({value}, 0.25) AS q25, quantile_cont({value}, 0.75) AS q75, stddev_pop({value}) AS std FROM {source}{group})"


@query("m0_expected_rate_call", f"""{with_('base')}, z AS (SELECT b.cell, b.cluster, b.n_count, b.n_feature, (log_count - med) / ({R2}) AS z FROM base b JOIN {stats_sql('log_count', 'cluster')} s USING (cluster)),
 r AS (SELECT round(z, 9) AS z, row_number() OVER (ORDER BY round(z, 9)) AS p, count(*) OVER () AS n FROM z),
 th AS (SELECT z AS threshold FROM r WHERE p = floor((n - 1) * 0.92) + 1)
 SELECT cell, cluster, {d('n_count')}, {i('n_feature')}, {d('ln(1 + n_feature) - 0.5 * ln(1 + n_count)', 'balance')}, {d('z')}, round(z, 9) >= threshold AS called FROM z, th""")
def m0(spark, sf):
    """Counts, totals, robust z by cluster, and the call at an expected rate of 8 %."""
    z = robust.robust_z(t.customer_base(spark, sf), "log_count", ["cluster"], "z", "r2").withColumn("_z", F.round("z", 9))
    threshold = ranks.expected_rate_threshold(z, "_z", 0.08)
    return z.crossJoin(F.broadcast(threshold)).select(
        "cell", "cluster", "n_count", "n_feature", scalars.complexity_balance(F.col("n_feature"), F.col("n_count")).alias("balance"), "z", (F.col("_z") >= F.col("threshold")).alias("called"))


@query("c1_cell_totals", f"{with_('tot')} SELECT cell, {d('n_count')}, {i('n_feature')} FROM tot")
def c1(spark, sf):
    return matrix.cell_totals(t.purchase_counts(spark, sf))


@query("c1_gene_totals", f"{with_('cm1')} SELECT gene, {d('sum(count)', 'total')}, {i('count(*) FILTER (count > 0)', 'n_cells')} FROM cm1 GROUP BY gene")
def c1g(spark, sf):
    return matrix.gene_totals(t.purchase_counts(spark, sf))


@query("c2_log_totals", f"{with_('base')} SELECT cell, {d('log_count')}, {d('log_feature')} FROM base")
def c2(spark, sf):
    return t.customer_base(spark, sf).select("cell", "log_count", "log_feature")


@query("c3_complexity_balance", f"{with_('base')} SELECT cell, {d('log_feature - 0.5 * log_count', 'balance')} FROM base")
def c3(spark, sf):
    return t.customer_base(spark, sf).select("cell", scalars.complexity_balance(F.col("n_feature"), F.col("n_count")).alias("balance"))


@query("c4_safe_divide", f"{with_('sc')} SELECT cell, {d('CASE WHEN s2 <> 0 THEN s1 / s2 ELSE 0 END', 'ratio')} FROM sc")
def c4(spark, sf):
    return t.demo_scores(spark, sf).select("cell", scalars.safe_divide(F.col("s1"), F.col("s2")).alias("ratio"))


@query("c5_complexity_prefix", f"""{with_('cm1')} SELECT cell, {d("sum(CASE WHEN gene LIKE '1%' OR gene LIKE '20%' THEN count ELSE 0 END) / sum(count)", 'mito')}, {d('count(*) / sum(count)', 'complexity')} FROM cm1 GROUP BY cell""")
def c5(spark, sf):
    counts = t.purchase_counts(spark, sf)
    share = matrix.prefix_fraction(counts, ["1", "20"], "mito")
    totals = matrix.cell_totals(counts)
    return share.join(totals, "cell").select("cell", "mito", scalars.safe_divide(F.col("n_feature"), F.col("n_count")).alias("complexity"))


@query("c6_log_normalise", f"{with_('tot')} SELECT cell, gene, {d('ln(1 + count * 1e4 / n_count)', 'value')} FROM cm1 JOIN tot USING (cell)")
def c6(spark, sf):
    return matrix.log_normalised(t.purchase_counts(spark, sf))


@query("c7_sigmoids", f"{with_('sc')} SELECT cell, {d(SIG.format('(s1 * 100 - 50)'), 'a')}, {d('1 / (1 + exp(-least(greatest((s2 - 0.5) / 0.1, -60.0), 60.0)))', 'b')} FROM sc")
def c7(spark, sf):
    return t.demo_scores(spark, sf).select("cell", scalars.sigmoid(F.col("s1") * 100 - 50).alias("a"), scalars.centred_sigmoid(F.col("s2"), 0.5, 0.1).alias("b"))


@query("c8_c10_evidence", f"""{with_('sc')}, e AS (SELECT cell, {SIG.format('(0.75 * s1 + 0.25 * s2)')} AS dosage, {CLIP.format('0.55 * ' + SIG.format('s2') + ' + 0.45 * (1 - s3)')} AS identity, s3 FROM sc)
 SELECT cell, {d('dosage')}, {d('identity')}, {d('greatest(dosage, s3)', 'sensitive')}, {d('1 - (1 - dosage) * (1 - identity)', 'both')} FROM e""")
def c8(spark, sf):
    s = t.demo_scores(spark, sf).withColumns({"dosage": scalars.dosage(F.col("s1"), F.col("s2")), "identity": scalars.identity(F.col("s2"), F.col("s3"))})
    return s.select("cell", "dosage", "identity", F.greatest("dosage", "s3").alias("sensitive"), scalars.union(F.col("dosage"), F.col("identity")).alias("both"))


@query("c11_c12_output_frame", f"""{with_('sc')}, o AS (SELECT cell, {CLIP.format('s1 * 0.5 + s2 * 0.5')} AS overall, s1 * 0.5 AS hom, s2 * 0.5 AS het FROM sc)
 SELECT cell, {d('overall')}, overall >= 0.5 AS called, CASE WHEN overall >= 0.5 THEN CASE WHEN hom >= het THEN 'homotypic_doublet' ELSE 'heterotypic_doublet' END ELSE '' END AS subtype,
 round(CASE WHEN overall >= 0.5 THEN CASE WHEN hom + het > 0 THEN greatest(hom, het) / (hom + het) ELSE 0.5 END END, 6) + 0.0 AS confidence FROM o""")
def c11(spark, sf):
    hom, het = F.col("s1") * 0.5, F.col("s2") * 0.5
    s = t.demo_scores(spark, sf).withColumn("overall", scalars.overall(hom, het))
    called = scalars.call(F.col("overall"), 0.5)
    return s.select("cell", "overall", called.alias("called"), scalars.called_subtype(called, hom, het).alias("subtype"), scalars.subtype_confidence(called, hom, het).alias("confidence"))


@query("c13_candidate_class", f"""{with_('sc')} SELECT cell, CASE WHEN positive = 0 THEN 'not_candidate' WHEN q >= 0.6 THEN 'homotypic_like' WHEN q <= 0.4 THEN 'heterotypic_like' ELSE 'subtype_ambiguous' END AS class
 FROM (SELECT cell, positive, CASE WHEN s1 + s2 > 0 THEN s1 / (s1 + s2) ELSE 0.5 END AS q FROM sc)""")
def c13(spark, sf):
    return t.demo_scores(spark, sf).select("cell", scalars.candidate_class(F.col("positive") == 1, F.col("s1"), F.col("s2")).alias("class"))


@query("c15_five_way_label", f"""{with_('rs')}, v AS (SELECT cell, coalesce(c, 0) AS low, {CLIP.format('coalesce(a, 0)')} AS hom, {CLIP.format('coalesce(b, 0)')} AS het FROM rs)
 SELECT cell, CASE WHEN low >= 0.9 THEN 'low_quality' WHEN het >= 0.9 AND het > hom THEN 'heterotypic_doublet' WHEN hom >= 0.9 AND hom >= het THEN 'homotypic_doublet'
 WHEN hom >= 0.6 OR het >= 0.6 OR 1 - (1 - hom) * (1 - het) >= 0.6 THEN 'uncertain' ELSE 'clean' END AS label FROM v""")
def c15(spark, sf):
    return t.rough_scores(spark, sf).select("cell", scalars.five_way_label(F.col("c"), F.col("a"), F.col("b")).alias("label"))


@query("c18_gated_fusion", f"""{with_('rs')}, v AS (SELECT cell, coalesce(a, (SELECT median(a) FROM rs)) AS a, coalesce(b, (SELECT median(b) FROM rs)) AS b FROM rs),
 k AS (SELECT cell, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS i, (rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0) / count(*) OVER () AS o FROM v),
 g AS (SELECT cell, i, {CLIP.format('(o - 0.95) / (1 - 0.95)')} AS r FROM k) SELECT cell, {d('i + 0.25 * (1 - i) * r', 'gated_025')}, {d('i + 0.5 * (1 - i) * r', 'gated_050')},
 {d('greatest(i, 0.5 * r)', 'gated_max')}, {d('i + 0.5 * (1 - i) * CASE WHEN i > 0.75 THEN 0 ELSE r END', 'gated_inlier')} FROM g""")
def c18(spark, sf):
    ranked = ranks.percentile_rank(ranks.percentile_rank(t.rough_scores(spark, sf), "a", "i", constant=0.0), "b", "o", constant=0.0)
    return ranked.select("cell", *(c.alias(n) for n, c in scalars.gated_fusion(F.col("i"), F.col("o")).items()))


@query("c19_c20_residual_identity", f"{with_('sc')} SELECT cell, {d('0.5 * s1 + 0.3 * s2 + 0.2 * s3', 'residual')}, {d('0.45 * greatest(0, s1 - 0.5) + 0.35 * greatest(0, s2 - 0.5) + 0.2 / (1 + s3)', 'identity')} FROM sc")
def c19(spark, sf):
    a, b, c = F.col("s1"), F.col("s2"), F.col("s3")
    return t.demo_scores(spark, sf).select("cell", scalars.dosage_residual(a, b, c).alias("residual"), scalars.neighbour_identity(a - 0.5, b - 0.5, c).alias("identity"))


@query("c22_one_hot", f"""{with_('sc')} SELECT cell, CASE WHEN cluster = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS cluster_BUILDING, CASE WHEN cluster = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0 END AS cluster_MACHINERY,
 CASE WHEN cluster IN ('BUILDING', 'MACHINERY') THEN 0.0::DOUBLE ELSE 1 END AS cluster___unknown__ FROM sc""")
def c22(spark, sf):
    return t.demo_scores(spark, sf).select("cell", *(c.alias(n) for n, c in scalars.one_hot(F.col("cluster"), ["BUILDING", "MACHINERY"], "cluster").items()))


@query("c23_canonical_pairs", f"{with_('sc')} SELECT DISTINCT least(cell, cast(key % 50 AS VARCHAR)) AS a, greatest(cell, cast(key % 50 AS VARCHAR)) AS b FROM sc")
def c23(spark, sf):
    a, b = scalars.canonical_pair(F.col("cell"), (F.col("key") % 50).cast("string"))
    return t.demo_scores(spark, sf).select(a.alias("a"), b.alias("b")).distinct()


@query("c24_c25_weights", f"""{with_('sc')}, n AS (SELECT label, count(*) AS c FROM sc GROUP BY 1) SELECT cell, CASE WHEN label = 'high_RNA_singlet' THEN 2.0::DOUBLE ELSE 1 END AS weight,
 {d('(SELECT sum(c) FROM n) / ((SELECT count(*) FROM n) * c)', 'balanced')}, {d('least((SELECT sum(c) FROM n) / c, 20)', 'capped')} FROM sc JOIN n USING (label)""")
def c24(spark, sf):
    s = t.demo_scores(spark, sf)
    n = s.groupBy("label").agg(F.count("*").alias("c"))
    whole = n.agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    joined = s.join(n.crossJoin(F.broadcast(whole)), "label")
    return joined.select("cell", scalars.sample_weight(F.col("label")).alias("weight"), (F.col("n") / (F.col("k") * F.col("c"))).alias("balanced"), F.least(F.col("n") / F.col("c"), F.lit(20.0)).alias("capped"))


@query("c26_separation", f"""{with_('rs')} SELECT cell, CASE WHEN b IS NULL THEN 'not available' WHEN b <= 0.55 THEN 'little detectable separation' WHEN b <= 0.65 THEN 'weak separation' WHEN b <= 0.75 THEN 'moderate separation' ELSE 'substantial separation' END AS separation FROM rs""")
def c26(spark, sf):
    return t.rough_scores(spark, sf).select("cell", scalars.separation(F.col("b")).alias("separation"))


@query("c27_method_alias", """SELECT event_id, CASE lower(event_type) WHEN 'click' THEN 'select' WHEN 'view' THEN 'show' ELSE lower(event_type) END AS method FROM events""")
def c27(spark, sf):
    alias = spark.createDataFrame([("click", "select"), ("view", "show")], "name string, to string")
    e = t.table(spark, sf, "events").withColumn("name", F.lower("event_type"))
    return e.join(F.broadcast(alias), "name", "left").select("event_id", F.coalesce("to", "name").alias("method"))


@query("a4_unique_names", """SELECT p_partkey, CASE WHEN r = 1 THEN p_brand ELSE p_brand || '_' || (r - 1) END AS name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)""")
def a4(spark, sf):
    from countloom.sources.coo import unique_names

    return unique_names(t.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "name")


@query("a10_binary_labels", """SELECT event_id, CASE WHEN v IN ('1','true','t','yes','y','doublet','doublets','multiplet','multiplets') THEN 1 WHEN v IN ('0','false','f','no','n','singlet','singlets','cell','cells') THEN 0 END::BIGINT AS label
 FROM (SELECT event_id, lower(trim(CASE event_id % 5 WHEN 0 THEN 'Doublet' WHEN 1 THEN ' cell ' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'n' ELSE '0' END)) AS v FROM events)""")
def a10(spark, sf):
    from countloom.sources.coo import parse_labels

    k = F.col("event_id") % 5
    raw = F.when(k == 0, "Doublet").when(k == 1, " cell ").when(k == 2, "TRUE").when(k == 3, "n").otherwise("0")
    return parse_labels(t.table(spark, sf, "events").select("event_id", raw.alias("raw")), "raw", "label").select("event_id", "label")


@query("a12_join_key", """SELECT k, CAST(n AS BIGINT) AS n FROM (SELECT 'o_custkey' AS k, count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'o_orderkey', count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer))""")
def a12(spark, sf):
    from countloom.sources.coo import key_overlap

    return key_overlap(t.table(spark, sf, "orders"), ["o_custkey", "o_orderkey"], t.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query("a14_external_scores", f"""{with_('sc')}, e AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events)
 SELECT c.cell, m.event_type AS method, {d('e.value', 'score')} FROM sc c CROSS JOIN (SELECT DISTINCT event_type FROM events) m LEFT JOIN e ON e.user_id = c.key AND e.event_type = m.event_type AND e.r = 1""")
def a14(spark, sf):
    from countloom.sources.coo import aligned_scores

    e = t.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("cell"), F.col("event_type").alias("method"), F.col("value").alias("score"), "event_id")
    return aligned_scores(e, t.demo_scores(spark, sf).select("cell"), "event_id").select("cell", "method", "score")


# ---------------------------------------------------------------- filters and joins

@query("d1_quality_filter", f"""{with_('tot')}, m AS (SELECT cell, sum(CASE WHEN gene LIKE '1%' THEN count ELSE 0 END) / sum(count) AS mito FROM cm1 GROUP BY 1), g AS (SELECT least(200.0, ceil(0.1 * count(DISTINCT gene))) AS l FROM cm1),
 q AS (SELECT cell, greatest({CLIP.format('1 - n_count / 500.0')}, {CLIP.format('1 - n_feature / l')}, {CLIP.format('(mito - 0.3) / 0.7')}) AS low_quality, n_count >= 500 AND n_feature >= l AND mito <= 0.3 AS passes FROM tot JOIN m USING (cell), g)
 SELECT cell, {d('low_quality')}, passes FROM q WHERE passes OR (SELECT count(*) FILTER (passes) FROM q) < least(2, (SELECT count(*) FROM q))""")
def d1(spark, sf):
    counts = t.purchase_counts(spark, sf)
    totals = matrix.cell_totals(counts).join(matrix.prefix_fraction(counts, ["1"], "mito"), "cell")
    return matrix.passing_or_all(matrix.low_quality(totals, counts.agg(F.count_distinct("gene").alias("n"))))


@query("d3_non_zero", f"{with_('cm1')} SELECT cell, gene, {d('count')} FROM cm1 WHERE cell IN (SELECT cell FROM cm1 GROUP BY 1 HAVING sum(count) > 0) AND gene IN (SELECT gene FROM cm1 GROUP BY 1 HAVING sum(count) > 0)")
def d3(spark, sf):
    return matrix.non_zero(t.purchase_counts(spark, sf))


@query("d5_high_count_mask", f"{with_('base')} SELECT cell, cluster, log_count >= b AS high FROM base JOIN (SELECT cluster, quantile_cont(log_count, 0.9) AS b FROM base GROUP BY 1) USING (cluster)")
def d5(spark, sf):
    return matrix.high_count_mask(t.customer_base(spark, sf)).select("cell", "cluster", "high")


@query("d9_gene_alignment", f"{with_('cm1')} SELECT cell, gene, {d('count')} FROM cm1 WHERE gene IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_size < 0) OR gene IN (SELECT gene FROM cm1 GROUP BY 1 HAVING count(*) > 5)")
def d9(spark, sf):
    counts = t.purchase_counts(spark, sf)
    return matrix.aligned(counts, counts.groupBy("gene").agg(F.count("*").alias("c")).filter("c > 5").select("gene"))


@query("d10_fallback_lookup", f"""{with_('base')}, ref AS (SELECT * FROM base WHERE cluster <> 'MACHINERY') SELECT cell, {d('(log_count - coalesce(g.med, w.med)) / coalesce(g.sc, w.sc)', 'z')} FROM base
 LEFT JOIN (SELECT cluster, med, {R2} AS sc FROM {stats_sql('log_count', 'cluster', 'ref')}) g USING (cluster), (SELECT med, {R2} AS sc FROM {stats_sql('log_count', '', 'ref')}) w""")
def d10(spark, sf):
    base = t.customer_base(spark, sf)
    return robust.z_with_fallback(base, "log_count", ["cluster"], "z", "r2", base.filter("cluster <> 'MACHINERY'")).select("cell", "z")


@query("d11_two_key_lookup", f"""{with_('base')}, q AS (SELECT cluster, library, count(*) / 100.0 AS q FROM base WHERE library <> 'ASIA' GROUP BY 1, 2) SELECT cell, {d('coalesce(q, 1)', 'q')} FROM base LEFT JOIN q USING (cluster, library)""")
def d11(spark, sf):
    base = t.customer_base(spark, sf)
    q = base.filter("library <> 'ASIA'").groupBy("cluster", "library").agg((F.count("*") / 100.0).alias("q"))
    return base.join(q, ["cluster", "library"], "left").select("cell", F.coalesce("q", F.lit(1.0)).alias("q"))


@query("d16_anti_join", f"{with_('cells')} SELECT cell FROM cells WHERE CAST(cell AS BIGINT) NOT IN (SELECT o_custkey FROM orders)")
def d16(spark, sf):
    bought = t.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("cell"))
    return t.customer_cells(spark, sf).select("cell").join(bought, "cell", "left_anti")


@query("d17_pool_overlap", "SELECT CAST(count(*) AS BIGINT) AS shared FROM (SELECT user_id FROM events INTERSECT SELECT c_custkey FROM customer)")
def d17(spark, sf):
    e, c = t.table(spark, sf, "events"), t.table(spark, sf, "customer")
    return e.select(F.col("user_id").alias("id")).intersect(c.select("c_custkey")).agg(F.count("*").alias("shared"))


@query("d22_consensus", f"""{with_('sc')} SELECT cell, {i('(CASE WHEN s1 >= 0.8 THEN 1 ELSE 0 END) + (CASE WHEN s2 >= 0.8 THEN 1 ELSE 0 END) + (CASE WHEN s3 >= 0.8 THEN 1 ELSE 0 END)', 'votes')},
 (CASE WHEN s1 >= 0.8 THEN 1 ELSE 0 END) + (CASE WHEN s2 >= 0.8 THEN 1 ELSE 0 END) + (CASE WHEN s3 >= 0.8 THEN 1 ELSE 0 END) >= 2 AS consensus FROM sc""")
def d22(spark, sf):
    votes = sum(((F.col(c) >= 0.8).cast("long") for c in ("s1", "s2", "s3")), F.lit(0).cast("long"))
    return t.demo_scores(spark, sf).select("cell", votes.alias("votes"), (votes >= 2).alias("consensus"))


# ---------------------------------------------------------------- aggregates

for variant, rule in (("r1", R1), ("r2", R2), ("r3", R3)):
    @query(f"e1_robust_z_{variant}", f"{with_('base')} SELECT cell, {d(f'(log_count - med) / ({rule})', 'z')} FROM base JOIN {stats_sql('log_count', 'cluster, library')} s USING (cluster, library)")
    def e1(spark, sf, variant=variant):
        return robust.robust_z(t.customer_base(spark, sf), "log_count", ["cluster", "library"], "z", variant).select("cell", "z")


@query("e1_robust_z_global", f"{with_('base')} SELECT cell, {d(f'(log_count - med) / ({R1})', 'z')} FROM base, {stats_sql('log_count', '')} s")
def e1g(spark, sf):
    return robust.robust_z(t.customer_base(spark, sf), "log_count", [], "z", "r1").select("cell", "z")


@query("e2_cluster_statistics", f"""{with_('base')} SELECT cluster, {i('n')}, {d('n / (SELECT count(*) FROM base)', 'abundance')}, {d('med')}, {d(R2, 'scale')} FROM {stats_sql('log_count', 'cluster')}
 UNION ALL SELECT '__global__', {i('n')}, 1.0::DOUBLE, {d('med')}, {d(R2, 'scale')} FROM {stats_sql('log_count', '')}""")
def e2(spark, sf):
    base = t.customer_base(spark, sf)
    group, whole = robust.statistics(base, "log_count", ["cluster"]), robust.statistics(base, "log_count", [])
    n = whole.select(F.col("n").alias("_all"))
    cols = lambda df, share: df.select("cluster", "n", share.alias("abundance"), "med", robust.scale_of("r2").alias("scale"))
    return cols(group.crossJoin(F.broadcast(n)), F.col("n") / F.col("_all")).unionByName(cols(whole.withColumn("cluster", F.lit("__global__")), F.lit(1.0)))


@query("e3_centroids", f"SELECT label, {i('p')}, {d('avg(x)', 'mean')} FROM (SELECT CAST(label AS BIGINT) AS label, generate_subscripts(embedding, 1) - 1 AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2")
def e3(spark, sf):
    e = t.table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("p", "x"))
    return e.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("mean"))


@query("e4_abundance_burden", f"{with_('cells')}, a AS (SELECT library, cluster, count(*) / sum(count(*)) OVER (PARTITION BY library) AS a FROM cells GROUP BY 1, 2) SELECT library, cluster, {d('a', 'abundance')}, {d('a * a', 'burden')} FROM a")
def e4(spark, sf):
    n = t.customer_cells(spark, sf).groupBy("library", "cluster").agg(F.count("*").alias("n"))
    a = F.col("n") / F.sum("n").over(W.partitionBy("library"))
    return n.select("library", "cluster", a.alias("abundance"), (a * a).alias("burden"))


@query("e5_gene_moments", f"{with_('cm1')}, n AS (SELECT count(*) AS n FROM customer) SELECT gene, {d('sum(count) / any_value(n)', 'mean')}, {d('greatest(sum(count * count) / any_value(n) - (sum(count) / any_value(n)) * (sum(count) / any_value(n)), 0)', 'variance')} FROM cm1, n GROUP BY gene")
def e5(spark, sf):
    n = t.table(spark, sf, "customer").agg(F.count("*").alias("n"))
    return matrix.gene_moments(t.purchase_counts(spark, sf).withColumnRenamed("count", "value"), n)


@query("e6_stable_genes", f"""{with_('cm1')}, n AS (SELECT count(*) AS n FROM customer), g AS (SELECT gene, sum(count) / any_value(n) AS mu, greatest(sum(count * count) / any_value(n) - power(sum(count) / any_value(n), 2), 0) AS va FROM cm1, n GROUP BY 1),
 s AS (SELECT gene FROM g WHERE mu > 0 ORDER BY sqrt(va) / mu, gene LIMIT 100), v AS (SELECT cell, sum(count) AS v FROM cm1 JOIN s USING (gene) GROUP BY cell)
 SELECT CAST(c_custkey AS VARCHAR) AS cell, {d('ln(1 + coalesce(v, 0))', 'stable')} FROM customer LEFT JOIN v ON cell = CAST(c_custkey AS VARCHAR)""")
def e6(spark, sf):
    return matrix.stable_gene_score(t.purchase_counts(spark, sf), t.customer_cells(spark, sf))


@query("e7_marker_dosage", f"""{with_('cells', 'tot')}, nc AS (SELECT cluster, count(*) AS k FROM cells GROUP BY 1), x AS (SELECT cell, gene, ln(1 + count * 1e4 / n_count) AS value FROM cm1 JOIN tot USING (cell)),
 w AS (SELECT gene, sum(value) / (SELECT count(*) FROM cells) AS gm FROM x GROUP BY 1), p AS (SELECT cluster, gene, sum(value) AS s FROM x JOIN cells USING (cell) GROUP BY 1, 2),
 r AS (SELECT cluster, gene, row_number() OVER (PARTITION BY cluster ORDER BY round(s / k - gm, 9) DESC, gene) AS r FROM p JOIN nc USING (cluster) JOIN w USING (gene))
, m AS (SELECT cell, sum(count) AS m FROM cm1 JOIN cells USING (cell) JOIN r USING (cluster, gene) WHERE r <= 25 GROUP BY cell)
 SELECT cell, {d('ln(1 + coalesce(m, 0))', 'marker_dosage')} FROM cells LEFT JOIN m USING (cell)""")
def e7(spark, sf):
    return matrix.marker_dosage(t.purchase_counts(spark, sf), t.customer_cells(spark, sf))


@query("e9_informativeness", f"""{with_('rs')}, q AS (SELECT cluster, quantile_cont(a, 0.5) AS q50, quantile_cont(a, 0.95) AS q95, greatest(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 1e-8) AS iqr, count(DISTINCT a) AS k,
 corr(a, ln(1 + spent)) AS r FROM rs GROUP BY cluster) SELECT cluster, {d("CASE WHEN k <= 1 THEN 0 ELSE (0.65 * " + CLIP.format('((q95 - q50) / iqr - 1) / 3') + " + 0.35 * " + CLIP.format('iqr / 0.25') + ") * coalesce(least(greatest(1 - 0.35 * abs(r), 0.45), 1), 1) END", 'informativeness')} FROM q""")
def e9(spark, sf):
    s = t.rough_scores(spark, sf).withColumn("a", scalars.finite(F.col("a")))
    q = s.groupBy("cluster").agg(F.expr("percentile(a, array(0.25, 0.5, 0.75, 0.95))").alias("q"), F.count_distinct("a").alias("k"), F.corr("a", F.log1p("spent")).alias("r"))
    return q.select("cluster", scalars.informativeness(*(F.col("q")[p] for p in range(4)), F.col("k"), F.col("r")).alias("informativeness"))


# ---------------------------------------------------------------- ranks

def rank_sql(value: str, source: str, by: str = "", constant: float = 0.5) -> str:
    key = f"PARTITION BY {by}" if by else ""
    part = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"CASE WHEN min({value}) OVER ({key}) = max({value}) OVER ({key}) THEN {constant} ELSE (rank() OVER ({key} ORDER BY {value}) + (count(*) OVER ({part}) - 1) / 2.0) / count(*) OVER ({key}) END"


@query("f1_average_rank", f"{with_('sc')} SELECT cell, {d(rank_sql('s1', 'sc'), 'r')} FROM sc")
def f1(spark, sf):
    return ranks.percentile_rank(t.demo_scores(spark, sf), "s1", "r").select("cell", "r")


@query("f2_rank_constant_zero", f"{with_('sc')} SELECT cell, {d(rank_sql('k', 'sc', '', 0.0), 'r')} FROM (SELECT cell, 1.0 AS k FROM sc)")
def f2(spark, sf):
    return ranks.percentile_rank(t.demo_scores(spark, sf).withColumn("k", F.lit(1.0)), "k", "r", constant=0.0).select("cell", "r")


@query("f3_rank_by_group", f"{with_('sc')} SELECT cell, {d(rank_sql('s1', 'sc', 'cluster'), 'r')} FROM sc")
def f3(spark, sf):
    return ranks.percentile_rank(t.demo_scores(spark, sf), "s1", "r", ["cluster"]).select("cell", "r")


@query("f4_empirical_percentile", f"{with_('sc')}, k AS (SELECT cell, s1, (rank() OVER (ORDER BY s1) + (count(*) OVER (PARTITION BY s1) - 1) / 2.0) / count(*) OVER () AS r FROM sc WHERE s1 < 0.9) SELECT cell, {d('coalesce(r, 0.5)', 'r')} FROM sc LEFT JOIN k USING (cell)")
def f4(spark, sf):
    s = t.demo_scores(spark, sf).withColumn("v", F.when(F.col("s1") < 0.9, F.col("s1")))
    return ranks.empirical(s, "v", "r").select("cell", "r")


@query("f5_f6_tail_union", f"""{with_('sc')}, r AS (SELECT cell, {rank_sql('s1', 'sc')} AS a, {rank_sql('s2', 'sc')} AS b FROM sc), x AS (SELECT cell, a, b, {CLIP.format('(a - 0.5) / 0.5')} AS ta, {CLIP.format('(b - 0.5) / 0.5')} AS tb FROM r)
 SELECT cell, {d('ta', 'tail')}, {d('1 - (1 - a) * (1 - b)', 'rank_union')}, {d('1 - (1 - ta) * (1 - tb)', 'tail_union')}, {d('0.7 * a + 0.3 * b', 'hybrid')} FROM x""")
def f5(spark, sf):
    s = ranks.percentile_rank(ranks.percentile_rank(t.demo_scores(spark, sf), "s1", "a"), "s2", "b")
    a, b = F.col("a"), F.col("b")
    return s.select("cell", ranks.tail(a).alias("tail"), scalars.union(a, b).alias("rank_union"), scalars.union(ranks.tail(a), ranks.tail(b)).alias("tail_union"), (0.7 * a + 0.3 * b).alias("hybrid"))


@query("f7_reference_ecdf", f"{with_('sc')}, ref AS (SELECT s1 FROM sc WHERE key % 3 = 0) SELECT cell, {d('(SELECT count(*) FROM ref WHERE ref.s1 <= sc.s1) / (SELECT count(*) FROM ref)', 'p')} FROM sc")
def f7(spark, sf):
    s = t.demo_scores(spark, sf)
    return ranks.reference_ecdf(s, "s1", s.filter("key % 3 = 0"), "s1", "p").select("cell", "p")


@query("f8_coarse_bin", f"{with_('sc')} SELECT cell, {i('least(floor(row_number() OVER (PARTITION BY cluster ORDER BY s1, cell) / CAST(count(*) OVER (PARTITION BY cluster) AS DOUBLE) * 5), 4)', 'bin')} FROM sc")
def f8(spark, sf):
    return ranks.coarse_bin(t.demo_scores(spark, sf), "s1", "cell", "bin", ["cluster"]).select("cell", "bin")


@query("f9_top_rank", f"{with_('pb')} SELECT cell, {i('row_number() OVER (ORDER BY b DESC NULLS LAST, cell)', 'rank')} FROM pb")
def f9(spark, sf):
    return ranks.top_rank(t.rough_ranking(spark, sf), "b", "cell", "rank").select("cell", "rank")


@query("f10_expected_rate_threshold", f"{with_('ok')}, r AS (SELECT b, row_number() OVER (ORDER BY b) AS p, count(*) OVER () AS n FROM ok) SELECT {d('b', 'threshold')} FROM r WHERE p = floor((n - 1) * 0.8) + 1")
def f10(spark, sf):
    return ranks.expected_rate_threshold(t.rough_ranking(spark, sf), "b", 0.2)


@query("f12_auto_threshold", f"""{with_('rs')} SELECT {d(CLIP.format('CASE WHEN median(b) + 3 * 1.4826 * mad(b) >= max(b) THEN quantile_cont(b, 0.95) ELSE median(b) + 3 * 1.4826 * mad(b) END'), 'threshold')} FROM rs""")
def f12(spark, sf):
    return ranks.auto_threshold(t.rough_scores(spark, sf), "b")


@query("f13_minimum_prefix", f"{with_('pb')}, r AS (SELECT row_number() OVER (ORDER BY b DESC NULLS LAST, cell) AS k, sum(positive) OVER (ORDER BY b DESC NULLS LAST, cell ROWS UNBOUNDED PRECEDING) AS tp, sum(positive) OVER () AS p FROM pb) SELECT {i('min(k)', 'selected')} FROM r WHERE tp >= ceil(0.5 * p - 1e-12)")
def f13(spark, sf):
    from countloom.operators.metrics import operating_points

    return operating_points(t.rough_ranking(spark, sf), "b", "cell", "positive", "hard", (0.5,)).select("selected")


@query("f14_rolling_median", f"""WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, {d('median(value)', 'expected')}, {i('count(*)', 'n')} FROM r WHERE k <= 20 GROUP BY 1 HAVING count(*) >= 2""")
def f14(spark, sf):
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = t.table(spark, sf, "events").withColumn("k", F.row_number().over(w)).filter("k <= 20")
    return last.groupBy("user_id").agg(F.expr("percentile(value, 0.5)").alias("expected"), F.count("*").alias("n")).filter("n >= 2")


@query("g3_hash_cap", f"{with_('sc')} SELECT cluster, cell FROM (SELECT cluster, cell, row_number() OVER (PARTITION BY cluster ORDER BY sha256('0:' || cell)) AS r FROM sc) WHERE r <= 20")
def g3(spark, sf):
    w = W.partitionBy("cluster").orderBy(F.sha2(F.concat(F.lit("0:"), F.col("cell")), 256))
    return t.demo_scores(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 20").select("cluster", "cell")


@query("g4_union_missing", f"{with_('sc')} SELECT cell, {d('s1')}, NULL::DOUBLE AS s2 FROM sc WHERE positive = 1 UNION ALL SELECT cell, NULL::DOUBLE, {d('s2')} FROM sc WHERE hard = 1")
def g4(spark, sf):
    s = t.demo_scores(spark, sf)
    return s.filter("positive = 1").select("cell", "s1").unionByName(s.filter("hard = 1").select("cell", "s2"), allowMissingColumns=True)


@query("g6_first_wins", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def g6(spark, sf):
    return t.table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))

"""Tables that state the protocol: they read no data, so they are no queries; each against SQL over the same fixed values."""

import duckdb
import pytest

from countloom.operators import contracts
from countloom.operators.governance import DENIED

CASES = {}


def query(name, sql):
    def register(make):
        CASES[name] = make, sql
        return make

    return register


def rows(values) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in v) + ")" for v in values)


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


GROUPS = [(r, g) for r, groups in contracts.RAW_GROUPS.items() for g in groups]
EDGES = [(f, n) for f, needs in contracts.NEEDS.items() for n in needs]
DENY = " OR ".join(f"lower(feature) LIKE '%{x.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}'" for x in DENIED)
AUDITED = [*contracts.CANDIDATES[:16], "true_label_rank", "is_external", "something_else"]


@query("k2_provenance", f"""WITH RECURSIVE e AS (SELECT * FROM (VALUES {rows(EDGES)}) v(feature, needs)), g AS (SELECT * FROM (VALUES {rows(GROUPS)}) v(source, grp)),
 r AS (SELECT feature, needs AS source FROM e UNION SELECT r.feature, e.needs FROM r JOIN e ON r.source = e.feature), x AS (SELECT feature, count(*) > 1 OR max(CASE WHEN needs NOT LIKE 'raw:%' THEN 1 ELSE 0 END) = 1 AS composite FROM e GROUP BY 1)
 SELECT feature, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources, array_to_string(list_sort(list(DISTINCT grp)), ';') AS groups, any_value(composite) AS composite FROM r JOIN g USING (source) JOIN x USING (feature) GROUP BY feature""")
def k2(spark, sf):
    return contracts.provenance(spark)


@query("k4_feature_matrix", f"""SELECT CAST(place AS BIGINT) AS place, feature, ({DENY}) AS denied, feature IN ({listed(contracts.ALLOWED)}) AS allowed, NOT ({DENY}) AS included
 FROM (VALUES {', '.join(f"({p}, '{f}')" for p, f in enumerate(contracts.CANDIDATES))}) v(place, feature)""")
def k4(spark, sf):
    """41 candidates, of which 35 are in the public matrix and 24 in the protocol's list."""
    return contracts.feature_matrix(spark)


@query("k5_feature_audit", f"""WITH f AS (SELECT unnest([{listed(AUDITED)}]) AS feature), t AS (SELECT unnest([{listed(DENIED)}]) AS token, generate_subscripts([{listed(DENIED)}], 1) AS p),
 r AS (SELECT feature, p, token AS reason FROM f, t WHERE contains(lower(feature), token) UNION ALL SELECT feature, 98, 'not allowed' FROM f WHERE feature NOT IN ({listed(contracts.ALLOWED)}) UNION ALL SELECT feature, 99, 'no provenance' FROM f WHERE feature NOT IN ({listed(contracts.CANDIDATES)}))
 SELECT feature, coalesce(string_agg(reason, '; ' ORDER BY p), '') AS reasons, CASE WHEN count(reason) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM f LEFT JOIN r USING (feature) GROUP BY feature""")
def k5(spark, sf):
    return contracts.feature_audit(spark, AUDITED)


@query("o19_o29_variants", "SELECT * FROM (VALUES ('raw_sum_parents_removed', 'raw_sum', 'removed', 750::BIGINT, 250::BIGINT), ('downsampled_parents_removed', 'downsampled', 'removed', 750, 500), ('downsampled_parents_retained', 'downsampled', 'retained', 188, 250), ('raw_sum_parents_retained', 'raw_sum', 'retained', 188, 125)) v(variant, counts, parents, n_train, n_test)")
def o19(spark, sf):
    """Variants by name and by replaced parts, with sizes scaled for training only and for all splits."""
    sizes = {"n_train": 375, "n_test": 250}
    plans = [({}, 2, False), ({"counts": "downsampled"}, 2, True), ({"variant": "downsampled_parents_retained"}, 0.5, False), ({"parents": "retained"}, 0.5, True)]
    found = []
    for parts, factor, historical in plans:
        scaled = contracts.scaled_sizes(sizes, factor, historical)
        found.append((*contracts.construction(**parts), scaled["n_train"], scaled["n_test"]))
    return spark.createDataFrame(found, "variant string, counts string, parents string, n_train long, n_test long")


@query("o39_metric_table", f"SELECT * FROM (VALUES {rows(contracts.METRICS)}) v(metric, positive, negative, subset, budget)")
def o39(spark, sf):
    return contracts.metric_table(spark)


@query("k1_source_groups", "SELECT feature, source FROM (VALUES ('duo', 'dosage'), ('duo', 'identity'), ('dosage', 'count_z'), ('identity', 'distance'), ('duo', 'count_z'), ('duo', 'distance')) v(feature, source)")
def k1(spark, sf):
    from countloom.operators.governance import source_groups

    return source_groups(spark.createDataFrame([("duo", "dosage"), ("duo", "identity"), ("dosage", "count_z"), ("identity", "distance")], "feature string, needs string"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_same_rows(name, spark):
    make, sql = CASES[name]
    df = make(spark, None)
    answer = duckdb.sql(sql)
    order = [df.columns.index(c) for c in answer.columns]
    text = lambda x: ";".join(x) if isinstance(x, list) else x
    assert sorted(tuple(text(r[c]) for c in order) for r in df.collect()) == sorted(tuple(r) for r in answer.fetchall())

"""Registry of queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Common table expressions of the SQL side.
CTE = {
    "cm1": "cm1 AS (SELECT CAST(o_custkey AS VARCHAR) AS cell, CAST(l_partkey AS VARCHAR) AS gene, sum(l_quantity) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)",
    "cells": "cells AS (SELECT CAST(c_custkey AS VARCHAR) AS cell, c_mktsegment AS cluster, r_name AS library FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "tot": "tot AS (SELECT cell, sum(count) AS n_count, count(*) FILTER (count > 0) AS n_feature FROM cm1 GROUP BY 1)",
    "base": "base AS (SELECT cell, cluster, library, n_count, n_feature, ln(1 + n_count) AS log_count, ln(1 + n_feature) AS log_feature FROM tot JOIN cells USING (cell))",
    "sc": """sc AS (SELECT CAST(c_custkey AS VARCHAR) AS cell, c_mktsegment AS cluster, c_custkey AS key,
      CAST((c_custkey * 37) % 101 AS DOUBLE) / 100 AS s1, CAST((c_custkey * 53) % 97 AS DOUBLE) / 96 AS s2, CAST((c_custkey * 11) % 89 AS DOUBLE) / 88 AS s3,
      CASE WHEN c_custkey * 7 % 5 = 0 THEN 1 ELSE 0 END AS positive, CASE WHEN c_custkey * 7 % 5 = 1 THEN 1 ELSE 0 END AS hard,
      CASE WHEN c_custkey * 7 % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'homotypic_doublet' ELSE 'heterotypic_doublet' END WHEN c_custkey * 7 % 5 = 1 THEN 'high_RNA_singlet' ELSE 'clean' END AS label
      FROM customer)""",
    "rs": """rs AS (SELECT CAST(c_custkey AS VARCHAR) AS cell, c_mktsegment AS cluster, c_custkey AS key, CASE WHEN c_custkey % 13 <> 0 THEN round(c_acctbal / 8000, 3) END AS a,
      CASE WHEN c_custkey % 19 <> 0 AND c_custkey % 23 <> 0 THEN round(CAST(c_custkey * 53 % 97 AS DOUBLE) / 80 - 0.1, 4) END AS b, round(1 - c_acctbal / 9000, 3) AS c, round(spent, 2) AS spent,
      CASE WHEN c_custkey * 7 % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'homotypic_doublet' ELSE 'heterotypic_doublet' END WHEN c_custkey * 7 % 5 = 1 THEN 'high_RNA_singlet' ELSE 'clean' END AS label
      FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey)""",
    "pb": "pb AS (SELECT *, CASE WHEN label LIKE '%_doublet' THEN 1 ELSE 0 END AS positive, CASE WHEN label = 'high_RNA_singlet' THEN 1 ELSE 0 END AS hard FROM rs)",
    "ok": "ok AS (SELECT * FROM pb WHERE b IS NOT NULL)",
    "ms": """ms AS (SELECT cell, cluster, key, label, method, CASE method WHEN 'a' THEN a WHEN 'b' THEN b WHEN 'c' THEN c END AS score FROM rs, (SELECT unnest(['a', 'b', 'c', 'none']) AS method))""",
}
DEEP = {"cm1": ["cm1"], "cells": ["cells"], "tot": ["cm1", "tot"], "base": ["cm1", "cells", "tot", "base"], "sc": ["sc"], "rs": ["rs"], "pb": ["rs", "pb"], "ok": ["rs", "pb", "ok"], "ms": ["rs", "ms"]}


def with_(*names: str, recursive: bool = False) -> str:
    """WITH clause of the named expressions and all that they need."""
    order = []
    for n in names:
        for d in DEEP[n]:
            if d not in order:
                order.append(d)
    return "WITH " + ("RECURSIVE " if recursive else "") + ", ".join(CTE[n] for n in order)


def query(name: str, sql: str | None = None):
    """Registers a query.  Doubles are rounded to six places on both sides, whole numbers are bigint."""

    def register(make):
        def run(spark, sf_dir: str) -> DataFrame:
            df = make(spark, sf_dir)
            kinds = dict(df.dtypes)
            return df.select(*(
                (F.round(c, 6) + F.lit(0.0)).alias(c) if k in ("double", "float") else F.col(c).cast("bigint").alias(c) if k in ("int", "smallint", "tinyint") else F.col(c)
                for c, k in kinds.items()))

        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return make

    return register


def d(x: str, name: str | None = None) -> str:
    """SQL of a rounded double."""
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name or x}"


def i(x: str, name: str | None = None) -> str:
    return f"CAST({x} AS BIGINT) AS {name or x}"

"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from countloom.llm import pii

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "personal_data":
            assert not any(s[0] in pii.BASE for r in docs.collect() for s in pii.spans(r["text"]))
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns)


def test_an_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def plain_run(docs):
    """The stages after quality on a few rows, by plain versions: groups by sets of shingles, spans by patterns, sizes by words."""
    from test_operators import classes, shingles

    wanted = classes({r["doc_id"]: shingles(r["text"], 5) for r in docs if r["doc_id"] is not None}, 80, 100)
    return {i for i, c in wanted.items() if i == c}


def test_each_stage_on_edge_rows(spark, edge_docs):
    """Nulls in any column, empty and long texts, repeated rows: every stage keeps the columns and a defined set of rows."""
    rows = edge_docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, edge_docs, SF)
    assert kept.columns == edge_docs.columns and not {3, 4, 5} & {r["doc_id"] for r in kept.collect()}
    one = stages["near_duplicates"](spark, edge_docs, SF).collect()
    assert {r["doc_id"] for r in one} == plain_run(rows) | {None} and len(one) == len({r["doc_id"] for r in one})
    safe = {(r["doc_id"], r["text"]) for r in stages["personal_data"](spark, edge_docs, SF).collect()}
    assert safe == {(r["doc_id"], None if r["text"] is None else pii.redacted(r["text"])) for r in rows}
    mixed = [r["doc_id"] for r in stages["mixing"](spark, edge_docs, SF).collect()]
    assert set(mixed) <= {r["doc_id"] for r in rows} and max(mixed.count(r["doc_id"]) for r in rows if r["doc_id"] != 2) <= 2 and mixed.count(2) <= 4
    coded = stages["encoding"](spark, edge_docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in coded) == sorted(str(r["doc_id"]) for r in rows) and all(r["n_tokens"] * 4 == len(r["ids"]) for r in coded)

import os

import pytest

import __spark_entry__
import corpus_pipeline
from ferrywake.llm import decontaminate, lattice

DIR = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_pipeline_on_small_tables(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [(r.item_id, decontaminate.words(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    now, seen = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DIR).persist()
        assert now.columns == docs.columns, name
        seen.append(now.count())
    rows = now.collect()
    assert seen == sorted(seen, reverse=True) and seen[1] == seen[0]  # no document here is without a language
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.n_chars == len(r.text) for r in rows)
    for r in rows:
        line = " ".join(decontaminate.words(r.text))
        assert not any(" ".join(ws) in line for _, ws in bench)
    out = corpus_pipeline.run(spark, DIR).collect()
    text = {r.doc_id: r.text for r in rows}
    assert {r.doc_id for r in out} == set(text) and all(lattice.decode(r.ids) == text[r.doc_id] for r in out)


def test_stages_on_awkward_rows(spark, make, prose):
    """Nulls in any column, ties, repeated rows, empty tables and extra columns with the names used inside."""
    rows = [(i, prose(i, 40)) for i in range(30)] + [(40, None), (41, ""), (42, "123 !"), (None, prose(0, 40)), (3, prose(3, 40)), (3, prose(3, 40)), (50, prose(5, 40).upper()), (51, f"{prose(51, 40)} mail me at a@b.co"), (None, None), (None, prose(77, 40))]
    docs = make([(d, t, "en" if d is None or d % 3 else None) for d, t in rows])
    for name in ("lang_pred", "score_", "__lang", "__score", "id_", "th_", "hits_", "__hits", "whole_", "spans_", "__text", "__spans", "__id", "__th"):
        docs = docs.selectExpr("*", f"1 AS `{name}`")
    kept = {}
    for rows_ in (docs, docs.limit(0)):
        now = rows_
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, DIR)
            assert now.columns == docs.columns, name
            kept.setdefault(name, now.collect())
        out = corpus_pipeline.STAGES[-1][1](spark, now, DIR).collect()
        if rows_ is not docs:
            assert out == [] == now.collect()
    first, second = kept["language ID"], kept["SimHash near-dedup"]
    assert not {40, 41, 42} & {r.doc_id for r in first} and len(first) == len(rows) - 4 and all(r.lang == "en" for r in first)
    assert sorted(r.doc_id for r in second if r.doc_id is not None) == [*range(30), 51] and [r.text for r in second if r.doc_id is None] == [prose(77, 40)]
    masked = {r.doc_id: r.text for r in kept["PII"]}
    assert masked[51].endswith("mail me at [EMAIL]") and masked[7] == prose(7, 40)

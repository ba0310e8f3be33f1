"""The pipeline and its stages on nulls, repeated rows, clashing columns and empty tables."""

import corpus_pipeline
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, line string"
PROSE = "The quick brown fox jumps over the lazy dog number {} while many other animals of the wood look on and wonder why."


def rows_of(n):
    good = [(i, "\n".join(PROSE.format(7 * i + k) for k in range(4)), "en", "s", 1, 0.5, "c", "l") for i in range(n)]
    odd = [(100, None, None, None, None, None, None, None), (101, "", "en", "s", 0, 0.0, "c", "l"), (None, "a b c", "en", "s", 5, 0.0, "c", "l"), (None, None, None, None, None, None, None, None)]
    return good + odd + [good[0], good[0]]


def saved(spark, folder, docs, labels, benchmark):
    for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, "doc_id long, quality int, toxic int, text string"), ("benchmark", benchmark, "item_id long, text string, doc_id long")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("tables", ["full", "bare"])
def test_stages_keep_columns_and_handle_edges(spark, tmp_path, tables):
    full = tables == "full"
    labels = [(i, 1, 0, "x") for i in range(12)] + [(100, 0, 0, "x"), (101, 0, 0, "x"), (None, 1, None, None), (5, None, None, None)] if full else []
    benchmark = [(1, PROSE.format(21), 3), (2, None, None), (None, "", None)] if full else []
    at = saved(spark, tmp_path, rows_of(12), labels, benchmark)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kind = docs.schema
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == kind.names, name
        got = out.collect()
        docs = spark.createDataFrame(got, kind)
        assert {r.doc_id for r in got} <= {*range(12), 100, 101, None}, name
        if name == "line dedup":
            assert all(r.n_chars == len(r.text) for r in got)
        copies = [r for r in got if r.doc_id == 0]
        assert len(copies) in (0, 3), name  # repeated rows are judged alike
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert len(packed) == docs.count()
    assert len(corpus_pipeline.run(spark, at).collect()) == len(packed)
    if full:
        assert 3 not in {r.doc_id for r in packed}  # it holds the first item


def test_empty_documents(spark, tmp_path):
    at = saved(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, at).count() == 0

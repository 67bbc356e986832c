"""The pipeline on the smallest tables: every stage's decisions take effect."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import op1_ngram_join, op4_mixing, op7_decontaminate
from weftgraph.llm.common import table

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages(spark):
    docs = table(spark, DATA, "documents")
    docs = docs.unionByName(docs.limit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
        if name == "near_duplicates":
            found = op1_ngram_join.ngram_components(before).select("component_id").distinct()
            assert docs.count() == found.count() == docs.select("doc_id").distinct().count()
    assert op7_decontaminate.find_benchmark(docs, table(spark, DATA, "benchmark")).where("contaminated").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).cache()
    assert mixed.count() == docs.count() and mixed.columns[: len(docs.columns)] == docs.columns
    got = mixed.agg(F.sum("n_tokens"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")) for d in op4_mixing.DOMAINS]).first()
    assert all(abs(x / got[0] - op4_mixing.TARGET[d]) < 0.02 for x, d in zip(got[1:], op4_mixing.DOMAINS, strict=True))
    assert mixed.where("copies < floor(rate) or copies > ceil(rate)").count() == 0


def test_odd_rows(spark):
    """Null ids and texts, repeated ids with other texts, copies, clashing columns, empty tables, nothing known of languages."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, text(1), None, "s"), (1, text(2), None, "s"), (2, text(1), None, "s"), (None, text(1), None, "s"), (None, text(3), None, "s"), (None, text(3), None, "s"), (5, None, None, None), (5, None, None, None), (6, "", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("mine") for c in ("weft_row", "k", "rank", "rate", "copies")})
    assert corpus_pipeline.language(spark, docs, DATA).count() == len(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA)
    assert kept.columns == docs.columns and kept.where("weft_row = 'mine' and k = 'mine'").count() == kept.count()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, text(1)), (1, text(2)), (None, text(3)), (5, None), (5, None), (6, "")]))
    mixed = corpus_pipeline.mixture(spark, kept, DATA).collect()
    assert len(mixed) == 6 and all(r.weft_row == "mine" and r.rate >= 0 for r in mixed)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DATA)
        assert none.count() == 0

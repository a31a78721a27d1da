import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_stages_chain(spark):
    import corpus_pipeline as p
    from loomwatch.session import ship

    ship(spark)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, ids = docs.count(), {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == docs.columns, name
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now <= ids and len(now) == out.count()
        docs, ids = out, now
    assert 0.5 * before < len(ids) < before
    packed = p.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids

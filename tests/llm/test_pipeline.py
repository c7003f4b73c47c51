"""The pipeline's stages, each on its own input."""

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        docs, was = spark.read.parquet(str(tmp_path / str(i))), docs
        if i < len(P.STAGES) - 1:
            assert docs.columns == columns, name
        if i < 3:
            assert docs.count() <= was.count()
            assert not docs.join(was, columns, "left_anti").count()
    assert 0 < docs.count() <= 3 * before and {"shard", "slot"} <= set(docs.columns)

import os
import sys

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pressmill.llm import quality

DATA = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="module")
def stages(spark):
    """What every stage returns, in turn, over a table with odd rows and an extra column."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("digest", F.lit("clash"))
    odd = [(9001, None), (9002, ""), (9003, "one\xa0word"), (None, "a text without an id " * 9), (9004, "and a long one " * 700)]
    odd = spark.createDataFrame(odd, "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).unionByName(odd.limit(3), allowMissingColumns=True)
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], DATA).cache())
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text").collect()), key=repr)


def test_filters_keep_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:4])
    for before, after in zip(stages[:3], stages[1:4], strict=True):
        assert set(rows(after)) <= set(rows(before))


def test_quality_goes_by_the_score(spark, stages):
    odds = quality.fitted(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    score = quality.Scorer(odds).score
    assert rows(stages[1]) == sorted((r for r in rows(stages[0]) if score(r[1] or "") >= 0.5), key=repr)


def test_one_of_each_group(stages):
    from tests.llm.test_simhash import wider_groups_by_hand

    before, after = rows(stages[1]), rows(stages[2])
    assert len(after) == len(set(after))
    assert {d for d, _ in after if d is not None} == {c for _, _, c in wider_groups_by_hand(before) if c is not None}


def test_no_passages(spark, stages):
    from tests.llm.test_decontamination import by_hand

    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    before = rows(stages[2])
    dirty = {key[0] for key in by_hand(before, items)}
    assert rows(stages[3]) == [r for r in before if r[0] not in dirty]


def test_pieces(stages):
    original = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    got = sorted(((r.doc_id, list(r.ids), r.round_trip) for r in stages[4].collect()), key=repr)
    assert got == sorted(((d, original.encode(t or ""), True) for d, t in rows(stages[3])), key=repr)


def test_empty_tables(spark, stages):
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stages[0].limit(0), DATA).collect() == []


def test_run(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, DATA).count() > 0

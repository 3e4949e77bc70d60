"""The pipeline's stages, each held against what its operator or brute force says about its own input."""

import pytest

import corpus_pipeline as cp
from landgrid.llm.langid import fit, predict
from landgrid.llm.mixing import mix
from landgrid.llm.quality import judge
from tests.llm.test_nearcopies import brute_kept

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def kept(spark, frame):
    """The rows that a stage gives, as a table without history."""
    return spark.createDataFrame(frame.toArrow(), frame.schema).repartition(2).cache()


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gives for all that the one before it kept, the documents first."""
    out = [kept(spark, spark.read.parquet(f"{SF}/documents.parquet"))]
    for _, stage in cp.STAGES:
        out.append(kept(spark, stage(spark, out[-1], SF)))
    return out


def test_language_id(stages):
    docs, known = stages[:2]
    assert known.columns == docs.columns
    assert ids(known) == ids(predict(docs, fit(docs)).where("lang_pred <> 'und' AND score >= 0.5"))


def test_quality_rules(stages):
    known, good = stages[1:3]
    assert good.columns == known.columns and ids(good) == ids(judge(known).where("kept").select("row.doc_id"))


def test_near_dedup(stages):
    good, single = stages[2:4]
    assert single.columns == good.columns and ids(single) == brute_kept([(r.doc_id, r.text) for r in good.collect()])


def test_mixing(stages):
    single, mixed = stages[3:5]
    assert mixed.columns == single.columns
    assert ids(mixed) == sorted(r.doc_id for r in mix(single).collect() for _ in range(r.times))


def test_sentencepiece(stages):
    mixed, last = stages[4:]
    assert ids(last) == ids(mixed) and last.where("NOT exact").count() == 0


def test_run_is_the_stages_one_after_another(spark, stages):
    assert sorted(map(tuple, cp.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))


def test_stages_are_the_named_ones():
    assert [f for _, f in cp.STAGES] == [cp.language_id, cp.quality_rules, cp.near_dedup, cp.mixing, cp.sentencepiece]

"""The stages of the pipeline: columns, decisions and awkward tables."""

import pathlib

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from pairloom.llm import queries, stages  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    if not pathlib.Path(SF).exists():
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def test_stages_keep_columns_and_narrow(results):
    docs = results[0]
    for stage in results[1:-1]:
        assert stage.dtypes == docs.dtypes
    counts = [df.count() for df in results[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 100


def test_each_stage_is_its_operator(spark, results):
    ids = [{r[0] for r in df.select("doc_id").collect()} for df in results]
    judged = queries.op9_quality(spark, SF).where("kept").select("doc_id").collect()
    assert ids[2] == ids[1] & {r[0] for r in judged}
    near = stages.chosen_path.near_duplicates(results[2]).where("kept").select("doc_id").collect()
    assert ids[3] == {r[0] for r in near}
    before = {r["doc_id"]: r["text"] for r in results[3].collect()}
    lost = {r["doc_id"]: r for r in stages.phrases.remove_repeats(results[3], ["doc_id"]).collect()}
    for row in results[4].collect():
        key = row["doc_id"]
        expected = lost[key]["kept_text"] if lost[key]["n_removed"] else before[key]
        assert (row["text"], row["n_chars"]) == (expected, len(expected))
    assert ids[5] == ids[4] == ids[3]


def test_run_is_all_stages(spark, results):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == results[-1].columns
    place = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert {tuple(r) for r in found.select(*place).collect()} == {
        tuple(r) for r in results[-1].select(*place).collect()
    }


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_awkward_tables(spark, stage):
    if not pathlib.Path(SF).exists():
        pytest.skip("no test data")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, key map<string,int>"
    text = " ".join(f"thing{i}" for i in range(80))
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, {"a": 1}), (2, text, "en", "s", None, None), (2, text, "en", "s", 5, None)]
    for table in (rows, []):
        df = spark.createDataFrame(table, schema)
        out = stage(spark, df, SF)
        assert out.count() <= 4
        if stage is not stages.best_fit_packing:
            assert out.columns == df.columns

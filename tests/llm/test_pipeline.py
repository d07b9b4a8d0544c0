"""The pipeline and the registered queries."""

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "similar", "benchmark", "personal", "encode"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    rows = out.collect()
    assert 0 < len(rows) < len(ids) and {r.doc_id for r in rows} <= ids
    assert all(r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.parametrize("stage", [f for n, f in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (2, "", "en", "s", 0),
            (3, "word " * 30000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    last = stage is corpus_pipeline.STAGES[-1][1]
    for given in (docs, docs.limit(0)):
        out = stage(spark, given, SF)
        assert last or out.columns == docs.columns
        assert out.count() <= given.count()


def test_each_operator_has_a_query():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def rows_at_once(spark):
    before = spark.conf.get(ROWS_AT_ONCE)
    yield lambda n: spark.conf.set(ROWS_AT_ONCE, n)
    spark.conf.set(ROWS_AT_ONCE, before)


def _largest_batch(df):
    """Rows of the largest batch that Python gets, and of all."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    found = [r.n for r in df.mapInArrow(sizes, "n long").collect()]
    return max(found), sum(found)


@pytest.mark.parametrize("stage", [f for n, f in corpus_pipeline.STAGES])
def test_stages_hand_python_few_rows_at_once(spark, rows_at_once, stage):
    docs = spark.range(3000).coalesce(1).selectExpr(
        "id doc_id", "concat('text number ', id) text", "'en' lang", "'s' source", "0L n_chars")
    for given, most in ((10_000, 1000), (0, 1000), (300, 300)):
        rows_at_once(given)
        stage(spark, docs.limit(0), SF)
        assert _largest_batch(docs) == (most, 3000)


def test_encode_over_many_batches(spark, rows_at_once):
    rows = [(i, None if i % 700 == 0 else f"Text {i}, number {i * i} of many; thus {i % 7} again!") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r.ids for r in corpus_pipeline.encode_bpe(spark, docs, SF).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert found == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}


def test_run_leaves_the_session_as_it_was(spark, rows_at_once):
    rows_at_once(7000)
    corpus_pipeline.run(spark, SF)
    assert spark.conf.get(ROWS_AT_ONCE) == "7000"

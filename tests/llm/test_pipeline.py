"""Registered queries of the subpackage, and the pipeline stage by stage against plain rules."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siteweave.llm.queries import QUERIES
from siteweave.plans.stages import written
from tests.llm.conftest import SF
from tests.llm.test_filters import plain_contamination, plain_spans
from tests.llm.test_simhash import components, plain_fingerprint
from tools.check_oracles import TABLES, compare


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    result = compare(spark, db, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert result.startswith(("ok ", "rows-only ")), result


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name == "packing":
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert after.keys() == {i for i, t in before.items() if any(c.isalpha() for c in t)}
        if name == "near_duplicates":
            groups = components({i: plain_fingerprint(t) for i, t in before.items()}, 4)
            assert after == {i: before[i] for i, c in groups.items() if i == c}
        if name == "decontamination":
            bad = {i for i, n, hit, _ in plain_contamination(list(before.items()), items) if hit and 20 * hit >= n}
            assert bad and after == {i: t for i, t in before.items() if i not in bad}
        if name == "pii":
            assert after.keys() == before.keys() and any(plain_spans(t) for t in before.values())
            for i, t in before.items():
                found = plain_spans(t)
                assert after[i] == t if not found else not any(t[a:b] in after[i] for _, a, b in found)
        before = after
    lengths = {}
    for r in docs.collect():
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths.keys() == before.keys()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_an_id_that_stands_over_two_texts_loses_neither(spark):
    one, other = "the same few words in this text here", "quite another sentence with other words in it"
    rows = [(3, one), (5, one), (5, other), (6, other), (7, "alone"), (7, "alone"), (8, "alone"), (None, one), (9, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert sorted(kept, key=repr) == sorted([(3, one), (5, other), (7, "alone"), (None, one), (4, "")], key=repr)


def test_hard_rows_in_the_language_stage(spark, hard, documents):
    """With rows to learn from, hard rows go through all five stages."""
    taught = [(1000 + i, t, "en", "s", 1, 1, "c") for i, t in documents[:60]]
    docs = hard.unionByName(spark.createDataFrame(taught, hard.schema))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        if name == "language":
            left = [r.doc_id for r in docs.collect()]
            assert not {8, 9, 10} & set(left) and left.count(7) == 2
        if name != "packing":
            assert docs.columns == columns
    assert docs.count()


def test_stages_stand_hard_rows(spark, hard, nothing):
    benchmark = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert benchmark.columns
    for frame in (hard.drop("score", "key"), hard, nothing):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = written(stage(spark, docs, SF), name)
            if name != "packing":
                assert docs.columns == frame.columns
        assert docs.count() >= (frame is not nothing)
    model_free = corpus_pipeline.language(spark, nothing, SF)
    assert model_free.count() == 0

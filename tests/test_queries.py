"""Every registered query next to its checking SQL, on the whole smallest tables."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from siteweave.catalog import crm_queries, registry
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    result = compare(spark, db, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert result.startswith(("ok ", "rows-only ")), result


def test_plugin_analyzer(spark):
    rows = entry.queries()["analyze_with_plugin"](spark, SF).collect()
    assert rows and all(r.summary is None or r.summary.endswith(" characters") for r in rows)
    assert {r.confidence_score for r in rows} <= {0.7, None}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "content" in df.columns


def test_csv_splits_writes_its_input_in_many_tasks(spark, tmp_path, monkeypatch):
    """No task reads all documents, and every file is read in several splits all the same."""
    docs = [(i, "en" if i % 2 else None, None if i == 7 else f'line {i}, "quoted"\nnext line\n' * (2000 + i)) for i in range(40)]
    kinds = "doc_id long, lang string, text string"
    spark.createDataFrame(docs, kinds).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    paths, read = [], crm_queries.read_split_csv
    monkeypatch.setattr(crm_queries, "read_split_csv", lambda s, path: paths.append(path) or read(s, path))
    got = entry.queries()["import_csv_splits"](spark, str(tmp_path)).collect()
    wanted = [(str(i), lang, hashlib.md5((text or "").encode()).hexdigest()) for i, lang, text in docs]
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    sizes = [len(r.content) for r in spark.read.format("binaryFile").load(f"{paths[0]}/*.csv").collect()]
    assert len(sizes) == 4 and min(sizes) > 2 * (256 << 10)

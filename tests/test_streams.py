"""Incremental jobs: several runs on one checkpoint."""

import json
import os
import re

from siteweave.sources import tables
from siteweave.streaming import history, jobs

SCHEMA = "domain string, status string, leads long, ts timestamp"


def _drop(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records), encoding="utf-8")


def _record(domain, status="completed", ts="2024-01-01T00:00:00"):
    return {"domain": domain, "status": status, "leads": 2, "ts": ts}


def test_incremental_export_resumes(spark, tmp_path):
    landing, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        arrivals = jobs.read_arrivals(spark, str(landing), SCHEMA)
        exports = {"companies": lambda d: d.select("domain", "status"), "leads": lambda d: d.select("leads")}
        jobs.incremental_export(arrivals, exports, out, progress, "csv")
        leads = tables.read_csv(spark, f"{out}/leads", "leads long").count()
        domains = sorted(
            r.domain for r in tables.read_csv(spark, f"{out}/companies", "domain string, status string").collect()
        )
        assert leads == len(domains)
        return domains

    _drop(landing, "1.json", [_record("a.com"), _record("b.com"), _record(" A.com")])
    assert run() == ["a.com", "b.com"]
    _drop(landing, "2.json", [_record("b.com"), _record("c.com")])
    assert run() == ["a.com", "b.com", "c.com"]
    assert run() == ["a.com", "b.com", "c.com"]


def test_first_domains_and_stats(spark, tmp_path):
    landing = tmp_path / "in"
    _drop(landing, "1.json", [_record("a.com"), _record("a.com", "failed"), _record("b.com")])

    def firsts(fn, name):
        arrivals = jobs.read_arrivals(spark, str(landing), SCHEMA)
        jobs.run_available(fn(arrivals).select("domain"), str(tmp_path / name), str(tmp_path / f"{name}-cp"))
        return sorted(r.domain for r in spark.read.schema("domain string").parquet(str(tmp_path / name)).collect())

    assert firsts(jobs.first_domains, "plain") == ["a.com", "b.com"]
    within = lambda d: jobs.first_domains_within(d, "ts")
    assert firsts(within, "within") == ["a.com", "b.com"]
    path, progress = str(tmp_path / "stats"), str(tmp_path / "stats-cp")

    def stats():
        jobs.run_stats(jobs.progress_stats(jobs.read_arrivals(spark, str(landing), SCHEMA)), path, progress)
        rows = spark.read.schema("status string, records long, leads long").parquet(path).collect()
        return {r.status: (r.records, r.leads) for r in rows}

    assert stats() == {"completed": (2, 4), "failed": (1, 2)}
    _drop(landing, "2.json", [_record("c.com", "failed")])
    assert firsts(jobs.first_domains, "plain") == ["a.com", "b.com", "c.com"]
    assert stats() == {"completed": (2, 4), "failed": (2, 4)}


def test_upsert_knows_earlier_batches(spark, tmp_path):
    landing, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    crm = spark.createDataFrame([("7", "old.com")], "id string, domain string")
    schema = "seq long, domain string, success string"

    def run():
        jobs.upsert_actions(jobs.read_arrivals(spark, str(landing), schema), crm, out, progress)
        rows = spark.read.parquet(f"{out}/actions").orderBy("seq").select("seq", "action", "id").collect()
        return [tuple(r) for r in rows]

    _drop(landing, "1.json", [
        {"seq": 1, "domain": "old.com", "success": "true"}, {"seq": 2, "domain": "new.com", "success": "true"},
    ])
    first = [(1, "update", "7"), (2, "create", None)]
    assert run() == first
    _drop(landing, "2.json", [
        {"seq": 3, "domain": "new.com", "success": "true"}, {"seq": 4, "domain": "x.com", "success": "true"},
    ])
    second = first + [(3, "update", "new:new.com"), (4, "create", None)]
    assert run() == second
    assert run() == second
    assert sorted(r.key for r in history.KeyHistory(spark, f"{out}/created", "key").table(2).collect()) == ["new.com", "x.com"]


def test_history_runs():
    for n in (0, 1, 9, 10, 11, 99, 100, 237, 1000):
        runs = history.runs_before(n)
        assert [b for first, last in runs for b in range(first, last + 1)] == list(range(n))
        assert len(runs) <= 9 * max(1, len(str(n)))
    assert history.runs_before(237)[-2:] == [(235, 235), (236, 236)]
    assert history.merges_after(8) == [] and history.merges_after(9) == [(0, 9)]
    assert history.merges_after(99) == [(90, 99), (0, 99)]


def test_history_over_many_batches(spark, tmp_path, monkeypatch):
    """Merged runs, repeated batches, and a batch that reads only the buckets of its keys."""
    monkeypatch.setattr(history, "BASE", 3)
    kept = history.KeyHistory(spark, str(tmp_path / "h"), "k", "k string, n int", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, n int")
    for b in range(10):
        kept.add(frame([] if b == 4 else [(f"k{b}", b)]), b)
        if b in (3, 8):  # repeated after a failure
            kept.add(frame([(f"k{b}", b)]), b)
        assert {r.k for r in kept.table(b + 1).collect()} == {f"k{i}" for i in range(b + 1) if i != 4}
    asked = frame([("k2", 0), ("k9", 0), ("new", 0)])
    assert {(r.k, r.n) for r in kept.known(asked, 10).collect()} == {("k2", 2), ("k9", 9)}
    assert kept.known(asked, 0).count() == 0
    # runs that were merged are gone after the next batch: 0-8 and 9 are left
    assert sorted(p.name for p in (tmp_path / "h").iterdir()) == ["run=0-8", "run=9-9"]
    plan = kept.known(frame([("k2", 0)]), 10)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d", plan)) == 2


def test_restarted_jobs_over_many_batches(spark, tmp_path, monkeypatch):
    """Twelve files, several runs of the job, each batch one file: as if all had been one table."""
    monkeypatch.setattr(history, "BASE", 3)
    landing, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    crm = spark.createDataFrame([("7", "d3.com")], "id string, domain string")
    schema = "seq long, domain string, success string"
    seen, want = {"d3.com"}, []
    for n in range(12):
        rows = [{"seq": 10 * n + i, "domain": f"d{(n * i) % 7}.com", "success": "true"} for i in range(4)]
        _drop(landing, f"{n:02}.json", rows)
        os.utime(landing / f"{n:02}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # files arrive in this order
        fresh = set()
        for r in rows:
            new = r["domain"] not in seen | fresh
            fresh.add(r["domain"])
            id_ = None if r["domain"] not in seen else "7" if r["domain"] == "d3.com" else f"new:{r['domain']}"
            want.append((r["seq"], "create" if new else "update", id_))
        seen |= fresh
        if n % 4 == 3:
            arrivals = jobs.read_arrivals(spark, str(landing), schema, max_files=1)
            jobs.upsert_actions(arrivals, crm, out, progress)
    got = spark.read.parquet(f"{out}/actions").orderBy("seq").select("seq", "action", "id").collect()
    assert [tuple(r) for r in got] == want

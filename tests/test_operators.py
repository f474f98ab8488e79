"""Operators on hand-made inputs with known results."""

import random

import pytest

from pyspark.sql import functions as F

from siteweave import schemas
from siteweave.functions import crm as crm_fn
from siteweave.operators import crawl, crm, domain_list, enrich, export, pages, reports
from siteweave.plans import skew
from siteweave.operators import imports, text_search, updates
from siteweave.plans.running import running_counts
from siteweave.plans.stages import bucketed
from siteweave.sources.split_csv import read_split_csv
from siteweave.sources import lines, tables

BODY = " word" * 40


def _lines(spark, entries):
    return spark.createDataFrame(list(enumerate(entries, 1)), "line_no long, line string")


def test_domain_list(spark):
    mixed = _lines(
        spark,
        ["example.com", "# This is a comment", "", "https://test.com/page", "duplicate.com", "duplicate.com"],
    )
    accepted = domain_list.accept(mixed).orderBy("line_no").collect()
    assert [r.domain for r in accepted] == ["example.com", "test.com", "duplicate.com"]
    assert [r.message for r in domain_list.reject(mixed).collect()] == [
        "Line 6: Duplicate domain 'duplicate.com'"
    ]
    odd = _lines(
        spark,
        ["https://example.com", "http://test.com/page", "www.site.com", "test", "", "domain.com",
         "sub.domain.com", "domain.co.uk", "192.168.1.1", "domain..com", "-domain.com", "domain-.com"],
    )
    assert domain_list.accept(odd).count() == 10
    assert [r.message for r in domain_list.reject(odd).collect()] == ["Line 4: Invalid domain/URL 'test'"]
    assert domain_list.accept(_lines(spark, ["a.com"]).limit(0)).count() == 0
    first = domain_list.limit_domains(domain_list.accept(odd), 2).collect()
    assert sorted(r.domain for r in first) == ["example.com", "test.com"]
    assert domain_list.limit_domains(domain_list.accept(odd), 0).count() == 10


def test_line_numbers_over_many_splits(spark, tmp_path):
    expected = [f"host{i}.com" if i % 7 else "" for i in range(5000)]
    (tmp_path / "list.txt").write_text("\n".join(expected) + "\n", encoding="utf-8")
    (tmp_path / "other.txt").write_text("a.com\nb.com", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {(r.file.rsplit("/", 1)[1], r.line_no): r.line for r in rows}
    assert got == {("list.txt", i): v for i, v in enumerate(expected, 1)} | {
        ("other.txt", 1): "a.com", ("other.txt", 2): "b.com",
    }


GRAPH = {
    "https://a.com": "<a href='/b'>1</a><a href='/c#x'>2</a><a href='https://www.a.com/d/'>3</a>"
    "<a href='mailto:x@a.com'>4</a><a href='#top'>5</a><a href='javascript:void(0)'>6</a>"
    "<a href='https://other.com/z'>7</a>" + BODY,
    "https://a.com/b": "<a href='/e'>1</a><a href='../a.com/b'>2</a><a href='https://a.com'>3</a> me@a.com" + BODY,
    "https://a.com/c": "<a href='/f'>short</a>",
    "https://www.a.com/d": "<a href='//sub.a.com/g'>1</a>" + BODY,
    "https://a.com/e": "<a href='/h'>1</a>" + BODY,
    "https://a.com/f": BODY,
    "https://a.com/h": BODY,
}


def _crawl(spark, tmp_path, max_depth=2, max_pages=10):
    stored = spark.createDataFrame(
        [(i, u, h) for i, (u, h) in enumerate(GRAPH.items())] + [(99, "https://a.com/b", "copy")],
        "page_id long, url string, html string",
    )
    rows = crawl.page_table(stored)
    starts = spark.createDataFrame([("a.com", "https://a.com"), ("gone.org", "https://gone.org")],
                                   "domain string, url string")
    visited = crawl.crawl(starts, rows, max_depth, max_pages)
    return crawl.crawled_pages(visited, rows)


def test_crawl_order_and_caps(spark, tmp_path):
    crawled = _crawl(spark, tmp_path).where("domain = 'a.com'").orderBy("rank").collect()
    assert [(r.url, r.depth, r.success) for r in crawled] == [
        ("https://a.com", 0, True), ("https://a.com/b", 1, True), ("https://a.com/c", 1, False),
        ("https://www.a.com/d", 1, True), ("https://a.com/e", 2, True),
        ("https://a.com/a.com/b", 2, False), ("https://sub.a.com/g", 2, False),
    ]
    three = _crawl(spark, tmp_path, max_pages=3).where("domain = 'a.com'").orderBy("rank").collect()
    assert [r.url for r in three] == ["https://a.com", "https://a.com/b", "https://a.com/c"]
    flat = _crawl(spark, tmp_path, max_depth=0).collect()
    assert sorted(r.url for r in flat) == ["https://a.com", "https://gone.org"]
    counts = crawl.depth_counts(_crawl(spark, tmp_path)).orderBy("depth").collect()
    assert [(r.depth, r.pages, r.successful_pages) for r in counts] == [(0, 2, 1), (1, 3, 2), (2, 3, 1)]


def test_stored_spelling_of_urls_does_not_matter(spark):
    """Trailing slashes and fragments of stored pages and starts; the second spelling is a copy."""
    graph = {
        "https://a.com/": "<a href='/about/'>1</a><a href='/x'>2</a>" + BODY,
        "https://a.com/about/": "<a href='team?x=1#y'>1</a>" + BODY,
        "https://a.com/x#top": BODY,
        "https://a.com/about/team?x=1": BODY,
        "https://a.com/about": "copy",
    }
    stored = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(graph.items())], "page_id long, url string, html string")
    for pages_of in (stored, stored.drop("page_id").where("html <> 'copy'")):
        rows = crawl.page_table(pages_of)
        for start in ("https://a.com", "https://a.com/", "https://a.com/#a"):
            starts = spark.createDataFrame([("a.com", start)], "domain string, url string")
            crawled = crawl.crawled_pages(crawl.crawl(starts, rows), rows).orderBy("rank").collect()
            assert [(r.url, r.depth, r.success) for r in crawled] == [
                ("https://a.com/", 0, True), ("https://a.com/about/", 1, True), ("https://a.com/x#top", 1, True),
                ("https://a.com/about/team?x=1", 2, True),
            ]


def test_combining_leaves_no_page_out(spark):
    rows = [("a.com", f"https://a.com/{i}", True, f"text {i}", [f"m{i}@a.com"], i) for i in range(1, 21)]
    kinds = "domain string, url string, success boolean, content string, emails array<string>, rank int"
    (r,) = pages.combine_pages(spark.createDataFrame(rows, kinds)).collect()
    assert r.pages_scraped == 20 and len(r.emails) == 20 and r.content.count("=== Page: ") == 20


def test_page_table_keeps_only_reachable_pages(spark):
    other = [("https://b.org/x", BODY), ("https://nota.com/", BODY)]
    for with_id in (True, False):
        data = [(i, u, h) for i, (u, h) in enumerate([*GRAPH.items(), *other])]
        stored = spark.createDataFrame(data, "page_id long, url string, html string")
        stored = stored if with_id else stored.drop("page_id")
        starts = crawl.domain_starts(spark.createDataFrame([("a.com",)], "domain string"))
        rows = crawl.page_table(stored, starts=starts)
        assert sorted(r.url for r in rows.collect()) == sorted(GRAPH)
        visited = crawl.crawl(starts, rows).orderBy("rank").collect()
        assert [r.url for r in visited][:2] == ["https://a.com", "https://a.com/b"] and len(visited) == 7


def _queue_crawl(links, ok, start, depth, cap):
    """Plain queue crawl, for comparison."""
    queue, seen, out = [(start, 0)], set(), []
    while queue and len(out) < cap:
        url, d = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        out.append((url, d))
        if ok.get(url) and d < depth:
            queue += [(u, d + 1) for u in links[url] if u not in seen]
    return out


def test_crawl_equals_queue_on_random_graphs(spark):
    rng = random.Random(3)
    stored, want = [], {}
    for g in range(12):
        domain = f"g{g}.com"
        urls = [f"https://{domain}"] + [f"https://{domain}/p{i}" for i in range(30)]
        links = {u: [rng.choice(urls) for _ in range(rng.randint(0, 25))] for u in urls}
        ok = {u: rng.random() < 0.8 for u in urls}
        for u in urls:
            anchors = "".join(f"<a href='{v}'>l</a>" for v in links[u])
            stored.append((u, anchors + (BODY if ok[u] else "")))
            ok[u] = ok[u] or len(" ".join("l" for _ in links[u])) > 100
        want[domain] = _queue_crawl(links, ok, urls[0], 3, 12)
    rows = crawl.page_table(spark.createDataFrame(stored, "url string, html string"))
    starts = spark.createDataFrame([(d, f"https://{d}") for d in want], "domain string, url string")
    got = crawl.crawl(starts, rows, 3, 12).orderBy("domain", "rank").collect()
    for domain, expected in want.items():
        assert [(r.url, r.depth) for r in got if r.domain == domain] == expected


def test_combine_pages(spark, tmp_path):
    crawled = _crawl(spark, tmp_path)
    combined = {r.domain: r for r in pages.combine_pages(crawled).collect()}
    a = combined["a.com"]
    assert a.url == "https://a.com" and a.success and a.pages_scraped == 7
    assert a.emails == ["me@a.com", "x@a.com"]  # raw HTML counts, so does a mailto link
    assert a.content.startswith("=== Page: https://a.com ===\n1 2 3")
    assert a.content.count("=== Page:") == 4
    assert combined["gone.org"].error == "No successful pages" and not combined["gone.org"].success
    wanted = spark.createDataFrame([("a.com",), ("new.net",)], "domain string")
    full = {r.domain: r for r in pages.with_missing_domains(pages.combine_pages(crawled), wanted).collect()}
    assert full["new.net"].error == "No pages scraped" and full["new.net"].url == ""


def _content(spark, rows):
    data = [(d, f"https://{d}", ok, None, text, emails, error) for d, ok, text, emails, error in rows]
    return spark.createDataFrame(data, schemas.SITE_CONTENT)


def test_enrich_company_and_leads(spark):
    content = _content(spark, [
        ("a.com", True, "x" * 60, ["john.doe@a.com", "info@a.com"], None),
        ("b.com", False, "", [], None),
        ("c.com", True, "short", [], None),
        ("d.com", False, "", ["x@d.com"], "Connection timeout"),
    ])
    answer = '{"company": {"industry": "Retail"}, "confidence_score": 9}'
    responses = spark.createDataFrame([(d, answer) for d in ("a.com", "c.com", "a.com")],
                                      "key string, response_text string")
    rows = {r.domain: r for r in enrich.enrich_company(
        content, enrich.from_responses(responses), F.lit("t")).collect()}
    assert rows["a.com"].analysis.industry == "Retail" and rows["a.com"].error is None
    assert rows["b.com"].error == "Scraping failed: Unknown error" and not rows["b.com"].success
    assert rows["c.com"].success and rows["c.com"].analysis is None
    assert rows["d.com"].error == "Scraping failed: Connection timeout"
    lead = '{"buyer_persona": "Technical Buyer", "lead_score_adjustment": 30, "confidence": 0.85, "reasoning": "r"}'
    leads = spark.createDataFrame([("john.doe@a.com", lead), ("x@d.com", lead)],
                                  "key string, response_text string")
    enriched = enrich.enrich_leads(content, leads, F.lit("t"))
    by_domain = {r.domain: r for r in enriched.collect()}
    assert [x.email for x in by_domain["a.com"].leads] == ["john.doe@a.com", "info@a.com"]
    assert by_domain["a.com"].leads[0].analysis.lead_score_adjustment == 30
    assert by_domain["a.com"].leads[1].analysis is None
    assert by_domain["b.com"].leads == [] and by_domain["b.com"].success
    assert by_domain["d.com"].leads[0].analysis is None
    exported = {r.email: r for r in export.lead_export_rows(enriched).collect()}
    assert exported["john.doe@a.com"].buyer_persona == "Technical Buyer"
    assert exported["x@d.com"].lead_score_adjustment == 0
    companies = {r.domain: r for r in export.company_export_rows(enrich.enrich_company(
        content, enrich.from_responses(responses), F.lit("t"))).collect()}
    assert companies["a.com"].emails_found == "john.doe@a.com;info@a.com"
    assert companies["c.com"].confidence_score == 0.0


def test_bulk_split(spark):
    content = _content(spark, [("a.com", True, "x" * 60, [], None), ("b.com", False, "", [], "down")])
    lead = '{"buyer_persona": "p", "lead_score_adjustment": 1, "confidence": 0.5, "reasoning": "r"}'
    answers = spark.createDataFrame([("u@a.com", lead)], "key string, response_text string")
    contacts = spark.createDataFrame(
        [("1", "u@a.com"), ("2", None), ("3", "plain"), ("4", "v@b.com"), ("5", "w@a.com"), ("6", "u@a.com")],
        "id string, email string",
    )
    bulk = enrich.bulk_leads(contacts, content, answers, hot_rows=2)
    assert sorted(r.id for r in enrich.bulk_results(bulk).collect()) == ["1", "6"]
    errors = sorted(r.error.split(":")[0] for r in enrich.bulk_errors(bulk).collect())
    assert errors == ["Could not extract domain from email", "Failed to analyze content for w@a.com",
                      "Failed to scrape b.com", "Lead missing email"]


def test_import_counts(spark):
    crm_rows = spark.createDataFrame([("12345", "test.com"), ("9", "test.com")], "id string, domain string")
    records = spark.createDataFrame(
        [(1, "test.com", "True", "d"), (2, "new.com", "true", "d"), (3, "new.com", "TRUE", "d"),
         (4, " ", "true", "d"), (5, "bad.com", "false", "d"), (6, "new.com", "true", "d")],
        "seq long, domain string, success string, business_type string",
    )
    for hot_rows in (None, 1):
        actions = crm.import_company_actions(records, crm_rows, hot_rows)
        got = {r.seq: (r.action, r.id, r.created_by) for r in actions.collect()}
        assert got == {
            1: ("update", "12345", None), 2: ("create", None, None), 3: ("update", None, 2),
            6: ("update", None, 2),
        }
    summary = reports.import_summary(records, actions, "companies").first()
    assert (summary.total, summary.imported, summary.updated, summary.failed) == (6, 1, 3, 0)
    empty = reports.import_summary(records.limit(0), actions.limit(0), "companies").first()
    assert (empty.status, empty.total, empty.imported) == ("completed", 0, 0)


def test_import_properties(spark):
    records = spark.createDataFrame([("a.com", "B2B", "", "0.9")],
                                    "domain string, business_type string, naics_code string, confidence_score string")
    props = records.select(crm_fn.import_company_properties(records).alias("p")).first().p
    assert props == {"domain": "a.com", "name": "a.com", "business_type_description": "B2B",
                     "confidence_score": "0.9", "enrichment_status": "completed", "enrichment_date": ""}


def test_crm_csv_round_trip(spark, tmp_path):
    results = spark.createDataFrame(
        [(" A.com ", "A, \"Inc\"", "line\nbreak", None), ("b.com", None, "", "x" * 300)],
        "domain string, name string, company_summary string, enrichment_error string",
    )
    rows = export.crm_company_csv(results)
    assert rows.columns == ["Company Domain Name", "Name", "Company Description", "Enrichment Error",
                            "Enrichment Status"]
    path = str(tmp_path / "out")
    tables.write_csv(rows, path)
    back = {r["Company Domain Name"]: r for r in tables.read_csv(spark, path).collect()}
    assert back["a.com"]["Name"] == 'A, "Inc"' and back["a.com"]["Company Description"] == "line break"
    assert back["b.com"]["Name"] == "b.com" and len(back["b.com"]["Enrichment Error"]) == 255
    done = tables.existing_domains(tables.read_csv(spark, path))
    asked = spark.createDataFrame([(1, "a.com"), (2, "c.com")], "line_no long, domain string")
    assert [r.domain for r in domain_list.remaining(asked, done).collect()] == ["c.com"]


def test_import_csv_skips_empty_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text('domain,success\na.com,True\n,\n"x ""y""",\n', encoding="utf-8")
    rows = tables.non_empty_rows(tables.read_csv(spark, str(tmp_path / "in.csv"))).collect()
    assert [r.domain for r in rows] == ["a.com", 'x "y"']


def test_lookup_company_tiers(spark):
    companies = spark.createDataFrame(
        [("3", "n", "www.a.com a.com", None, None), ("2", "n", "a.com", None, None),
         ("4", "n", None, "https://b.com/x", "a.com"), ("5", "the c.com shop", None, None, None),
         ("6", None, None, None, "see MYC.COM now")],
        "id string, name string, domain string, website string, description string",
    )
    asked = spark.createDataFrame([("https://A.com/",), ("b.com",), ("c.com",), ("none.org",)], "domain string")
    got = {r.domain: (r.tier, r.id) for r in crm.lookup_company(asked, companies).collect()}
    assert got == {"https://A.com/": (1, "2"), "b.com": (2, "4"), "c.com": (3, "5"), "none.org": (None, None)}


def test_scrape_report(spark):
    metrics = spark.createDataFrame(
        [("a", 2.0, True, None, 100, 1), ("b", 4.0, False, "timeout", 50, 9), ("c", 0.0, False, None, 0, 0)],
        schemas.SCRAPE_METRICS,
    )
    r = reports.scrape_report(metrics).first()
    assert (r.total_domains, r.successful_scrapes, r.failed_scrapes) == (3, 1, 2)
    assert (r.total_duration, r.average_duration, r.min_duration, r.max_duration) == (6.0, 3.0, 2.0, 4.0)
    assert (r.domains_per_minute, r.total_content_size, r.total_emails_found) == (30.0, 100, 1)
    assert {x.error: x.failures for x in reports.scrape_errors(metrics).collect()} == {"timeout": 1, "Unknown": 1}
    none = reports.scrape_report(metrics.limit(0)).first()
    assert (none.total_domains, none.total_duration, none.domains_per_minute) == (0, 0.0, 0.0)


def test_reports_on_empty_input(spark):
    empty = spark.createDataFrame(
        [], "enrichment_status string, description string, city string, state string, country string, site_content string"
    )
    r = reports.enrichment_coverage(empty).first()
    assert (r.total, r.enriched_percent, r.remaining) == (0, 0.0, 0)


def test_attach_spreads_hot_and_null_keys(spark):
    rows = spark.createDataFrame(
        [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 10}") for i in range(600)],
        "id long, k string",
    )
    lookup = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 3)], "k string, v int")
    for how in ("left", "inner", "left_anti"):
        plain = rows.join(lookup, "k", how)
        salted = skew.attach(rows, lookup, "k", "id", how, hot_rows=50, salts=7)
        assert sorted(r.id for r in salted.collect()) == sorted(r.id for r in plain.collect())
    joined = skew.attach(rows, lookup, "k", "id", hot_rows=50, salts=7)
    assert {(r.id, r.v) for r in joined.collect()} == {
        (r.id, r.v) for r in rows.join(lookup, "k", "left").collect()
    }


def test_mark_first(spark):
    rows = spark.createDataFrame([(5, "a"), (2, "a"), (3, None), (4, "b")], "seq long, k string")
    got = {r.seq: r.first for r in skew.mark_first(rows, "k", "seq", "first").collect()}
    assert got == {5: False, 2: True, 3: False, 4: True}


def test_running_counts_equal_one_long_scan(spark):
    rng = random.Random(5)
    data = [(i, rng.randint(0, 2), rng.random() < 0.4) for i in range(1000)]
    df = spark.createDataFrame(data, "seq long, run int, flag boolean")
    got = running_counts(df, "run", "seq", {"done": F.col("flag"), "total": F.lit(True)}, chunk=17).collect()
    counts = {}
    want = {}
    for seq, run, flag in data:
        done, total = counts.get(run, (0, 0))
        counts[run] = (done + flag, total + 1)
        want[seq] = counts[run]
    assert {r.seq: (r.done, r.total) for r in got} == want


def test_batch_progress_counts_records_without_a_site(spark):
    rows = [(i, 0, f"c{i}", None if i == 9 else f"c{i}.com", None, i % 2 == 0, None) for i in range(12)]
    outcomes = spark.createDataFrame(
        rows, "seq long, run int, company string, domain string, website string, enriched boolean, error string"
    )
    got = reports.batch_progress(outcomes, "run", "seq", chunk=4).orderBy("seq").collect()
    assert [(r.seq, r.enriched, r.total) for r in got] == [(4, 3, 5)]


def test_apply_to_batches(spark):
    df = spark.createDataFrame([("a",), ("",)], "name string")

    def fn(record):
        if not record["name"]:
            raise KeyError("name")
        return {"size": len(record["name"])}

    rows = enrich.apply_to_batches(df, fn, "size long").collect()
    assert [(r.size, r.type) for r in rows if r.error is None] == [(1, None)]
    assert [r.type for r in rows if r.error is not None] == ["KeyError"]


def test_failed_rows_and_dump(spark):
    errors = spark.createDataFrame([("a.com", "e" * 300)], "domain string, error string")
    row = enrich.failed_export_rows(errors).first()
    assert row.name == "a.com" and row.enrichment_status == "failed" and len(row.enrichment_error) == 255
    df = spark.createDataFrame([(True, None, ["x"], 1.5)], "b boolean, a string, c array<string>, d double")
    dumped = tables.dump(df).first()
    assert dumped.asDict() == {"a": "", "b": "true", "c": '["x"]', "d": "1.5"}


def test_lookup_company_in_free_text(spark):
    """Keys with spaces, of forty lengths and of less than a gram, in texts of 30 KB."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß. ") for _ in range(rng.randint(1, 9)))
    texts = [(f"{i:04}", word(), " ".join(word() for _ in range(5000))) for i in range(40)] + [("9999", None, None)]
    companies = spark.createDataFrame(
        [(i, n, None, None, d) for i, n, d in texts], "id string, name string, domain string, website string, description string"
    )
    keys = {t[2][k : k + n].lower().strip("/") for k, n in zip(range(100, 4000, 97), range(1, 41)) for t in texts[:40:13]}
    keys |= {"a", "é", "zz top", "x" * 50, texts[7][1].lower()} - {""}
    asked = spark.createDataFrame([(k,) for k in keys], "domain string")
    got = {r.domain: r.id for r in crm.lookup_company(asked, companies).collect()}
    want = {}
    for k in keys:
        hits = [i for i, n, d in texts if n is not None and (k in n.lower() or k in d.lower())]
        want[k] = min(hits, default=None)
    assert got == want and None in want.values()


def test_containing_splits_common_grams(spark):
    texts = spark.createDataFrame([(i, f"row {i} of all", "x" if i % 2 else None) for i in range(60)], "id int, a string, b string")
    keys = spark.createDataFrame([(k,) for k in ("of all", "row 7", "row 7 of", "", "none")], "key string")
    got = text_search.containing(keys, texts, ["a", "b"], hot_rows=5).collect()
    want = [(k, i) for k in ("of all", "row 7", "row 7 of") for i in range(60) if k in f"row {i} of all"]
    assert sorted((r.key, r.id) for r in got) == sorted(want)


def test_running_counts_of_sparse_numbers(spark):
    """Numbers far apart, one run that holds nearly everything, rows without a run; ranges are bound by rows."""
    rng = random.Random(6)
    numbers = rng.sample(range(-(1 << 60), 1 << 60), 3000)
    data = [(s, None if i % 50 == 0 else 1 if i % 40 else 2, rng.random() < 0.4) for i, s in enumerate(numbers)]
    df = spark.createDataFrame(data, "seq long, run int, flag boolean")
    got = running_counts(df, "run", "seq", {"done": F.col("flag"), "total": F.lit(True)}, chunk=100)
    counts, want = {}, {}
    for seq, run, flag in sorted(data, key=lambda r: r[0]):
        done, total = counts.get(run, (0, 0))
        counts[run] = want[seq] = (done + flag, total + 1)
    assert {r.seq: (r.done, r.total) for r in got.collect()} == want


def test_crawl_steps_move_only_the_frontier(spark):
    """The links lie in buckets of their URLs; a step's join does not shuffle them."""
    links = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"), F.array(F.lit("x")).alias("links"))
    frontier = spark.range(10).select(F.concat(F.lit("u"), "id").alias("url"), F.lit("d").alias("domain"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        with bucketed(links, "links", "url") as edges:
            joined = frontier.join(edges, "url")
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert joined.count() == 10
            name = edges.inputFiles()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and name
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("siteweave_links")]


CSV_FILES = {
    "plain": 'k,text\n1,a\n2,"b ""q"" c"\n',
    "breaks": 'k,text\n1,"a\nb"\n"2\n","x, ""y\n\n""\n"\n\n3,z\n4,\n"",""\n',
    "carriage": 'k,text\r\n1,a\r\n2,"b c"\r\n',
    "header": '"k","te\nxt"\n1,2\n',
    "long": "k,text\n" + "".join(f'{i},"{"w " * (i % 40)}\n{i}"\n' if i % 3 else f"{i},p{i}\n" for i in range(900)),
}


@pytest.mark.parametrize("name", sorted(CSV_FILES))
@pytest.mark.parametrize("split", ["64", "1m"])
def test_split_csv_equals_one_reader(spark, tmp_path, name, split):
    """Whatever bytes the splits end at, inside quoted fields too, the rows are those of a whole-file reader."""
    path = tmp_path / "in.csv"
    path.write_bytes(CSV_FILES[name].encode())
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997" if name == "long" and split == "64" else split)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_split_csv(spark, str(path))
        got = sorted(map(tuple, df.collect()), key=repr)
        tasks = spark.read.text(str(path)).rdd.getNumPartitions()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    whole = tables.read_csv(spark, str(path))
    assert df.columns == whole.columns
    assert got == sorted(map(tuple, whole.collect()), key=repr)
    assert split != "64" or tasks > 1


def test_split_csv_of_nothing(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    assert read_split_csv(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    only = read_split_csv(spark, str(tmp_path / "head.csv"))
    assert only.columns == ["a", "b"] and only.count() == 0


def test_import_runs_report_the_state_of_their_source(spark, tmp_path):
    crm_rows = spark.createDataFrame([("7", "old.com")], "id string, domain string")
    run = lambda name, kind="companies", **more: imports.run_import(spark, f"file:{tmp_path}/{name}", kind, crm_rows, **more).first().asDict()
    (tmp_path / "full.csv").write_text("domain,success\nold.com,True\nnew.com,True\nnew.com,True\n,\nx.com,False\n")
    got = run("full.csv")
    assert (got["status"], got["total"], got["imported"], got["updated"], got["failed"]) == ("completed", 4, 1, 2, 0)
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("domain,success\n")
    for name in ("none.csv", "head.csv"):
        got = run(name)
        assert (got["status"], got["total"], got["imported"]) == ("completed", 0, 0)
    assert run("missing.csv")["error"] == "source does not exist"
    assert run("full.csv", "deals")["error"] == "Unsupported object type: deals"
    assert (run("full.csv", connected=False)["status"], run("full.csv", connected=False)["reason"]) == ("skipped", "no_token")
    (tmp_path / "broken.csv.gz").write_bytes(b"this is no gzip stream at all")
    assert run("broken.csv.gz")["error"].startswith("source cannot be read")


def test_used_columns_are_seen_during_the_write(spark):
    leads = spark.createDataFrame([("a.b@x.com", "x.com", None), (None, "y.com", "")], "email string, domain string, buyer_persona string")
    rows = export.crm_lead_csv(leads)
    assert rows.columns[0] == "Email" and "Buyer Persona" not in rows.columns and rows.count() == 2
    assert export.crm_lead_csv(leads.limit(0)).columns == []


def test_enrichment_runs(spark):
    companies = spark.createDataFrame(
        [(1, "1", "a.com", None), (2, "2", "a.com", None), (3, "3", None, None), (4, "4", "x.y", None), (5, "5", "bad.com", None),
         (6, "6", "mute.com", None), (7, "7", None, "https://www.gone.com/")],
        "n long, id string, domain string, website string",
    )
    content = spark.createDataFrame(
        [("a.com", True, "x" * 70_000, None), ("bad.com", False, "", "timeout"), ("mute.com", True, "y" * 200, None)],
        "domain string, success boolean, content string, error string",
    )
    answer = '{"company": {"city": "Bonn"}, "business_intelligence": {}, "confidence_score": 7}'
    analyses = enrich.company_analyses(spark.createDataFrame([("a.com", answer)], "key string, response_text string"))
    rows = updates.company_enrichment(companies, "n", content, analyses, F.to_timestamp(F.lit("2024-01-01")), hot_rows=2)
    got = {r.id: r for r in rows.collect()}
    assert {i: r.state for i, r in got.items()} == {
        "1": "completed", "2": "already_processed", "3": "no_domain", "4": "no_domain", "5": "scrape_failed",
        "6": "analysis_failed", "7": "scrape_failed",
    }
    assert [i for i, r in got.items() if r.action] == ["1"] and got["1"].properties["city"] == "Bonn"
    assert len(got["1"].properties["site_content"]) == 65_536
    assert got["4"].reason == "Invalid domain: x.y" and got["5"].reason == "Scraping failed: timeout"

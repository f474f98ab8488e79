"""Column functions against expected values and the Python standard library."""

import random
from html.parser import HTMLParser
from html.entities import html5
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from siteweave.functions import analysis, domains, html, names, text


def test_extract_domain(evaluate):
    cases = {
        "user@example.com": "example.com",
        "admin@sub.example.com": "sub.example.com",
        "test@EXAMPLE.COM": "example.com",
        "http://www.example.com": "example.com",
        "example.com/page": "example.com",
        "": None,
        "not-a-domain": None,
        "@": None,
        "192.168.1.1": "192.168.1.1",
        "domain..com": "domain..com",
        "-domain.com": "-domain.com",
        "https://a.com:8080/x?y#z": "a.com",
        "x@www.site.com": "www.site.com",
        "https://x.com/@user.name": "user.name",
        "a.b": None,
        " ftp://Files.Example.org/pub ": "files.example.org",
        None: None,
    }
    assert evaluate(domains.extract_domain, list(cases)) == list(cases.values())


def test_normalize_url(evaluate):
    cases = {
        "example.com": "https://example.com",
        "http://example.com": "http://example.com",
        " www.example.com ": "https://www.example.com",
        "": "",
        None: "",
        "HTTP://x.y": "https://HTTP://x.y",
    }
    assert evaluate(domains.normalize_url, list(cases)) == list(cases.values())


def test_url_host_and_keys(evaluate):
    assert evaluate(domains.url_host, ["https://U:p@WWW.A.com:80/x", "nohost", "//b.org?x", None]) == [
        "a.com", None, "b.org", None,
    ]
    assert evaluate(domains.search_key, ["HTTPS://A.com/", "a.com/x/"]) == ["a.com", "a.com/x"]
    assert evaluate(domains.domain_safe, ["https://a/b"]) == ["https__a_b"]


def test_resolve_url_like_the_standard_library(spark):
    bases = ["https://a.com", "https://a.com/", "https://a.com/b", "https://a.com:80/b/c/d.html?x=1#f",
             "http://a.com/x//y/"]
    hrefs = ["/b", "b", "./b", "../b", "../../../b", "?q=1", "//h.com/z", "https://o.com/a/../b", "b/",
             "b/.", "b/..", "c?x=/../y", "..", ".", "mailto:x@y.z", "/a//b", "/a/./b/../c#f", "https:rel",
             "b#x", "tel:1", "/..", "/a/b/..", "//h.com", "x//y"]
    rows = [(b, h) for b in bases for h in hrefs]
    df = spark.createDataFrame(rows, "b string, h string")
    got = df.select("b", "h", domains.resolve_url(F.col("b"), F.col("h")).alias("u")).collect()
    assert [(r.b, r.h, r.u) for r in got] == [(b, h, urljoin(b, h)) for b, h in rows]


class _Text(HTMLParser):
    """Visible text by the standard library's parser, for comparison."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out, self.part, self.hidden = [], [], False

    def flush(self):
        piece = "".join(self.part).strip()
        self.part = []
        if piece:
            self.out.append(piece)

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.hidden = tag in ("script", "style")

    def handle_endtag(self, tag):
        if self.hidden:
            self.part = []
        self.flush()
        self.hidden = False

    def handle_data(self, data):
        if not self.hidden:
            self.part.append(data)

    def handle_entityref(self, name):
        self.part.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        self.part.append(chr(int(name[1:], 16) if name[0] in "xX" else int(name)))

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_comment


def visible(page):
    parser = _Text()
    parser.feed(page)
    parser.close()
    parser.flush()
    return " ".join(parser.out)


def test_html_to_text_on_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("html", html.html_to_text(F.col("html")).alias("t")).collect()
    assert len(rows) == 250
    assert [r.t for r in rows] == [visible(r.html) for r in rows]


def test_html_to_text_cases(evaluate):
    cases = {
        "<html><title>Test Page</title><style>x{}</style><body><script>var a='<p>';</script>"
        "<h1>Welcome to Test Site</h1><p>Hi.</p></body></html>": "Test Page Welcome to Test Site Hi.",
        "a &lt;div&gt; &amp; &quot; &#39; &nbsp;": "a <div> & \" '",
        "&amp;lt;": "&lt;",
        "&#8364;&#x20AC;&euro;": "€€€",
        "&#0;&#xD800;&#x110000;": "���",
        "<p title='a>b'>x</p>y<!-- c <p>no</p> -->z": "x y z",
        "<script>never closed": "",
        "a < b": "a < b",
        "&unknown; x&copy y": "&unknown; x© y",
        "": "",
    }
    assert evaluate(html.html_to_text, list(cases)) == list(cases.values())


@pytest.mark.parametrize(
    ("part", "text", "links"),
    [
        ("<a ", 1_000_000, 0), ('<a ">" ', None, 0), ('<a "', 1_000_000, 0), ("<!--", 0, 0), ("<script ", 1_000_000, 0),
        ("< ", 1_000_000, 0), ("<!d ", 1_000_000, 0), ("<a '\"> ", None, 0), ('<a href="/x" ', None, 1), ("&amp", None, 0), ("<p>x", None, 0),
    ],
)
def test_hostile_pages_are_read_in_linear_time(spark, part, text, links):
    """A megabyte of openings that never close, quotes and comments included, takes seconds."""
    import time

    page = part * (1_000_000 // len(part))
    df = spark.createDataFrame([(page,)], "h string")
    found = html.extract_links(F.col("h"), F.lit("https://a.com/y"), F.lit("a.com"))
    start = time.time()
    got = df.select(F.length(html.html_to_text(F.col("h"))).alias("n"), F.size(found).alias("links")).first()
    assert time.time() - start < 20
    assert got.links == links and (text is None or abs(got.n - text) <= 10)


def test_unclosed_quotes_and_tags(evaluate):
    cases = {
        'a <b title="x>y</b> c': "a y c",
        "a <b c": "a <b c",
        'x <i>y</i> <b "': 'x y <b "',
        "one <a title=\"2 > 1\" href='/q'>two</a> <a href=\"/r>three</a> <!-- <b> four": "one two three",
        "<<b>x": "< x",
        "<p a='1' b=\"<\">t</p><a 'z>u": "t u",
    }
    assert evaluate(html.html_to_text, list(cases)) == list(cases.values())
    pages = list(cases)[3:4] + ["<a title='>' href=/a>x</a><a href='/b' <a href=\"/c\"", "<a>x</a><!-- <a href='/h'> --><LINK href=/L>"]
    found = evaluate(lambda c: html.extract_links(c, F.lit("https://a.com/"), F.lit("a.com")), pages)
    assert found[1:] == [["https://a.com/a", "https://a.com/b", "https://a.com/c"], ["https://a.com/L"]]
    assert found[0][0] == "https://a.com/q"


def test_extract_emails_everywhere(evaluate):
    page = (
        "info@example.com <a href='mailto:sales@example.com'>x</a> support@example.com "
        "<!-- hidden@example.com --><script>'script@example.com'</script> contact@other-domain.com "
        "admin@sub.example.com INFO@Example.com uk@notexample.com"
    )
    found = evaluate(lambda c: html.extract_emails(c, F.lit("Example.com")), [page, "", "none", None])
    assert found[0] == [
        "info@example.com", "sales@example.com", "support@example.com", "hidden@example.com",
        "script@example.com", "admin@sub.example.com",
    ]
    assert found[1:3] == [[], []]


def test_extract_emails_matches_plain_pattern(evaluate):
    """The anchored scan finds what an unanchored left-to-right scan finds."""
    import re

    rng = random.Random(7)
    texts = ["".join(rng.choice("ab1.@-_% c") for _ in range(200)) + "a@b.com1_x@y.com" for _ in range(300)]
    plain = re.compile(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")

    def expected(t, domain):
        seen, out = set(), []
        for e in plain.findall(t):
            host = e.split("@")[1].lower()
            if (host == domain or host.endswith("." + domain)) and e.lower() not in seen:
                seen.add(e.lower())
                out.append(e)
        return out

    for domain in ("com", "y.com"):
        got = evaluate(lambda c: html.extract_emails(c, F.lit(domain)), texts)
        assert got == [expected(t, domain) for t in texts]


def test_extract_links(evaluate):
    page = (
        "<a href='/b'>x</a><a href=\"/c#x\">y</a><a class=q href=https://www.a.com/d/>z</a>"
        "<a href='mailto:x@a.com'>m</a><a href='#top'>t</a><a href='javascript:void(0)'>j</a>"
        "<a href='https://other.com/z'>o</a><link rel=next href='/b?x=1&amp;y=2'><a>none</a>"
        "<!-- <a href='/hidden'> --><a href=''>e</a><a href='//sub.a.com/g'>g</a><area href='/no'>"
    )
    found = evaluate(
        lambda c: html.extract_links(c, F.lit("https://a.com/x/"), F.lit("a.com")), [page]
    )
    assert found[0] == [
        "https://a.com/b", "https://a.com/c", "https://www.a.com/d", "https://a.com/b?x=1&y=2",
        "https://sub.a.com/g",
    ]


def test_links_in_text(evaluate):
    found = evaluate(
        lambda c: html.extract_links_from_text(c, F.lit("a.com")),
        ["see https://a.com/x/, http://www.a.com/y. (https://b.com/) https://s.a.com https://a.com/x", None],
    )
    assert found == [["https://a.com/x", "http://www.a.com/y", "https://s.a.com"], []]


@pytest.mark.parametrize(
    "email,first,last",
    [
        ("john.doe@x.com", "John", "Doe"), ("jane_smith@x.com", "Jane", "Smith"),
        ("admin@x.com", "Admin", ""), ("mary-ann.o_neil@x.com", "Mary-Ann", "O_Neil"),
        ("a.b.c@x.com", "A", "C"),
    ],
)
def test_parse_email_name(evaluate, email, first, last):
    assert tuple(evaluate(names.parse_email_name, [email])[0]) == (first, last)


def test_names_and_title_case(evaluate):
    values = ["doe-smith", "o'neil", "x2y", "éCOLE", "", "a.b_c d"]
    assert evaluate(text.title_case, values) == [v.title() for v in values]
    assert tuple(evaluate(names.guess_lead_name, ["a.b.c@x"])[0]) == ("A", "B C")
    assert tuple(evaluate(names.guess_lead_name, ["._-@x"])[0]) == ("", "")


def test_text_fields(evaluate):
    assert evaluate(lambda c: text.truncate_field(c, 5), ["a\nb\r\nc", None, "é" * 9]) == [
        "a b  ", "", "ééééé",
    ]
    assert evaluate(text.format_confidence, ["0.9", "0.125", "0", None, "high", "1"]) == [
        "0.9", "0.12", "", "", "", "1.0",
    ]
    assert evaluate(text.distinct_ignoring_case, [["B@x", "a@x", "b@X", "A@x", "c"]], "array<string>") == [
        ["B@x", "a@x", "c"]
    ]


def test_analysis_values(evaluate):
    assert evaluate(analysis.parse_revenue, ["$10M-$50M", "$1.5B", "none", None, "0"]) == [
        10_000_000, 1_000_000, None, None, None,
    ]
    assert evaluate(analysis.parse_employees, ["100-500", "1,000", "few"]) == [100, 1, None]
    assert evaluate(analysis.map_industry, ["Retail", "Mining", None]) == ["RETAIL", None, None]
    assert evaluate(analysis.lead_status, [-1, 0, 4, 5, 6, 7], "int") == [
        "UNQUALIFIED", "OPEN", "OPEN", "CONNECTED", "CONNECTED", "OPEN_DEAL",
    ]


def test_parse_responses(evaluate):
    good = (
        '{"company": {"name": "n", "description": "d", "numberofemployees": 12}, '
        '"business_intelligence": {"technologies_used": ["a", "b"]}, "confidence_score": 8}'
    )
    parsed = evaluate(
        analysis.parse_company_response,
        [good, "{}", '{"_error": "x"}', '{"_parse_error": true}', "no", '{"a":', None],
    )
    assert parsed[0].company_summary == "d" and parsed[0].number_of_employees == "12"
    assert parsed[0].technologies_used == ["a", "b"] and parsed[0].confidence_score == 0.8
    assert parsed[1].confidence_score == 0.5 and parsed[1].value_propositions == []
    assert parsed[2:] == [None] * 5
    lead = 'Sure: {"buyer_persona": "p", "lead_score_adjustment": 3, "confidence": 0.5, "reasoning": "{r}"} ok'
    leads = evaluate(analysis.parse_lead_response, [lead, '{"buyer_persona": "p"}', "none", None])
    assert tuple(leads[0]) == ("p", 3, 0.5, "{r}") and leads[1:] == [None] * 3


def test_one_decimal_is_rounded_from_the_exact_value(evaluate):
    values = [6.25, 18.75, 0.35, 0.25, 0.05, 0.15, 2.675, 81.25, 100.0, 0.0, 1e-9, 99.95, 99.999, 1e15, 33.333333333333336, 2 / 3 * 100]
    values += [i / 37 * 100 for i in range(37)] + [i / 16 * 100 for i in range(16)] + [i / 1000 for i in range(0, 1000, 7)]
    got = evaluate(text.round_1, values + [None], "double")
    assert [f"{x:.1f}" for x in got[:-1]] == [f"{v:.1f}" for v in values] and got[-1] is None
    assert evaluate(text.percent_1, [0.8125, 0.0625, None, 1.0], "double") == ["81.2%", "6.2%", "0.0%", "100.0%"]

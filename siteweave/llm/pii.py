"""Personal data: base rules, high-recall candidates, boosted trees, calibrated thresholds.

Everything that touches texts is column expressions. Candidates of all documents are counted by
their few discrete features (a table bounded by the product of the feature values); trees are
boosted on those counts and become one CASE expression. Labels are weak: a candidate is positive
when it meets a base span, and no feature tells the base rule's own check (validity digits, plus
sign), so the trees learn what such spans look like and where they stand.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from siteweave.functions.text import let

KINDS = ("email", "ip", "card", "phone")

# The base rules. Possessive and anchored so that a long run is read once: a match
# can only begin where a run of its first characters begins, or right behind the match before.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Documents that no rule of a kind can match, told apart by a cheaper look.
_MAY = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}

# Candidates: wider than the base rules on purpose.
CANDIDATES = {
    "email": r"(?:\G|(?<![\w.%+-]))[\w.%+-]++ ?(?:@|\((?:at|AT)\)|\[(?:at|AT)\]) ?[\w-]++(?: ?(?:\.|\((?:dot|DOT)\)|\[(?:dot|DOT)\]) ?[\w-]++)*+",
    "ip": r"(?<![0-9])[0-9]{1,4}+(?:[.,:][0-9]{1,4}+){3}+",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ ./-]?[0-9]){10,20}+",
    "phone": r"(?<![0-9])(?:\+[ ]?|00)?(?:[0-9]{1,4}+[ ./-]{1,2}+)?+\(?[0-9]{2,5}+\)?[ ./-]{1,2}+[0-9]{2,5}+(?:[ ./-][0-9]{2,5}+){0,3}+",
}
_MAY_CANDIDATE = {
    "email": lambda t: t.rlike(r"@|[\[(](?:at|AT)[\])]"),
    "ip": lambda t: t.rlike(r"[0-9][.,:][0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ ./-]?[0-9]){10}"),
    "phone": lambda t: t.rlike(r"[0-9]\)?[ ./-]{1,2}[0-9]"),
}
_CUES = r"(?i)(?:mail|phone|tel|call|fax|mobil|card|visa|account|host|server|addr|ip)[\w.]*\W{0,3}$"
FEATURES = ("digits", "groups", "length", "before", "after", "cue")
ROUNDS, RATE, PRECISION, LEAST = 30, 0.3, 0.95, 20
_CHUNK = 256
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def _running(steps: Column, most: bool = False) -> Column:
    """Running sums (or, with ``most``, maxima) of non-negative numbers, in two levels: linear for
    all lengths that texts can have."""
    both = (lambda x, y: F.greatest(x, y)) if most else (lambda x, y: x + y)
    whole = lambda a: F.aggregate(a, F.lit(0), both)

    def cut(a: Column) -> Column:
        last = F.floor((F.size(a) - 1) / _CHUNK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(a, c * _CHUNK + 1, _CHUNK))

    def level(chunks: Column) -> Column:
        before = F.aggregate(
            F.transform(chunks, whole),
            F.array(F.lit(0)),
            lambda found, n: F.concat(found, F.array(both(F.element_at(found, -1), n))),
        )
        inside = lambda b, s, c, i: both(F.get(b, c), whole(F.slice(s, F.lit(1), i + 1)))
        return let(
            before,
            lambda b: F.flatten(F.transform(chunks, lambda s, c: F.transform(s, lambda _, i: inside(b, s, c, i)))),
        )

    return let(steps, lambda a: F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(let(cut(a), level)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, text); starts count code points."""

    def placed(x: Column) -> Column:
        steps = F.transform(
            x["found"],
            lambda m, i: F.length(F.get(x["gaps"], i)) + F.when(i > 0, F.length(F.get(x["found"], i - 1))).otherwise(0),
        )
        starts = _running(steps)
        return F.zip_with(starts, x["found"], lambda s, m: F.struct(s.alias("start"), m.alias("text")))

    both = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    )
    return let(both, placed)


def _luhn(digits: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int")
        return F.when((F.length(d) - i) % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(digits, i)) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        byte = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{byte}\.{byte}\.{byte}\.{byte}$")
    if kind == "card":
        return let(F.translate(match, " -", ""), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(F.translate(match, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _spans(kind: str, found: Column) -> Column:
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), (m["start"] + F.length(m["text"])).alias("end")
        ),
    )


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind]), lambda m: _holds(kind, m["text"]))
    return F.when(_MAY[kind](text), _spans(kind, found)).otherwise(F.array().cast(_SPAN))


def _char_class(c: Column) -> Column:
    """0 none, 1 white space, 2 letter, 3 digit, 4 bracket or quote, 5 other."""
    return (
        F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike(r"[0-9]"), 3)
        .when(c.rlike(r"[\[\](){}<>\"']"), 4).otherwise(5)
    )


def candidates(text: Column, base: Column, kind: str) -> Column:
    """Candidate spans with features, ``hit``: whether a base span of the kind is met, and
    ``inside``: whether one covers them."""
    number = KINDS.index(kind)

    def featured(m: Column) -> Column:
        start, end = m["start"], m["start"] + F.length(m["text"])
        digits = F.length(F.regexp_replace(m["text"], "[^0-9]", ""))
        groups = F.length(F.regexp_replace(m["text"], r"[^ .,:/@-]", ""))
        ahead = F.substring(text, F.greatest(start - 15, F.lit(1)), F.least(start, F.lit(16)))
        return F.struct(
            F.lit(number).alias("kind"), start.alias("start"), end.alias("end"),
            F.least(digits, F.lit(21)).alias("digits"), F.least(groups, F.lit(7)).alias("groups"),
            F.least(F.floor(F.length(m["text"]) / 4).cast("int"), F.lit(8)).alias("length"),
            _char_class(F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")).alias("before"),
            _char_class(F.substring(text, end + 1, F.lit(1))).alias("after"),
            F.when((start > 0) & ahead.rlike(_CUES), 1).otherwise(0).alias("cue"),
            F.exists(base, lambda b: (b["kind"] == number) & (b["start"] < end) & (b["end"] > start)).alias("hit"),
            F.exists(base, lambda b: (b["kind"] == number) & (b["start"] <= start) & (b["end"] >= end)).alias("inside"),
        )

    found = matches(text, CANDIDATES[kind])
    kind_of = f"array<struct<kind:int,start:int,end:int,{','.join(f'{f}:int' for f in FEATURES)},hit:boolean,inside:boolean>>"
    return F.when(_MAY_CANDIDATE[kind](text), F.transform(found, featured)).otherwise(F.array().cast(kind_of))


# Working columns; no input is expected to use these names.
_BASE, _CANDIDATES, SPANS = "__pii_base", "__pii_candidates", "__pii_spans"


def with_candidates(docs: DataFrame, text_column: str) -> DataFrame:
    """Add the base spans, by kind and start, and the candidates."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    out = docs.withColumn(_BASE, F.concat(*[base_spans(text, k) for k in KINDS]))
    return out.withColumn(_CANDIDATES, F.concat(*[candidates(text, F.col(_BASE), k) for k in KINDS]))


def feature_counts(found: DataFrame, half: Column) -> DataFrame:
    """Candidates counted by features, for the learning and the calibrating half of the documents."""
    rows = found.select(half.alias("half"), F.explode(_CANDIDATES).alias("c"))
    keys = ["kind", *FEATURES]
    return rows.groupBy("half", *[F.col(f"c.{k}").alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("c.hit").cast("long")).alias("hits")
    )


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _tree(rows: list, names: tuple, depth: int):
    """Regression tree on gradient sums: nested (feature, cut, low, high) or a leaf value."""
    grad, hess = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best = None
    if depth:
        for name in names:
            sums = defaultdict(lambda: [0.0, 0.0])
            for r in rows:
                s = sums[r[name]]
                s[0] += r["g"]
                s[1] += r["h"]
            g = h = 0.0
            values = sorted(sums)
            for value, after in zip(values, values[1:]):
                g, h = g + sums[value][0], h + sums[value][1]
                gain = g * g / (h + 1) + (grad - g) ** 2 / (hess - h + 1) - grad * grad / (hess + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, name, after)
    if best is None or best[0] < 1e-6:
        return RATE * grad / (hess + 1)
    _, name, cut = best
    low, high = [r for r in rows if r[name] < cut], [r for r in rows if r[name] >= cut]
    return name, cut, _tree(low, names, depth - 1), _tree(high, names, depth - 1)


def _value(tree, row: dict) -> float:
    while isinstance(tree, tuple):
        name, cut, low, high = tree
        tree = low if row[name] < cut else high
    return tree


def boost(counts: list[dict], rounds: int = ROUNDS, depth: int = 3) -> list:
    """Boosted trees by logistic loss on counted rows (``n``, ``hits``, features)."""
    names = ("kind", *FEATURES)
    rows = [dict(r, score=0.0) for r in counts]
    trees = []
    for _ in range(rounds if rows else 0):
        for r in rows:
            p = _sigmoid(r["score"])
            r["g"], r["h"] = r["hits"] - r["n"] * p, r["n"] * p * (1 - p)
        trees.append(_tree(rows, names, depth))
        for r in rows:
            r["score"] += _value(trees[-1], r)
    return trees


def thresholds(trees: list, counts: list[dict], precision: float = PRECISION, least: int = LEAST) -> dict[int, float]:
    """Per kind, the lowest score from which on the calibrating half has the wanted precision."""
    out = {}
    for kind in range(len(KINDS)):
        scored = sorted(((sum(_value(t, r) for t in trees), r) for r in counts if r["kind"] == kind), key=lambda x: -x[0])
        n = hits = 0
        for i, (score, r) in enumerate(scored):
            n, hits = n + r["n"], hits + r["hits"]
            tied = i + 1 < len(scored) and scored[i + 1][0] == score
            if not tied and n >= least and hits >= precision * n:
                out[kind] = score
    return out


def _expression(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    name, cut, low, high = tree
    return F.when(c[name] < cut, _expression(low, c)).otherwise(_expression(high, c))


def _added(c: Column, trees: list, cuts: dict[int, float]) -> Column:
    """Candidates over the threshold of their kind that no base span covers."""
    if not trees or not cuts:
        return F.lit(False)
    score = F.lit(0.0)
    for tree in trees:
        score = score + _expression(tree, c)
    cut = F.create_map(*[x for k, v in cuts.items() for x in (F.lit(k), F.lit(v - 1e-9))])
    return ~c["inside"] & F.coalesce(score >= F.element_at(cut, c["kind"]), F.lit(False))


def annotate(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The input with two more columns, base spans and all spans (``SPANS``), see :func:`find`."""
    found = with_candidates(docs.select(*docs.columns), text_column)
    # Bounded: one row per half and combination of feature values.
    half = F.pmod(F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))), F.lit(2)).cast("int")
    counts = [r.asDict() for r in feature_counts(found, half).collect()]
    trees = boost([r for r in counts if r["half"] == 0])
    cuts = thresholds(trees, [r for r in counts if r["half"] == 1])
    more = F.transform(
        F.filter(_CANDIDATES, lambda c: _added(c, trees, cuts)),
        lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
    )
    return found.withColumn(SPANS, F.array_sort(F.concat(_BASE, more))).drop(_CANDIDATES)


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, base, spans): arrays of (kind, start, end), by kind, then start.

    Starts and ends count code points, ends are exclusive. Null and empty texts have no spans. One
    row per input row; repeated rows get equal spans, other columns are ignored. With too few
    candidates to calibrate, the base spans are all there is; so it is on empty tables.
    """
    narrow = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return annotate(narrow).select("doc_id", "text", F.col(_BASE).alias("base"), F.col(SPANS).alias("spans"))


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The input with every span of :func:`find` replaced by its kind; null texts stay null."""
    found = annotate(docs, text_column)
    return found.withColumn(text_column, redacted(F.col(text_column), F.col(SPANS))).select(*docs.columns)


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one tag."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(ordered: Column) -> Column:
        ends = _running(F.transform(ordered, lambda s: s["end"]), most=True)
        return let(F.struct(ordered.alias("spans"), ends.alias("ends")), build)

    def build(x: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(x["ends"], i - 1))
        piece = lambda s, i: let(
            before(i),
            lambda e: F.when(s["start"] < e, "").otherwise(
                F.concat(F.substring(text, e + 1, s["start"] - e), F.get(tags, s["kind"]))
            ),
        )
        last = F.element_at(x["ends"], -1)
        return F.concat(F.array_join(F.transform(x["spans"], piece), ""), F.substring(text, last + 1, F.length(text)))

    by_start = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(by_start, cut))

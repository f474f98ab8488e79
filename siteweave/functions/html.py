"""Column functions on stored HTML: text, e-mail addresses and links.

All of them are native expressions, so a page is read, reduced and dropped in one scan stage and
raw HTML never reaches a shuffle.
"""

from __future__ import annotations

from html.entities import html5, name2codepoint

from pyspark.sql import Column, functions as F

from siteweave.fixed_values import (
    EMAIL_HOST,
    EMAIL_LOCAL,
    MIN_PAGE_CHARS,
    TEXT_URL,
    TEXT_URL_TRAILING,
)
from siteweave.functions.domains import (
    host_or_empty,
    resolve_link,
    rstrip,
    under_domain,
    url_parts,
)
from siteweave.functions.text import distinct_ignoring_case, let, or_empty, strip

_CUT, _END = "\x02", "\x03"
_QUOTED = r"""(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+"""
# Parts that hold no text; an unclosed one runs to the end of the page.
_HIDDEN = (
    r"!--.*?(?:--\s*>|\z)"
    r"|script\b{0}>.*?(?:</script\s*>|\z)"
    r"|style\b{0}>.*?(?:</style\s*>|\z)"
)
_TAG = rf"""(?:[!?][a-z][^>]*+|/?[a-z][^>"']*+{_QUOTED})"""
_NAMED = r"[!?/]?[a-z]"
# A page is scanned in two steps, both of which read every character once, whatever the page holds.
# The strict pattern knows quotes; a tag that finds no end with them yields the rest of the page, so
# this happens once. The loose pattern reads that rest without quotes, and its tags end before the
# next "<". A group that looks back is entered only where its branch is sure to match, because a failed
# branch keeps what it has captured there. The leading "<" stands in front of the alternatives, so other characters cost one comparison.
_STRICT = f"(?is)<(?:{_HIDDEN.format('[^>]*+')}|{_TAG}>|(?={_NAMED})(?<=(<))(.*)\\z)"
_LOOSE = f"(?is)<(?:{_HIDDEN.format('[^<>]*+')}|[!?/]?[a-z][^<>]*+>)"
# Stands for the border in front of the unclosed rest, if there is one.
_REST = _CUT + "<<<"
_IS_LINK = r"""(?:a|link)(?=[\s/"'])"""
_LINK_TAGS = (
    f"(?is)<(?:{_HIDDEN.format('[^>]*+')}|(?!{_IS_LINK}){_TAG}>"
    rf"""|({_IS_LINK}[^>"']*+{_QUOTED}(?=>)|{_NAMED}.*\z))"""
)
_LOOSE_LINK_TAGS = (
    f"(?is)<(?:{_HIDDEN.format('[^<>]*+')}|(?!{_IS_LINK})[!?/]?[a-z][^<>]*+>|({_IS_LINK}[^<>]*+))"
)
_HREF = r"""(?is)^.*?[\s"']href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_PIECE = r"(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&)"


def _constant_map(pairs: dict[str, str]) -> Column:
    text = "\x03".join(f"{name}\x04{value}" for name, value in sorted(pairs.items()))
    return F.str_to_map(F.lit(text), F.lit("\x03"), F.lit("\x04"))


def _entity(name: Column) -> Column:
    """Text of a named entity (standard library names); the short HTML 4 list is searched first."""
    common = {k: chr(cp) for k, cp in name2codepoint.items()}
    rare = {k[:-1]: v for k, v in html5.items() if k.endswith(";") and k[:-1] not in common}
    return F.coalesce(
        F.try_element_at(_constant_map(common), name), F.try_element_at(_constant_map(rare), name)
    )


def _code_point(cp: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    usable = cp.between(1, 0xD7FF) | cp.between(0xE000, 0x10FFFF)
    return F.when(
        usable, F.decode(F.unhex(F.lpad(F.hex(F.when(usable, cp)), 8, "0")), "UTF-32")
    ).otherwise("�")


def decode_entities(c: Column) -> Column:
    """Decode named and numeric character references exactly once; the semicolon may be missing."""

    def one(piece: Column) -> Column:
        body = F.rtrim(F.substring(piece, F.lit(2), F.length(piece)), F.lit(";"))
        number = F.substring(body, F.lit(2), F.length(body))
        return (
            F.when(~piece.startswith("&") | (F.length(piece) == 1), piece)
            .when(
                body.rlike("^#[xX]"),
                _code_point(F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).try_cast("bigint")),
            )
            .when(body.startswith("#"), _code_point(number.try_cast("bigint")))
            .otherwise(F.coalesce(_entity(body), piece))
        )

    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(1))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def _without_tags(html: Column) -> Column:
    """A page with a border in place of every tag and hidden part."""

    def loosely(page: Column) -> Column:
        rest = F.regexp_replace(F.replace(page, F.lit(_REST), F.lit("<")), _LOOSE, _CUT)
        return F.when(page.contains(_REST), rest).otherwise(page)

    return let(F.regexp_replace(html, _STRICT, f"{_CUT}$1$1$1$2"), loosely)


def html_to_text(html: Column) -> Column:
    """Visible text of a page: trimmed, non-empty text nodes joined by one space."""
    texts = F.transform(F.split(_without_tags(html), _CUT), lambda t: strip(decode_entities(t)))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def extract_emails(html: Column, domain: Column) -> Column:
    """Addresses at the domain or its subdomains, anywhere in the raw text, in order of appearance.

    Addresses equal but for case count once, in the first spelling. A match may start only where a
    run of address characters starts (or right after a match), which finds the same addresses
    without re-reading long runs from every position.
    """
    pattern = rf"(?:\G|(?<!{EMAIL_LOCAL})){EMAIL_LOCAL}++@{EMAIL_HOST}"
    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))

    def at(target: Column) -> Column:
        return F.filter(
            found, lambda e: under_domain(F.lower(F.substring_index(e, "@", -1)), target)
        )

    usable = (or_empty(domain) != "") & html.contains("@")
    kept = let(F.lower(domain), at)
    return F.when(usable, distinct_ignoring_case(kept)).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def page_links(html: Column, url: Column) -> Column:
    """Absolute URLs of the ``a`` and ``link`` elements, resolved against the page, in page order.

    Empty links, fragments and ``javascript:`` links are left out; fragments and trailing slashes
    are cut. Not yet limited to one site: see :func:`internal_links`.
    """
    def loosely(tags: Column) -> Column:
        # only the last one can be the unclosed rest; it holds the end mark
        rest = F.concat(F.lit("<"), F.rtrim(F.try_element_at(tags, F.lit(-1)), F.lit(_END)))
        more = F.regexp_extract_all(rest, F.lit(_LOOSE_LINK_TAGS), F.lit(1))
        unclosed = F.coalesce(F.try_element_at(tags, F.lit(-1)).endswith(_END), F.lit(False))
        return F.when(unclosed, F.concat(F.slice(tags, 1, F.size(tags) - 1), more)).otherwise(tags)

    tags = F.regexp_extract_all(F.concat(html, F.lit(_END)), F.lit(_LINK_TAGS), F.lit(1))
    links = let(F.filter(tags, lambda t: t != ""), loosely)
    raw = F.filter(F.transform(links, lambda t: F.regexp_extract(t, _HREF, 1)), lambda v: v != "")
    quoted = "[\"']"
    values = F.transform(
        raw,
        lambda v: decode_entities(
            F.when(
                F.substring(v, 1, 1).rlike(quoted), F.substring(v, F.lit(2), F.length(v) - 2)
            ).otherwise(v)
        ),
    )
    wanted = F.filter(
        values, lambda v: (v != "") & ~v.startswith("#") & ~v.startswith("javascript:")
    )
    absolute = let(
        url_parts(url),
        lambda page: F.transform(
            wanted, lambda v: rstrip(F.substring_index(resolve_link(page, v), "#", 1), "/")
        ),
    )
    return F.array_distinct(F.filter(absolute, lambda u: u != ""))


def internal_links(links: Column, domain: Column) -> Column:
    """The links whose host is the domain or one of its subdomains."""
    return F.filter(links, lambda u: under_domain(host_or_empty(u), domain))


def extract_links(html: Column, url: Column, domain: Column) -> Column:
    """Internal links of a page, unique, in order of appearance."""
    return internal_links(page_links(html, url), domain)


def extract_links_from_text(text: Column, domain: Column) -> Column:
    """Internal absolute URLs written out in a plain text, unique, in order of appearance."""
    found = F.when(
        text.contains("://"), F.regexp_extract_all(text, F.lit(TEXT_URL), F.lit(0))
    )
    urls = F.transform(found, lambda u: rstrip(u, TEXT_URL_TRAILING))
    # the host keeps its port and case here, as written
    inside = F.filter(
        urls,
        lambda u: under_domain(
            F.regexp_replace(F.regexp_extract(u, "^https?://([^/?#]*)", 1), r"^www\.", ""), domain
        ),
    )
    unique = F.array_distinct(F.transform(inside, lambda u: rstrip(u, "/")))
    return F.coalesce(unique, F.expr("cast(array() as array<string>)"))


def page_success(text: Column) -> Column:
    """A page counts as scraped when its text has more than 100 characters."""
    return F.length(or_empty(text)) > MIN_PAGE_CHARS


def page_error(text: Column, fetch_error: Column | None = None) -> Column:
    """Why a page failed: the stored fetch error, else too little text; null on success."""
    short = F.format_string(
        "Insufficient content scraped (only %d characters)", F.length(or_empty(text))
    )
    stored = F.nullif(fetch_error, F.lit("")) if fetch_error is not None else F.lit(None)
    return F.when(stored.isNotNull(), stored).when(~page_success(text), short)

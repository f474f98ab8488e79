"""Building blocks of the checking SQL (DuckDB), written independently of the Spark expressions."""

from __future__ import annotations

SPACE_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
TAGS = (
    r"(?is)<(?:!--.*?--\s*>|script\b[^>]*>.*?</script\s*>|style\b[^>]*>.*?</style\s*>"
    r"|[!?][a-z][^>]*>|/?[a-z][^>]*>)"
)
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def with_(ctes: list[str], body: str) -> str:
    return f"with {', '.join(ctes)} {body}"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE_CHARS})"


def host(u: str) -> str:
    raw = f"lower(regexp_extract({u}, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
    return rf"nullif(regexp_replace({raw}, '^www\.', ''), '')"


def extract_domain(x: str) -> str:
    t = f"lower({strip(x)})"
    right = f"trim(string_split({t}, '@')[2])"
    url = f"case when regexp_matches({t}, '^(https?|ftps?)://') then {t} else 'https://' || {t} end"
    h = (
        rf"regexp_replace(regexp_replace(regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1), "
        r"'^www\.', ''), ':.*$', '')"
    )
    return (
        f"case when len(string_split({t}, '@')) = 2 and contains({right}, '.') then {right} "
        f"when contains({h}, '.') and length({h}) >= 4 then {h} end"
    )


def title(x: str) -> str:
    return (
        rf"array_to_string(list_transform(regexp_extract_all({x}, '\p{{L}}+|[^\p{{L}}]+'), "
        "lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def html_text(h: str) -> str:
    entity = (
        "replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, "
        "'&copy(;|$)', '©', 'g'), '&middot(;|$)', '·', 'g'), '&quot(;|$)', '\"', 'g'), "
        "'&nbsp(;|$)', chr(160), 'g'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39))"
    )
    entity = f"regexp_replace({entity}, '&amp(;|$)', '&', 'g')"
    nodes = f"string_split(regexp_replace({h}, '{TAGS}', chr(2), 'g'), chr(2))"
    texts = f"list_transform({nodes}, lambda x: {strip(entity)})"
    return f"array_to_string(list_filter({texts}, lambda t: t <> ''), ' ')"


def emails(text: str, domain: str) -> str:
    found = f"regexp_extract_all({text}, '{EMAIL}')"
    mine = f"lower(string_split(e, '@')[2])"
    kept = (
        f"list_filter({found}, lambda e: {mine} = lower({domain}) "
        f"or ends_with({mine}, '.' || lower({domain})))"
    )
    lowered = f"list_transform({kept}, lambda e: lower(e))"
    return (
        f"list_filter({kept}, lambda e, i: list_position({lowered}, lower(e)) = i)"
    )


def links(html: str, url: str) -> str:
    """Links of pages whose hrefs are all relative to the root."""
    visible = (
        rf"regexp_replace({html}, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g')"
    )
    hrefs = f"""regexp_extract_all({visible}, '<(?:a|link) [^>]*href="(/[^"]*)"', 1)"""
    root = f"regexp_extract({url}, '^([a-z]+://[^/?#]*)', 1)"
    full = (
        f"list_transform({hrefs}, lambda p: rtrim(regexp_replace({root} || p, '#.*$', ''), '/'))"
    )
    return f"list_filter({full}, lambda u, i: list_position({full}, u) = i)"


def joined(items: str, sep: str = " ") -> str:
    return f"array_to_string({items}, '{sep}')"


def properties(pairs: dict[str, str], always: tuple[str, ...] = ()) -> str:
    """Sorted ``name=value`` text of the non-empty properties."""
    items = [
        f"'{k}=' || coalesce({v}, '')" if k in always
        else f"case when coalesce({v}, '') <> '' then '{k}=' || {v} end"
        for k, v in pairs.items()
    ]
    return (
        f"array_to_string(list_sort(list_filter([{', '.join(items)}], "
        "lambda p: p is not null)), ';')"
    )


def truncate(x: str, limit: int) -> str:
    return f"left(replace(replace(coalesce({x}, ''), chr(10), ' '), chr(13), ' '), {limit})"


def confidence(x: str) -> str:
    n = f"try_cast({x} as double)"
    return f"case when coalesce({n}, 0) = 0 then '' else cast(round_even({n}, 2) as varchar) end"

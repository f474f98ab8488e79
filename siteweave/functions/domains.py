"""Column functions on domains, hosts and URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siteweave.fixed_values import MIN_DOMAIN_LENGTH
from siteweave.functions.text import let, or_empty, strip


# Host of a text that may lack a scheme, and host of a URL; user, port and path left out.
BARE_HOST = r"^(?:(?:https?|ftps?)://)?(?:www\.)?([^/?#:]*)"
URL_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)"


def _without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def authority(url: Column) -> Column:
    """What stands between ``scheme://`` (or ``//``) and the first ``/``, ``?`` or ``#``."""
    return F.regexp_extract(
        F.translate(url, "\t\r\n", ""), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1
    )


def extract_domain(c: Column) -> Column:
    """Domain of an e-mail address, URL or bare host; null when there is none.

    An address with exactly one ``@`` and a dot after it yields that right part unchanged. Anything
    else is read as a URL: the host without one leading ``www.`` and without port, accepted when it
    has a dot and at least four characters.
    """
    return let(F.lower(strip(c)), _domain_of)


def _domain_of(text: Column) -> Column:
    one_at = F.length(text) - F.length(F.replace(text, F.lit("@"))) == 1
    mail_host = strip(F.substring_index(text, "@", -1))
    host = F.regexp_extract(F.translate(text, "\t\r\n", ""), BARE_HOST, 1)
    is_host = let(
        host,
        lambda h: F.when(
            h.contains(".") & (F.length(h) >= MIN_DOMAIN_LENGTH) & ~h.contains("["), h
        ),
    )
    return F.when(one_at & mail_host.contains("."), mail_host).otherwise(is_host)


def normalize_url(c: Column) -> Column:
    """Trim and prefix ``https://`` unless a (lower-case) http or https scheme is there."""
    url = strip(c)
    return (
        F.when(or_empty(c) == "", "")
        .when(url.rlike("^https?://"), url)
        .otherwise(F.concat(F.lit("https://"), url))
    )


def normalize_domain(c: Column) -> Column:
    return F.lower(strip(c))


def domain_safe(c: Column) -> Column:
    """A domain that can stand in a path: ``/`` becomes ``_``, ``:`` goes."""
    return F.translate(c, "/:", "_")


def host_or_empty(c: Column) -> Column:
    """Lower-case host of a URL without user, port and one leading ``www.``; empty without a host."""
    host = F.regexp_extract(F.translate(F.ltrim(c), "\t\r\n", ""), URL_HOST, 1)
    return _without_www(F.lower(host))


def url_host(c: Column) -> Column:
    """The same, null without a host."""
    return F.nullif(host_or_empty(c), F.lit(""))


def under_domain(host: Column, domain: Column) -> Column:
    """True when the host is the domain or one of its subdomains."""
    return (host == domain) | host.endswith(F.concat(F.lit("."), domain))


def search_key(c: Column) -> Column:
    """Look-up form of a domain: lower case, no scheme, no ``/`` at the ends."""
    return F.btrim(F.regexp_replace(F.lower(c), "https?://", ""), F.lit("/"))


def rstrip(c: Column, chars: str) -> Column:
    return F.rtrim(c, F.lit(chars))


def record_domain(website: Column, email: Column) -> Column:
    """Domain of a contact: its website when given (even if it has no domain), else its address."""
    return F.when(or_empty(website) != "", extract_domain(website)).otherwise(
        F.when(or_empty(email) != "", extract_domain(email))
    )


def company_domain(domain: Column, website: Column) -> Column:
    """Domain of a company: the stored one when given, else that of its website."""
    return F.when(or_empty(domain) != "", domain).otherwise(
        F.when(or_empty(website) != "", extract_domain(website))
    )


def company_domain_failure(domain: Column) -> Column:
    """Why a company domain cannot be used; null when it can."""
    bad = (F.length(domain) < MIN_DOMAIN_LENGTH) | ~domain.contains(".")
    return F.when(or_empty(domain) == "", "No domain found").when(
        bad, F.concat(F.lit("Invalid domain: "), domain)
    )


def url_parts(url: Column) -> Column:
    """Scheme, root (``scheme://authority``), path and query of a page's URL."""
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.struct(
        scheme.alias("scheme"),
        F.concat(scheme, F.lit("://"), authority(url)).alias("root"),
        F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1).alias("query"),
    )


def resolve_link(page: Column, href: Column) -> Column:
    """Resolve a link against the :func:`url_parts` of its page (generic URL syntax, dots removed)."""
    clean = F.translate(F.ltrim(href), "\t\r\n", "")
    plain = clean.startswith("/") & ~clean.startswith("//") & ~clean.contains("/.")
    link_scheme = F.lower(F.regexp_extract(clean, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    # "https:page" on an https page is a relative link
    local = (link_scheme == page["scheme"]) & ~clean.rlike("^[^:]*://")
    link = F.when(local, F.regexp_replace(clean, "^[^:]*:", "")).otherwise(clean)
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(page["path"], "[^/]*$", "")
    joined = F.when(path.startswith("/"), path).otherwise(
        F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    )
    steps = F.split(F.substring(joined, F.lit(2), F.length(joined)), "/", -1)
    # only a relative path closes up empty steps
    segments = F.when(path.startswith("/"), F.filter(steps, lambda s: s != ".")).otherwise(
        F.filter(steps, lambda s: (s != "") & (s != "."))
    )
    kept = F.aggregate(
        segments,
        F.expr("cast(array() as array<string>)"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    names = F.array_join(kept, "/")
    ends_in_folder = joined.rlike(r"/\.{0,2}$") & (names != "") & ~names.endswith("/")
    resolved = F.concat(
        page["root"], F.lit("/"), names, F.when(ends_in_folder, "/").otherwise("")
    )
    query = F.when(tail.startswith("?"), F.lit("")).otherwise(page["query"])
    return (
        F.when(plain, F.concat(page["root"], clean))
        .when((link_scheme != "") & ~local, clean)
        .when(link.startswith("//"), F.concat(page["scheme"], F.lit(":"), link))
        .when(path == "", F.concat(page["root"], page["path"], query, tail))
        .otherwise(F.concat(resolved, tail))
    )


def url_key(url: Column) -> Column:
    """What tells pages apart: the URL without its fragment and trailing slashes, as in links."""
    return F.rtrim(F.substring_index(url, "#", 1), F.lit("/"))


def resolve_url(base: Column, href: Column) -> Column:
    """Resolve a link against the URL of its page."""
    return let(url_parts(base), lambda page: resolve_link(page, href))

"""URLs: the page they name, matching forms, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tracking parameters that a normal form drops, compared in lower case.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid")


def page_url(url: Column) -> Column:
    """The page: scheme and host in lower case, without query, fragment, trailing slashes and outer blanks."""
    bare = F.regexp_replace(F.trim(url), r"[?#].*$", "")
    bare = F.regexp_replace(bare, r"/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://)?[^/]*", 0)
    return F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))


def host(url: Column) -> Column:
    """The host in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.when(found != "", found)


def match_url(url: Column) -> Column:
    """The form in which retrieved and gold pages are compared: trimmed, nothing from ``?`` on; null gives ''."""
    return F.split_part(F.trim(F.coalesce(url, F.lit(""))), F.lit("?"), F.lit(1))


def short_hash(value: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 16)


def _decoded(part: Column) -> Column:
    """A form-encoded text; one with a broken escape is taken as it stands, but for its plus signs."""
    return F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normal_url(url: Column) -> Column:
    """The crawl's normal form: sorted parameters, no tracking, no blank ones, no fragment, percent-encoding made uniform.

    Scheme and host in lower case, no trailing slash (but for the root), no ``;`` parameters of the last part.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"[\t\r\n]", ""), r"^[\x00-\x20]+|#.*$", "")
    front, query = F.substring_index(bare, "?", 1), F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    scheme = F.regexp_extract(front, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    rest = F.substring(front, F.length(scheme) + 1, F.length(front))
    host_part = F.regexp_extract(rest, r"^(//[^/]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.substring(rest, F.length(host_part) + 1, F.length(rest)), ";[^/]*$", ""), "/+$", "")
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p.rlike("=.")), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS)))
    asked = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(F.lower(scheme), F.lower(host_part), F.when(path == "", "/").otherwise(path), F.when(asked == "", "").otherwise(F.concat(F.lit("?"), asked)))

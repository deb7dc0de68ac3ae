"""URL operators as built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that tell pages apart.
KEPT_PARAMS = ("q", "search", "id", "page", "sort", "category")


def url_host(url: Column) -> Column:
    """Lower-cased host, or the empty string."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def filter_params(query: Column) -> Column:
    """The parameters of a query string that are kept, each once, in order."""
    kept = F.filter(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*KEPT_PARAMS))
    return F.array_join(F.array_distinct(kept), "&")


def resolve_dots(path: Column) -> Column:
    """A path without `.` and `..` segments and without empty ones."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.lit("/"), F.array_join(up, "/"))


def normalize_url(url: Column) -> Column:
    """Scheme and host in lower case; no user, fragment, default port or trailing
    slash; dot segments resolved; kept parameters only. Null without a host."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = url_host(url)
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = resolve_dots(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    query = filter_params(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")))
    out = F.concat(scheme, F.lit("://"), host, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when((host != "") & scheme.isNotNull(), out)


def absolute_url(base: Column, href: Column) -> Column:
    """href as seen from the page at base."""
    scheme, authority = F.try_parse_url(base, F.lit("PROTOCOL")), F.try_parse_url(base, F.lit("AUTHORITY"))
    root = F.concat(scheme, F.lit("://"), authority)
    folder = F.regexp_replace(F.coalesce(F.try_parse_url(base, F.lit("PATH")), F.lit("/")), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(root, folder, href))
    )


def hrefs(html: Column) -> Column:
    """The targets of a page's anchors, in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.transform(found, lambda h: F.replace(h, F.lit("&amp;"), F.lit("&")))

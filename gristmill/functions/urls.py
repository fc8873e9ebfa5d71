"""URL expressions and functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def _encoded(c: Column) -> Column:
    """Form encoding that keeps ~ and escapes *."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _sorted_query(query: Column) -> Column:
    """Pairs in order of key and value, freshly encoded; the values of a repeated key become one list, written in brackets."""
    pair = lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "^[^=]*=?", "")).alias("v"))
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))

    def whole(key: Column) -> Column:
        values = F.transform(F.filter(pairs, lambda p: p["k"] == key), lambda p: p["v"])
        return F.struct(key.alias("k"), F.when(F.size(values) == 1, values[0]).otherwise(F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))).alias("v"))

    return F.array_join(F.transform(F.array_sort(F.transform(keys, whole)), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def normalize_url(c: Column | str) -> Column:
    """Lower-case scheme and host, no trailing slash but the root's, sorted query, no fragment."""
    url = F.col(c) if isinstance(c, str) else c
    part = lambda n: F.regexp_extract(url, r"^(?:([A-Za-z][A-Za-z0-9+.-]*:))?(//[^/?#]*)?([^?#]*)(?:[?]([^#]*))?", n)
    path = F.when(part(3) == "/", "/").otherwise(F.regexp_replace(part(3), "/+$", ""))
    query = _sorted_query(part(4))
    return F.concat(F.lower(part(1)), F.lower(part(2)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _join_series(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href, strict=True)])


def url_join(base: Column | str, href: Column | str) -> Column:
    return F.pandas_udf(_join_series, "string")(base, href)


def crawl_key(c: Column | str) -> Column:
    """Without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(c if isinstance(c, Column) else F.col(c), "[?#].*$", ""), "/+$", "")


def is_web_url(c: Column | str) -> Column:
    u = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))).isin("http", "https") & (F.try_parse_url(u, F.lit("HOST")) != ""), F.lit(False))


def title_from_url(c: Column | str) -> Column:
    """Words of the last path segment, each with a capital; Home for the root."""
    segment = F.element_at(F.split(crawl_key(F.regexp_replace(c if isinstance(c, Column) else F.col(c), "^[A-Za-z]+://[^/]*", "")), "/"), -1)
    words = F.filter(F.split(segment, "[-_]"), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))), " ")
    return F.when(shown == "", "Home").otherwise(shown)

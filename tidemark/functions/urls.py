"""URL expressions: canonical form, domain, document id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed_values as fx

# scheme, authority, path, query, fragment
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def canonical_url(raw: Column) -> Column:
    """Lower-case scheme and host, no tracking parameters, no fragment.

    A missing scheme becomes https. Other parameters keep their order and
    blank values; their percent-encoding is left as it is.
    """
    url = F.trim(raw)

    def part(i: int) -> Column:
        return F.regexp_extract(url, _PARTS, i)

    def is_kept(param: Column) -> Column:
        name = F.lower(F.substring_index(param, "=", 1))
        return (
            (param != "")
            & ~name.startswith(fx.TRACKING_PREFIX)
            & ~name.isin(*fx.TRACKING_PARAMS)
        )

    # A parameter without "=" has a blank value.
    kept = F.transform(
        F.filter(F.split(part(4), "&"), is_kept),
        lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))),
    )
    query = F.array_join(kept, "&")
    scheme = F.when(part(1) == "", F.lit("https")).otherwise(F.lower(part(1)))
    authority = F.lower(part(2))
    return F.concat(
        scheme,
        F.lit(":"),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(F.lit("")),
        part(3),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
    )


def domain(url: Column) -> Column:
    """Host (and port, if given) in lower case, without a leading ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _PARTS, 2)), r"^www\.", "")


def domain_suffixes(dom: Column) -> Column:
    """A domain and all its parent domains: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(dom, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def doc_id(url: Column) -> Column:
    """First 24 hex digits of the URL's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 24)

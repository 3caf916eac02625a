"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolescope.functions.words import let


def host(url: Column) -> Column:
    """Lower-cased host without user and port; empty for relative links."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_base(url: Column) -> Column:
    """What relative links of a page need: scheme, origin, folder, and the URL without query and fragment.

    Taken once per page, so that each link costs a few short tests.
    """
    page = F.regexp_extract(url, r"^([^?#]*)", 1)
    folder = F.regexp_extract(page, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/(?:[^/]*/)*)", 1)
    return F.struct(
        F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1).alias("scheme"),
        F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1).alias("origin"),
        F.when(folder == "", "/").otherwise(folder).alias("folder"),
        page.alias("page"),
        F.regexp_extract(url, r"^([^#]*)", 1).alias("with_query"), url.alias("url"),
    )


def _folded(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments resolved, however many; the root has no parent."""
    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    def joined(parts: Column) -> Column:
        kept = F.aggregate(parts, F.array().cast("array<string>"), step)
        folder = F.element_at(parts, -1).isin(".", "..")
        return F.regexp_replace(F.concat(F.array_join(kept, "/"), F.when(folder, "/").otherwise("")), "^/*", "/")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), let(F.split(path, "/"), joined)).otherwise(path)


def absolute_url(base: Column, link: Column) -> Column:
    """A link as seen from a page: absolute, scheme-relative, rooted, query, fragment or relative.

    Blanks before a link do not count. Steps (``.``, ``..``) in rooted and relative paths are resolved fully.
    """
    link = F.regexp_replace(link, r"^[\x00-\x20]+", "")
    path = F.regexp_extract(link, r"^([^?#]*)", 1)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    below = F.regexp_replace(F.concat(base["folder"], path), "/{2,}", "/")
    return (
        F.when(link.startswith("/") & ~link.startswith("//"), F.concat(base["origin"], _folded(path), rest))
        .when(link == "", base["url"])
        .when(link.startswith("//"), F.concat(base["scheme"], link))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), link)
        .when(link.startswith("?"), F.concat(base["page"], link))
        .when(link.startswith("#"), F.concat(base["with_query"], link))
        .otherwise(F.concat(base["origin"], _folded(below), rest))
    )

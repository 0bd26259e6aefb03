"""URL filters: host rules first, then a listing behind a blocked Bloom filter.

URLs that the filter rules out never move; the few it lets through meet the
listing in an exact hash join, which removes its false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.llm import bloom
from dealmargin.llm.columns import ascii_lower, enclosed, without
from dealmargin.operators.joins import settle, spread_join

TRACKING = ("utm_", "ref=")


def url_host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark or hash; A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark or hash."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www. or m., closing slashes, fragment and tracking."""
    host = F.regexp_replace(url_host(url), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    tracked = lambda p: (p == "") | p.startswith(TRACKING[0]) | p.startswith(TRACKING[1])
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~tracked(p)), "&")
    return F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def rule_verdict(
    host: Column, path: Column, rules: Sequence[tuple[str, str, str]]
) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, both NULL where none does.

    A rule (host, path, verdict) fits its host and all its subdomains where the
    URL's path starts with the rule's path.
    """
    rule = verdict = F.lit(None).cast("string")
    for its_host, its_path, its_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == its_host) | host.endswith(f".{its_host}")) & path.startswith(its_path)
        rule = F.when(fits, its_host + its_path).otherwise(rule)
        verdict = F.when(fits, its_verdict).otherwise(verdict)
    return rule, verdict


def filter_urls(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    url_column: str = "url",
    listed_column: str = "url",
) -> DataFrame:
    """Pages with host, path, rule and verdict ('allow' or 'block').

    A page that no rule fits is blocked if its canonical URL is that of a listed
    one, and allowed otherwise. NULL or a text without :// has an empty host and
    path, no rule, and is allowed unless the listing holds such a text. Repeated
    pages are judged alike, repeated listed URLs count once and NULL ones not at
    all; an empty listing blocks nothing. Columns called host, path, rule or
    verdict are replaced, others pass through.
    """
    pages = without(pages, "host", "path", "rule", "verdict")
    url = F.col(url_column)
    known = settle(
        listed.where(F.col(listed_column).isNotNull())
        .select(canonical_url(F.col(listed_column)).alias("_canonical"))
        .distinct()
    )
    blocks = bloom.block_count(known.count)
    listing = bloom.bloom_filter(known.rows, "_canonical", blocks)
    split = enclosed(
        pages,
        host=url_host(url),
        path=url_path(url),
        _canonical=F.when(url.isNotNull(), canonical_url(url)),
    )
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("_ruled", verdict)
    probed = bloom.with_possible(ruled, listing, "_canonical", blocks, "_in").withColumn(
        "_maybe", F.col("_in") & F.col("_ruled").isNull() & F.col("_canonical").isNotNull()
    )
    out = ["_own.*", "host", "path", "rule"]
    passed = probed.where(~F.col("_maybe")).select(
        *out, F.coalesce("_ruled", F.lit("allow")).alias("verdict")
    )
    possible = spread_join(
        probed.where("_maybe"),
        known.rows.withColumn("_listed", F.lit(True)),
        ["_canonical"],
        "left",
    ).select(
        *out, F.when(F.col("_listed"), "block").otherwise("allow").alias("verdict")
    )
    return passed.unionByName(possible)

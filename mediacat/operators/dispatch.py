"""Routing: which extractor serves a URL, which site a search, whether search filters are valid."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col
from mediacat.functions.url import host, port, scheme, url_join

# What a plugin's priority is cut to where a built-in extractor competes, and a user's override.
BUILT_IN_MAX = 99
USER_MAX = 255


@dataclass(frozen=True)
class Extractor:
    """``claims`` are hosts a plugin may take over; ``override`` is a priority set by the user."""

    name: str
    pattern: str
    priority: int = 0
    plugin: bool = False
    claims: tuple[str, ...] = ()
    override: int | None = None


def dispatch_column(url: Column | str, extractors: Sequence[Extractor]) -> Column:
    """The name of the extractor of the highest effective priority; the last registered wins ties.

    All patterns are literals of one projection: no join, each compiled once per task.
    """
    u = as_col(url)
    h = F.coalesce(host(u), F.lit(""))
    suits = [u.rlike(e.pattern) for e in extractors]
    competitor = F.lit(False)
    for e, s in zip(extractors, suits):
        if not e.plugin:
            competitor = competitor | s
    ranked = []
    for i, (e, s) in enumerate(zip(extractors, suits)):
        if not e.plugin:
            priority = F.lit(e.priority)
        elif e.override is not None:
            priority = F.lit(min(e.override, USER_MAX))
        else:
            claimed = F.lit(False)
            for c in e.claims:
                claimed = claimed | (h == c) | h.endswith("." + c)
            priority = F.when(competitor & ~claimed, F.lit(min(e.priority, BUILT_IN_MAX))).otherwise(F.lit(e.priority))
        ranked.append(F.when(s, F.struct(priority.alias("priority"), F.lit(i).alias("i"), F.lit(e.name).alias("name"))))
    if len(ranked) == 1:
        return ranked[0]["name"]
    return F.greatest(*ranked)["name"] if ranked else F.lit(None).cast("string")


def dispatch_urls(df: DataFrame, extractors: Sequence[Extractor], url: str = "url") -> DataFrame:
    return df.withColumn("extractor", dispatch_column(url, extractors))


class ExtractorRegistry:
    """Extractors with the columns that make media records of the pages routed to them."""

    def __init__(self):
        self.extractors: list[Extractor] = []
        self.columns: dict[str, dict[str, Column]] = {}

    def register_extractor(
        self, name: str, pattern: str, columns: Mapping[str, Column], priority: int = 0, plugin: bool = True, **options
    ) -> None:
        """``columns`` are fields of the media schema (or a part of it), as columns of a page."""
        self.extractors.append(Extractor(name, pattern, priority, plugin, **options))
        self.columns[name] = dict(columns)

    def extract(self, pages: DataFrame, keep: Sequence[str], url: str = "url") -> DataFrame:
        """``keep`` of each routed page, its extractor's fields (NULL for those of others) and ``extractor``.

        One projection over the pages, however many extractors there are.
        """
        routed = dispatch_urls(pages, self.extractors, url)
        fields = dict.fromkeys(f for columns in self.columns.values() for f in columns)
        values = []
        for field in fields:
            own = [F.when(F.col("extractor") == name, columns[field]) for name, columns in self.columns.items() if field in columns]
            values.append(F.coalesce(*own).alias(field))
        return routed.where(F.col("extractor").isin(*self.columns)).select(*keep, *values, "extractor")


def search_winners(sites: DataFrame) -> DataFrame:
    """One row per site name: the built-in, unless a plugin claims it; else the plugin of the highest priority.

    ``sites`` has ``name, ordinal, plugin, overrides, priority``; the first registered wins ties.
    """
    named = sites.withColumn("site", F.lower("name"))
    row = F.struct("name", "ordinal", "plugin", "priority")
    rank = F.struct("priority", (-F.col("ordinal")).alias("o"))
    winners = named.groupBy("site").agg(
        F.min_by(row, F.when(~F.col("plugin"), F.col("ordinal"))).alias("built_in"),
        F.max_by(row, F.when(F.col("plugin") & F.col("overrides"), rank)).alias("claiming"),
        F.max_by(row, F.when(F.col("plugin"), rank)).alias("plugin"),
    )
    chosen = F.when(F.col("built_in").isNull(), F.col("plugin")).otherwise(F.coalesce("claiming", "built_in"))
    return winners.select("site", chosen.alias("w")).select("site", "w.*")


def dispatch_search_sites(searches: DataFrame, sites: DataFrame, site: str = "site") -> DataFrame:
    winners = search_winners(sites).select(F.col("site").alias("_site"), F.col("name").alias("extractor"))
    joined = searches.withColumn("_site", F.lower(site)).join(winners, "_site", "left")
    return joined.drop("_site")


def distinct_sites(sites: DataFrame) -> DataFrame:
    """Site names without regard to case; the first registered gives spelling and position."""
    first = sites.groupBy(F.lower("name").alias("site")).agg(F.min_by(F.struct("name", "ordinal"), "ordinal").alias("_f"))
    return first.select("_f.*")


def validate_filters(filters: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Each search filter with what is wrong with it: ``unknown_key``, ``non_numeric``, ``invalid_value`` or NULL.

    ``filters`` has ``key, value``; ``descriptors`` has ``key, allowed`` (array) and ``policy`` (``allowed``,
    ``numeric`` or ``free``).
    """
    known = descriptors.groupBy("key").agg(F.first("allowed").alias("_allowed"), F.first("policy").alias("_policy"))
    joined = filters.join(known, "key", "left")
    value = F.col("value")
    numeric = value.rlike(r"^\+?\d{1,10}$") & (value.try_cast("long") < (1 << 32))
    reason = (
        F.when(F.col("_policy").isNull(), "unknown_key")
        .when((F.col("_policy") == "numeric") & ~numeric, "non_numeric")
        .when((F.col("_policy") == "allowed") & ~F.array_contains("_allowed", value), "invalid_value")
    )
    return joined.withColumn("reason", reason).drop("_allowed", "_policy")


def same_origin(a: Column | str, b: Column | str) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & port(a).eqNullSafe(port(b))


def same_origin_links(df: DataFrame, base: str = "page_url", href: str = "href") -> DataFrame:
    """Links resolved against their page, those to other origins dropped."""
    resolved = df.withColumn("link", url_join(base, href))
    return resolved.where(F.coalesce(same_origin("link", base), F.lit(False)))


def is_retryable(status: Column | str) -> Column:
    """Failures worth another try: no status at all, 429, and 5xx."""
    s = as_col(status)
    return s.isNull() | (s == 429) | (s >= 500)

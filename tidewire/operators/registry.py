"""The catalog of sources: built-in and personal ones together, checks of drafts and manifests, and constraints of stored tables.

Checks give rows (rule, key) that break them; expected are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a personal source may be.
CONNECTORS, CATEGORIES = ("rss", "json"), ("global", "cyber", "defense", "policy")
LANGUAGES = ("tr", "en", "ar", "fr", "es", "ru", "de", "sr", "el", "az", "zh", "vi")
REGIONS = ("global", "north_america", "middle_east", "europe", "asia_pacific", "americas", "africa")


def personal_sources(sources: DataFrame) -> DataFrame:
    """Personal sources that are not deleted, the latest first."""
    return sources.where("deleted_at IS NULL").orderBy(F.desc("created_at"), "source_id")


def effective_catalog(built_in: DataFrame, personal: DataFrame) -> DataFrame:
    """Built-in sources and the enabled personal ones; a personal source stands in place of a built-in one with its id. personal: also enabled, deleted_at."""
    live = personal.where("enabled AND deleted_at IS NULL").select(built_in.columns)
    return built_in.join(live.select("source_id"), "source_id", "left_anti").select(built_in.columns).unionByName(live)


def draft_error(name: Column, connector: Column, category: Column, language: Column, region: Column, endpoint: Column) -> Column:
    """The first thing that is wrong with a draft of a personal source, null if nothing is."""
    size = F.length(F.trim(F.coalesce(name, F.lit(""))))
    url = F.trim(F.coalesce(endpoint, F.lit("")))
    known = lambda c, some: F.coalesce(c.isin(*some), F.lit(False))
    return (
        F.when((size < 2) | (size > 120), "invalid_name").when(~known(connector, CONNECTORS), "invalid_connector_type").when(~known(category, CATEGORIES), "invalid_category")
        .when(~known(language, LANGUAGES), "invalid_language").when(~known(region, REGIONS), "invalid_region").when(~url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^\s/?#]+|[^/\s])"), "invalid_url")
        .when(~url.rlike("(?i)^https://"), "https_required").when(url.rlike("^[^:]+://[^/?#]*@"), "credentials_in_url_not_allowed")
    )


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """Rows (source_id, error) of a manifest: source_id, endpoint, screens (array), min_s, base_s, max_s, mode, daily_budget."""
    c = F.col
    empty = F.coalesce("endpoint", F.lit("")) == ""
    rules = (
        (F.coalesce("source_id", F.lit("")) == "", "empty sourceId"), (empty, "missing endpoint"), (~empty & ~c("endpoint").rlike("(?i)^https://"), "endpoint must use https"),
        (F.coalesce(F.size("screens"), F.lit(0)) <= 0, "has no target screen"), (F.least("min_s", "base_s", "max_s") <= 0, "poll intervals must be positive"), (c("min_s") > c("base_s"), "min interval exceeds base"),
        (c("base_s") > c("max_s"), "base interval exceeds max"), (c("daily_budget") <= 0, "dailyRequestBudget must be positive"), ((c("mode") == "quota_limited") & c("daily_budget").isNull(), "quota_limited source needs a dailyRequestBudget"),
    )
    found = manifest.select("source_id", F.explode(F.array_compact(F.array(*(F.when(when, text) for when, text in rules)))).alias("error"))
    again = manifest.groupBy("source_id").agg(F.count("*").alias("n")).where("n > 1").select("source_id", F.explode(F.array_repeat(F.lit("duplicate sourceId"), (c("n") - 1).cast("int"))).alias("error"))
    return found.unionByName(again)


def breaks(rows: DataFrame, key: str, rule: str, holds: Column) -> DataFrame:
    """Rows (rule, key) for which a condition does not hold; an unknown one holds, as in a database's checks."""
    return rows.where(~F.coalesce(holds, F.lit(True))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def repeated(rows: DataFrame, columns: list[str], rule: str) -> DataFrame:
    """Rows (rule, key) for values of columns that several rows have; rows with a null in one don't count."""
    whole = rows.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    return whole.select(F.lit(rule).alias("rule"), F.concat_ws("|", *columns).alias("key"))


def unlisted(rows: DataFrame, key: str, column: str, values: list[str], rule: str) -> DataFrame:
    """Rows (rule, key) whose column has a value that is not listed."""
    return breaks(rows, key, rule, F.col(column).isin(*values))


def known_urls(asked: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """Asked rows (url) that some item has in one of several columns."""
    every = items.select(F.explode(F.array_compact(F.array(*columns))).alias("url")).distinct()
    return asked.join(every, "url", "left_semi")


def tags(groups: Column, topic: Column, most: int = 4) -> Column:
    """Up to ``most`` tags from an array of terms in order: words begin with a capital, short ones are all capitals, repeats by case go; the topic if none."""

    def shown(term: Column) -> Column:
        words = F.filter(F.split(term, r"[\s-]+"), lambda w: w != "")
        cased = F.transform(words, lambda w: F.when((F.length(w) <= 3) & (w == F.lower(w)), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))))
        return F.array_join(cased, " ")

    made = F.transform(groups, shown)
    first = F.filter(made, lambda tag, i: F.array_position(F.transform(made, lambda x: F.lower(x)), F.lower(tag)) == i + 1)
    kept = F.slice(first, 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(topic))

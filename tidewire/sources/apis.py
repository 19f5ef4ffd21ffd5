"""Items of news APIs whose answers are landed as a JSON column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.sources.feeds import clean, moment, text_field


@dataclass(frozen=True)
class Api:
    """Where an API's answer has what: paths and field names, the first that is not empty."""

    rows: str
    title: tuple[str, ...]
    url: tuple[str, ...]
    key: tuple[str, ...]
    summary: tuple[str, ...] = ()
    published: tuple[str, ...] = ()
    publisher: tuple[str, ...] = ()
    label: str = "{}"
    compact_time: bool = False
    placeholder: str = ""
    sentiment: str = ""
    countries: str = ""
    texts_name_countries: bool = True


#: Layouts of the answers.
APIS = {
    "gdelt": Api("articles", ("title",), ("url",), ("url",), (), ("seendate",), ("domain",), compact_time=True, texts_name_countries=False),
    "currents": Api("news", ("title",), ("url",), ("id",), ("description",), ("published",), label="Currents API"),
    "newsdata": Api("results", ("title",), ("link",), ("article_id",), ("description",), ("pubDate",), ("source_name",)),
    "worldnews": Api("news", ("title",), ("url",), ("id",), ("text", "summary"), ("publish_date",), label="World News API"),
    "freenews": Api("data", ("title",), ("original_url",), ("uuid",), ("body", "subtitle"), ("published_at",), ("publisher",), placeholder="https://www.freenewsapi.io/article/"),
    "finlight": Api("articles", ("title",), ("link",), ("link",), ("summary",), ("publishDate",), ("source",), sentiment="sentiment", countries="countries"),
    "reliefweb": Api("data", ("fields.title",), ("fields.url_alias", "fields.url", "href"), ("id",), ("fields.body-html", "fields.body"), ("fields.date.created",), countries=""),
}
_COMPACT = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})"


def countries_in(text: Column, names: list[str]) -> Column:
    """Names that occur in a text as whole words, case apart, long names first."""
    ordered = sorted(names, key=lambda n: (-len(n), n))
    return F.array_compact(F.array(*(F.when(text.rlike(rf"(?i)\b{re.escape(n)}\b"), F.lit(n)) for n in ordered))) if ordered else F.array().cast("array<string>")


def api_items(answers: DataFrame, api: str, countries: list[str]) -> DataFrame:
    """Rows (source_id, ordinal, upstream_id, title, url, summary, published, publisher, countries) of one API's answers (source_id, body).

    Articles without a title or (but for a placeholder) an address are left out; of repeated addresses of a source the first stays.
    ``countries`` are the API's own that are known names, then those that title and summary name, each once.
    """
    spec = APIS[api]
    rows = answers.select("source_id", F.posexplode(F.try_variant_get(F.try_parse_json("body"), f"$.{spec.rows}", "array<variant>")).alias("ordinal", "row"))
    summary = F.coalesce(clean(text_field(*spec.summary)), F.lit("")) if spec.summary else F.lit("")
    tone = text_field(spec.sentiment) if spec.sentiment else F.lit(None).cast("string")
    key = F.coalesce(text_field(*spec.key), F.try_variant_get("row", f"$.{spec.key[0]}", "string"))
    url = F.coalesce(text_field(*spec.url), F.concat(F.lit(spec.placeholder), key) if spec.placeholder else F.lit(None).cast("string"))
    raw = text_field(*spec.published)
    published = moment(F.when(raw.rlike(_COMPACT), F.regexp_replace(raw, _COMPACT + ".*$", "$1-$2-$3T$4:$5:$6Z")) if spec.compact_time else raw)
    title = text_field(*spec.title)
    named = countries_in(F.concat_ws(" ", title, summary), countries) if spec.texts_name_countries else F.array().cast("array<string>")
    if spec.countries:
        own = F.try_variant_get("row", f"$.{spec.countries}", "array<string>")
        known = F.create_map(*(F.lit(x) for n in countries for x in (n.lower(), n))) if countries else F.create_map().cast("map<string,string>")
        named = F.array_distinct(F.concat(F.array_compact(F.transform(F.coalesce(own, F.array().cast("array<string>")), lambda c: F.try_element_at(known, F.lower(c)))), named))
    publisher = text_field(*spec.publisher) if spec.publisher else F.lit(spec.label)
    items = rows.select(
        "source_id", "ordinal", key.alias("upstream_id"), title.alias("title"), url.alias("url"), F.concat(F.when(tone.isNotNull() & (tone != "neutral"), F.concat(F.lit("[Sentiment: "), tone, F.lit("] "))).otherwise(""), summary).alias("summary"),
        published.alias("published"), publisher.alias("publisher"), named.alias("countries"),
    ).where("title <> '' AND url <> ''")
    rest = [c for c in items.columns if c not in ("source_id", "url")]
    return items.groupBy("source_id", "url").agg(F.min_by(F.struct(*rest), "ordinal").alias("_row")).select("source_id", "url", "_row.*").select(items.columns)

"""Items of RSS, Atom and JSON feeds whose bodies are a string column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import fold

#: Most blocks scanned, items kept and JSON rows read of a feed; longest title, and summary of a JSON row.
MAX_BLOCKS, MAX_ITEMS, MAX_ROWS, MAX_TITLE, MAX_SUMMARY = 200, 150, 100, 500, 4000
ENVELOPES = ("items", "articles", "results", "data", "entries")
#: Patterns, on text without case and accents, of items that advertise the publisher.
NOT_NEWS = (
    r"abone\s*ol", "subscribe", "subscription", "newsletter", r"bildirimleri\s*ac", "telefonunuzda", "whatsapp", r"uygulamamizi\s*indirin",
    "podcast.*abone", r"haberleri\s*takip\s*etmek\s*icin", r"bizi\s*takip\s*edin", r"sosyal\s*medya",
)
#: Layouts of times that feeds have beside ISO 8601, weekday removed.
LAYOUTS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "yyyy/MM/dd")


def tag(block: Column, *names: str) -> Column:
    """Text of the first of these tags that is not empty, any name space, CDATA unwrapped."""
    found = []
    for name in names:
        inner = F.regexp_extract(block, rf"(?is)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}\s*>", 1)
        found.append(F.nullif(F.trim(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit("")))
    return F.coalesce(*found)


def _numeric(text: Column, pattern: str, base: int) -> Column:
    """Decode character references by number; ``pattern`` has the number as its group. Numbers are UTF-16 units."""
    units = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.decode(F.unhex(F.substring(F.lpad(F.conv(n, base, 16), 8, "0"), 5, 4)), "UTF-16BE"))
    between = F.split(text, pattern.replace("(", "(?:"), -1)
    joined = F.array_join(F.zip_with(between, units, lambda x, unit: F.concat(x, F.coalesce(unit, F.lit("")))), "")
    return F.when(text.rlike(pattern), joined).otherwise(text)


def decode(text: Column) -> Column:
    """Named references, then references by number, ``&amp;`` last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " ")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(_numeric(_numeric(text, r"&#(\d+);", 10), r"&#[xX]([0-9a-fA-F]+);", 16), F.lit("&amp;"), F.lit("&"))


def clean(text: Column) -> Column:
    """References decoded, markup dropped, white space squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(decode(text), r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))


def body_kind(body: Column) -> Column:
    """What a body is, by its start for HTML and else by the first root found anywhere in it."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"^\ufeff?(?U)\s*", "")
    return (
        F.when(text == "", "empty").when(text.rlike(r"(?i)^<(?:!doctype\s+html|html)\b"), "html").when(text.rlike(r"(?i)<(?:[\w.-]+:)?(?:rss|rdf)\b"), "rss")
        .when(text.rlike(r"(?i)<(?:[\w.-]+:)?feed\b"), "atom").when(text.startswith("<"), "xml").otherwise("other")
    )


def is_news(text: Column) -> Column:
    """Whether a text matches none of the publisher's own notices."""
    return ~F.replace(fold(F.coalesce(text, F.lit(""))), F.lit("ı"), F.lit("i")).rlike("|".join(NOT_NEWS))


def moment(text: Column) -> Column:
    """A feed's time as ISO 8601 in UTC, null if it is none."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", ""), r"\b(?:GMT|UTC|UT|Z)$", "+0000")
    iso = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}")
    parsed = F.coalesce(F.when(iso, F.trim(text).try_cast("timestamp")), *(F.try_to_timestamp(plain, F.lit(x)) for x in LAYOUTS))
    return F.date_format(F.to_utc_timestamp(parsed, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def web_link(text: Column) -> Column:
    return F.when(F.trim(text).rlike(r"(?i)^https?://[^\s/?#]+"), F.trim(text))


def ttl_seconds(body: Column) -> Column:
    minutes = F.regexp_extract(body, r"(?i)<ttl>\s*(\d+)\s*</ttl>", 1).try_cast("int")
    return F.when(minutes > 0, minutes * 60)


def xml_items(feeds: DataFrame, notices: bool = False) -> DataFrame:
    """Rows (source_id, ordinal, guid, title, link, summary, published) of RSS, RDF and Atom bodies.

    Items without a title and, unless ``notices``, the publisher's own notices are left out and don't count as items kept;
    summaries are whole; other bodies have no items. ``published`` is as the feed has it, see ``moment``; a link that is not
    http(s) is null. feeds: source_id, body.
    """
    body, kind = F.col("body"), body_kind(F.col("body"))
    atom = (kind == "atom") | (body.rlike(r"(?i)<(?:[\w.-]+:)?entry\b") & ~body.rlike(r"(?i)<(?:[\w.-]+:)?item\b"))
    blocks = lambda name: F.slice(F.regexp_extract_all("body", F.lit(rf"(?is)<(?:[\w.-]+:)?{name}\b[^>]*>(.*?)</(?:[\w.-]+:)?{name}>"), F.lit(1)), 1, MAX_BLOCKS)

    def item(block: Column, ordinal: Column) -> Column:
        title = clean(tag(block, "title"))
        short = F.when(F.length(title) > MAX_TITLE, F.concat(F.rtrim(F.substring(title, 1, MAX_TITLE - 1)), F.lit("..."))).otherwise(title)
        return F.struct(ordinal.alias("ordinal"), block.alias("block"), short.alias("title"), clean(tag(block, "description", "summary", "content:encoded", "encoded", "content")).alias("summary"))

    kept = F.filter(F.transform(F.when(atom, blocks("entry")).otherwise(blocks("item")), item), lambda x: (x["title"] != "") & (F.lit(notices) | is_news(F.concat_ws(" ", x["title"], x["summary"]))))
    rows = feeds.where(kind.isin("rss", "atom") | (atom & (kind != "html"))).select("source_id", F.inline(F.slice(kept, 1, MAX_ITEMS)))
    block = F.col("block")
    href = F.coalesce(*(F.nullif(F.regexp_extract(block, p, 1), F.lit("")) for p in (
        r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']alternate["'])[^>]*\bhref\s*=\s*["']([^"']+)["']""", r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["']""")))  # fmt: skip
    return rows.select(
        "source_id", "ordinal", tag(block, "guid", "id").alias("guid"), "title", web_link(decode(F.coalesce(href, tag(block, "link")))).alias("link"), "summary",
        tag(block, "pubDate", "published", "updated", "date").alias("published"),
    )


def text_field(*names: str) -> Column:
    """The first of some fields of a variant ``row`` that is a text and not empty; dots lead into objects."""

    def text(name: str) -> Column:
        path = "$" + "".join(f"['{x}']" for x in name.split("."))
        is_text = F.schema_of_variant(F.try_variant_get("row", path, "variant")) == "STRING"
        return F.when(is_text, F.nullif(F.trim(F.try_variant_get("row", path, "string")), F.lit("")))

    return F.coalesce(*map(text, names))


def json_items(feeds: DataFrame) -> DataFrame:
    """Rows (source_id, ordinal, guid, title, link, summary, published) of JSON feeds and common envelopes.

    Rows without a title are left out. Links that are not http(s) and times that are none are null.
    """
    doc = F.try_parse_json("body")
    arrays = [F.try_variant_get(doc, p, "array<variant>") for p in ("$", *(f"$.{e}" for e in ENVELOPES), *(f"$.data.{e}" for e in ENVELOPES if e != "data"))]
    rows = feeds.select("source_id", F.posexplode(F.slice(F.coalesce(*arrays), 1, MAX_ROWS)).alias("ordinal", "row"))

    out = rows.select(
        "source_id", "ordinal", text_field("id", "guid", "uuid").alias("guid"), F.substring(text_field("title", "headline", "name"), 1, MAX_TITLE).alias("title"), web_link(text_field("url", "link", "web_url", "external_url")).alias("link"),
        F.substring(text_field("summary", "description", "content_text", "excerpt"), 1, MAX_SUMMARY).alias("summary"),
        moment(text_field("date_published", "publishedAt", "published_at", "pubDate", "date", "created_at")).alias("published"),
    )
    return out.where("title <> ''")

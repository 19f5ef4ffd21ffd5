"""Phrases in texts, and relevance scores from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import filter_words
from tidewire.operators.terms import MOST_TERMS, term_places

#: Phrases that are looked for in one pass; more take further passes.
MAX_PATTERN_PHRASES = MOST_TERMS
#: Most lexicon rows that are broadcast.
MAX_BROADCAST_PHRASES = 200_000
#: Fixed values of the relevance score: for each further phrase of a group, up to so many; noise, official and aggregator
#: sources, several domains, a known context; least score that is accepted; the group of noise phrases.
FURTHER, MOST_FURTHER, NOISE, OFFICIAL, AGGREGATOR, SEVERAL, CONTEXT, LEAST, NEGATIVE = 3, 3, 5, 15, 20, 10, 28, 25, "negative"


def phrase_hits(texts: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Rows (id, group, phrase, hits): occurrences of each phrase as a whole run of words; they may overlap.

    texts: id and text; lexicon: group, phrase, of any number and length. Texts and phrases are compared as ``filter_words`` gives
    them; ``phrase`` comes back as it was given. A phrase under several groups counts in each. Null texts have no hits.
    """
    spelled = lexicon.select("group", "phrase", filter_words(F.col("phrase")).alias("term"))
    found = term_places(texts.select("id", filter_words(F.col(text)).alias("text")), spelled.select(F.lit("").alias("group"), "term"), limit=MAX_PATTERN_PHRASES, overlap=True)
    return found.groupBy("id", "term").agg(F.count("*").alias("hits")).join(spelled, "term").select("id", "group", "phrase", "hits")


def relevance(texts: DataFrame, hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows (id, domain, score, accepted, rejected_by) of every text.

    texts: id, official, aggregator (boolean), context (a domain that the event type gives, or null), and guard, if there is such a column: a reason
    against the item, which without a context rejects it at once. groups: group, domain,
    base, place (its order), strong. A group with k different phrases scores base + 3 * min(k - 1, 3); the score is the sum over
    all groups, less 5 (not below 0) with noise phrases, which are those of the group NEGATIVE, plus the source's, the context's
    and, with several domains, 10 more points. Noise without a strong group or a context is rejected at once. The domain is the one with
    most points, on ties the one whose first group comes first, a context's own last.
    """
    n_groups = groups.count()
    small = n_groups <= MAX_BROADCAST_PHRASES
    noisy = hits.where(F.col("group") == NEGATIVE).select("id").distinct().withColumn("noise", F.lit(True))
    by_group = hits.groupBy("id", "group").agg(F.count_distinct("phrase").alias("k")).join(F.broadcast(groups) if small else groups, "group")
    points = F.col("base") + FURTHER * F.least(F.col("k") - 1, F.lit(MOST_FURTHER))
    by_domain = by_group.groupBy("id", "domain").agg(F.sum(points).alias("points"), F.min("place").alias("place"), F.bool_or("strong").alias("strong"))
    context = texts.where("context IS NOT NULL").select("id", F.col("context").alias("domain"), F.lit(CONTEXT).alias("points"), F.lit(n_groups).alias("place"), F.lit(False).alias("strong"), F.lit(True).alias("given"))
    merged = by_domain.withColumn("given", F.lit(False)).unionByName(context).groupBy("id", "domain").agg(
        F.sum("points").alias("points"), F.min("place").alias("place"), F.bool_or("strong").alias("strong"), F.sum(F.when(~F.col("given"), F.col("points"))).alias("words"))
    by_text = merged.groupBy("id").agg(
        F.sum("words").alias("words"), F.count("words").alias("domains"), F.bool_or("strong").alias("strong"), F.max_by("domain", F.struct("points", -F.col("place"))).alias("domain"))
    guard = F.col("guard") if "guard" in texts.columns else F.lit(None).cast("string")
    rows = texts.select("id", "official", "aggregator", "context", guard.isNotNull().alias("_guarded")).join(by_text, "id", "left").join(noisy, "id", "left")
    noise, known = F.coalesce("noise", F.lit(False)), F.col("context").isNotNull()
    score = F.coalesce("words", F.lit(0))
    score = F.when(noise, F.greatest(score - NOISE, F.lit(0))).otherwise(score)
    for when, more in ((F.col("official"), OFFICIAL), (F.col("aggregator"), AGGREGATOR), (F.col("domains") > 1, SEVERAL), (known, CONTEXT)):
        score = score + F.when(when, more).otherwise(0)
    barred = ((noise & ~F.coalesce("strong", F.lit(False))) | F.col("_guarded")) & ~known
    rows = rows.select("id", F.when(~barred, F.col("domain")).alias("domain"), F.when(barred, 0).otherwise(score).cast("long").alias("score"), barred.alias("_barred"))
    accepted = ~F.col("_barred") & (F.col("score") >= LEAST) & F.col("domain").isNotNull()
    reason = F.when(F.col("_barred"), "negative_noise").when(~accepted, "low_relevance")
    return rows.select("id", "domain", "score", accepted.alias("accepted"), reason.alias("rejected_by"))

"""Defense industry in news items: segments, activities, programs, makers, materials, and which country buys from which."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.lexical import marked
from tidewire.operators.terms import ALL, GROUP, NONE, term_places

#: Characters around a country's name that are looked at.
WINDOW = 60
BUYER, SUPPLIER, NEUTRAL = "buyer", "supplier", "neutral"
#: What follows or comes before a country that buys or supplies.
BUYS_AFTER = r"^(?:'s)?\s+(?:to\s+|will\s+|plans?\s+to\s+|is\s+set\s+to\s+|has\s+|had\s+|would\s+)?(?:buy|buys|bought|acquire|acquires|acquired|order|orders|ordered|procure|procures|procured|purchase|purchases|purchased|select|selects|selected|choose|chooses|chose|receive|receives|received|deploy|deploys|deployed|operate|operates)\b"
SUPPLIES_AFTER = r"^(?:'s)?\s+(?:to\s+|will\s+|has\s+)?(?:supply|supplies|supplied|deliver|delivers|delivered|export|exports|exported|sell|sells|sold|provide|provides|provided|manufacture|manufactures|produced?|build|builds|built)\b"
MADE_AFTER, MADE_BEFORE = r"^[- ](?:made|built|manufactured|designed|supplied|origin)\b", r"(?:from|built by|made by|manufactured by|supplied by|produced by)\s+$"
SOLD_TO_BEFORE = r"(?:sale|sales|export|exports|deliver|delivery|deliveries|supply|sell|transfer|transfers)\s+(?:of\s+)?(?:\w+\s+){0,4}?to\s+$"
MAKERS_AFTER = r"^[ ](?:[a-z-]+ ){0,2}(?:firm|firms|company|companies|manufacturer|manufacturers|maker|makers|contractor|contractors|shipyard|defense firm|defence firm|conglomerate|industry|industries|group)\b"
#: Points of a platform for its segment; least points of a segment, commodity or activity; least weight of a segment's strongest term.
PLATFORM_POINTS, LEAST, STRONG = 3, 2, 2
#: Activities of items without one, by segment; activities with more impact; the one that stress makes so; words of value and urgency.
BY_SEGMENT, OTHER_ACTIVITY = {"Naval": "Naval Program", "UAV / Unmanned": "UAV / Aerospace", "Aerospace": "UAV / Aerospace"}, "Industrial Partnership"
MAJOR, STRESSED = ("Procurement", "Export Review", "Naval Program", "Production Capacity"), "Supply Chain"
VALUE, URGENT = ("billion", "million", "multi-year", "multiyear", "largest", "record", "biggest", "$"), ("urgent", "immediate", "breaking", "halt", "grounded", "crisis", "emergency", "scrambled")
#: Bodies that stand for an organisation where none is named, in order, and labels of what is not known.
BODIES = (("Pentagon", ("pentagon",)), ("NATO", ("nato",)), ("Defense Ministry", ("ministry of defense", "defense ministry")))
UNKNOWN, NOWHERE, SEVERAL = "Not specified", "Global / Unspecified", "Multi-region"
#: Kinds of lexicon rows whose terms have weights, and of those that only name something.
WEIGHTED, NAMED = ("segment", "activity", "commodity", "stress"), ("platform", "contractor", "relevance")
FACT = "struct<kind:string,name:string,place:int,score:long,top:long,link:string,role:string,link_place:int>"


def country_role(before: Column, after: Column, demonym: Column) -> Column:
    """Whether one mention of a country buys or supplies; the first rule that holds."""
    supplies = after.rlike(MADE_AFTER) | before.rlike(MADE_BEFORE) | after.rlike(SUPPLIES_AFTER) | (demonym & after.rlike(MAKERS_AFTER))
    return F.when(supplies, SUPPLIER).when(before.rlike(SOLD_TO_BEFORE) | after.rlike(BUYS_AFTER), BUYER).otherwise(NEUTRAL)


def _facts(items: DataFrame, lexicon: DataFrame, countries: DataFrame) -> DataFrame:
    """Rows (id, facts): all that an item's words name, one element a name."""
    texts, spark = marked(items), items.sparkSession
    own = [("value", "", t) for t in VALUE] + [("urgent", "", t) for t in URGENT] + [("body", n, t) for n, ts in BODIES for t in ts]
    cues = spark.createDataFrame([(k, n, t, i) for i, (k, n, t) in enumerate(own)], "kind string, name string, term string, place int")
    key = F.concat_ws("\u0000", "kind", "name").alias("group")
    split = lambda df: df.withColumns({"kind": F.split_part("group", F.lit("\u0000"), F.lit(1)), "name": F.split_part("group", F.lit("\u0000"), F.lit(2))})

    weighed = lexicon.where(F.col("kind").isin(*WEIGHTED))
    weights = weighed.select(key, "term", "weight").groupBy("group", "term").agg(F.max("weight").cast("long").alias("weight"))
    scores = term_places(texts, weighed.select(key, "term"), GROUP, every=False, plural=True).join(weights, ["group", "term"]).groupBy("id", "group").agg(F.sum("weight").alias("score"), F.max("weight").alias("top"))
    names = lexicon.where(F.col("kind").isin(*NAMED)).select("kind", "name", "term", "place").unionByName(cues)
    named = term_places(texts, names.select(key, "term"), NONE, every=False, plural=True).select("id", "group").distinct()
    facts = split(scores).unionByName(split(named), allowMissingColumns=True)
    of = lexicon.groupBy("kind", "name").agg(F.min("place").alias("place"), F.first("link").alias("link")).unionByName(cues.groupBy("kind", "name").agg(F.min("place").alias("place")), allowMissingColumns=True)
    segments = lexicon.where("kind = 'segment'").groupBy(F.col("name").alias("link")).agg(F.min("place").alias("link_place"))
    facts = facts.join(of.join(segments, "link", "left"), ["kind", "name"])

    found = term_places(texts, countries.select(F.col("country").alias("group"), "term"), ALL, window=WINDOW).join(countries.groupBy("country", "term").agg(F.bool_or("demonym").alias("demonym")).withColumnRenamed("country", "group"), ["group", "term"])
    order = F.struct((-F.length("term")).alias("a"), F.col("term").alias("b"), F.col("first").alias("c"))
    role = country_role(F.col("before"), F.col("after"), F.col("demonym"))
    said = found.withColumn("role", role).groupBy("id", "group").agg(F.min(order).alias("seen"), F.min_by("role", F.struct((F.col("role") == NEUTRAL).alias("x"), order.alias("y"))).alias("role"))
    home = countries.groupBy("country").agg(F.min("region").alias("link")).withColumnRenamed("country", "group")
    said = said.join(home, "group").select("id", F.lit("country").alias("kind"), F.col("group").alias("name"), F.lit(0).alias("place"), "role", "link", "seen")
    rows = facts.unionByName(said, allowMissingColumns=True)
    ordered = F.array_sort(F.collect_list(F.struct("place", "seen", "name", "kind", "score", "top", "link", "role", "link_place")))
    return rows.groupBy("id").agg(F.transform(ordered, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "name", "place", "score", "top", "link", "role", "link_place"))).cast(FACT)).alias("facts"))


def detect(items: DataFrame, lexicon: DataFrame, countries: DataFrame) -> DataFrame:
    """Rows (id, relevant, segments, segment, activity, organisations, organisation, programs, program, commodities, area, stress, countries, parties, confidence, impact, priority) of every item.

    items: id (one row each), text, official (boolean), and summary, if there is such a column; lexicon: kind (of WEIGHTED and NAMED), name, term, weight, place (order of names), link (a
    platform's segment, a contractor's country); countries: country, region, term, demonym (boolean). All terms but countries' may end in s or es. A country
    that is only named and is the home of a named contractor supplies. ``parties`` tells suppliers and buyers, two of each at most.
    """
    facts = _facts(items, lexicon, countries)
    rows = items.select("id", F.coalesce("official", F.lit(False)).alias("_official")).join(facts, "id", "left").withColumn("facts", F.coalesce("facts", F.array().cast(f"array<{FACT}>")))
    of = lambda kind: F.filter("facts", lambda x: x["kind"] == kind)
    names = lambda c: F.transform(c, lambda x: x["name"])
    rows = rows.withColumns({"_platforms": of("platform"), "_makers": of("contractor"), "_scored": of("segment"), "commodities": names(F.filter(of("commodity"), lambda x: x["score"] >= LEAST)), "stress": F.coalesce(F.get(of("stress"), 0)["score"], F.lit(0)), "_countries": of("country")})
    boost = lambda s: PLATFORM_POINTS * F.size(F.filter("_platforms", lambda p: p["link"] == s))
    segments = F.filter(F.transform("_scored", lambda x: F.struct((-(x["score"] + boost(x["name"]))).alias("low"), x["place"].alias("place"), x["name"].alias("name"), (x["top"] >= STRONG).alias("strong"))), lambda x: (x["low"] <= -LEAST) & (x["strong"] | (boost(x["name"]) > 0)))
    bare = F.filter("_platforms", lambda p: p["link"].isNotNull() & ~F.exists("_scored", lambda x: x["name"] == p["link"]))
    only = F.array_distinct(F.transform(bare, lambda p: F.struct((-boost(p["link"])).cast("long").alias("low"), p["link_place"].alias("place"), p["link"].alias("name"), F.lit(True).alias("strong"))))
    rows = rows.withColumn("_segments", F.array_sort(F.concat(segments, only)))
    top = F.get("_segments", 0)["name"]
    ranked = F.array_sort(F.transform(F.filter(of("activity"), lambda x: x["score"] >= LEAST), lambda x: F.struct((-x["score"]).alias("low"), x["place"].alias("place"), x["name"].alias("name"))))
    other = F.lit(OTHER_ACTIVITY)
    for segment, activity in BY_SEGMENT.items():
        other = F.when(top == segment, activity).otherwise(other)
    homes = F.transform("_makers", lambda m: m["link"])
    parties = F.transform("_countries", lambda c: F.struct(c["name"].alias("country"), c["link"].alias("region"), F.when((c["role"] == NEUTRAL) & F.coalesce(F.array_contains(homes, c["name"]), F.lit(False)), SUPPLIER).otherwise(c["role"]).alias("role")))
    rows = rows.withColumns({"activity": F.coalesce(F.get(ranked, 0)["name"], other), "countries": parties, "organisations": names("_makers"), "programs": names("_platforms")})
    who = lambda role: F.transform(F.filter("countries", lambda c: c["role"] == role), lambda c: c["country"])
    rows = rows.withColumns({"_buyers": who(BUYER), "_suppliers": who(SUPPLIER), "_others": F.filter("countries", lambda c: c["role"] == NEUTRAL)})
    two = lambda c: F.array_join(F.slice(c, 1, 2), " / ")
    some = lambda c: F.size(c) > 0
    regions = F.array_distinct(F.transform("_others", lambda c: c["region"]))
    label = (F.when(some("_suppliers") & some("_buyers"), F.concat(two("_suppliers"), F.lit(" → "), two("_buyers"))).when(some("_buyers"), F.concat(two("_buyers"), F.lit(" (buyer)"))).when(some("_suppliers"), F.concat(two("_suppliers"), F.lit(" (supplier)")))
             .when(F.size("_others") == 1, F.get("_others", 0)["country"]).when((F.size("_others") > 1) & (F.size(regions) == 1), F.get(regions, 0)).when(F.size("_others") > 1, SEVERAL).otherwise(NOWHERE))
    one = lambda c: F.when(c, 1).otherwise(0)
    signals = one(some("organisations")) + one(some("programs")) + one(some("_buyers") | some("_suppliers")) + one(some("commodities")) + one(some("_segments"))
    trust = F.least(F.lit(5), F.greatest(F.lit(2), F.when(F.col("_official"), 3).otherwise(2) + F.least(signals, F.lit(3)) - 1))
    impact = F.least(F.lit(5), 2 + one(F.col("activity").isin(*MAJOR)) + one(some(of("value"))) + one((F.col("stress") > 0) & (F.col("activity") == STRESSED)))
    band = lambda level: F.when(level >= 4, "High").when(level >= 3, "Medium").otherwise("Low")
    rows = rows.withColumns({"_trust": trust, "_impact": impact, "parties": label})
    relevant = some("_segments") | some("organisations") | some("programs") | some("commodities") | some(of("relevance"))
    priority = F.when((F.col("_impact") >= 4) & some(of("urgent")), "elevated").when(F.col("_impact") >= 4, "high").when(F.col("_impact") >= 3, "medium").otherwise("low")
    first = lambda c: F.coalesce(F.get(c, 0), F.lit(UNKNOWN))
    return rows.select(
        "id", relevant.alias("relevant"), names("_segments").alias("segments"), first(names("_segments")).alias("segment"), "activity", "organisations", F.coalesce(F.get("organisations", 0), F.get(names(of("body")), 0), F.lit(UNKNOWN)).alias("organisation"), "programs", first("programs").alias("program"),
        "commodities", F.when(some("commodities"), F.array_join(F.slice("commodities", 1, 3), ", ")).otherwise(UNKNOWN).alias("area"), "stress", "countries", "parties", band(F.col("_trust")).alias("confidence"), band(F.col("_impact")).alias("impact"), priority.alias("priority"))


def commodity_mentions(detected: DataFrame) -> DataFrame:
    """Rows (commodity, stressed) of relevant items, as ``pressure`` takes them."""
    return detected.where("relevant").select(F.explode("commodities").alias("commodity"), (F.col("stress") > 0).alias("stressed"))

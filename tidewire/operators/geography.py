"""Where a news item takes place: candidates from names in its words, places of anchors, and the decision among all evidence.

Names of a gazetteer are found by one automaton with their offsets; what stands right before and after a name tells how the
item speaks of it. Everything is an expression over the row's own hits, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import filter_words
from tidewire.operators.terms import term_hits


class Place(NamedTuple):
    """A place of a gazetteer; ``weak`` are those of its names that do not stand for it alone, as persons and bodies."""

    label: str
    lat: float
    lng: float
    country_code: str | None
    region: str | None
    names: Sequence[str]
    weak: Sequence[str] = ()


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",")]


#: Words that join a name to what follows it, directions before a name.
POSSESSIVES = _list("nin, in, nun, un, s")
CASES = _list("a, e, ya, ye, da, de, dan, den, daki, deki, taki, teki")
DIRECTIONS = _list("north, northern, south, southern, east, eastern, west, western, central, kuzey, guney, dogu, bati, orta")
#: Who acts for a country, and what countries do.
OFFICIALS = _list(
    "foreign ministry, ministry of foreign affairs, foreign minister, state department, defense ministry, defence ministry, ministry of defense, ministry of defence, presidency, president, prime minister, government, cabinet, "
    "diplomatic mission, embassy, leader, mps, mp, lawmakers, parliament, corps, army, military, combat medics, foreign spy chief, disisleri bakanligi, disisleri bakani, savunma bakanligi, savunma bakani, cumhurbaskanligi, "
    "cumhurbaskani, basbakan, basbakani, hukumet, hukumeti, bakanlar kurulu, buyukelcilik, diplomatik misyon")
ACTIONS = _list(
    "cuts ties, cut ties, denies, denied, accuses, accused, reaffirms, reaffirm, votes, vote, overturning, set to dominate, inch closer, launches strikes, rejects, preparing, to take, will take, says, said, announced, agreed, "
    "agreeing, denies agreeing, karar aldi, reddetti, sucladi, acikladi, oyladi")
#: Words before and after the place of an event.
EVENT_BEFORE = _list("in, near, around, across, inside, from, toward, towards, over, at, within, into, outside, off, de, da, den, dan")
EVENT_AFTER = _list(
    "da, de, daki, deki, taki, teki, yakini, yakininda, civarinda, bolgesinde, sinirinda, kiyisinda, aciklarinda, war, conflict, combat zone, combat zones, crisis, ceasefire, fight, force, stability force, tension, dispute, "
    "patrol, drill, exercise, border, front, frontline, airspace, territory, coast, strait, region, province, capital, airstrike, strike, missile, drone, shelling, invasion, sanctions, talks, summit, sinir, siniri, bolge, bolgesi, "
    "hava, sahasi, toprak, saldiri, ateskes, talimati, talimat, isgal, isgal alani, istikrar gucu, gucu, gerilim, ihtilaf, devriye, tatbikat, kriz, savasi, savas, yaptirim, muzakere, zirve, refugee returns, returns dashboard, "
    "dashboard, elections, election, insecurity, train station, stabbing, terror, partnership, funding, hospital care, malnutrition, refugee, refugees, desplazamientos, confinamientos, people of, municipio de, department of")
#: Words of talks, and words before and after a target.
TALKS = _list("talks, negotiations, summit, meeting, mediation, ceasefire talks, peace talks, muzakere, muzakereler, gorusme, gorusmeler, zirve, arabuluculuk, ateskes gorusmeleri")
TARGET_BEFORE = _list("against, on, targeting, hits, hit, strikes, strike, attacks, attack, sanctions, embargo, karsi, hedef alan, hedefledi, vurulan, vurdu, saldirdi, yaptirim, ambargo, blacklist, adds, add")
TARGET_AFTER = _list("sanctions, embargo, targeted, hit, struck, attacked, vuruldu, hedef alindi, yaptirim, ambargo, blacklist, blacklisted, sanctions law")
#: Ways in which a text speaks of a place, in order, with the scores of names of several words and of one.
METHODS = (("official_actor_phrase", 96, 90), ("headline_location_prefix", 86, 82), ("country_actor_phrase", 90, 84), ("negotiation_location_phrase", 97, 91), ("event_location_phrase", 95, 88), ("target_country_phrase", 90, 84), ("mentioned_location_phrase", 74, 70))
OFFICIAL, HEADLINE, ACTOR, TALK, EVENT, TARGET, MENTION, CONTEXT = range(8)
#: Characters before and after a name that are looked at; all phrases are shorter.
WINDOW = 64


def _any(phrases: Sequence[str]) -> str:
    return "(?:" + "|".join(sorted(phrases, key=lambda p: -len(p))) + ")"


_LEAD = rf"(?:the )?(?:{_any(DIRECTIONS)} )?$"
_CASE = f"(?: {_any(CASES)})?"
BEFORE_EVENT, PEOPLE_OF = rf"(?:^| ){_any(EVENT_BEFORE)} {_LEAD}", "(?:^| )people of the $"
AFTER_PLAIN, AFTER_EVENT = rf"^ {_any(EVENT_AFTER)}(?: |$)", rf"^{_CASE} {_any(EVENT_AFTER)}(?: |$)"
HEAD_BEFORE = "^(?:world|global|update|flash update) $"
AFTER_ACTOR, AFTER_OFFICIAL = rf"^ {_any(ACTIONS)}(?: |$)", rf"^(?: {_any(POSSESSIVES)})? {_any(OFFICIALS)}(?: |$)"
BEFORE_TARGET, AFTER_TARGET = rf"(?:^| ){_any(TARGET_BEFORE)}{_CASE} {_LEAD}", rf"^{_CASE} {_any(TARGET_AFTER)}(?: |$)"
IN_TALKS = rf"(?:^| ){_any(TALKS)}(?: |$)"

_FACTS = "struct<rank:int,place:int,key:string,label:string,country_code:string,region:string,lat:double,lng:double,tokens:int,weak:boolean,name:string>"
CANDIDATES = "array<struct<label:string,country_code:string,region:string,lat:double,lng:double,method:string,score:int,name:string>>"


class Gazetteer:
    """Places with their names as words; built from (name, plain name) pairs that Spark folded."""

    def __init__(self, places: Sequence[Place], plain: dict[str, str]):
        self.rows, self.terms = [], []
        for number, p in enumerate(places):
            weak, seen = {plain[n] for n in p.weak}, set()
            for name in p.names:
                if plain[name] and plain[name] not in seen:
                    seen.add(plain[name])
                    self._add(number, p, name, plain[name], plain[name] in weak)
        self.n_names = len(self.rows)
        for number, p in enumerate(places):  # labels stand for their places as anchors only
            self._add(number, p, p.label, plain[p.label], False)

    def _add(self, number: int, p: Place, name: str, words: str, weak: bool) -> None:
        self.rows.append({"rank": len(self.rows), "place": number, "key": p.country_code or p.label, "label": p.label, "country_code": p.country_code, "region": p.region, "lat": p.lat, "lng": p.lng, "tokens": words.count(" ") + 1, "weak": weak, "name": name})
        self.terms.append(words)

    def hits(self, words: Column, anchors: bool = False) -> Column:
        n = len(self.rows) if anchors else self.n_names
        lexicon = [("place", t, None) for t in self.terms[:n]] + [("talks", t, None) for t in TALKS]
        return term_hits(words, lexicon, facts=(self.rows[:n] + [None] * len(TALKS), _FACTS), window=WINDOW)


def _known(hits: Column) -> Column:
    """What is known of the names among the hits, each once."""
    return F.array_distinct(F.transform(F.filter(hits, lambda h: h["group"] == "place"), lambda h: h["facts"]))


def _of(known: Column, rank: Column) -> Column:
    return F.get(F.filter(known, lambda x: x["rank"] == rank), 0)


def gazetteer(spark: object, places: Sequence[Place]) -> Gazetteer:
    """A gazetteer whose names are folded as texts are."""
    names = sorted({n for p in places for n in (p.label, *p.names, *p.weak)})
    if not names:
        return Gazetteer([], {})
    folded = spark.createDataFrame([(n,) for n in names], "n string").select("n", filter_words(F.col("n")).alias("w"))
    return Gazetteer(places, {r.n: r.w for r in folded.collect()})


def _codes(hits: Column) -> Column:
    """Rank * 8 + way, each once, of all ways in which the names among the hits are spoken of."""

    def ways(h: Column, in_talks: Column) -> Column:
        before, after = h["before"], h["after"]
        strong = ~h["facts"]["weak"]
        event = before.rlike(BEFORE_EVENT) | before.rlike(PEOPLE_OF) | after.rlike(AFTER_EVENT)
        found = (
            (OFFICIAL, after.rlike(AFTER_OFFICIAL)), (HEADLINE, strong & ((h["first"] == 0) | (before.rlike(HEAD_BEFORE) & (h["first"] < WINDOW)))), (ACTOR, strong & after.rlike(AFTER_ACTOR)), (TALK, event & in_talks),
            (EVENT, event), (TARGET, strong & (before.rlike(BEFORE_TARGET) | after.rlike(AFTER_TARGET))), (CONTEXT, strong & (before.rlike(BEFORE_EVENT) | after.rlike(AFTER_PLAIN))),
        )
        return F.array(*(F.when(holds, h["rank"] * 8 + way) for way, holds in found))

    once = F.array(F.exists(hits, lambda h: h["group"] == "talks"))  # an array of one, so that its value and not the search goes into the inner function
    named = F.filter(hits, lambda h: h["group"] == "place")
    found = F.flatten(F.transform(once, lambda in_talks: F.flatten(F.transform(named, lambda h: ways(h, in_talks)))))
    return F.array_distinct(F.array_compact(found))


def _mentions(known: Column, codes: Column) -> Column:
    """Rank * 8 + MENTION of places that are only mentioned, by a name of several words or two names of their own."""
    spoken = F.transform(F.filter(codes, lambda c: c % 8 < MENTION), lambda c: _of(known, (c / 8).cast("int"))["place"])
    bare = F.array_except(F.transform(known, lambda x: x["place"]), spoken)

    def best(p: Column) -> Column:
        own = F.filter(known, lambda x: x["place"] == p)
        longest = F.array_min(F.transform(own, lambda x: F.struct((-x["tokens"]).alias("t"), x["rank"].alias("r"))))
        several = F.size(F.filter(own, lambda x: ~x["weak"])) >= 2
        return F.when((longest["t"] <= -2) | several, longest["r"] * 8 + MENTION)

    return F.array_compact(F.transform(bare, best))


def location_candidates(items: DataFrame, known: Gazetteer, text: str = "text") -> DataFrame:
    """Add ``candidates``, an array of (label, country_code, region, lat, lng, method, score, name), best first, to rows.

    For every place and way of speaking of it the best score and the first name with it in the gazetteer's order; places of one
    country_code are one. Without any other evidence a place counts as mentioned if a name of several words, or two names
    of its own, are in the text. Null and empty texts have an empty array. Own columns of that name are replaced.
    """
    kept = [F.col(f"`{c}`") for c in items.columns if c.lower() != "candidates"]
    rows = items.select(*kept, filter_words(F.coalesce(F.col(text), F.lit(""))).alias("_words")).withColumn("_hits", known.hits(F.col("_words")))
    return _with_candidates(rows).select(*kept, "candidates")


def _with_candidates(rows: DataFrame) -> DataFrame:
    known = F.col("_known")
    several, single = (F.array(*(F.lit(m[i]) for m in METHODS)) for i in (1, 2))
    rows = rows.withColumn("_codes", _codes(F.col("_hits"))).withColumn("_known", _known(F.col("_hits")))
    rows = rows.withColumn("_every", F.concat(F.filter("_codes", lambda c: c % 8 < MENTION), _mentions(known, F.col("_codes"))))
    facts = F.transform("_every", lambda c: F.struct(_of(known, (c / 8).cast("int")).alias("of"), (c % 8).alias("way"), c.alias("code")))
    score = lambda x: F.when(x["of"]["tokens"] >= 2, F.get(several, x["way"])).otherwise(F.get(single, x["way"]))
    rows = rows.withColumn("_facts", facts).withColumn("_scored", F.transform("_facts", lambda x: F.struct(
        F.concat(x["of"]["key"], F.lit("::"), x["way"].cast("string")).alias("key"), (-score(x)).alias("low"), x["code"].alias("code"), x["of"].alias("of"), x["way"].alias("way"))))

    def best(key: Column) -> Column:
        own = F.filter("_scored", lambda x: x["key"] == key)
        first = F.array_min(F.transform(own, lambda x: F.struct(x["low"].alias("low"), x["code"].alias("code"), x["of"].alias("of"), x["way"].alias("way"))))
        return F.struct(first["low"].alias("low"), F.array_min(F.transform(own, lambda x: x["code"])).alias("seen"), first["of"].alias("of"), first["way"].alias("way"))

    rows = rows.withColumn("_keys", F.array_distinct(F.transform("_scored", lambda x: x["key"]))).withColumn("_best", F.array_sort(F.transform("_keys", best)))
    ways = F.array(*(F.lit(m[0]) for m in METHODS))
    shown = F.transform("_best", lambda b: F.struct(*(b["of"][c].alias(c) for c in ("label", "country_code", "region", "lat", "lng")), F.get(ways, b["way"]).alias("method"), (-b["low"]).alias("score"), b["of"]["name"].alias("name")))
    return rows.withColumn("candidates", shown.cast(CANDIDATES))


#: Scores of a place by its names in a text alone: of several words, weak, of one word in a context, of two names; the least that counts.
SEVERAL_WORDS, WEAK_WORDS, IN_CONTEXT, TWO_NAMES, LEAST = 90, 60, 70, 75, 70
#: Scores of a place whose officials a text names, by names of several words and of one.
OFFICIALS_OF = (95, 85)
LOCATION = "struct<label:string,country_code:string,region:string,lat:double,lng:double>"


def _located(known: Column, best: Column) -> Column:
    """The place of a rank."""
    x = _of(known, best)
    return F.when(best.isNotNull(), F.struct(*(x[c].alias(c) for c in ("label", "country_code", "region", "lat", "lng")))).cast(LOCATION)


def _by_text(codes: Column, known: Column, officials: bool) -> Column:
    """A rank of the place with the highest score, the first of these; null if none has enough."""
    spoken = F.transform(F.filter(codes, lambda c: c % 8 == (OFFICIAL if officials else CONTEXT)), lambda c: (c / 8).cast("int"))

    def score(x: Column) -> Column:
        if officials:
            return F.when(F.array_contains(spoken, x["rank"]), F.when(x["tokens"] >= 2, OFFICIALS_OF[0]).otherwise(OFFICIALS_OF[1])).otherwise(0)
        alone = F.when(x["tokens"] >= 2, F.when(x["weak"], WEAK_WORDS).otherwise(SEVERAL_WORDS)).when(F.array_contains(spoken, x["rank"]) & ~x["weak"], IN_CONTEXT).otherwise(0)
        two = F.size(F.filter(known, lambda y: (y["place"] == x["place"]) & ~y["weak"])) >= 2
        return F.when(two, F.greatest(alone, F.lit(TWO_NAMES))).otherwise(alone)

    scored = F.filter(F.transform(known, lambda x: F.struct((-score(x)).alias("low"), x["place"].alias("place"), x["rank"].alias("rank"))), lambda x: x["low"] <= -LEAST)
    return F.array_min(scored)["rank"]


def locations(items: DataFrame, known: Gazetteer, text: str = "text", anchors: bool = False) -> DataFrame:
    """Add ``location`` and ``official_location`` (label, country_code, region, lat, lng; or null) to rows: where the text is, and whose officials it names.

    ``anchors``: a text that is a label or a name as a whole is that place, the gazetteer's first with it. Own columns of these
    names are replaced; null and empty texts have no place.
    """
    kept = [F.col(f"`{c}`") for c in items.columns if c.lower() not in ("location", "official_location")]
    rows = items.select(*kept, filter_words(F.coalesce(F.col(text), F.lit(""))).alias("_words")).withColumn("_every", known.hits(F.col("_words"), anchors))
    return _with_locations(rows, known, anchors).select(*kept, "location", "official_location")


def _with_locations(rows: DataFrame, known: Gazetteer, anchors: bool) -> DataFrame:
    rows = rows.withColumn("_hits", F.filter("_every", lambda h: (h["group"] == "talks") | (h["rank"] < known.n_names)))
    rows = rows.withColumn("_codes", _codes(F.col("_hits"))).withColumn("_known", _known(F.col("_hits")))
    whole = F.filter("_every", lambda h: (h["group"] == "place") & (h["before"] == "") & (h["after"] == ""))
    exact = F.array_min(F.transform(whole, lambda h: F.struct(h["facts"]["place"].alias("place"), h["facts"].alias("of"))))["of"]
    rows = rows.withColumn("_whole", exact).withColumn("_at", _by_text(F.col("_codes"), F.col("_known"), False)).withColumn("_of", _by_text(F.col("_codes"), F.col("_known"), True))
    found = _located(F.col("_known"), F.col("_at"))
    at = F.struct(*(F.col("_whole")[c].alias(c) for c in ("label", "country_code", "region", "lat", "lng"))).cast(LOCATION)
    return rows.withColumns({"location": F.when(F.col("_whole").isNotNull(), at).otherwise(found) if anchors else found, "official_location": _located(F.col("_known"), F.col("_of"))})

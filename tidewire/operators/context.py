"""What a news item is about: event type, roles of countries and officials, guards and the reason for no marker.

An item's words are looked at once: one pass finds all phrases of the rules and lexicons with their places, the rules are
expressions over these hits. Rules and cues are data; lexicons of countries, officials and institutions are given by the caller.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import filter_words, first_sentence
from tidewire.operators.terms import term_hits


class Rule(NamedTuple):
    """An event type and the phrases one of which makes it; the first rule that holds wins."""

    event: str
    phrases: tuple[str, ...]


def _phrases(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(","))


#: Guards, in the order in which they are tried, with their phrases and the event type of items that have one.
GUARDS = (
    ("sports_or_non_relevant_domain", "sports", _phrases("tennis, football, soccer, basketball, volleyball, roland garros, djokovic, knocks out, third round, match, tournament, score, league, transfer")),
    ("local_crime_not_geopolitical", "local_crime", _phrases("park halindeki otomobil, silahli saldiri, yerel saldiri, trafik kazasi, otomobil kazasi, tekne arizasi, ariza yapan tekne, kurtarildi, mahalle, ilce, ordinary crime, local crime, traffic accident, car crash, bus driver, license in new york")),
    ("non_relevant_lifestyle_item", "lifestyle", _phrases("everest, tattoos, therapeutic, healing ink, celebrity, movie, album, travel, tourism, weather conditions, lifestyle, human interest")),
)
#: Phrases of opinions, which are no events.
OPINION, OPINION_REASON = "analysis_or_opinion", "analysis_or_opinion_item"
OPINION_PHRASES = _phrases("reflects his wishes, not agreed terms, what it means, raising the stakes, masking strategic weakness, examines, political pawns, the lebanon i knew, when will it end, want to keep, not take his oil, likely pushing, analysis, opinion, commentary, explainer")
#: Words that say that someone is appointed, and the kinds of appointments in the order in which they are tried.
APPOINTING = _phrases("appoints, appointed, names, named, designates, designated, picks, chooses, nominates, nominated, taps, selected, atadi, goreve getirdi, gorevlendirdi, aday gosterdi, secti, becomes new, as new, to lead, new national security council chief, new defense chief, new defence chief, new army chief, new foreign minister, new ambassador, new envoy, yeni gorev, baskanligina atadi, sef olarak atadi, liderligine getirdi")
APPOINTMENTS = (
    Rule("national_security_appointment", _phrases("national security council, security adviser, security advisor, milli guvenlik, ulusal guvenlik")),
    Rule("defense_appointment", _phrases("defense chief, defence chief, army chief, chief of staff, general staff, defense minister, defence minister, savunma, genelkurmay")),
    Rule("diplomatic_appointment", _phrases("ambassador, envoy, foreign minister, foreign ministry, buyukelci, elci, disisleri")),
    Rule("government_appointment", _phrases("prime minister, president, government, minister, bakan, basbakan, cumhurbaskani")),
)
OTHER_APPOINTMENT = "official_appointment"
#: All other events in the order in which they are tried.
EVENTS = (
    Rule("health_outbreak", _phrases("ebola, outbreak, salgini, salgin, who warns, dso")), Rule("missile_strike", _phrases("missile strike, fuze saldirisi")),
    Rule("drone_strike", _phrases("drone strike, drone strikes, iha saldirisi, siha saldirisi")), Rule("military_incident", _phrases("fires on, hostile drone, mistaking it for hostile drone")),
    Rule("strategic_waterway", _phrases("strait of hormuz, waterway, ship attacked, attack on ship, vessel hit, maritime security")), Rule("strike", _phrases("airstrike, air strike, strike, strikes, attack, attacks, saldiri, saldirilarini")),
    Rule("condemnation", _phrases("condemns, condemned, kinadi, bears full responsibility, responsibility for")), Rule("warning", _phrases("warns, warned, sounds alarm, uyardi, alarm seviyesini")),
    Rule("diplomatic_visit", _phrases("visits, visited, to visit, heads to, travels to, gidecek, ziyareti, ziyaret edecek")), Rule("summit", _phrases("summit, zirve")),
    Rule("meeting", _phrases("meets with, met with, held talks with, gorus, gorustu, gorusecek")), Rule("sanctions_impact", _phrases("sanctions slash, sanctions impact, yaptirim etkisi")),
    Rule("sanctions_announcement", _phrases("sanctions, yaptirim")), Rule("official_statement", _phrases("official statement, press statement, message, mesaji, aciklama, said, says")),
)
UNKNOWN = "unknown"
#: Events of attacks, of crises, and phrases that give countries and places a part in them: role, its value, phrases.
ATTACKS, CRISES = ("strike", "attack", "drone_strike", "missile_strike", "military_incident"), ("health_outbreak", "humanitarian_crisis")
ATTACK_PARTS = (
    ("primary_actor_country", "Israel", _phrases("israeli strike, israeli strikes, israilden, soykirimci israil, idf fires")), ("primary_actor_country", "Iran", _phrases("iranian missile, iranian strike")),
    ("affected_actor", "Lebanese soldiers", ("lebanese soldiers",)), ("affected_country", "Lebanon", ("lebanese soldiers",)), ("affected_location", "Gaza Strip", ("gaza", "gazze")),
    ("event_location", "West Bank", ("west bank", "bati seria")), ("event_location", "Kuwait", ("kuwait base", "in kuwait", "kuwait")),
    ("referenced_event_location", "Romania", ("romania hit", "romanian building", "in romania")), ("affected_country", "Lebanon", ("lubnan", "lebanon")),
)
#: Parts in any event, and in one of sanctions.
OTHER_PARTS = (
    ("blamed_actor", "Russia", _phrases("russia bears, russia after, russia for, russian responsibility")), ("partner_country", "Japan", ("japan", "japonya")),
    ("reporting_actor_country", "South Korea", ("south korea says", "guney kore")),
)
SANCTION_PARTS = (("impact_location", "Montenegro", ("montenegro", "karadag")), ("target_actor", "Russian investments", ("russian investments", "russian assets")), ("issuing_institution", "EU", ("eu sanctions", "european union sanctions", "ab yaptirim")))
#: What a country does that makes it the actor; how a person is appointed; what is no person's name.
COUNTRY_ACTIONS = _phrases("condemns, condemned, warns, warned, says, said, announced, rejects, urged, calls, kinadi, uyardi, acikladi")
APPOINTED_PERSON = r"\b(?:appoints|appointed|names|named|designates|designated|picks|chooses|nominates|nominated|taps|selected|atadi)\s+([a-z][a-z]+(?:\s+[a-z][a-z]+){0,3})\s+(?:as|to|for|olarak|gorevine|baskanligina|sef olarak)\b"
NO_PERSON = ("new", "the", "a", "an")
#: Domains that an event type gives.
EVENT_DOMAINS = {
    "official_statement": _phrases("condemnation, warning, official_statement, diplomatic_message, official_appointment, government_appointment, national_security_appointment, internal_government_decision"),
    "diplomacy": _phrases("diplomatic_visit, meeting, summit, defense_policy, defense_appointment, diplomatic_appointment"),
    "conflict": _phrases("attack, strike, drone_strike, missile_strike, clash, military_operation, military_incident, strategic_waterway, maritime_security"),
    "sanctions_law": _phrases("sanctions_announcement, sanctions_impact, legal_decision"), "humanitarian": _phrases("humanitarian_crisis, health_outbreak"),
}
#: Characters of an item's body that count.
BODY_CHARS = 1200


#: Groups of hits that tell something when they stand side by side.
BESIDE = (("country", "title"), ("title", "country"), ("country", "act"))


class Lexicons(NamedTuple):
    """Names that roles are read from, each in the order in which it is tried.

    countries: (label, alias); titles: (phrase, label); persons: (actor, country, title, institution, aliases);
    organisations and media: phrases; institutions: (label, country, aliases); state_institutions: (phrase, label);
    strategic: labels of countries that are waterways or seas.
    """

    countries: Sequence[tuple[str, str]] = ()
    titles: Sequence[tuple[str, str]] = ()
    persons: Sequence[tuple[str, str, str, str, Sequence[str]]] = ()
    organisations: Sequence[str] = ()
    media: Sequence[str] = ()
    institutions: Sequence[tuple[str, str, Sequence[str]]] = ()
    state_institutions: Sequence[tuple[str, str]] = ()
    strategic: Sequence[str] = ()


def _has(hits: Column, group: str) -> Column:
    return F.exists(hits, lambda h: h["group"] == group)


def _first(hits: Column, group: str) -> Column:
    """The value of a group's hit that comes first in the lexicon."""
    return F.array_min(F.transform(F.filter(hits, lambda h: h["group"] == group), lambda h: F.struct(h["rank"].alias("rank"), h["value"].alias("value"))))["value"]


def event_type(hits: Column, guards: Sequence[tuple[str, str, tuple[str, ...]]] = GUARDS, appointments: Sequence[Rule] = APPOINTMENTS, events: Sequence[Rule] = EVENTS) -> Column:
    """The first event type whose phrases are among the hits of ``event_lexicon``: guards, opinions, appointments, then events."""
    out = F.when(F.lit(False), "")
    for reason, event, _ in guards:
        out = out.when(_has(hits, f"guard:{reason}"), event)
    out = out.when(_has(hits, "opinion"), OPINION)
    kind = F.when(F.lit(False), "")
    for rule in appointments:
        kind = kind.when(_has(hits, f"appointment:{rule.event}"), rule.event)
    out = out.when(_has(hits, "appointing"), kind.otherwise(OTHER_APPOINTMENT))
    for rule in events:
        out = out.when(_has(hits, f"event:{rule.event}"), rule.event)
    return out.otherwise(UNKNOWN)


def guard_reason(hits: Column, guards: Sequence[tuple[str, str, tuple[str, ...]]] = GUARDS) -> Column:
    out = F.when(F.lit(False), "")
    for reason, _, _ in guards:
        out = out.when(_has(hits, f"guard:{reason}"), reason)
    return out


def event_lexicon(guards: Sequence[tuple[str, str, tuple[str, ...]]] = GUARDS, opinion: Sequence[str] = OPINION_PHRASES, appointing: Sequence[str] = APPOINTING, appointments: Sequence[Rule] = APPOINTMENTS, events: Sequence[Rule] = EVENTS) -> list[tuple[str, str, str | None]]:
    """Rows of a lexicon for ``term_hits`` with all phrases of the rules."""
    rows = [(f"guard:{reason}", p, None) for reason, _, phrases in guards for p in phrases] + [("opinion", p, None) for p in opinion] + [("appointing", p, None) for p in appointing]
    rows += [(f"appointment:{r.event}", p, None) for r in appointments for p in r.phrases]
    return rows + [(f"event:{r.event}", p, None) for r in events for p in r.phrases]


def event_types(texts: DataFrame, **rules: Sequence) -> DataFrame:
    """Add ``event_type`` and ``guard`` to rows with ``text``; rules are those of ``event_lexicon``, by default the fixed ones.

    A null or empty text is of the type unknown, without guard. Other columns stay, own ones of these names are replaced.
    """
    kept = [F.col(f"`{c}`") for c in texts.columns if c.lower() not in ("event_type", "guard")]
    hits = texts.select(*kept, term_hits(filter_words(F.col("text")), event_lexicon(**rules)).alias("_hits"))
    own = {k: v for k, v in rules.items() if k in ("guards", "appointments", "events")}
    guard = guard_reason(F.col("_hits"), rules.get("guards", GUARDS))
    return hits.select(*kept, event_type(F.col("_hits"), **own).alias("event_type"), guard.alias("guard"))


def event_domain(event: Column) -> Column:
    """The domain that an event type gives; null for opinions, guarded and unknown ones."""
    out = F.when(F.lit(False), "")
    for domain, events in EVENT_DOMAINS.items():
        out = out.when(event.isin(*events), domain)
    return out


def _countries(hits: Column) -> Column:
    """Labels of the countries among the hits, those of longer names first, then in the lexicon's order; each once."""
    rows = F.transform(F.filter(hits, lambda h: h["group"] == "country"), lambda h: F.struct((-F.length(h["term"])).alias("a"), h["rank"].alias("b"), h["value"].alias("value")))
    return F.array_distinct(F.transform(F.array_sort(rows), lambda x: x["value"]))


def _only(hits: Column, group: str, field: str = "value") -> Column:
    return F.get(F.filter(hits, lambda h: h["group"] == group), 0)[field]


def _parts(hits: Column, parts: Sequence[tuple[str, str, tuple[str, ...]]], prefix: str, when: Column) -> dict[str, Column]:
    """For each role the value of its first part that is among the hits."""
    out: dict[str, Column] = {}
    for i, (role, value, _) in enumerate(parts):
        here = F.when(when & _has(hits, f"{prefix}:{i}"), value)
        out[role] = F.coalesce(out[role], here) if role in out else here
    return out


ROLES = ("issuing_actor", "issuing_country", "issuing_title", "issuing_institution", "institution", "appointed_person", "primary_actor_country", "affected_actor", "affected_country", "affected_location",
         "event_location", "referenced_event_location", "blamed_actor", "partner_country", "reporting_actor_country", "counterparty_country", "strategic_location", "impact_location", "target_actor", "mentioned_only")


def entity_roles(items: DataFrame, lexicons: Lexicons, body_chars: int = BODY_CHARS, **rules: Sequence) -> DataFrame:
    """Add ``event_type``, the roles in ROLES, ``destinations``, ``source_media``, ``reasons``, ``guard`` and ``no_marker`` to news items.

    items: title, and where there are such columns summary, body (its first ``body_chars`` characters, None: all) and source_name. The actor is
    a known person, else a country beside an official's title, else the longest-named country in a text with a title, else a country that acts, else an institution's.
    Null texts have unknown events and no roles. Other columns stay, own ones of these names are replaced. No shuffle.
    """
    added = {"event_type", "guard", "no_marker", "destinations", "source_media", "reasons", *ROLES}
    kept = [F.col(f"`{c}`") for c in items.columns if c.lower() not in added]
    column = lambda name: F.col(name) if name in items.columns else F.lit(None).cast("string")
    body = column("body") if body_chars is None else F.substring(column("body"), 1, body_chars)
    lexicon = event_lexicon(**rules)
    countries = [("country", alias, label) for label, alias in lexicons.countries]
    lexicon += countries + [("title", p, v) for p, v in lexicons.titles] + [("media", m, m) for m in lexicons.media] + [("organisation", o, o.upper()) for o in lexicons.organisations]
    lexicon += [("person", a, str(i)) for i, p in enumerate(lexicons.persons) for a in p[4]] + [("direct", a, str(i)) for i, x in enumerate(lexicons.institutions) for a in x[2]]
    lexicon += [("state", p, v) for p, v in lexicons.state_institutions] + [("act", a, a) for a in COUNTRY_ACTIONS]
    for prefix, parts in (("attack", ATTACK_PARTS), ("other", OTHER_PARTS), ("sanction", SANCTION_PARTS)):
        lexicon += [(f"{prefix}:{i}", p, None) for i, (_, _, phrases) in enumerate(parts) for p in phrases]
    words = F.trim(filter_words(F.concat_ws(" ", F.col("title"), column("summary"), body, column("source_name"))))
    rows = items.select(*kept, words.alias("_words"), term_hits(words, lexicon, BESIDE).alias("_hits"), *(
        term_hits(filter_words(t), countries).alias(n) for n, t in (("_t", F.col("title")), ("_s", first_sentence(column("summary"))), ("_b", first_sentence(body)))))
    h = F.col("_hits")
    own = {k: v for k, v in rules.items() if k in ("guards", "appointments", "events")}
    rows = rows.withColumns({
        "event_type": event_type(h, **own), "guard": guard_reason(h, rules.get("guards", GUARDS)), "_all": _countries(h), "_title": F.get(_countries(F.col("_t")), 0),
        "_summary": F.get(_countries(F.col("_s")), 0), "_body": F.get(_countries(F.col("_b")), 0), "_person": F.get(_listed([p[:4] for p in lexicons.persons], 4), _first(h, "person").cast("int")),
        "_direct": F.get(_listed([x[:2] for x in lexicons.institutions], 2), _first(h, "direct").cast("int")),
        "_acts": _only(h, "country+act"), "_turned": _only(h, "title+country>"), "_pair": _only(h, "country+title"),
        "_any_title": _first(h, "title"), "_state": _first(h, "state"), "_org": _first(h, "organisation"), "_strategic": _strategic(h, lexicons.strategic),
    })
    person, event = F.col("_person"), F.col("event_type")
    straight = F.col("_pair").isNotNull()
    pair_country = F.coalesce("_pair", "_turned")
    pair_title, pair_alias, pair_role = (F.when(straight, _only(h, a, f)).otherwise(_only(h, b, f)) for a, b, f in (("country+title>", "title+country", "value"), ("country+title", "title+country>", "term"), ("country+title>", "title+country", "term")))
    known = person[1]
    by_pair = F.coalesce(known, pair_country)
    listed = F.when(by_pair.isNull() & F.col("_any_title").isNotNull(), F.get("_all", 0))
    by_title = F.coalesce(by_pair, listed)
    by_act = F.coalesce(by_title, F.col("_acts"))
    country = F.coalesce(by_act, F.col("_direct")[1])
    title = F.coalesce(person[2], F.when(known.isNull() & pair_country.isNotNull(), pair_title), F.when(listed.isNotNull(), F.col("_any_title")))
    institution = F.coalesce(F.col("_direct")[0], F.col("_state"))
    rows = rows.withColumns({"issuing_actor": person[0], "issuing_country": country, "issuing_title": title, "institution": institution, "_by_act": by_act})
    attack, other, sanction = _parts(h, ATTACK_PARTS, "attack", event.isin(*ATTACKS)), _parts(h, OTHER_PARTS, "other", F.lit(True)), _parts(h, SANCTION_PARTS, "sanction", event == "sanctions_impact")
    named = F.regexp_extract("_words", APPOINTED_PERSON, 1)
    others = F.filter("_all", lambda c: ~F.coalesce(c == F.col("issuing_country"), F.lit(False)))
    crisis = F.when(event.isin(*CRISES), F.coalesce("_summary", "_body"))
    affected = F.coalesce(crisis, attack["affected_country"])
    place = attack["event_location"]
    by_name = attack["affected_location"].isNull() & place.isNull()
    known_reason = F.when(person.isNotNull(), F.concat(F.lit("known_actor_alias: "), person[0], F.lit(" -> "), known))
    rows = rows.withColumns({
        "issuing_institution": F.coalesce(person[3], "_org", F.col("_direct")[0], F.when(F.col("_direct").isNull(), F.col("_state")), sanction["issuing_institution"]),
        "appointed_person": F.when((named != "") & ~named.isin(*NO_PERSON), named), **{r: attack[r] for r in ("primary_actor_country", "affected_actor", "affected_location", "referenced_event_location")}, **other,
        "affected_country": affected, "event_location": F.coalesce(place, F.when(by_name, F.col("_title"))), "destinations": F.when((event == "diplomatic_visit") & (F.size(others) > 0), others),
        "counterparty_country": F.when(event.isin("meeting", "summit"), F.coalesce(F.get(others, 0), F.get("_all", 0))), "strategic_location": F.col("_strategic"),
        "impact_location": sanction["impact_location"], "target_actor": sanction["target_actor"], "mentioned_only": F.when(affected.isNull() & attack["affected_location"].isNull(), F.col("_summary")),
        "source_media": F.array_distinct(F.transform(F.array_sort(F.filter(h, lambda x: x["group"] == "media"), lambda a, b: a["rank"] - b["rank"]), lambda x: x["term"])),
        "reasons": F.array_compact(F.array(
            known_reason, F.when(known.isNull() & pair_country.isNotNull(), F.concat(F.lit("country_demonym_role: "), pair_alias, F.lit(" "), pair_role, F.lit(" -> "), pair_country)),
            F.when(F.col("_direct").isNotNull(), F.concat(F.lit("institution_country: "), F.col("_direct")[0], F.lit(" -> "), F.col("_direct")[1])).when(
                F.col("_state").isNotNull() & F.col("_by_act").isNotNull(), F.concat(F.lit("institution_inherits_country: "), "institution", F.lit(" -> "), F.col("_by_act"))),
            F.when(affected.isNotNull() & event.isin(*CRISES), "summary/body health-crisis location"), F.when(by_name & F.col("_title").isNotNull(), "title location"))),
    })
    appointed = event.isin(OTHER_APPOINTMENT, *(r.event for r in rules.get("appointments", APPOINTMENTS))) & F.col("issuing_country").isNull()
    reason = F.when(event == OPINION, OPINION_REASON).when(appointed & F.col("institution").isNotNull(), "institution_without_country_context").when(appointed, "unresolved_issuing_country").otherwise(F.col("guard"))
    return rows.withColumn("no_marker", reason).select(*kept, "event_type", *ROLES, "destinations", "source_media", "reasons", "guard", "no_marker")


def _listed(rows: list[Sequence[str]], width: int) -> Column:
    """An array of arrays of strings."""
    return F.array(*(F.array(*(F.lit(x) for x in row)) for row in rows)) if rows else F.array().cast("array<array<string>>")


def _strategic(hits: Column, labels: Sequence[str]) -> Column:
    """The first of these labels that a country among the hits has."""
    found = F.transform(F.filter(hits, lambda h: (h["group"] == "country") & h["value"].isin(*labels)), lambda h: h["value"]) if labels else F.array().cast("array<string>")
    return F.get(F.array_intersect(F.array(*map(F.lit, labels)).cast("array<string>"), found), 0)

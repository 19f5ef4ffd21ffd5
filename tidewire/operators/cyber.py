"""Attackers and victims: the role of each country, group and region that an item on cyber attacks names, from the words around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.lexical import marked
from tidewire.operators.terms import ALL, NONE, places_by_lexicon, term_places

#: Characters around a name that are looked at.
WINDOW = 64
ORIGIN, TARGET, NEUTRAL = "origin", "target", "neutral"
HIGH, MEDIUM, LOW = "high", "medium", "low"
#: Short names of the United States, which only capitals tell from a pronoun, and the alias that stands for them.
SHORT_NAMES, ALIAS = r"\bU\.S\.A\.?|\bU\.S\.|\bUSA\b|\bUS\b", " usa "
#: What follows or comes before a name whose country attacks.
ACTORS_AFTER = r"^[ -](?:state[ -]sponsored |government[ -]backed |nation[ -]state |military |cyber |elite )*(?:apt\b|advanced persistent threat|hackers?\b|hacking (?:group|crew|team|unit)|threat actors?\b|threat group|cyber ?spies?\b|cyber ?espionage|cyber ?criminals?\b|operatives?\b|spies\b|cyber army|cyber unit|intelligence (?:group|operatives|service))"
TAIL_AFTER = r"^[ -](?:linked|backed|sponsored|aligned|affiliated|nexus|controlled|directed|state[ -]sponsored|state[ -]backed|speaking)\b"
SERVICE_AFTER = r"^(?:'s)?[ ](?:gru|svr|fsb|mss|irgc|rgb|intelligence|military intelligence|cyber army|cyber command|state security|spy agency)\b"
BY_BEFORE = r"(?:targeted|attacked|hit|breached|compromised|hacked|struck|infiltrated|disrupted|backed|sponsored|operated|run|orchestrated|launched)\s+by\s+(?:the\s+|suspected\s+|alleged(?:ly)?\s+)*$"
SOURCE_BEFORE = r"(?:attributed to|blamed on|blamed|linked to|tied to|operated by|carried out by|conducted by|orchestrated by|run by|backed by|sponsored by|hackers? from|actors? from|attackers? from|hackers? based in|actors? based in|based in|operating (?:from|out of)|originating (?:from|in)|stemming from|emanating from|out of)\s+(?:the\s+)?$"
#: What comes before or follows a name whose country is attacked.
VERB_BEFORE = r"(?:^|[^a-z])(?:targets?|targeting|targeted|hits?|hitting|attacks?|attacking|attacked|breach(?:es|ing|ed)?|compromis(?:e|es|ing|ed)|infiltrat(?:e|es|ing|ed)|strikes?|struck|striking|hacks?|hacking|hacked|disrupt(?:s|ing|ed)?|infect(?:s|ing|ed)?|spying on|spied on|aimed at|directed at|deployed against|launched against)\s+(?:the\s+|a\s+|an\s+|several\s+|multiple\s+|various\s+|numerous\s+|dozens of\s+|some\s+){0,2}$"
PREPOSITION_BEFORE = r"(?:^|[^a-z])(?:against|across|throughout|affecting|impacting|victims in|aimed at|directed at|focused on|campaign against|operations? against|espionage against|attacks? on|assault on|raids? on)\s+(?:the\s+|\w+\s+){0,2}$"
VICTIMS = "government|governments|govt|agency|agencies|ministry|ministries|firm|firms|company|companies|organization|organizations|organisation|organisations|business|businesses|enterprise|enterprises|user|users|customer|customers|citizen|citizens|resident|residents|national|nationals|hospital|hospitals|clinic|clinics|bank|banks|university|universities|school|schools|infrastructure|network|networks|systems|entity|entities|institution|institutions|sector|industry|industries|military|defense|defence|telecom|telecoms|grid|utilities|servers|developers|users"
PASSIVE_AFTER = r"^(?:'s [a-z]+)?[ ](?:was|were|is|are|got|has been|have been|had been)\s+(?:also\s+|recently\s+|reportedly\s+|allegedly\s+)*(?:targeted|hit|breached|attacked|hacked|compromised|infiltrated|struck|disrupted|affected|impacted|victimi[sz]ed|exposed|leaked)\b|^[ ](?:fell victim|came under attack|suffered (?:a|an|from) (?:breach|cyber ?attack|ransomware|hack|intrusion|data breach))"
#: Words without which a victim's noun after a name says nothing.
ATTACK = r"(?:^|[^a-z])(?:breach|breached|hack|hacked|hacking|attack|attacked|cyberattack|ransomware|malware|compromis|infiltrat|target|targeted|exploit|exploited|stole|stolen|steal|leak|leaked|exposed|exposing|espionage|spy|spying|backdoor|intrusion|victim|phishing|trojan|wiper|breach|data breach)"
#: The rules of what comes before a name, from the name on backwards: such a rule is tried at one place, not at each of the window.
_THE, _ADVERBS = r"(?:\s+eht)?", r"(?:\s+(?:eht|detcepsus|degella|yldegella))*"
_DONE = "targeted attacked hit breached compromised hacked struck infiltrated disrupted backed sponsored operated run orchestrated launched"
_FROM = "attributed to,blamed on,blamed,linked to,tied to,operated by,carried out by,conducted by,orchestrated by,run by,backed by,sponsored by,hacker from,hackers from,actor from,actors from,attacker from,attackers from,hacker based in,hackers based in,actor based in,actors based in,based in,operating from,operating out of,originating from,originating in,stemming from,emanating from,out of"
_DOES = "target,targets,targeting,targeted,hit,hits,hitting,attack,attacks,attacking,attacked,breach,breaches,breaching,breached,compromise,compromises,compromising,compromised,infiltrate,infiltrates,infiltrating,infiltrated,strike,strikes,struck,striking,hack,hacks,hacking,hacked,disrupt,disrupts,disrupting,disrupted,infect,infects,infecting,infected,spying on,spied on,aimed at,directed at,deployed against,launched against"
_SOME = "the,a,an,several,multiple,various,numerous,dozens of,some"
_TOWARDS = "against,across,throughout,affecting,impacting,victims in,aimed at,directed at,focused on,campaign against,operation against,operations against,espionage against,attack on,attacks on,assault on,raid on,raids on"


def _back(words: str, between: str = ",") -> str:
    return "|".join(w[::-1] for w in words.split(between))


BACK_TO_BY = rf"^{_ADVERBS}\s+yb\s+(?:{_back(_DONE, ' ')})"
BACK_TO_SOURCE = rf"^{_THE}\s+(?:{_back(_FROM)})"
BACK_TO_VERB = rf"^(?:\s+(?:{_back(_SOME)})){{0,2}}\s+(?:{_back(_DOES)})(?:[^a-z]|$)"
BACK_TO_PREPOSITION = rf"^(?:\s+\w+){{0,2}}\s+(?:{_back(_TOWARDS)})(?:[^a-z]|$)"
ROLE_RANK, TRUST_RANK = {TARGET: 3, ORIGIN: 2, NEUTRAL: 1}, {HIGH: 3, MEDIUM: 2, LOW: 1}
#: The kind of group whose country is an attacker's.
STATE = "nation_state"


def mention_role(before: Column, after: Column, demonym: Column, attack: Column) -> Column:
    """Role and confidence (struct) of one mention: attackers first, then victims; the first rule that holds."""
    named, called = rf"^(?:'s)?[ ](?:{VICTIMS})\b", rf"^[ ](?:[a-z][a-z-]+ ){{0,2}}(?:{VICTIMS})\b"
    back = F.reverse(before)
    rules = (
        (demonym & after.rlike(ACTORS_AFTER), ORIGIN, HIGH), (after.rlike(TAIL_AFTER), ORIGIN, HIGH), (after.rlike(SERVICE_AFTER), ORIGIN, HIGH), (back.rlike(BACK_TO_BY), ORIGIN, HIGH), (back.rlike(BACK_TO_SOURCE), ORIGIN, HIGH),
        (back.rlike(BACK_TO_VERB), TARGET, HIGH), (after.rlike(PASSIVE_AFTER), TARGET, HIGH), (back.rlike(BACK_TO_PREPOSITION), TARGET, MEDIUM), (attack & F.when(demonym, after.rlike(called)).otherwise(after.rlike(named)), TARGET, MEDIUM),
    )
    pair = lambda role, trust: F.struct(F.lit(role).alias("role"), F.lit(trust).alias("confidence"))
    out = F.when(rules[0][0], pair(*rules[0][1:]))
    for holds, *given in rules[1:]:
        out = out.when(holds, pair(*given))
    return out.when(demonym, pair(NEUTRAL, LOW)).otherwise(pair(NEUTRAL, MEDIUM))


def _rank(values: dict[str, int], c: Column) -> Column:
    out = F.lit(0)
    for name, rank in values.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def geo_roles(items: DataFrame, countries: DataFrame, actors: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows (item_id, region, country, roles, role, confidence): a row for each country of an item, and for each term of a region, without a country.

    items: id (one row each), text and, where there is such a column, summary; countries: country, region, term, demonym (boolean); actors: actor, kind, country (null
    if none is known), term; regions: region, term. Longer names take their places first, countries' before regions'. A group that acts for a
    state makes its country an attacker. ``role`` is the strongest of ``roles``: target, origin, neutral.
    """
    spelled = items.withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), SHORT_NAMES, ALIAS))
    if "summary" in items.columns:
        spelled = spelled.withColumn("summary", F.regexp_replace(F.coalesce("summary", F.lit("")), SHORT_NAMES, ALIAS))
    texts = marked(spelled).select(F.struct("id", F.col("text").rlike(ATTACK).alias("attack")).alias("id"), "text")
    of = countries.groupBy("country", "term").agg(F.bool_or("demonym").alias("demonym"))
    named = lambda kind, name, demonym: F.concat(F.lit(kind), F.when(demonym, "d").otherwise("-"), name).alias("group")
    names = of.select(named("c", F.col("country"), F.col("demonym")), "term", F.lit(0).alias("turn")).unionByName(regions.select(named("r", F.col("region"), F.lit(True)), "term", F.lit(1).alias("turn")))
    by_state = actors.where(F.col("kind") == STATE).join(countries.select("country").distinct(), "country").select(named("a", F.col("country"), F.lit(False)), "term")
    found = places_by_lexicon(texts, {"names": (names, {"claim": ALL, "window": WINDOW}), "groups": (by_state, {"claim": NONE, "every": False})}).where("group <> ''")

    # roles are told where the places are found, so what is around a name is never shuffled; numbers stand for them, which Spark adds up without sorting
    kind, demonym = F.substring("group", 1, 1), F.substring("group", 2, 1) == "d"
    m = F.when(kind == "a", F.struct(F.lit(ORIGIN).alias("role"), F.lit(HIGH).alias("confidence"))).otherwise(mention_role(F.col("before"), F.col("after"), demonym, F.col("id.attack")))
    said = found.select("id.id", F.expr("substring(group, 3)").alias("name"), F.when(kind == "r", F.col("term")).alias("term"), "first", m.alias("m"))
    said = said.select("id", "name", "term", "first", _rank(ROLE_RANK, F.col("m.role")).alias("role"), _rank(TRUST_RANK, F.col("m.confidence")).alias("trust"))
    rows = said.groupBy("id", "name", "term").agg(
        F.bit_or(F.expr("shiftleft(1, role)")).alias("seen"), F.max("role").alias("role"), F.max("trust").alias("surest"),
        F.max(F.col("first").cast("long") * 4 + F.col("trust")).alias("last"),
    )
    name_of = lambda ranks, c: F.element_at(F.array(*map(F.lit, sorted(ranks, key=ranks.get))), c)
    role, direct = name_of(ROLE_RANK, F.col("role")), F.col("term").isNotNull()
    seen = F.filter(F.array(*(F.when(F.col("seen").bitwiseAND(1 << rank) != 0, name) for name, rank in sorted(ROLE_RANK.items()))), lambda r: r.isNotNull())
    home = countries.where("country IS NOT NULL").groupBy(F.col("country").alias("_country")).agg(F.min("region").alias("_region"))
    rows = rows.withColumn("country", F.when(~direct, F.col("name"))).join(F.broadcast(home), F.col("country") == F.col("_country"), "left")
    confidence = F.when(~direct, name_of(TRUST_RANK, F.col("surest"))).when(F.col("last") % 4 == TRUST_RANK[LOW], LOW).otherwise(MEDIUM)
    return rows.select(F.col("id").alias("item_id"), F.when(direct, F.col("name")).otherwise(F.col("_region")).alias("region"), "country", F.when(direct, F.array(role)).otherwise(seen).alias("roles"), role.alias("role"), confidence.alias("confidence"))


def named_groups(items: DataFrame, actors: DataFrame) -> DataFrame:
    """Rows (item_id, actor, kind, country): groups that an item names, each once. items: id, text, summary; actors: actor, kind, country, term."""
    found = term_places(marked(items), actors.select(F.col("actor").alias("group"), "term"), NONE, every=False).select("id", F.col("group").alias("actor")).distinct()
    of = actors.groupBy("actor").agg(F.first("kind").alias("kind"), F.first("country").alias("country"))
    return found.join(of, "actor").select(F.col("id").alias("item_id"), "actor", "kind", "country")


def role_hits(roles: DataFrame) -> DataFrame:
    """Rows (item_id, region, role, country) for ``cyber_regions``: a row for each role of a country or region."""
    return roles.select("item_id", "region", F.explode("roles").alias("role"), "country")

import pytest

from tidewire.operators import cyber, desk

COUNTRIES = [
    ("China", "east_asia", "china", False), ("China", "east_asia", "chinese", True), ("Taiwan", "east_asia", "taiwan", False), ("Taiwan", "east_asia", "taiwanese", True), ("North Korea", "east_asia", "north korea", False), ("North Korea", "east_asia", "north korean", True),
    ("Korea", "east_asia", "korea", False), ("Japan", "east_asia", "japanese", True), ("Russia", "eurasia", "russia", False), ("Russia", "eurasia", "russian", True), ("Ukraine", "eurasia", "ukraine", False), ("Ukraine", "eurasia", "ukrainian", True), ("United States", "north_america", "usa", False),
    ("United States", "north_america", "american", True), ("Iran", "middle_east", "iran", False), ("Israel", "middle_east", "israeli", True), ("Philippines", "asia", "philippine", True), ("Saudi Arabia", "middle_east", "saudi arabia", False), ("Germany", "europe", "german", True), ("India", "asia", "indian", True),
]
ACTORS = [("Volt Typhoon", "nation_state", "China", "volt typhoon"), ("Sandworm", "nation_state", "Russia", "sandworm"), ("Lazarus Group", "nation_state", "North Korea", "lazarus group"), ("Lazarus Group", "nation_state", "North Korea", "lazarus"), ("LockBit", "cybercrime", None, "lockbit")]
REGIONS = [("middle_east", "middle east"), ("europe", "europe"), ("europe", "european"), ("asia", "north korea border")]
CASES = {
    "Chinese hackers target Taiwan's semiconductor industry": {"China": "origin", "Taiwan": "target"}, "Taiwan was targeted by Chinese state-sponsored hackers": {"Taiwan": "target", "China": "origin"},
    "North Korean hackers target US banks in new campaign": {"North Korea": "origin", "United States": "target"}, "Russian hackers breach Ukrainian energy companies": {"Russia": "origin", "Ukraine": "target"},
    "Volt Typhoon infiltrates US critical infrastructure networks": {"China": "origin", "United States": "target"}, "Sandworm wiper malware hits Ukrainian government agencies": {"Russia": "origin", "Ukraine": "target"},
    "China-linked group targets Philippine government": {"China": "origin", "Philippines": "target"}, "Iran-backed actors hit Israeli water utilities": {"Iran": "origin", "Israel": "target"}, "Cyberattack on Saudi Arabia linked to Iran": {"Iran": "origin", "Saudi Arabia": "origin"},
    "Researchers expose Russia’s GRU hacking unit operations": {"Russia": "origin"}, "Ransomware gang hits German hospitals and clinics": {"Germany": "target"}, "Phishing campaign targets Indian banks and users": {"India": "target"},
    "US firm publishes annual transparency report on data requests": {"United States": "neutral"}, "New malware lets attackers spy on us through webcams": {}, "Google patches actively exploited Chrome zero-day": {}, "LockBit strikes again": {}, "": {},
}


@pytest.fixture(scope="module")
def read(spark):
    lexicons = (spark.createDataFrame(COUNTRIES, "country string, region string, term string, demonym boolean"), spark.createDataFrame(ACTORS, "actor string, kind string, country string, term string"), spark.createDataFrame(REGIONS, "region string, term string"))
    return lambda rows: cyber.geo_roles(spark.createDataFrame(rows, "id int, text string, summary string"), *lexicons)


def test_attackers_and_victims(read):
    texts = list(CASES)
    got = {i: {} for i in range(len(texts))}
    for r in read([(i, t, None) for i, t in enumerate(texts)]).collect():
        got[r.item_id][r.country] = r.role
    assert {t: got[i] for i, t in enumerate(texts)} == CASES
    lazarus = {r.country: (r.role, r.roles) for r in read([(1, "Lazarus Group steals crypto from Japanese exchange", None)]).collect()}
    assert lazarus == {"North Korea": ("origin", ["origin"]), "Japan": ("neutral", ["neutral"])}


def test_roles_add_up_and_windows_end_with_the_title(read):
    rows = {r.country: r for r in read([(1, "Russia", "was hacked. Russian hackers attack American users"), (2, "Attacks on Europe and European firms. North Korea border", None), (3, None, None)]).collect()}
    assert rows["Russia"].roles == ["neutral", "origin"] and rows["Russia"].role == "origin" and rows["Russia"].confidence == "high" and rows["United States"].role == "target"
    assert rows["North Korea"].role == "neutral" and [k for k in rows if k] == [k for k in rows if k in ("Russia", "United States", "North Korea")]
    direct = sorted((r.region, r.role, r.confidence) for r in read([(2, "Attacks on Europe and European firms. North Korea border", None)]).where("country IS NULL").collect())
    assert direct == [("europe", "target", "medium"), ("europe", "target", "medium")]


def test_regions_of_items(spark, read):
    hits = cyber.role_hits(read([(1, "Chinese hackers target Taiwan's chip firms", None), (2, "North Korean Lazarus Group targets US banks", None)]))
    got = {r.region: (r.n, r.origin, r.target, r.neutral) for r in desk.cyber_regions(hits, 2).collect()}
    assert got == {"east_asia": (2, 2, 1, 0), "north_america": (1, 0, 1, 0)}
    groups = cyber.named_groups(spark.createDataFrame([(1, "Lazarus and LockBit, lazarus group"), (2, None)], "id int, text string"), spark.createDataFrame(ACTORS, "actor string, kind string, country string, term string"))
    assert sorted((r.item_id, r.actor, r.country) for r in groups.collect()) == [(1, "Lazarus Group", "North Korea"), (1, "LockBit", None)]

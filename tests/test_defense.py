import pytest

from tidewire.operators import defense, rollups

LEXICON = [
    ("segment", "Naval", "frigate", 3, 0, None), ("segment", "Naval", "shipyard", 1, 0, None), ("segment", "Naval", "destroyer", 3, 0, None), ("segment", "Aerospace", "jet", 1, 1, None), ("segment", "UAV / Unmanned", "drone", 2, 2, None), ("segment", "Munitions", "artillery shell", 3, 3, None), ("segment", "Munitions", "missile", 2, 3, None), ("segment", "Land Systems", "tank", 2, 4, None),
    ("activity", "Export Review", "foreign military sale", 3, 10, None), ("activity", "Industrial Partnership", "joint venture", 3, 11, None), ("activity", "Industrial Partnership", "co-production", 2, 11, None), ("activity", "Sustainment", "mro", 2, 12, None), ("activity", "Sustainment", "spare parts", 2, 12, None), ("activity", "Sustainment", "sustainment contract", 3, 12, None), ("activity", "Production Capacity", "increase output", 3, 13, None), ("activity", "Production Capacity", "new production line", 3, 13, None),
    ("activity", "Procurement", "to buy", 2, 14, None), ("activity", "Supply Chain", "shortage", 2, 15, None), ("commodity", "Semiconductors", "semiconductor", 2, 20, None), ("commodity", "Semiconductors", "chipmaker", 1, 20, None), ("commodity", "Titanium", "titanium", 1, 21, None), ("stress", "stress", "shortage", 2, 30, None), ("stress", "stress", "export ban", 3, 30, None),
    ("platform", "F-35 Lightning II", "f-35", None, 40, "Aerospace"), ("platform", "Bayraktar TB2", "bayraktar tb2", None, 41, "UAV / Unmanned"), ("platform", "K2 Black Panther", "k2 tank", None, 42, "Land Systems"), ("contractor", "Lockheed Martin", "lockheed martin", None, 50, "United States"), ("contractor", "Baykar", "baykar", None, 51, "Turkey"), ("relevance", "", "navy", None, 60, None),
]
COUNTRIES = [("Poland", "europe", "poland", False), ("South Korea", "asia", "south korea", False), ("South Korea", "asia", "south korean", True), ("Germany", "europe", "germany", False), ("Germany", "europe", "german", True), ("Ukraine", "europe", "ukraine", False), ("United States", "america", "american", True), ("Korea", "asia", "korea", False), ("India", "asia", "india", False)]


@pytest.fixture(scope="module")
def read(spark):
    lexicon = spark.createDataFrame(LEXICON, "kind string, name string, term string, weight int, place int, link string")
    countries = spark.createDataFrame(COUNTRIES, "country string, region string, term string, demonym boolean")

    def run(*texts, summary=None, official=None):
        frame = spark.createDataFrame([(i, t, summary, official) for i, t in enumerate(texts)], "id int, text string, summary string, official boolean")
        return [r for _, r in sorted((r.id, r) for r in defense.detect(frame, lexicon, countries).collect())]

    return run


def test_segments_activities_and_names(read):
    got = read(
        "Shipyard lays keel for new frigate program", "Air force receives new F-35 Lightning II jets", "Baykar unveils new Bayraktar TB2 drone variant", "Army orders thousands of precision-guided artillery shells", "State Department approves foreign military sale of missiles",
        "Two primes sign joint venture for co-production of airframe", "Air force awards MRO and spare parts sustainment contract", "Manufacturer to increase output with new production line", "Lockheed Martin delivers F-35s", "Local bakery wins regional dessert competition", None, "Navy asks NATO", "jet")
    assert [r.segment for r in got[:4]] == ["Naval", "Aerospace", "UAV / Unmanned", "Munitions"] and [r.activity for r in got[4:8]] == ["Export Review", "Industrial Partnership", "Sustainment", "Production Capacity"]
    assert (got[8].organisation, got[8].program, got[8].activity, got[8].segments) == ("Lockheed Martin", "F-35 Lightning II", "UAV / Aerospace", ["Aerospace"])
    assert got[0].activity == "Naval Program" and not got[9].relevant and not got[10].relevant and got[10].segment == defense.UNKNOWN and got[10].parties == defense.NOWHERE
    assert got[11].relevant and got[11].organisation == "NATO" and not got[12].relevant


def test_buyers_and_suppliers(read):
    got = read(
        "Poland to buy K2 tanks from South Korea in major deal", "Germany to supply Leopard 2 tanks to Ukraine", "South Korean defense firm and India", "Lockheed Martin and American jets", "Poland and Germany", "Poland and India", "India", "India orders; Poland acquires; Ukraine bought german-made drones",
        "India in Poland buys. Poland sells")
    assert got[0].parties == "South Korea → Poland" and {c.country: c.role for c in got[0].countries} == {"South Korea": "supplier", "Poland": "buyer"} and got[0].program == "K2 Black Panther"
    assert {c.country: c.role for c in got[1].countries}["Germany"] == "supplier" and got[2].parties == "South Korea (supplier)" and got[3].parties == "United States (supplier)"
    assert got[4].parties == "europe" and got[5].parties == defense.SEVERAL and got[6].parties == "India" and got[7].parties == "Germany → Ukraine / Poland"
    assert {c.country: c.role for c in got[8].countries} == {"Poland": "buyer", "India": "neutral"}


def test_stress_confidence_and_impact(spark, read):
    text = "Semiconductor shortage and export ban disrupt defense supply chain"
    (row,) = read(text, summary="Chipmakers face extended lead times amid sanctions, crisis of a record $2 billion $ ", official=True)
    assert row.commodities == ["Semiconductors"] and row.stress == 5 and row.activity == "Supply Chain" and (row.confidence, row.impact, row.priority) == ("Medium", "High", "elevated")
    plain = read("Lockheed Martin wins $2 billion F-35 sustainment contract", official=True)[0]
    assert (plain.confidence, plain.impact, plain.priority, plain.area) == ("High", "Medium", "medium", defense.UNKNOWN)
    lexicon = spark.createDataFrame(LEXICON, "kind string, name string, term string, weight int, place int, link string")
    countries = spark.createDataFrame(COUNTRIES, "country string, region string, term string, demonym boolean")
    items = spark.createDataFrame([(1, text, None), (2, "semiconductors", None), (3, "bakery", None)], "id int, text string, official boolean")
    detected = defense.detect(items, lexicon, countries)
    assert [tuple(r)[:4] for r in rollups.pressure(defense.commodity_mentions(detected)).collect()] == [("Semiconductors", 2, 1, 25)]
    assert defense.detect(items.where("false"), lexicon, countries).collect() == []

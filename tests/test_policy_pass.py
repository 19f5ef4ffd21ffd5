from tidewire.operators import lexical

ORDER = ["Crisis & Conflict", "Trade", "Diplomacy"]


def test_one_pass_tells_the_same_as_places_of_their_own(spark):
    topics = spark.createDataFrame([("Trade", "tariff", 2), ("Crisis & Conflict", "war", 2), ("Diplomacy", "talks", 1)], "group string, term string, weight int")
    signals = spark.createDataFrame([("escalation", "threat", 3), ("magnitude", "mass", 2), ("deescalation", "calm", 2)], "group string, term string, weight int")
    places = spark.createDataFrame([("Guinea", "guinea", "africa", False), ("Papua", "papua new guinea", "oceania", False), ("sahel", "sahel", "africa", True), ("Mali", "mali", "africa", False), ("Mali", "mali", None, False), ("Asia", "asia", None, True)], "group string, term string, region string, is_region boolean")
    texts = ["Papua New Guinea, guinea and Guinea: tariffs", "mali and guinea war", "the sahel talks calm", "sahel; papua new guinea. mass threat", "asia", "nothing", None, "mali guinea guinea guinea", "mali, guinea, guinea"]
    texts = spark.createDataFrame([(i, t, i % 2 == 0) for i, t in enumerate(texts)], "id long, text string, official boolean")
    known = spark.createDataFrame([("nothing",)], "term string")
    once = lexical.policy(texts, topics, signals, None, ORDER, known, places)
    assert once._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = lexical.places(texts, places)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    apart = lexical.policy(texts, topics, signals, found, ORDER, known)
    assert sorted(once.collect()) == sorted(apart.collect())
    assert {r.id: r.region for r in once.collect()} == {0: "Guinea", 1: "Mali", 2: "africa", 3: "Papua", 4: lexical.SEVERAL, 5: lexical.NOWHERE, 6: lexical.NOWHERE, 7: "Guinea", 8: "africa"}

from tidewire.operators import lexical


def test_longer_terms_claim_first(spark):
    texts = spark.createDataFrame([(1, "Crypto exchange and another EXCHANGE."), (2, "exchanges, the u.s. f-35s"), (3, None), (4, "crypto exchange")], "id long, text string")
    lexicon = spark.createDataFrame([("fin", "crypto exchange", 3), ("fin", "exchange", 2), ("fin", "crypto", 1), ("air", "f-35", 2), ("us", "u.s.", 1), ("all", "exchange", 2)], "group string, term string, weight int")
    got = {(r.id, r.group): (r.score, r.max_weight, r.terms) for r in lexical.weighted_scores(texts, lexicon).collect()}
    assert got == {(1, "fin"): (5, 3, ["crypto exchange", "exchange"]), (4, "fin"): (3, 3, ["crypto exchange"]), (2, "us"): (1, 1, ["u.s."]), (1, "all"): (2, 2, ["exchange"]), (4, "all"): (2, 2, ["exchange"])}
    kept = {(r.id, r.sector): r.confidence for r in lexical.sectors(lexical.weighted_scores(texts, lexicon)).collect()}
    assert kept == {(1, "fin"): "high", (4, "fin"): "medium", (1, "all"): "low", (4, "all"): "low"}
    assert lexical.weighted_scores(texts, lexicon.limit(0)).count() == 0 and lexical.weighted_scores(texts.limit(0), lexicon).count() == 0


def test_places_and_their_label(spark):
    lexicon = spark.createDataFrame([("Guinea", "guinea", "africa", False), ("Papua", "papua new guinea", "oceania", False), ("africa", "sahel", "africa", True), ("Mali", "mali", "africa", False)], "group string, term string, region string, is_region boolean")
    texts = spark.createDataFrame([(1, "Papua New Guinea, guinea and Guinea"), (2, "mali and guinea"), (3, "the sahel"), (4, "sahel; papua new guinea. Mali?"), (5, "none")], "id long, text string")
    found = lexical.places(texts, lexicon)
    assert {(r.id, r.country): r.mentions for r in found.where("id = 1").collect()} == {(1, "Papua"): 1, (1, "Guinea"): 2}
    assert {r.id: r.region for r in lexical.display_region(found).collect()} == {1: "Guinea", 2: "africa", 3: "africa", 4: lexical.SEVERAL}


def test_policy_ladder(spark):
    topics = spark.createDataFrame([("Trade", "tariff", 2), ("Crisis & Conflict", "war", 2), ("Diplomacy", "talks", 1)], "group string, term string, weight int")
    signals = spark.createDataFrame([("escalation", "invasion", 3), ("escalation", "threat", 3), ("magnitude", "mass", 2), ("deescalation", "truce", 4), ("deescalation", "calm", 2)], "group string, term string, weight int")
    texts = spark.createDataFrame([(1, "invasion threat tariff war", True), (2, "invasion mass truce", False), (3, "talks", False), (4, "nothing", True), (5, "war calm", False), (6, "threat", None)], "id long, text string, official boolean")
    places = spark.createDataFrame([(1, "Mali", "africa", 1)], "id long, country string, region string, mentions long")
    got = {r.id: (r.topic, r.severity, r.region, r.relevant, r.confidence) for r in lexical.policy(texts, topics, signals, places, ["Crisis & Conflict", "Trade", "Diplomacy"], spark.createDataFrame([("nothing",)], "term string")).collect()}
    assert got == {
        1: ("Crisis & Conflict", "critical", "Mali", True, "high"), 2: ("Diplomacy", "medium", lexical.NOWHERE, False, "low"), 3: ("Diplomacy", "low", lexical.NOWHERE, False, "low"),
        4: ("Diplomacy", "low", lexical.NOWHERE, True, "medium"), 5: ("Crisis & Conflict", "low", lexical.NOWHERE, True, "medium"), 6: ("Diplomacy", "high", lexical.NOWHERE, False, "low"),
    }

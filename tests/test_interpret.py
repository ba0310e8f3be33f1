"""Adjudication of readings, cleaned identities, proposals to split, anchors of names."""

from pyspark.sql import functions as F

from lectern.operators import context, interpret

ADDRESS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


def greedy(lineages):
    groups = []
    for sources in lineages or []:
        home = next((g for g in groups if g & set(sources)), None)
        if home is None:
            groups.append(set(sources))
        else:
            home |= set(sources)
    return len(groups)


def test_witnesses(spark):
    cases = [None, [], [["a"]], [["a"], ["b"], ["a", "b"]], [["a"], ["b"], ["b", "c"], ["c"]], [[], []], [["a", "b"], ["c"], ["b", "c"], ["c", "d"], ["d"]]]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, l array<array<string>>")
    got = {r["i"]: r["n"] for r in rows.select("i", interpret.witnesses(F.col("l")).alias("n")).collect()}
    assert got == {i: greedy(c) for i, c in enumerate(cases)}


def test_adjudication(spark):
    m, s, t = interpret.MEMBERSHIP, interpret.STRUCTURE, "person/nearby-title"
    rows = [
        (0, [m, m], [["c"], ["c"]], ["place"], 2), (1, [m], [["c"]], ["place"], 1), (2, [m, t], [["c"], ["d"]], [], 3), (3, [s], [["c"]], ["place"], 2), (4, None, None, None, 2),
        (5, [m], [["c"]], ["place", "organization"], 2), (6, [m], [["c"]], None, None),
    ]
    got = {r["i"]: r for r in interpret.adjudicated(spark.createDataFrame(rows, "i int, signals array<string>, lineages array<array<string>>, alternatives array<string>, n_tokens int")).collect()}
    assert [(got[i].had_reading, got[i].supported, got[i].scopes, got[i].n_witnesses, got[i].disposition, got[i].becomes) for i in range(7)] == [
        (True, False, ["component"], 1, "reclassify", "place"), (True, True, ["candidate-span"], 1, "person-survives", None),
        (True, True, ["component", "neighbourhood"], 2, "person-survives", None), (True, True, ["candidate-span"], 1, "person-survives", None),
        (False, False, [], 0, "undetermined", None), (True, False, ["component"], 1, "contested-without-person", None), (True, True, ["component"], 1, "person-survives", None),
    ]


def test_reasons_and_polarity(spark):
    rows = spark.createDataFrame([
        (0, ["known_surname", "other"], ["nearby_title", "known-surname"], ["anchor_signature_block", "possessive", "possessive"], True, True), (1, None, None, None, None, False), (2, ["nearby_title"], [], [], False, None),
    ], "i int, c array<string>, p array<string>, r array<string>, l boolean, s boolean")
    got = {r["i"]: r["x"] for r in rows.select("i", interpret.person_reasons(*[F.col(x) for x in "cprls"]).alias("x")).collect()}
    assert got == {0: ["known-surname", "nearby-title", "anchor:signature_block", "contextual-usage:possessive", "person-evidenced-linkage", "census-name-structure"], 1: [], 2: []}
    rows = spark.createDataFrame([("contraction", -9), ("common_english_word", 3), ("x", 5), ("x", -5), ("x", 0), ("x", None)], "r string, w int")
    assert [r["p"] for r in rows.select(interpret.polarity(F.col("r"), F.col("w")).alias("p")).collect()] == ["neutral", "negative", "positive", "negative", "neutral", "neutral"]


def test_identities(spark):
    lexicon = spark.createDataFrame([("can", "ordinary"), ("good", "ordinary"), ("rose", "ordinary"), ("rose", "name"), ("will", "ordinary"), ("will", "ambiguous")], "word string, kind string")
    options = [
        ("a", 0, "Tania Can Collier", False, True), ("a", 1, "Tania Collier", False, True), ("a", 2, "Good Tania Collier", False, True), ("a", 3, "Tania can", False, True),
        ("a", 4, "Good Good", True, True), ("b", 0, "Rose Can Will", False, False), ("b", 1, "rose can will", False, False), ("c", 0, "can", False, True), ("d", 0, None, None, None), ("e", 0, "  ", False, True),
    ]
    got = interpret.cleaned_options(spark.createDataFrame(options, "candidate_key string, position int, name string, backed boolean, relabel boolean"), lexicon).collect()
    assert sorted((r.candidate_key, r.position, r.cleaned) for r in got) == [("a", 1, "Tania Collier"), ("a", 4, "Good Good"), ("b", 0, "Rose Can Will")]
    groups = spark.createDataFrame([(1, "Tania Can Collier"), (2, "Tania Collier"), (3, "Rose Can Collier")], "group_id int, name string")
    found = interpret.inserted_words(groups, spark.createDataFrame([(1,), (1,), (2,)], "group_id int"), lexicon).collect()
    assert [tuple(r) for r in found] == [(1, "Tania Can Collier", "Tania Collier")]


def test_splits(spark):
    cases = [
        ("Chris, Margaret and Lee", [(0, ["dividing-punctuation"]), (1, ["coordinating-conjunction"])], ["Chris", "Margaret", "Lee"]),
        ("Smith Jones Brown", [], ["Smith Jones Brown"]), ("and Lee", [], ["and Lee"]), ("O'Brien/Smith-Jones", [(0, ["dividing-punctuation"])], ["O'Brien", "Smith-Jones"]),
        ("Ann, and Bo", [(0, ["dividing-punctuation", "coordinating-conjunction"])], ["Ann", "Bo"]), ("(Ann) - Bo", [], ["Ann) - Bo"]), ("Ann", [], ["Ann"]), ("...", [], None), ("", [], None),
    ]
    rows = spark.createDataFrame([(i, v) for i, (v, _, _) in enumerate(cases)], "i int, v string").withColumn("t", interpret.tokens_of(F.col("v")))
    cuts = interpret.split_proposal(F.col("v"), F.col("t"))
    got = {r["i"]: r for r in rows.select("i", cuts.alias("cuts"), interpret.segments(F.col("v"), F.col("t"), F.transform(cuts, lambda c: c["boundary"])).alias("parts")).collect()}
    for i, (_, wanted, parts) in enumerate(cases):
        assert [(c["boundary"], c["rules"]) for c in got[i]["cuts"]] == wanted, cases[i]
        assert (got[i]["parts"] and [p["text"] for p in got[i]["parts"]]) == parts, cases[i]
    both = interpret.split_proposal(F.col("v"), F.col("t"), F.array(F.lit(True), F.lit(True), F.lit(False)))
    assert [(c["boundary"], len(c["rules"])) for c in rows.filter("i = 0").select(both.alias("x")).first()["x"]] == [(0, 2), (1, 1)]
    record = interpret.split_record(spark.createDataFrame([("Ann, Bo Ray", [0], [1, 0, 0, 7, -1])], "value string, proposed array<int>, confirmed array<int>")).first()
    assert (record.proposed, record.confirmed, record.accepted_exactly, [p.text for p in record.parts]) == ([0], [0, 1], False, ["Ann", "Bo", "Ray"])


def test_anchors(spark):
    role, signature, mail, unit = "anchor_full_name_with_role", "anchor_signature_block", "anchor_name_with_email", "anchor_full_name_with_organization"
    cases = [
        ("Jordan Lee", "Jordan Lee, Director of Finance", None, [role]), ("Jordan Lee", "We met Jordan Lee — Senior Counsel", "x", [role]), ("Jordan", "Jordan, Director", None, []),
        ("Jordan Lee", "Jordan Lee, Human Resources", None, [unit]), ("Jordan Lee", "Jordan Lee", "Director of Finance", [signature]), ("Jordan Lee", "Then Jordan Lee left us", "Director", []),
        ("Casey Morgan", "Casey Morgan (cmorgan@example.edu)", None, [mail]), ("Casey Morgan", "Casey Morgan", "call cmorgan@example.edu", [mail]), ("Amy Lee", "Amy Lee lee@example.edu", None, []),
        ("Jordan Lee", "Jordan Lee, PhD", "Finance Office", [signature]), ("Jordan Lee", "Jordan Lee", "It was late. Office hours.", []), (None, None, None, []),
    ]
    rows = spark.createDataFrame([(i, m, t, n, (t.index(m) + len(m)) if t else None) for i, (m, t, n, _) in enumerate(cases)], "i int, m string, t string, n string, e int")
    rules = context.anchor_rules(F.col("m"), F.col("t"), F.col("e"), F.col("n"), ("director", "counsel"), ("resources", "office"), ADDRESS)
    got = {r["i"]: r["r"] for r in rows.select("i", rules.alias("r")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}

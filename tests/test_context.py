"""Rules that read a name's surroundings."""

from lectern.operators import context

WORDS = {
    "openers": ("dear", "thank you"), "follow_ons": ("please",), "attribution": ("said", "wrote"), "lead_ins": ("according to",), "roles": ("manager", "team lead"),
    "actions": ("said", "called", "arrived"), "directed": ("called", "asked"), "abbreviations": ("mrs",),
}
CASES = [
    ("Dear [Jordan], welcome", ["contextual_direct_address"]), ("[Jordan], please come", ["contextual_direct_address"]), ("today [Jordan] said so", ["contextual_attribution"]),
    ("according to [Jordan] it rains", ["contextual_attribution"]), ("[Jordan] and Nora Lind, who left", ["contextual_coordination"]), ("[Jordan] and Nora Lind left", []), ("the manager and [Jordan]", ["contextual_coordination"]),
    ("[Jordan] and tables", []), ("with Ann, Bob Ray, [Jordan]", ["contextual_person_list"]), ("with Ann, [Jordan], Bob", ["contextual_person_list"]), ("with Ann, [Jordan] again", []),
    ("[Jordan]'s desk", ["contextual_possessive"]), ("[Jordan] arrived", ["contextual_human_subject"]), ("[Jordan] has quietly", []), ("[Jordan] has arrived.", ["contextual_human_subject"]),
    ("we asked [Jordan] twice", ["contextual_human_object"]), ("nobody asked. [Jordan] sat", []), ("...ed [Jordan] rose...", []), ("Jordan said", []), (None, []), ("", []),
]


def test_usage_rules(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, context string").repartition(2)
    got = {r["i"]: r["rules"] for r in rows.select("i", context.usage_rules(rows["context"], WORDS).alias("rules")).collect()}
    assert {i: got[i] for i in got} == {i: r for i, (_, r) in enumerate(CASES)}


def test_no_words(spark):
    rows = spark.createDataFrame([("Dear [Jordan] said",)], "context string")
    assert rows.select(context.usage_rules(rows["context"], {}).alias("r")).first()["r"] == []

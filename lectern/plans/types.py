"""Queries over types, contexts and normal forms of candidates; parts, customers, orders and benchmark items stand for candidates."""

from pyspark.sql import functions as F

from lectern.functions import wording
from lectern.operators import context, normalize, types
from lectern.plans.catalog import query

_CATEGORIES = (
    "known_first_name", "organization_suffix", "calendar_term", "document_structure_term", "likely_acronym", "strong_name_structure", "nearby_title",
    "common_english_word", "institution_term",
)
_READINGS = ("ordinary-language", "person", "organization", "domain-terminology", "place")
_HARMLESS = ("ordinary-language", "domain-terminology")


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values):
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


_FACTS = f"""
facts AS (SELECT p_partkey, p_size, p_name, p_brand,
  CASE p_size % 6 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'cin' WHEN 3 THEN 'organization' ELSE 'person' END AS kind,
  CASE WHEN p_size % 7 = 0 THEN ['acronym'] WHEN p_size % 11 = 0 THEN ['numeric-identifier'] ELSE []::VARCHAR[] END AS relations,
  [replace(({_list(_CATEGORIES)})[p_partkey % 9 + 1], '_', '-')] AS categories FROM part),
typed AS (SELECT *, CASE
  WHEN kind = 'email' THEN 'emails' WHEN kind = 'phone' THEN 'phones' WHEN kind = 'cin' THEN 'identifiers'
  WHEN list_contains(relations, 'numeric-identifier') THEN 'identifiers'
  WHEN list_contains(relations, 'acronym') OR categories[1] = 'likely-acronym' THEN 'acronyms'
  WHEN kind = 'organization' OR categories[1] IN ('organization-suffix', 'institution-term') THEN 'organizations'
  WHEN categories[1] = 'calendar-term' THEN 'dates-terms' WHEN categories[1] = 'document-structure-term' THEN 'document-titles'
  WHEN kind = 'person' AND categories[1] IN ('known-first-name', 'nearby-title') THEN 'people' ELSE 'other' END AS type FROM facts)
"""


def _facts(spark, sf_dir):
    size = F.col("p_size") % 6
    kind = F.when(size == 0, "email").when(size == 1, "phone").when(size == 2, "cin").when(size == 3, "organization").otherwise("person")
    none = F.expr("cast(array() as array<string>)")
    relations = F.when(F.col("p_size") % 7 == 0, F.array(F.lit("acronym"))).when(F.col("p_size") % 11 == 0, F.array(F.lit("numeric-identifier"))).otherwise(none)
    rule = F.element_at(F.array(*[F.lit(x) for x in _CATEGORIES]), (F.col("p_partkey") % 9 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_name", "p_brand", kind.alias("kind"), relations.alias("relations"), types.all_categories(F.array(rule), F.array(rule)).alias("categories")
    )


@query("WITH " + _FACTS + "SELECT p_partkey, type, CASE WHEN type = 'other' THEN 'undetermined' ELSE type END AS section FROM typed")
def semantic_types(spark, sf_dir):
    parts = [F.col(x) for x in ("kind", "relations", "categories")]
    return _facts(spark, sf_dir).select("p_partkey", types.semantic_type(*parts).alias("type"), types.section(*parts).alias("section"))


@query("WITH " + _FACTS + f"""
SELECT p_brand AS doc_id, CASE WHEN type = 'other' THEN 'undetermined' ELSE type END AS section, list_position({_list(types.ORDER)}, any_value(CASE WHEN type = 'other' THEN 'undetermined' ELSE type END))::BIGINT AS place,
  count(*) AS n_entities, sum(p_size)::BIGINT AS n_occurrences, count(*) FILTER (p_partkey % 4 = 0) AS n_decided, list_sort(list(p_partkey)) AS candidate_keys
FROM typed GROUP BY 1, 2
""")
def type_summaries(spark, sf_dir):
    """Summaries by type for each document, for which a brand stands."""
    items = _facts(spark, sf_dir).select(
        F.col("p_brand").alias("doc_id"),
        types.section(F.col("kind"), F.col("relations"), F.col("categories")).alias("section"), F.col("p_partkey").alias("candidate_key"),
        F.col("p_size").alias("n_occurrences"), (F.col("p_partkey") % 4 == 0).alias("decided"),
    )
    return types.summaries(items, "doc_id")


@query("WITH " + _FACTS + f""",
read AS (SELECT *, CASE WHEN p_size % 5 = 0 THEN NULL ELSE list_distinct(list_transform(range(p_size % 3), lambda i: ({_list(_READINGS)})[(p_partkey + i * i) % 5 + 1])) END AS readings FROM facts)
SELECT p_partkey, CASE WHEN reason = 'one harmless reading' THEN 'unlikely' ELSE 'review-required' END AS necessity,
  CASE WHEN reason = 'one harmless reading' THEN readings[1] END AS explanation, reason FROM (SELECT *, CASE
    WHEN kind IN ('email', 'phone', 'cin') THEN 'protective type' WHEN readings IS NULL THEN 'no profile' WHEN len(readings) = 0 THEN 'no evidence'
    WHEN len(readings) > 1 THEN 'several readings' WHEN readings[1] = 'person' THEN 'a person'
    WHEN readings[1] NOT IN ('ordinary-language', 'domain-terminology') THEN 'may be private' ELSE 'one harmless reading' END AS reason FROM read)
""")
def review_necessity(spark, sf_dir):
    all_ = F.array(*[F.lit(x) for x in _READINGS])
    one = lambda i: F.element_at(all_, ((F.col("p_partkey") + i * i) % 5 + 1).cast("int"))
    n = F.col("p_size") % 3
    readings = F.when(F.col("p_size") % 5 != 0, F.array_distinct(F.slice(F.array(one(0), one(1)), F.lit(1), n)))
    return _facts(spark, sf_dir).select("p_partkey", types.necessity(F.col("kind"), readings, _HARMLESS).alias("x")).select("p_partkey", "x.*")


_ARCHETYPES = ("shortened-name", "acronym", "identifier", "institutional-term", "calendar-term", "common-word", "uncertain")


@query("WITH " + _FACTS + f""",
placed AS (SELECT *, CASE ({_list(_ARCHETYPES)})[p_size % 8 + 1] WHEN 'shortened-name' THEN 'people' WHEN 'acronym' THEN 'acronyms' WHEN 'identifier' THEN 'identifiers'
  WHEN 'institutional-term' THEN 'institutional' WHEN 'calendar-term' THEN 'calendar' WHEN 'common-word' THEN 'common-words'
  ELSE CASE WHEN kind = 'person' THEN 'people' ELSE 'other' END END AS section FROM facts)
SELECT section, count(*) AS n FROM placed GROUP BY 1
""")
def triage_sections(spark, sf_dir):
    archetype = F.get(F.array(*[F.lit(x) for x in _ARCHETYPES]), (F.col("p_size") % 8).cast("int"))
    return types.by_rule(_facts(spark, sf_dir).withColumn("section", types.triage_section(archetype, F.col("kind"))), "section")


def _gated(spark, sf_dir):
    facts = _facts(spark, sf_dir).withColumns({
        "detected_type": F.col("kind"), "n_tokens": F.size(F.split("p_name", " ")) - F.when(F.col("p_partkey") % 3 > 0, 1).otherwise(0), "decided": F.col("p_size") == 17,
        "settled": F.col("p_size") == 23, "contextual": F.col("p_partkey") % 10 == 4,
    })
    return types.gated(facts, ("common-english-word", "calendar-term", "strong-name-structure"))


_GATED = _FACTS + """,
gated AS (SELECT *, CASE WHEN p_size = 17 THEN 'decided' WHEN p_size = 23 THEN 'settled before' WHEN kind <> 'person' THEN 'type out of scope'
  WHEN len(string_split(p_name, ' ')) - CASE WHEN p_partkey % 3 > 0 THEN 1 ELSE 0 END <> 1 THEN 'several words'
  WHEN categories[1] IN ('known-personal-name-token', 'known-first-name', 'known-name-structure') THEN 'known as a name'
  WHEN p_partkey % 10 = 4 THEN 'used as a person' WHEN categories[1] NOT IN ('common-english-word', 'calendar-term', 'strong-name-structure') THEN 'no ordinary evidence' END AS why_review FROM facts)
"""


@query("WITH " + _GATED + "SELECT p_partkey, why_review, CASE WHEN why_review IS NULL THEN categories[1] END AS evidence FROM gated")
def residual_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("p_partkey", "why_review", F.array_join("evidence", ",").alias("evidence"))


@query("WITH " + _GATED + "SELECT coalesce(why_review, 'ordinary language') AS rule, count(*) AS n FROM gated GROUP BY 1")
def resolutions_by_rule(spark, sf_dir):
    return types.by_rule(_gated(spark, sf_dir).withColumn("rule", F.coalesce("why_review", F.lit("ordinary language"))), "rule")


# --- contexts ----------------------------------------------------------------------------------


def _occurrences(spark, sf_dir):
    """Line items as occurrences: an order is a document, a part a candidate."""
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("candidate_key"), F.col("l_linenumber").alias("block_order"), F.col("l_quantity").cast("int").alias("start")
    ).dropDuplicates(["doc_id", "candidate_key", "block_order", "start"])


_OCCURRENCES = """
occ AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS candidate_key, l_linenumber AS block_order, l_quantity::INT AS start FROM lineitem),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_order, start, candidate_key) - 1 AS sequence FROM occ)
"""


@query("WITH " + _OCCURRENCES + """
SELECT doc_id, candidate_key, block_order, start, sequence, p_brand, group_id FROM seq
LEFT JOIN part ON candidate_key = p_partkey AND p_size > 10
LEFT JOIN (SELECT l_orderkey AS doc_id, l_partkey AS candidate_key, min(l_suppkey) AS group_id FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) g USING (doc_id, candidate_key)
""")
def review_occurrences(spark, sf_dir):
    """Occurrences in document order with facts of their candidates and their first groups."""
    found = _occurrences(spark, sf_dir)
    lines = _t(spark, sf_dir, "lineitem")
    groups = lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("candidate_key"), F.col("l_suppkey").alias("group_id"))
    parts = _t(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("candidate_key"), "p_brand")
    facts = found.select("doc_id", "candidate_key").distinct().join(parts, "candidate_key")
    return context.with_facts(found, facts, groups).select("doc_id", "candidate_key", "block_order", "start", "sequence", "p_brand", "group_id")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block_order FROM documents)
SELECT doc_id, block_order::INT AS block_order, sha256(lead(text, 1) OVER w) AS next_hash, sha256(lead(text, 2) OVER w) AS after_next_hash FROM l
WHERE trim(text) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY block_order)
""")
def following_blocks(spark, sf_dir):
    from lectern.operators import detect

    rows = context.with_following(detect.blocks(_t(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "block_order", F.sha2("next_text", 256).alias("next_hash"), F.sha2("after_next_text", 256).alias("after_next_hash"))


_RULES = tuple(context.WEIGHTS)
_WEIGHTS = "CASE r " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in context.WEIGHTS.items()) + " END"
_STRENGTH = """least(55, floor(coalesce(list_sum(list_transform(list_reverse_sort(list_transform(RULES, lambda r: WEIGHTS)), lambda w, i: w * CASE i WHEN 1 THEN 1.0 WHEN 2 THEN 0.4 WHEN 3 THEN 0.2 ELSE 0.1 END)), 0) + 0.5))::INT""".replace("WEIGHTS", _WEIGHTS)


@query("WITH " + _OCCURRENCES + f""",
told AS (SELECT *, list_distinct(list_transform(range(start % 4), lambda i: ({_list(_RULES)})[(candidate_key + block_order + i * i) % 11 + 1])) AS rules FROM seq),
s AS (SELECT *, coalesce({_STRENGTH.replace('RULES', 'rules')}, 0) AS strength, len(list_filter(rules, lambda r: starts_with(r, 'anchor_'))) > 0 AS anchor FROM told),
g AS (SELECT doc_id, candidate_key, list_sort(list_distinct(flatten(list(rules)))) AS rules, count(*) FILTER (len(rules) = 0) AS n_without, count(*) AS n,
  arg_max(sequence, struct_pack(a := anchor, b := strength, c := -sequence)) AS telling FROM s GROUP BY 1, 2)
SELECT doc_id, candidate_key, array_to_string(rules, ',') AS rules, n_without, n, telling, coalesce({_STRENGTH.replace('RULES', 'rules')}, 0) AS strength,
  coalesce({_STRENGTH.replace('RULES', 'rules')}, 0) >= 30 AS passes FROM g
""")
def contextual_evidence(spark, sf_dir):
    """Rules of all occurrences of a candidate, their combined strength and the telling occurrence."""
    every = F.array(*[F.lit(x) for x in _RULES])
    one = lambda i: F.element_at(every, ((F.col("candidate_key") + F.col("block_order") + i * i) % 11 + 1).cast("int"))
    rules = F.array_distinct(F.slice(F.array(one(0), one(1), one(2)), F.lit(1), F.col("start") % 4))
    found = context.document_order(_occurrences(spark, sf_dir)).withColumn("rules", rules)
    return context.person_evidence(found).withColumn("rules", F.array_join("rules", ","))


# --- normal forms ------------------------------------------------------------------------------

_LEADING, _TRAILING = ("small", "cold", "the"), ("widget", "gadget")


@query("""
WITH v AS (SELECT p_partkey, p_name || CASE WHEN p_size % 4 = 0 THEN ',' ELSE '' END AS value FROM part),
w AS (SELECT *, list_transform(string_split(value, ' '), lambda t: lower(trim(t, ' .,'))) AS names FROM v),
c AS (SELECT *, CASE WHEN names[1] IN ('small', 'cold', 'the') THEN 1 ELSE 0 END AS head, CASE WHEN names[-1] IN ('widget', 'gadget') THEN 1 ELSE 0 END AS tail FROM w)
SELECT p_partkey, trim(CASE WHEN head + tail >= len(names) THEN value ELSE array_to_string(string_split(value, ' ')[head + 1 : len(names) - tail], ' ') END, ' .,') AS retained FROM c
""")
def stripped_values(spark, sf_dir):
    """Values without the words that come off their ends, and without punctuation there."""
    rows = _t(spark, sf_dir, "part").withColumn("value", F.concat("p_name", F.when(F.col("p_size") % 4 == 0, ",").otherwise("")))
    return normalize.with_retained(rows.select("p_partkey", "value"), "value", _LEADING, _TRAILING).select("p_partkey", "retained")


def _people(spark, sf_dir):
    """Parts as people of a document for each brand: their names, and the second words of some by themselves."""
    p = _t(spark, sf_dir, "part")
    alone = p.filter("p_size % 3 = 0").select(F.col("p_brand").alias("doc_id"), F.substring_index("p_name", " ", -1).alias("display_value"))
    whole = p.select(F.col("p_brand").alias("doc_id"), F.col("p_name").alias("display_value"))
    rows = whole.unionByName(alone).distinct().withColumn("detected_type", F.lit("person"))
    return rows.withColumn("candidate_key", F.concat(F.lit("person:"), F.lower("display_value")))


_MERGES = """
people AS (SELECT DISTINCT * FROM (SELECT p_brand AS doc_id, p_name AS value FROM part UNION ALL SELECT p_brand, string_split(p_name, ' ')[-1] FROM part WHERE p_size % 3 = 0)),
merges AS (SELECT a.doc_id, 'person:' || a.value AS candidate_key, 'person:' || b.value AS target_key, b.value AS retained FROM people a JOIN people b
  ON a.doc_id = b.doc_id AND b.value = substring(a.value, strpos(a.value, ' ') + 1) AND strpos(a.value, ' ') > 0 AND string_split(a.value, ' ')[1] IN ('small', 'cold', 'the'))
"""


@query("WITH " + _MERGES + "SELECT * FROM merges")
def normal_merges(spark, sf_dir):
    people = _people(spark, sf_dir)
    return normalize.merges(people, F.lit(True), _LEADING, ())


@query("WITH " + _MERGES + """,
found AS (SELECT p_brand AS doc_id, 'person:' || p_name AS candidate_key, p_partkey AS block_order, p_name AS match FROM part)
SELECT f.doc_id, count(*) AS n, count(m.retained) AS n_moved, count(m.retained) FILTER (strpos(match, retained) > 0) AS n_narrowed,
  count(m.retained) FILTER (strpos(match, retained) = 0) AS n_whole FROM found f LEFT JOIN merges m USING (doc_id, candidate_key) GROUP BY 1
""")
def normal_statistics(spark, sf_dir):
    """Occurrences that merges move to other candidates, and how many of them get narrower."""
    people = _people(spark, sf_dir)
    planned = normalize.merges(people, F.lit(True), _LEADING, ())
    found = _t(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), F.concat(F.lit("person:"), F.lower("p_name")).alias("candidate_key"), F.col("p_partkey").alias("block_order"),
        F.lit(0).alias("start"), F.length("p_name").alias("end"), F.col("p_name").alias("match"),
    )
    return normalize.statistics(normalize.rehomed(found, planned), "doc_id")


# --- wording -----------------------------------------------------------------------------------


@query("""
SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '[REDACTED EMAIL]' WHEN 1 THEN '[REDACTED PHONE]' WHEN 2 THEN '[REDACTED ID]' WHEN 3 THEN '[REDACTED ORGANIZATION]' ELSE '[PERSON REDACTED]' END AS generic,
  '[' || upper(p_type) || ' ' || CASE WHEN p_partkey < 1000 THEN lpad(p_partkey::VARCHAR, 3, '0') ELSE p_partkey::VARCHAR END || ']' AS numbered,
  'X-' || CASE WHEN p_size < 1000 THEN lpad(p_size::VARCHAR, 3, '0') ELSE p_size::VARCHAR END AS custom,
  'paragraph word/document.xml ' || p_partkey AS ref, p_partkey::INT AS ref_index FROM part
""")
def placeholders(spark, sf_dir):
    ref = wording.paragraph_ref(F.lit("word/document.xml"), F.col("p_partkey"))
    return _facts(spark, sf_dir).join(_t(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey").select(
        "p_partkey", wording.placeholder(F.col("kind")).alias("generic"), wording.numbered_placeholder(F.col("p_type"), F.col("p_partkey")).alias("numbered"),
        wording.from_template(F.lit("X-{n}"), F.col("p_size")).alias("custom"), ref.alias("ref"), wording.read_ref(ref)["index"].alias("ref_index"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'sequential' WHEN p_size % 3 = 1 THEN 'blanket' ELSE CASE WHEN p_type = 'PROMO' THEN 'blanket' ELSE 'blanket' END END AS mode,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '[REDACTED ' || upper(p_type) || ']' END AS blanket,
  CASE WHEN p_size % 5 = 0 THEN p_brand || '_{n}' WHEN p_size % 5 = 1 THEN 'N{n}' ELSE upper(p_type) || '_{n}' END AS pattern FROM part
""")
def replacement_rules(spark, sf_dir):
    """Rules of types that have none by default: given parts over built ones."""
    size = F.col("p_size")
    mode = F.when(size % 3 == 0, "Sequential").when(size % 3 == 1, "other")
    pattern = F.when(size % 5 == 0, F.col("p_brand")).when(size % 5 == 1, "N{n}")
    return _t(spark, sf_dir, "part").select("p_partkey", wording.rule(F.col("p_type"), mode, F.when(size % 2 == 0, F.col("p_brand")), pattern).alias("r")).select("p_partkey", "r.*")


@query(r"""
SELECT item_id, sha256(regexp_replace(regexp_replace(text, '\b(and of)\b', '$1\2', 'gi'), '\b(the|and)\b', 'X', 'gi')) AS hash FROM benchmark
""".replace(r"'$1\2'", r"'$' || '1\\\\2'"))
def replaced_words(spark, sf_dir):
    """Whole words replaced in any case, the longest first; special characters of a replacement stand for themselves."""
    rules = F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("replacement")) for a, b in (("and", "X"), ("and of", r"$1\\2"), ("the", "X"))])
    return _t(spark, sf_dir, "benchmark").select("item_id", F.sha2(wording.with_replacements(F.col("text"), rules), 256).alias("hash"))


@query("""
WITH t AS (SELECT item_id, string_split(lower(text), ' ')[:12] AS words FROM benchmark)
SELECT a.item_id, round(CASE WHEN len(list_distinct(list_concat(a.words, b.words))) = 0 THEN 0 ELSE len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) END, 9) AS likeness,
  a.words[1] || ', ' || a.words[2] || ', and ' || a.words[3] AS phrase, [2, 3, len(a.words) - 5]::INT[] AS parts,
  CASE WHEN a.item_id % 3 = 0 THEN '~100%' WHEN a.item_id % 3 = 1 THEN '~0%' ELSE a.item_id % 100 || '%' END AS shown
FROM t a JOIN t b ON b.item_id = a.item_id + 1 WHERE len(a.words) >= 7 AND (a.item_id % 3 <> 2 OR a.item_id % 100 > 0)
""")
def wording_figures(spark, sf_dir):
    """Likeness of neighbouring items' words, a joined phrase, the shape of a split, and percents as shown."""
    t = _t(spark, sf_dir, "benchmark").select("item_id", F.slice(F.split(F.lower("text"), " "), 1, 12).alias("words"))
    a, b = t, t.select((F.col("item_id") - 1).alias("item_id"), F.col("words").alias("other"))
    i = F.col("item_id")
    value = F.when(i % 3 == 0, 99.7).when(i % 3 == 1, 0.2).otherwise(i % 100)
    met = a.join(b, "item_id").filter((F.size("words") >= 7) & ((i % 3 != 2) | (i % 100 > 0)))
    return met.select(
        "item_id", F.round(wording.jaccard(F.col("words"), F.col("other")), 9).alias("likeness"), wording.joined(F.slice("words", 1, 3)).alias("phrase"),
        wording.parts_of(F.size("words"), F.array(F.lit(4), F.lit(1), F.lit(99), F.lit(4))).alias("parts"), wording.percent_shown(value).alias("shown"),
    )

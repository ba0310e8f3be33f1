"""Queries over packs of terms and normal forms; names of parts and words of items stand for them."""

from pyspark.sql import functions as F

from lectern.functions import forms
from lectern.plans.catalog import query
from lectern.sources import packs


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WORDS = "words AS (SELECT item_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM benchmark)"
_KEY = "regexp_replace(upper(strip_accents(replace(word, 'ß', 'SS'))), '[^A-Z]', '', 'g')"


def _words(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("word"))


@query(f"WITH {_WORDS} SELECT {_KEY} AS key, bit_or((1 << (item_id % 3))::INT) AS flags, bit_or((1 << (item_id % 3))::INT) & 2 <> 0 AS second FROM words GROUP BY 1")
def name_flags(spark, sf_dir):
    """Flags of all rows of a name, and a test of one bit."""
    rows = _words(spark, sf_dir).withColumn("flag", F.expr("shiftleft(1, cast(item_id % 3 as int))"))
    return packs.flags_by_key(rows, forms.name_key(F.col("word"))).withColumn("second", packs.has_bit(F.col("flags"), 2))


@query(f"""
WITH {_WORDS}, flags AS (SELECT {_KEY} AS key, bit_or((1 << (item_id % 3))::INT) AS flags FROM words GROUP BY 1),
v AS (SELECT item_id, array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:2], ' ') AS value FROM benchmark),
k AS (SELECT *, regexp_replace(upper(strip_accents(replace(string_split(value, ' ')[1], 'ß', 'SS'))), '[^A-Z]', '', 'g') AS lead, regexp_replace(upper(strip_accents(replace(string_split(value, ' ')[-1], 'ß', 'SS'))), '[^A-Z]', '', 'g') AS trail FROM v)
SELECT item_id, a.flags AS lead_flags, b.flags AS trail_flags, coalesce(a.flags & 1 <> 0, false) AND coalesce(b.flags & 2 <> 0, false) AS name_like
FROM k LEFT JOIN flags a ON a.key = lead LEFT JOIN flags b ON b.key = trail
""")
def names_by_flags(spark, sf_dir):
    """First and last words of values looked up among names."""
    rows = _words(spark, sf_dir).withColumn("flag", F.expr("shiftleft(1, cast(item_id % 3 as int))"))
    names = packs.flags_by_key(rows, forms.name_key(F.col("word")))
    values = _t(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1, 2), " ").alias("value"))
    return packs.with_name_flags(values, names).select("item_id", "lead_flags", "trail_flags", "name_like")


@query("""
WITH v AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'St. ' || p_name WHEN p_size % 4 = 1 THEN string_split(p_name, ' ')[1] ELSE p_name END AS value FROM part),
k AS (SELECT *, regexp_replace(trim(regexp_replace(upper(value), '[^A-Z0-9]+', ' ', 'g')), '\\bST\\b', 'SAINT') AS place_key FROM v),
places AS (SELECT DISTINCT regexp_replace(trim(regexp_replace(upper(value), '[^A-Z0-9]+', ' ', 'g')), '\\bST\\b', 'SAINT') AS key FROM v WHERE p_partkey % 2 = 0)
SELECT p_partkey, place_key, CASE WHEN key IS NOT NULL AND strpos(place_key, ' ') > 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'possible' ELSE 'attested' END END AS place FROM k LEFT JOIN places ON key = place_key
""")
def places(spark, sf_dir):
    size, name = F.col("p_size"), F.col("p_name")
    value = F.when(size % 4 == 0, F.concat(F.lit("St. "), name)).when(size % 4 == 1, F.substring_index(name, " ", 1)).otherwise(name)
    values = _t(spark, sf_dir, "part").select("p_partkey", value.alias("value"), (F.col("p_partkey") % 5 == 0).alias("name_like"))
    known = values.filter("p_partkey % 2 = 0").select(forms.place_key(F.col("value")).alias("key"))
    return packs.with_places(values, known).select("p_partkey", "place_key", "place")


@query(r"""
SELECT p_partkey, trim(regexp_replace(replace(lower(p_name), 'e', ' and '), '[^a-z0-9'']+', ' ', 'g')) AS term,
  trim(regexp_replace(regexp_replace(lower(p_brand || '., ' || p_name), '[.,]', '', 'g'), '\s+', ' ', 'g')) AS whole,
  CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || '''s' END AS said, p_name AS bare FROM part
""")
def phrase_forms(spark, sf_dir):
    """Terms and whole values in normal form, and words without a possessive ending."""
    said = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit("'s")))
    return _t(spark, sf_dir, "part").select(
        "p_partkey", forms.phrase_key(F.replace("p_name", F.lit("e"), F.lit("&"))).alias("term"), forms.full_value(F.concat("p_brand", F.lit("., "), "p_name")).alias("whole"),
        said.alias("said"), forms.unclitic(said).alias("bare"),
    )


@query("""
WITH t AS (SELECT DISTINCT lower(word) AS term FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM benchmark))
SELECT term FROM t WHERE term <> ''
""")
def word_lists(spark, sf_dir):
    """Entries of a list with comments, in normal form, each once."""
    lines = _words(spark, sf_dir).select(F.concat(F.lit(" "), "word", F.lit("  # note")).alias("value"))
    return packs.word_list(lines)


@query("""
WITH packs AS (SELECT DISTINCT p_brand AS rule, p_name AS term FROM part),
gone AS (SELECT DISTINCT p_brand AS rule, p_name AS term FROM part WHERE p_size % 4 = 0), new AS (SELECT DISTINCT p_brand AS rule, p_type AS term FROM part WHERE p_size % 4 = 1)
SELECT * FROM packs EXCEPT SELECT * FROM gone UNION SELECT * FROM new
""")
def overridden_packs(spark, sf_dir):
    """Packs after the additions and removals of JSON texts."""
    p = _t(spark, sf_dir, "part")
    lists = p.groupBy("p_brand").agg(F.collect_set(F.when(F.col("p_size") % 4 == 1, F.col("p_type"))).alias("add"), F.collect_set(F.when(F.col("p_size") % 4 == 0, F.col("p_name"))).alias("remove"))
    texts = lists.select(F.to_json(F.map_from_arrays(F.array("p_brand"), F.array(F.struct("add", "remove")))).alias("value"))
    return packs.overridden(p.select(F.col("p_brand").alias("rule"), F.col("p_name").alias("term")).distinct(), packs.read_overrides(texts))


@query("SELECT p_partkey, p_brand, CASE WHEN p_type <> 'PROMO' THEN p_type END AS p_type FROM part")
def decoded_rows(spark, sf_dir):
    """Rows whose columns are codes of tables; a code without an entry has no value."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    tables = {c: packs.coded(p, c) for c in ("p_brand", "p_type")}
    rows = p
    for c, values in tables.items():
        rows = rows.join(values.select(F.col("value").alias(c), F.col("code").alias("at")), c).drop(c).withColumnRenamed("at", c)
    return packs.decoded(rows, {"p_brand": tables["p_brand"], "p_type": tables["p_type"].filter("value <> 'PROMO'")})

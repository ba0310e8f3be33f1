"""Queries of reference packs, saved sessions and spans, over terms and texts of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import attestation, detect, evidence
from lectern.plans.catalog import query
from lectern.plans.evidence import _LEN, _P
from lectern.plans.proposals import _PAIR, _t
from lectern.sources import sessions

_FAMILIES = {"en": "higher-ed-terminology", "de": "medical-terminology", "fr": "legal-terminology", "es": "government-public-admin"}


def _terms(spark, sf_dir):
    """Starts of sentences as terms: a family for every language, a source for every source, and the values they are asked about."""
    d = _t(spark, sf_dir, "documents").filter("lang IS NOT NULL")
    t = d.select("doc_id", "lang", "source", F.explode(F.regexp_extract_all("text", F.lit(_PAIR), F.lit(0))).alias("term")).groupBy("lang", "source", "term").agg(F.min("doc_id").alias("place"))
    family = F.element_at(F.create_map(*[F.lit(x) for p in _FAMILIES.items() for x in p]), F.col("lang"))
    n = F.length("term")
    packs = t.select(
        family.alias("family"), F.concat_ws("-", F.lpad(F.col("place").cast("string"), 12, "0"), "source", "term").alias("order"), F.lower("term").alias("normalized"), "term", F.concat(F.lit("sub"), (n % 2).cast("string")).alias("sub_domain"), F.col("source").alias("source_family"),
        F.lit(None).cast("string").alias("source_id"), F.array(F.concat(F.lit("hint"), (n % 3).cast("string")), F.lit("term")).alias("hints"), F.when(n % 4 != 0, n % 4 == 1).alias("source_attested"), (F.col("place") % 3 == 0).alias("derived"), F.lit(None).cast("string").alias("parent_term"),
        F.element_at(F.array(*map(F.lit, attestation.RISKS)), (n % 3 + 1).cast("int")).alias("risk"), F.when(n % 7 == 0, F.upper(F.substring("term", 1, 2))).alias("acronym"), F.lit(None).cast("string").alias("expansion"), F.lit(None).cast("string").alias("notes"),
    ).withColumnRenamed("order", "place")
    values = t.select(F.col("term").alias("value")).distinct()
    asked = values.select("value", F.explode(F.array(*map(F.lit, _FAMILIES.values()))).alias("family"), F.lower("value").alias("normalized"))
    licences = t.select(family.alias("family"), F.col("source").alias("source_family"), F.concat(F.lit("Source "), "source").alias("source"), F.concat(F.lit("https://example.org/"), "source").alias("source_url"), F.lit("official").alias("authority_level"),
        F.when(F.col("source").endswith("1"), "public domain").otherwise("open licence").alias("licence"), F.lit("2026-08-10").alias("retrieved")).distinct()
    return values, asked, packs, licences.filter("source_family <> 'src2'")


_FAMILY = f"map({list(_FAMILIES)}, {list(_FAMILIES.values())})[lang]"
_AUDIT = f"""t AS (SELECT lang, source, term, min(doc_id) AS first FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '{_PAIR}')) AS term FROM documents WHERE lang IS NOT NULL) GROUP BY 1, 2, 3),
p AS (SELECT {_FAMILY} AS family, lpad(first::VARCHAR, 12, '0') || '-' || source || '-' || term AS place, lower(term) AS normalized, term, 'sub' || (length(term) % 2) AS sub_domain, source, 'hint' || (length(term) % 3) || '|term' AS hints,
  CASE WHEN length(term) % 4 = 0 THEN first % 3 <> 0 ELSE length(term) % 4 = 1 END AS source_attested, first % 3 = 0 AS derived, ['LOW', 'MEDIUM', 'HIGH'][length(term) % 3 + 1] AS risk, CASE WHEN length(term) % 7 = 0 THEN upper(term[1:2]) END AS acronym FROM t),
v AS (SELECT DISTINCT term AS value FROM t), a AS (SELECT value, p.* FROM v JOIN p ON p.normalized = lower(value))"""


@query(f"""WITH {_AUDIT} SELECT value, family, place, source AS source_family, CASE WHEN source = 'src2' THEN '' ELSE 'Source ' || source END AS source, CASE WHEN source = 'src2' THEN '' ELSE 'https://example.org/' || source END AS source_url,
  CASE WHEN source = 'src2' THEN '' ELSE 'official' END AS authority_level, CASE WHEN source = 'src2' THEN '' WHEN suffix(source, '1') THEN 'public domain' ELSE 'open licence' END AS licence, CASE WHEN source = 'src2' THEN '' ELSE '2026-08-10' END AS retrieved,
  sub_domain, term AS matched_term, normalized, hints, source_attested, derived, risk, acronym FROM a""")
def attestation_audit(spark, sf_dir):
    """One row for each attestation of the documents' terms in any pack, with its source and licence."""
    _, asked, packs, licences = _terms(spark, sf_dir)
    return attestation.audit_rows(asked, packs, licences).drop("source_id", "parent_term", "expansion", "notes")


@query(f"""WITH {_AUDIT}, ranked AS (SELECT *, min(place) OVER (PARTITION BY value, family, source) AS s_first, min(place) OVER (PARTITION BY value, family, sub_domain) AS d_first FROM a),
s AS (SELECT value, family, string_agg(source, ',' ORDER BY s_first) AS source_families FROM (SELECT DISTINCT value, family, source, s_first FROM ranked) GROUP BY 1, 2),
d AS (SELECT value, family, string_agg(sub_domain, ',' ORDER BY d_first) AS sub_domains FROM (SELECT DISTINCT value, family, sub_domain, d_first FROM ranked) GROUP BY 1, 2),
g AS (SELECT value, family, normalized, arg_min(term, place) AS matched_term, count(*) AS attestation_rows, max(CASE risk WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS r, bool_or(source_attested) AS has_source_attested FROM a GROUP BY 1, 2, 3)
SELECT value, family, normalized, matched_term, attestation_rows, source_families, CASE WHEN family IN ('higher-ed-terminology', 'medical-terminology') THEN '' ELSE sub_domains END AS sub_domains, ['LOW', 'MEDIUM', 'HIGH'][r] AS highest_risk, has_source_attested,
  2 AS n_tokens, map({list(attestation.CHANNELS)}, {list(attestation.CHANNELS.values())})[family] AS label FROM g JOIN s USING (value, family) JOIN d USING (value, family)""")
def attestation_channels(spark, sf_dir):
    """The uniform view of what each family says of the terms."""
    _, asked, packs, _ = _terms(spark, sf_dir)
    found = attestation.channels(attestation.audit_rows(asked, packs)).drop("hints")
    return found.withColumn("source_families", F.array_join("source_families", ",")).withColumn("sub_domains", F.array_join("sub_domains", ","))


@query(f"""WITH {_AUDIT}, h AS (SELECT DISTINCT value, family AS c FROM a UNION SELECT value, 'census-name' FROM v WHERE length(value) % 5 = 0 UNION SELECT value, 'gnis-place' FROM v WHERE length(value) % 6 = 0)
SELECT value, coalesce(string_agg(c, ',' ORDER BY list_position({[*attestation.CHANNELS, attestation.NAMES, attestation.PLACES]}, c)), '') AS channels FROM v LEFT JOIN h USING (value) GROUP BY 1""")
def attesting_channels(spark, sf_dir):
    """The channels that attest each term, in their order."""
    values, asked, packs, _ = _terms(spark, sf_dir)
    found = attestation.channels(attestation.audit_rows(asked, packs))
    named = values.filter(F.length("value") % 5 == 0)
    return attestation.attesting(values, found, named, values.filter(F.length("value") % 6 == 0)).withColumn("channels", F.array_join("channels", ","))


def _saved(spark, sf_dir):
    """Sessions of customers as saved texts: some of other versions, some damaged."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    one = F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('":{"candidateId":"'), F.col("o_orderkey").cast("string"), F.lit('","decision":"'), F.when(F.col("o_orderstatus") == "F", "Redact").otherwise("Keep"), F.lit('"'), F.when(F.col("o_orderkey") % 3 == 0, ',"source":"imported"').otherwise(""), F.lit("}"))
    held = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("decided"))
    k = F.col("c_custkey")
    version = F.when(k % 7 == 0, "1").when(k % 7 == 1, "3").when(k % 7 == 2, '"2"').otherwise("2")
    text = F.concat(
        F.lit('{"schemaVersion":'), version, F.lit(',"sessionId":"s'), k.cast("string"), F.when(k % 11 == 3, '","documentId":5').otherwise(F.concat(F.lit('","documentId":"'), F.col("c_name"), F.lit('"'))), F.lit(',"createdAt":"2026-01-01","updatedAt":"2026-02-01","candidateDecisions":{'),
        F.coalesce("decided", F.lit("")), F.lit('},"groupDecisions":{},"ambiguityResolutions":'), F.when(k % 13 == 4, "null").otherwise("{}"), F.lit(',"entityRegistry":{},"processingRevisions":[],"events":[]'), F.when(k % 17 != 5, ',"activeNotQuite":null').otherwise(""), F.when(k % 19 != 6, "}").otherwise(""),
    )
    return c.join(held, "c_custkey", "left").select(k.alias("k"), text.alias("value"))


_SAVED = """c AS (SELECT c_custkey AS k, c_name FROM customer), j AS (SELECT k, c_name, CASE
  WHEN k % 19 = 6 THEN 'not valid JSON' WHEN k % 7 = 0 THEN 'unrecognized schemaVersion 1 -- no migration path implemented' WHEN k % 7 = 1 THEN 'schemaVersion 3 is newer than this build supports (2) -- refusing to guess at an unknown future format'
  WHEN k % 7 = 2 THEN 'missing or non-numeric schemaVersion -- not a recognized ReviewSession save file' WHEN k % 11 = 3 THEN 'missing or non-string required field: documentId' WHEN k % 13 = 4 THEN 'missing or malformed required field: ambiguityResolutions'
  WHEN k % 17 = 5 THEN 'missing required field: activeNotQuite' END AS problem FROM c)"""


@query(f"WITH {_SAVED} SELECT coalesce(problem, 'read') AS outcome, count(*) AS n, min(k) AS first FROM j GROUP BY 1")
def session_outcomes(spark, sf_dir):
    """What becomes of saved sessions of several versions: read, or why not."""
    rows = sessions.judged(_saved(spark, sf_dir))
    return rows.groupBy(F.coalesce("problem", F.lit("read")).alias("outcome")).agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query(f"""WITH {_SAVED} SELECT 's' || k AS session_id, c_name AS doc_id, o_orderkey::VARCHAR AS candidate_id, CASE o_orderstatus WHEN 'F' THEN 'Redact' ELSE 'Keep' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN 'imported' ELSE 'reviewer' END AS source
FROM j JOIN orders ON o_custkey = k WHERE problem IS NULL""")
def session_rows(spark, sf_dir):
    """Decisions of the sessions that could be read."""
    good, _ = sessions.read_sessions(_saved(spark, sf_dir).select("value"))
    return sessions.session_decisions(good).select("session_id", "doc_id", "candidate_id", "decision", "source")


@query(rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::INT - 1 AS block_order FROM documents), m AS (SELECT doc_id, block_order, regexp_extract_all(t, '{_P}') AS f, string_split_regex(t, '{_P}') AS g FROM l WHERE contains(t, '@')),
n AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM m), o AS (SELECT doc_id, block_order, f[i] AS match, ({_LEN("g[1:i]")} + {_LEN("f[1:i-1]")})::INT AS start FROM n)
SELECT doc_id, block_order, match, start, (start + length(match))::INT AS "end" FROM o
""")
def reanchored_spans(spark, sf_dir):
    """Offsets of mail addresses, found again from their snippets alone and a hint that is off by five."""
    rows = detect.blocks(_t(spark, sf_dir, "documents").select("doc_id", "text"))
    found = detect.occurrences(rows).filter("detected_type = 'email'").select("doc_id", "block_order", "match", "context", (F.col("start") + 5).alias("near"))
    return evidence.reanchored(found, rows).select("doc_id", "block_order", "match", "start", "end")

"""Findings of the third round: ties, rounding and rules as the SQL of the queries has them."""

from __future__ import annotations

import math
import random
import re
from datetime import datetime
from itertools import combinations

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from lectern.functions import sql
from lectern.operators import corpus, figures, proposals, registry, relate, resolve


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over small tables."""
    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, want = queries()[name](spark, str(folder)), con.execute(oracle_sql()[name])
    columns = [d[0] for d in want.description]
    return sorted(map(tuple, got.select(*columns).collect()), key=str), sorted(want.fetchall(), key=str)


def test_deletion_counts_last_of_one_time(spark, tmp_path):
    at = datetime(2024, 1, 1)
    sessions = spark.createDataFrame([(s, 1, None) for s in range(4)], "session_id long, owner int, archived_at timestamp")
    changes = spark.createDataFrame([(0, at, "delete"), (0, at, "restore"), (1, at, "restore"), (1, at, "archive"), (2, at, "archive"), (2, at, "delete")], "session_id long, at timestamp, action string")
    got = {r.session_id: r.archived_at for r in figures.with_archived(sessions, changes).collect()}
    assert got == {1: None, 3: None}
    customer = spark.createDataFrame([(s, 1) for s in range(4)], "c_custkey long, c_nationkey int")
    orders = spark.createDataFrame([(0, 0, "O", at), (3, 0, "P", at), (6, 1, "F", at), (9, 1, "O", at), (12, 2, "F", at)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz")
    got, want = both(spark, tmp_path, "session_states", customer=customer, orders=orders)
    assert got == want and len(got) == 3


def test_percent_rounds_an_exact_half(spark, tmp_path):
    sql.register(spark, tables=False)
    assert tuple(spark.sql("SELECT guarded_percent(23, 80), guarded_percent(51, 80)").first()) == (28.8, 63.8)
    events = spark.range(80).select(
        F.col("id").alias("event_id"), F.lit(datetime(2024, 1, 5)).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") < 23, "purchase").otherwise("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    got, want = both(spark, tmp_path, "sql_usage_report", events=events)
    assert got == want and got[0][4] == 28.8


def test_replaced_words_has_its_sqls_rule(spark, tmp_path):
    items = spark.createDataFrame([(1, "this And Of that, the end and band"), (2, None), (3, "plain")], "item_id long, text string")
    got, want = both(spark, tmp_path, "replaced_words", benchmark=items)
    assert got == want


def test_pair_scores_meet_in_blocks(spark):
    rng, words = random.Random(3), "lorem ipsum dolor amet sit2 the with consul magna".split()
    texts = [" ".join([*rng.choices(words, k=rng.randrange(0, 30)), *rng.sample(["Apache License", "Old Mill Road", "Blue Trust", "x@a.example.org", "QRS QRS", "file no AB-12345"], rng.randrange(0, 5))]) for _ in range(60)] + [None, "", "Apache License"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    reps = docs.join(relate.classes(docs).filter("doc_id = rep").select("doc_id"), "doc_id")
    items, terms, shape = {}, {}, {r.doc_id: r.signature for r in corpus.structure(reps).collect()}
    for r in corpus.items(reps).collect():
        items.setdefault(r.doc_id, set()).add((r.kind, r.item))
    for r in corpus.terms(reps).collect():
        terms.setdefault(r.doc_id, {})[r.term] = r.n
    want = {}
    for a, b in combinations(sorted(items), 2):
        if shared := items[a] & items[b]:
            direct = sum(min(each * sum(k == kind for k, _ in shared), cap) for kind, (each, cap) in corpus.WEIGHTS.items())
            x, y = terms.get(a, {}), terms.get(b, {})
            norm = math.sqrt(sum(n * n for n in x.values())) * math.sqrt(sum(n * n for n in y.values()))
            cosine = sum(n * y.get(t, 0) for t, n in x.items()) / norm if norm else 0
            want[a, b] = (min(1, direct + corpus.VOCABULARY_CAP * cosine + corpus.STRUCTURE_WEIGHT * (shape[a] == shape[b])), len(shared))
    found = relate.pair_scores(docs)
    got = {(r.a, r.b): (r.score, r.n_shared) for r in found.collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for p, (score, n) in want.items():
        assert abs(got[p][0] - score) < 2e-9 and got[p][1] == n, (p, got[p], want[p])
    # the words of a document come once to a task, not to each of its pairs
    plan = found._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "n_a" not in plan
    strong = {(r.a, r.b) for r in relate.pair_scores(docs, 0.45).filter("score >= 0.45").collect()}
    assert strong == {p for p, (s, _) in want.items() if s >= 0.45} and strong


def test_dots_in_small_steps(monkeypatch):
    monkeypatch.setattr(relate, "_AT_ONCE", 3)
    texts = pd.DataFrame({"doc_id": [7, 1, 4, 9], "words": [[5, 5, 6], [5, 8, 9, 9], [], [6, 5, 9]], "signature": ["x", "x", "y", "x"]})
    pairs = pd.DataFrame([(1, 7), (1, 4), (4, 7), (1, 9), (7, 9)], columns=["a", "b"]).assign(direct=0.5, n_shared=1)
    assert not len(relate._dots((0, 0), pairs[:0], texts))
    got = {(r.a, r.b): (r.dot, r.square_a, r.square_b, r.alike) for r in relate._dots((0, 0), pairs, texts).itertuples()}
    assert got == {(1, 7): (2, 6, 5, True), (1, 4): (0, 6, 0, False), (4, 7): (0, 0, 5, False), (1, 9): (3, 6, 3, True), (7, 9): (3, 5, 3, True)}


def test_profiles_come_to_the_rows(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "x", None, "z"]), (1, "b", []), (1, "c", None)], "doc_id long, candidate_key string, rules array<string>")
    weights = spark.createDataFrame([("p", "x", 10), ("q", "x", 70), ("q", "x", 5)], "profile string, rule string, weight int")
    bands = spark.createDataFrame([("p", "Low", 40), ("p", "Mid", 45), ("r", "Any", 1)], "profile string, quality string, least int")
    found = registry.profiled(rows, weights, bands)
    got = {(r.profile, r.candidate_key): (r.score, r.quality) for r in found.collect()}
    assert got == {
        ("p", "a"): (45, "Mid"), ("q", "a"): (99, None), ("r", "a"): (35, "Any"), ("p", "b"): (35, None), ("q", "b"): (35, None), ("r", "b"): (35, "Any"), ("p", "c"): (35, None), ("q", "c"): (35, None), ("r", "c"): (35, "Any"),
    }
    # only the small tables of profiles are joined by sorting
    assert not re.search(r"SortMergeJoin \[.*candidate_key", found._jdf.queryExecution().executedPlan().toString())


def test_links_are_looked_up_from_the_end_with_fewer(spark):
    rng = random.Random(1)
    of = lambda name: spark.createDataFrame(sorted({(d, w) for d in range(8) for w in rng.choices("stuvwxyz", k=4)}), f"doc_id long, {name} string")
    left, right = of("a"), of("b")
    links = spark.createDataFrame(sorted({("s", w) for w in "tuvwxyz"} | {(w, "t") for w in "suvwxyz"} | {("u", "v")}), "a string, b string")
    want = sorted(map(tuple, left.join(right, "doc_id").join(links, ["a", "b"]).select("doc_id", "a", "b").collect()))
    assert sorted(map(tuple, proposals._linked(left, links, right, "a", "b").select("doc_id", "a", "b").collect())) == want and len(want) > 10


def test_truncated_variants_ask_for_their_beginnings(spark):
    values = ["Doc", "doc en", "doc  en-1", "Doc en 2", "doc en 2 x", "doc e", "other", "", None]
    rows = spark.createDataFrame([(1, f"k{i}", "person", v) for i, v in enumerate(values)] + [(2, "z", "person", "doc")], "doc_id long, candidate_key string, detected_type string, display_value string")
    found = resolve.truncated_variants(rows)
    assert sorted(map(tuple, found.collect())) == [(1, "k0", "k4"), (1, "k1", "k4"), (1, "k3", "k4")]
    assert "StartsWith" not in found._jdf.queryExecution().optimizedPlan().toString()

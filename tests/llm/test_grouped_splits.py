import random

from pyspark.sql import functions as F

from slovotok.llm import grouped_splits as g

DOCS = "id bigint, author_id bigint, continues_id bigint, group_id string"
SENTENCES = "id bigint, document_id string, sentence_index int, loaded_at timestamp, sentence_id string"


def brute(docs):
    """Groups by union-find over authors and links."""
    ids, parent = {d[0] for d in docs if d[0] is not None}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, a, c in docs:
        if i is None:
            continue
        if a:
            parent[find(("a", a))] = find(i)
        if c in ids:
            parent[find(c)] = find(i)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), set()).add(i)
    return {i: min(s) for s in groups.values() if len(s) > 1 for i in s}


def test_components_against_union_find(spark):
    rng = random.Random(4)
    docs = [(i, rng.choice([None, 0, *range(1, 60)]), rng.choice([None, None, i, 999, rng.randint(1, 120)])) for i in range(1, 120)]
    docs += [(200 + i, None, 201 + i) for i in range(60)] + docs[:20] + [(None, 5, 3)]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS)
    assert {r["id"]: r["group_id"] for r in g.components(g.ties(df)).collect()} == brute(docs)


def test_hot_author(spark):
    df = spark.createDataFrame([(i, 1 if i % 3 else 2, None, "") for i in range(1, 3000)], DOCS)
    assert {r["group_id"] for r in g.components(g.ties(df)).collect()} == {1, 3}


def test_numbers(spark):
    spelt = ["12", " 12", "12 ", "1 2", "12.0", "+12", "0012", "12.5", "n/a", "", None, "12a", "9" * 25]
    df = spark.createDataFrame([(s,) for s in spelt], "s string")
    assert [r[0] for r in df.select(g.document_number(F.col("s"))).collect()] == [12] * 7 + [None] * 6


def test_sentences_and_splits(spark):
    from datetime import datetime

    docs = spark.createDataFrame([(1, 7, None, ""), (2, 7, None, ""), (3, None, None, "")], DOCS)
    t = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [(10, "1.0", 1, t[0], ""), (11, " 2", 1, t[0], ""), (12, "3", 1, t[0], ""), (13, "9", 1, t[0], ""), (14, None, None, None, ""), (11, "3", 1, t[1], ""), (10, "1.0", 1, t[0], ""), (None, "1", 1, t[0], "")]
    sentences = spark.createDataFrame(rows, SENTENCES)
    assert sorted(tuple(r) for r in g.grouped_sentences(sentences, docs).collect()) == [(10, 1)]
    shares = spark.createDataFrame([("train", 0.8), ("test", 0.2), ("none", None)], "split_name string, share double")
    out = {r["sentence_id"]: r for r in g.split_sentences(sentences, docs, shares).collect()}
    assert set(out) == {10, 11, 12, 13, 14} and out[11]["split_name"] == out[12]["split_name"] and out[14]["split_name"] in ("train", "test")
    assert g.grouped_sentences(sentences.limit(0), docs).count() == 0 and g.grouped_sentences(sentences, docs.limit(0)).count() == 0


def test_shares_are_met(spark):
    df = spark.range(20_000).select(g.split_of(F.concat(F.lit("d"), F.col("id").cast("string")), [("train", 0.8), ("validation", 0.1), ("test", 0.1)]).alias("s"))
    got = {r["s"]: r["count"] / 20_000 for r in df.groupBy("s").count().collect()}
    assert abs(got["train"] - 0.8) < 0.02 and abs(got["validation"] - 0.1) < 0.02 and abs(got["test"] - 0.1) < 0.02

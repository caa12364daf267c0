"""Splits that keep related records together: connected components by alternating stars, then hashed split ranges.

Documents are tied to entities (authors) and to each other. Each entity ties its documents to the smallest of them, so an
entity with n documents gives n edges, not n squared. Large-star and small-star then alternate until no edge changes; each
step needs only the smallest neighbour of a node (a pre-aggregated minimum), so no neighbourhood is ever collected. The
join of edges with the minima is on a node that may hold a third of all edges: AQE splits such partitions. Edges are
written to the shared checkpoint folder after each round. The split of a record is found from a hash of its component's
id in the cumulated shares.

Defined results: null ids, unknown entities (null or 0), links to absent documents and links to oneself tie nothing;
repeated rows change nothing; a document that nothing ties is a group of its own; sentences without an existing document
are split by their own id; a sentence delivered twice counts once, in its latest load (ties: largest document number);
shares are scaled to sum 1; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slovotok.session import checkpoint

#: Rounds after which the alternation must have ended; it takes about the logarithm of the longest path, squared at worst.
MOST_ROUNDS = 60


def document_number(text: Column) -> Column:
    """The number that a document id spells: spaces of any kind, leading zeros and a zero fraction are ignored; null if it is none
    or beyond 64 bits."""
    digits = F.regexp_replace(text, r"[\s\x{A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]++", "")
    return F.regexp_extract(digits, r"^([+-]?[0-9]++)(?:\.0*+)?$", 1).try_cast("bigint")


def ties(documents: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, between tied documents: each with the smallest document of its author, and with what it continues."""
    docs = documents.filter(F.col("id").isNotNull()).select("id", "author_id", "continues_id")
    by = docs.filter(F.col("author_id").isNotNull() & (F.col("author_id") != 0)).select("id", "author_id")
    least = by.groupBy("author_id").agg(F.min("id").alias("v"))
    authors = by.join(least, "author_id").select(F.col("id").alias("u"), "v")
    ids = docs.select(F.col("id").alias("v")).distinct()
    links = docs.filter(F.col("continues_id").isNotNull()).select(F.col("id").alias("u"), F.col("continues_id").alias("v")).join(ids, "v", "left_semi")
    both = authors.unionByName(links.select("u", "v")).filter("u <> v")
    return both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node goes to the node's smallest neighbour (or itself)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour not larger than a node, and the node, go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def unsettled(edges: DataFrame) -> bool:
    """Whether the edges are not yet stars: a node that points to two others, or points on from where another points to it."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    by = ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not by.filter((F.col("out") > 1) | (F.col("out") > 0) & (F.col("into") > 0)).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, group_id): the smallest id of each node's component, for all nodes that occur in an edge u > v."""
    for _ in range(MOST_ROUNDS):
        edges = checkpoint(small_star(large_star(edges)))
        if not unsettled(edges):
            break
    else:
        raise RuntimeError("the components did not settle")
    targets = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(targets.select("id", F.col("id").alias("group_id")))


def latest_sentences(sentences: DataFrame) -> DataFrame:
    """(sentence_id, document, sentence_index): each sentence once, in its latest load."""
    number = document_number(F.col("document_id"))
    newest = F.max_by(F.struct(number.alias("document"), "sentence_index"), F.struct(F.coalesce(F.col("loaded_at").cast("string"), F.lit("")), F.coalesce(number, F.lit(-(1 << 63)))))
    return sentences.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("sentence_id")).agg(newest.alias("x")).select("sentence_id", "x.document", "x.sentence_index")


def grouped_sentences(sentences: DataFrame, documents: DataFrame) -> DataFrame:
    """(sentence_id, group_id) of the sentences whose document is tied to another. The join is the last step, so that AQE may split
    the partition of a document that holds much of all sentences."""
    groups = components(ties(documents))
    rows = latest_sentences(sentences)
    return rows.join(groups, rows["document"] == groups["id"]).select("sentence_id", "group_id")


def split_of(group: Column, shares: list[tuple[str, float]]) -> Column:
    """The split in whose cumulated share the hash of a group lies."""
    total = sum(max(s, 0.0) for _, s in shares)
    if not total:
        raise ValueError("no positive share")
    at = F.conv(F.substring(F.md5(F.concat(group, F.lit("|split"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    upto, out = 0.0, F
    for name, share in shares[:-1]:
        upto += max(share, 0.0) / total
        out = out.when(at < upto, name)
    return out.otherwise(F.lit(shares[-1][0])) if out is not F else F.lit(shares[-1][0])


def split_sentences(sentences: DataFrame, documents: DataFrame, shares: DataFrame) -> DataFrame:
    """(sentence_id, group_id, split_name, position) of every sentence; the position follows the index in its document."""
    named = [(r["split_name"], r["share"] or 0.0) for r in shares.orderBy(F.desc("share"), "split_name").limit(1000).collect()]
    # Documents and their groups first, so that the sentences are joined once and nothing after it asks for a partitioning.
    ids = documents.filter(F.col("id").isNotNull()).select("id").distinct()
    known = ids.join(components(ties(documents)), "id", "left").select(F.col("id").alias("known"), F.coalesce("group_id", "id").alias("group_id"))
    rows = latest_sentences(sentences)
    rows = rows.join(known, rows["document"] == known["known"], "left")
    group = F.col("group_id")
    key = F.when(group.isNotNull(), F.concat(F.lit("d"), group.cast("string"))).otherwise(F.concat(F.lit("s"), F.col("sentence_id").cast("string")))
    return rows.select("sentence_id", group, F.col("known").alias("document_number"), "sentence_index", split_of(key, named).alias("split_name"))


def split_report(rows: DataFrame) -> DataFrame:
    """Sentences, documents and share of each split."""
    by = rows.groupBy("split_name").agg(F.count("*").alias("n_sentences"), F.countDistinct("document_number").alias("n_documents"))
    return by.select("split_name", "n_sentences", "n_documents", F.round(F.col("n_sentences") / F.sum("n_sentences").over(Window.partitionBy()), 4).alias("share"))

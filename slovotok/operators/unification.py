"""Unification of features: whether readings of two words agree, with the features in conflict and the ones that are unknown.

Three-valued: a feature that either reading lacks is unknown, not in conflict; the gender of a plural says nothing; common gender agrees
with any. Two words match if some pair of their readings agrees in all features, are unknown if some pair has no conflict, and are in
conflict otherwise. Pairs of words are distinct before they are compared, so the work grows with the vocabulary, not with the text.

Defined results: words without a reading in the roles asked for give no edge; repeated pairs are counted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.functions.text import is_space, is_word, lookup_key, token_rows

FIELDS = ("case", "number", "gender")
MATCH, UNKNOWN, CONFLICT = "match", "unknown", "conflict"


def compared(a: Column, b: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """(conflicts, unknown): the features of two readings that differ, and the ones that either lacks."""
    plural = F.coalesce(a["number"] == "plural", F.lit(False)) | F.coalesce(b["number"] == "plural", F.lit(False))

    def state(f: str) -> Column:
        same = a[f] == b[f]
        if f == "gender":
            return F.when(plural, MATCH).when(a[f].isNull() | b[f].isNull(), UNKNOWN).when(same | (a[f] == "common") | (b[f] == "common"), MATCH).otherwise(CONFLICT)
        return F.when(same.isNull(), UNKNOWN).when(same, MATCH).otherwise(CONFLICT)

    which = lambda wanted: F.array_compact(F.array(*[F.when(state(f) == wanted, F.lit(f)) for f in fields]))
    return F.struct(which(CONFLICT).alias("conflicts"), which(UNKNOWN).alias("unknown"))


def unified(left: Column, right: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """(result, conflicts, unknown) of two arrays of readings; conflicts and unknown hold those of all pairs. Null without readings."""
    pairs = F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: compared(a, b, fields))))
    clean = lambda p: F.size(p["conflicts"]) == 0
    result = F.when(F.exists(pairs, lambda p: clean(p) & (F.size(p["unknown"]) == 0)), MATCH).when(F.exists(pairs, clean), UNKNOWN).otherwise(CONFLICT)
    every = lambda f: F.array_sort(F.array_distinct(F.flatten(F.transform(pairs, lambda p: p[f]))))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), F.struct(result.alias("result"), every("conflicts").alias("conflicts"), every("unknown").alias("unknown")))


def adjacent_pairs(docs: DataFrame) -> DataFrame:
    """(left_key, right_key, n): words that follow each other with nothing but space of one line between, by lookup key."""
    rows = token_rows(docs.filter("text <> ''"), ["doc_id"], before=2)
    linked = is_word(F.col("t")) & is_word(F.col("p2")) & is_space(F.col("p1")) & ~F.coalesce(F.col("p1").contains("\n"), F.lit(False))
    return rows.filter(linked).groupBy(lookup_key(F.col("p2")).alias("left_key"), lookup_key(F.col("t")).alias("right_key")).agg(F.count("*").alias("n"))


def agreement_edges(
    docs: DataFrame, lexicon: DataFrame, left: tuple[str, ...] = ("adjective", "participle"), right: tuple[str, ...] = ("noun",), fields: tuple[str, ...] = FIELDS, left_only: str = "true", right_only: str = "true"
) -> DataFrame:
    """(left_key, right_key, n, result, conflicts, unknown): the agreement of neighbouring words of which the first can have one of the
    `left` parts of speech and the second one of the `right`; other readings, and those that fail `left_only` or `right_only`, are
    not looked at."""
    readings = lexicon.filter(F.col("pos").isin(*left, *right)).select("key", "pos", "case", "tense", *(f for f in dict.fromkeys([*fields, "number"]) if f != "case")).distinct()
    kept = {"left": F.col("pos").isin(*left) & F.expr(left_only), "right": F.col("pos").isin(*right) & F.expr(right_only)}
    by = lambda pos, name: readings.filter(kept[name]).groupBy(F.col("key").alias(f"{name}_key")).agg(F.collect_list(F.struct(*[c for c in readings.columns if c != "key"])).alias(f"{name}_r"))
    pairs = reduce(lambda df, side: df.join(by(side[0], side[1]), f"{side[1]}_key"), ((left, "left"), (right, "right")), adjacent_pairs(docs))
    return pairs.withColumn("u", unified(F.col("left_r"), F.col("right_r"), fields)).select("left_key", "right_key", "n", "u.result", "u.conflicts", "u.unknown")


def _state(readings: Column, fits: Column, open_: Column) -> Column:
    return F.when(F.exists(readings, fits), MATCH).when(F.exists(readings, open_), UNKNOWN).otherwise(CONFLICT)


def government_frames(docs: DataFrame, lexicon: DataFrame, governed: dict[str, tuple[str, ...]]) -> DataFrame:
    """(left_key, right_key, n, result): governing words (by key, with the cases they allow) and the nouns and pronouns right after
    them: match if some reading has an allowed case, unknown if some has none, else conflict."""
    allowed = docs.sparkSession.createDataFrame([(k, list(c)) for k, c in governed.items()], "left_key string, allowed array<string>")
    by = lexicon.filter(F.col("pos").isin("noun", "pronoun")).select(F.col("key").alias("right_key"), "case").distinct().groupBy("right_key").agg(F.collect_list(F.struct("case")).alias("r"))
    pairs = adjacent_pairs(docs).join(F.broadcast(allowed), "left_key").join(by, "right_key")
    fits = lambda x: F.coalesce(F.array_contains("allowed", x["case"]), F.lit(False))
    return pairs.select("left_key", "right_key", "n", _state(F.col("r"), fits, lambda x: x["case"].isNull()).alias("result"))


def numeral_frames(docs: DataFrame, lexicon: DataFrame, numerals: dict[str, str]) -> DataFrame:
    """(left_key, right_key, n, result): numerals (by key, with the number that they ask of a noun in the genitive) and the nouns right
    after them."""
    asked = docs.sparkSession.createDataFrame(list(numerals.items()), "left_key string, asked string")
    by = lexicon.filter(F.col("pos") == "noun").select(F.col("key").alias("right_key"), "case", "number").distinct().groupBy("right_key").agg(F.collect_list(F.struct("case", "number")).alias("r"))
    pairs = adjacent_pairs(docs).join(F.broadcast(asked), "left_key").join(by, "right_key")
    fits = lambda x: F.coalesce((x["case"] == "genitive") & (x["number"] == F.col("asked")), F.lit(False))
    lacks = lambda x: (x["case"].isNull() & F.coalesce(x["number"] == F.col("asked"), F.lit(True))) | (x["number"].isNull() & F.coalesce(x["case"] == "genitive", F.lit(True)))
    return pairs.select("left_key", "right_key", "n", _state(F.col("r"), fits, lacks).alias("result"))

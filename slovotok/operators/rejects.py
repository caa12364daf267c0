"""Rows that fail to parse: rejected with a reason, all others loaded.

Undecoded records are cut into cells with possessive regular expressions (no recursion, so very long fields are safe), the
cells are exploded into (row, column, value), joined to a small rule table, validated, and the errors are aggregated to
the first reason of each row. Column 0 of a row is its shape: the number of its cells, or `?` where its quoting is wrong, so
wrong quoting and wrong widths are errors of the rule table like wrong values. Clean rows are what an anti-join with the errors
leaves; rejects and clean rows come from one cutting, which is written once.

Defined results: a null, empty or white-space record is no record (neither error nor loaded); repeated records are judged
one by one; an unknown feed is no record; the other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.session import checkpoint

# The parts of speech and feature keys of the two dictionary formats.
OPENCORPORA_POS = "NOUN ADJF ADJS COMP VERB INFN PRTF PRTS GRND NUMR ADVB NPRO PRED PREP CONJ PRCL INTJ".split()
FEATURE_KEYS = "case number gender animacy aspect tense person adj_form degree verb_form mood voice".split()
DICTIONARY_COLUMNS = "form lemma pos grammemes lemma_id paradigm_id source_id stress".split()
PROJECT_COLUMNS = "form lemma pos features lemma_id paradigm_id source_id stress".split()
RLC_COLUMNS = "text_orig text_cor quote correction tag".split()

REASONS = ("quoting", "columns", "value")

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
CSV_RECORD = rf"^{_FIELD}(?:,{_FIELD})*+\z"
CSV_CELL = rf",({_FIELD})"


@dataclass(frozen=True)
class Feed:
    """A record format: its name, columns, the range of column counts, and whether it is quoted CSV or plain TSV."""

    name: str
    columns: tuple[str, ...]
    least: int
    most: int
    quoted: bool
    comment: str | None = None


FEEDS = (
    Feed("opencorpora.csv", tuple(DICTIONARY_COLUMNS), 8, 8, True),
    Feed("project.tsv", tuple(PROJECT_COLUMNS), 4, 8, False, "#"),
    Feed("rlc_test.csv", tuple(RLC_COLUMNS), 5, 5, True),
)

#: feed, column (from 1; 0 is the shape), regular expression that a good value matches, regular expression that no good value
#: matches, reason.
RULES = (
    *((f.name, 0, r"^[0-9]++\z", None, "quoting") for f in FEEDS if f.quoted),
    *((f.name, 0, rf"^(?:\?|{'|'.join(map(str, range(f.least, f.most + 1)))})\z", None, "columns") for f in FEEDS),
    ("opencorpora.csv", 3, rf"^(?:{'|'.join(OPENCORPORA_POS)})\z", None, "value"),
    ("opencorpora.csv", 4, r"^[A-Za-z0-9-]++(?:\|[A-Za-z0-9-]++)*+\z", None, "value"),
    ("project.tsv", 4, rf"^(?:{'|'.join(FEATURE_KEYS)})=[A-Za-z0-9_-]++(?:\|(?:{'|'.join(FEATURE_KEYS)})=[A-Za-z0-9_-]++)*+\z", None, "value"),
    ("rlc_test.csv", 1, r"\p{L}", r"\x{FFFD}|[\p{Cc}&&[^\n\r]]", "value"),
)


def rule_table(spark: SparkSession) -> DataFrame:
    """The validation rules as a table of fixed size; the rank of a reason says which comes first."""
    return spark.createDataFrame([(*r, REASONS.index(r[4])) for r in RULES], "feed string, col int, must string, never string, reason string, rank int")


def _per_feed(feeds: tuple[Feed, ...], value) -> Column:
    chain = None
    for f in feeds:
        chain = F.when(F.col("feed") == f.name, value(f)) if chain is None else chain.when(F.col("feed") == f.name, value(f))
    return chain


def parsed(raw: DataFrame, feeds: tuple[Feed, ...] = FEEDS, key: str = "line_id") -> DataFrame:
    """One row a record: key, feed and cells, of which the first is the record's shape."""
    text = F.col("raw")
    blank = ~text.rlike(r"(?U)\S")
    no_record = _per_feed(feeds, lambda f: F.coalesce(text.startswith(f.comment), F.lit(False)) if f.comment else F.lit(False))
    header = _per_feed(feeds, lambda f: F.regexp_replace(text, '"', "") == ("," if f.quoted else "\t").join(f.columns))
    rows = raw.select(F.col(key).alias("key"), "feed", "raw").filter(text.isNotNull() & ~blank & (no_record == F.lit(False)) & ~header)
    broken = _per_feed(feeds, lambda f: ~text.rlike(CSV_RECORD) if f.quoted else F.lit(False))
    quoted = F.transform(
        F.expr("regexp_extract_all(concat(',', raw), '" + CSV_CELL.replace("\\", "\\\\") + "', 1)"),
        lambda c: F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c),
    )
    cells = _per_feed(feeds, lambda f: quoted if f.quoted else F.split(text, "\t", -1))
    cut = rows.select("key", "feed", F.when(~broken, cells).alias("cells"))
    return cut.select("key", "feed", F.coalesce(F.concat(F.array(F.size("cells").cast("string")), "cells"), F.array(F.lit("?"))).alias("cells"))


def errors(rows: DataFrame) -> DataFrame:
    """(key, reason) of each bad record, the first that applies; `rows` come from parsed()."""
    rules = rule_table(rows.sparkSession)
    cells = rows.select("key", "feed", F.posexplode_outer("cells").alias("col", "value"))
    checked = cells.join(F.broadcast(rules), ["feed", "col"])
    bad = checked.filter(~F.expr("value rlike must") | F.coalesce(F.expr("value rlike never"), F.lit(False)))
    return bad.groupBy("key").agg(F.min_by("reason", "rank").alias("reason"))


def rejects(raw: DataFrame, key: str = "line_id") -> DataFrame:
    """Bad records as (key, reason)."""
    return errors(parsed(raw, key=key)).withColumnRenamed("key", key)


def separated(raw: DataFrame, key: str = "line_id", feeds: tuple[Feed, ...] = FEEDS) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Bad records as (key, reason), and by feed the good ones as a table of the feed's columns; empty and missing trailing values
    are null. Records are cut once."""
    rows = checkpoint(parsed(raw, feeds, key))
    bad = errors(rows)
    good = rows.join(bad.select("key"), "key", "left_anti")
    cell = lambda i: F.nullif(F.try_element_at("cells", F.lit(i + 2)), F.lit(""))
    tables = {f.name: good.filter(F.col("feed") == f.name).select(F.col("key").alias(key), *[cell(i).alias(c) for i, c in enumerate(f.columns)]) for f in feeds}
    return bad.withColumnRenamed("key", key), tables


def loaded(raw: DataFrame, feed: Feed, key: str = "line_id") -> DataFrame:
    """The good records of one feed."""
    return separated(raw.filter(F.col("feed") == feed.name), key)[1][feed.name]

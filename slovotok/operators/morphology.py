"""Dictionary analysis of words: readings of tokens, forms of a lemma, and the detectors that need a dictionary.

Each distinct surface is analysed once and joined back, so the work follows the vocabulary, not the text. Readings are
grouped by lookup key once; repeated dictionary rows are dropped first, so a group holds the readings of one word only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.functions.text import is_number, is_word, lookup_key, token_rows
from slovotok.operators.sentences import WORD
from slovotok.plans.rules import Rule
from slovotok.session import checkpoint, small_enough

READING = ("form", "lemma", "pos", "case", "number", "gender", "animacy", "aspect", "tense", "person", "adjective_form", "degree", "verb_form", "mood", "voice", "lemma_id", "paradigm_id", "source_id", "stress")

# Verbs that are always written with не-.
LEXICAL_NE = "ненавидеть ненавижу ненавидишь негодовать нездоровиться несдобровать недоумевать неистовствовать".split()
_NE = regex.compile(r"(?<!\p{Alphabetic})[нН][еЕ][\p{Alphabetic}\-‑–']{2}")
VERBAL = ("verb", "gerund", "participle")


def by_key(lexicon: DataFrame) -> DataFrame:
    """(key, readings): the distinct readings of each lookup key, sorted."""
    rows = lexicon.select("key", *READING).dropDuplicates()
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*READING))).alias("readings"))


def readings_of(surface: Column, readings: Column) -> Column:
    """The readings of a surface: where it is written with ё and readings are too, only those; none for an unknown word."""
    lower = F.lower(surface)
    exact = F.filter(readings, lambda r: r["form"] == lower)
    chosen = F.when(lower.contains("ё") & (F.size(exact) > 0), exact).otherwise(readings)
    return F.coalesce(chosen, F.array().cast(f"array<struct<{','.join(f + ':string' for f in READING)}>>"))


def analyze(words: DataFrame, lexicon: DataFrame, column: str = "word") -> DataFrame:
    """words with an array column `readings`; each distinct surface is looked up once."""
    distinct = words.select(F.col(column).alias("_surface")).distinct()
    found = distinct.join(by_key(lexicon), lookup_key(F.col("_surface")) == F.col("key"), "left")
    memo = found.select("_surface", readings_of(F.col("_surface"), F.col("readings")).alias("readings"))
    return words.join(memo, words[column] == memo["_surface"], "left").drop("_surface")


def token_readings(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, idx, word, s, readings) of every word and number of the documents."""
    rows = token_rows(documents.filter("text <> ''"), ["doc_id"]).filter(is_word(F.col("t")) | is_number(F.col("t")))
    return analyze(rows.select("doc_id", "idx", F.col("t").alias("word"), "s"), lexicon)


def ambiguity(readings: Column) -> Column:
    """unknown, certain, ambiguous_form (one part of speech) or ambiguous_pos."""
    n = F.size(readings)
    parts = F.size(F.array_distinct(F.transform(readings, lambda r: r["pos"])))
    return F.when(n == 0, "unknown").when(n == 1, "certain").when(parts == 1, "ambiguous_form").otherwise("ambiguous_pos")


def forms_of_lemmas(lemmas: DataFrame, lexicon: DataFrame, column: str = "lemma") -> DataFrame:
    """The distinct analyses of each lemma."""
    rows = lexicon.select(*READING).dropDuplicates()
    return rows.join(lemmas.select(F.col(column).alias("lemma")).distinct(), "lemma", "left_semi")


def requested_keys(documents: DataFrame) -> DataFrame:
    """The distinct lookup keys of the documents' words and numbers, and of what follows не- in them."""
    rows = token_rows(documents.filter("text <> ''"), ["doc_id"]).filter(is_word(F.col("t")) | is_number(F.col("t")))
    keys = rows.select(F.explode(F.array(lookup_key(F.col("t")), F.when(F.lower("t").startswith("не"), lookup_key(F.substring("t", 3, 1 << 30))))).alias("key"))
    return keys.filter("key <> ''").distinct()


def _negated(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Words of four letters at least that begin with не: each once a batch, or each with its place and text."""
    for batch in batches:
        rows = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if _NE.search(text):
                rows += [(i, m.group(), *m.span()) for m in WORD.finditer(text) if m.lastindex and m.end() - m.start() > 3 and m.group()[:2].lower() == "не"]
        if not whole:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({r[1] for r in rows}), pa.string())], names=["t"])
            continue
        at = pa.array([r[0] for r in rows], pa.int64())
        made = [pa.array([r[c] for r in rows], k) for c, k in ((1, pa.string()), (2, pa.int32()), (3, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text").take(at), *made], names=["doc_id", "text", "t", "s", "e"])


def negated_verbs(documents: DataFrame, lexicon: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text, rule_id, s, e, replacement): verbs written together with не that no dictionary knows in one piece. Each distinct
    word is looked up once."""
    docs, kind = documents.filter(F.lower("text").contains("не")), documents.schema["doc_id"].dataType.simpleString()
    words = docs.select("text").mapInArrow(lambda batches: _negated(batches, False), "t string").distinct().filter(~F.lower("t").isin(LEXICAL_NE))
    whole = lexicon.filter(F.col("pos").isin(*VERBAL)).select("key").distinct()
    base = whole.select(F.col("key").alias("base_key"))
    split = checkpoint(words.join(whole, lookup_key(F.col("t")) == whole["key"], "left_anti").join(base, lookup_key(F.substring("t", 3, 1 << 30)) == base["base_key"], "left_semi"))
    rows = docs.select("doc_id", "text").mapInArrow(lambda batches: _negated(batches, True), f"doc_id {kind}, text string, t string, s int, e int")
    found = rows.join(F.broadcast(split) if small_enough(split, "t") else split, "t")
    rest = F.substring(F.lower("t"), 3, 1 << 30)
    cased = F.when(F.substring("t", 3, 1).rlike(r"^\p{IsUppercase}"), F.concat(F.upper(F.left(rest, F.lit(1))), F.substring(rest, 2, 1 << 30))).otherwise(rest)
    return found.select("doc_id", "text", F.lit(rule.rule_id).alias("rule_id"), "s", "e", F.concat(F.lit("не "), cased).alias("replacement"))

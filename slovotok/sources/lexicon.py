"""Dictionaries in several formats as one lexicon table: form, lemma, pos, categories, tags, ids, source and stress.

Readers take lines or rows as DataFrames, so text files, archives and tables serve alike. Rows that a strict reader would
refuse are dropped by default; `rejected` gives them, and `strict` makes them an error. The lexicon is stored as Parquet, clustered by lookup key, so that
look-ups of some forms skip most row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.functions.morphology import features, first_part_of_speech, part_of_speech, project_tags, split_tags
from slovotok.functions.text import lookup_key

HEADERS = ("form", "word", "surface")


def _empty(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def lexicon_rows(rows: DataFrame, source: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The lexicon of rows(form, lemma, pos, tags, lemma_id, paradigm_id, source_id, stress)."""
    made = features(F.col("tags"))
    return rows.filter((F.col("form") != "") & (F.col("lemma") != "")).select(
        *(carry or []), lookup_key(F.col("form")).alias("key"), F.lower("form").alias("form"), "lemma", "pos", *[c.alias(n) for n, c in made.items()],
        "lemma_id", "paradigm_id", F.coalesce("source_id", F.lit(source)).alias("source_id"), "stress",
    )


#: Columns that a line of each format has at least.
LEAST = {"project": 4, "opencorpora": 4, "pymorphy": 3}


def _split(line: Column, sep: str | None) -> Column:
    """The cells of a line; without a separator by tabs if the line has one, else by commas outside quotes."""
    if sep is not None:
        return F.split(line, sep, -1)
    quoted = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(',((?:"[^"]*+(?:""[^"]*+)*+"|[^,]*+))'), F.lit(1))
    bare = F.transform(quoted, lambda c: F.when(c.rlike('^".*"$'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(line.contains("\t"), F.split(line, "\t", -1)).otherwise(bare)


def _cells(lines: DataFrame, sep: str | None, least: int = 1, strict: bool = False) -> DataFrame:
    line = F.col("value")
    kept = lines.filter(F.trim(line) != "").filter(~F.trim(line).startswith("#"))
    cells = F.transform(_split(line, sep), lambda c: F.trim(c))
    made = kept.select(cells.alias("c"), "value").filter(~F.lower(F.element_at("c", 1)).isin(*HEADERS))
    short = F.size("c") < least
    error = F.raise_error(F.concat(F.lit("too few columns: "), "value")).cast("boolean")
    return made.filter(F.when(short, error).otherwise(F.lit(True)) if strict else ~short).select("c")


def rejected(lines: DataFrame, kind: str) -> DataFrame:
    """(value, n_columns): the lines of a dictionary of some format (a key of LEAST) that have too few columns."""
    sep = None if kind == "opencorpora" else "\t"
    rows = lines.filter((F.trim("value") != "") & ~F.trim("value").startswith("#")).select("value", _split(F.col("value"), sep).alias("c"))
    rows = rows.filter(~F.lower(F.trim(F.element_at("c", 1))).isin(*HEADERS))
    return rows.filter(F.size("c") < LEAST[kind]).select("value", F.size("c").alias("n_columns"))


def _at(i: int) -> Column:
    return _empty(F.try_element_at("c", F.lit(i)))


def read_project(lines: DataFrame, source: str = "project", strict: bool = False) -> DataFrame:
    """Tab-separated form, lemma, pos, features and up to four more; lines of fewer than four columns are dropped, or an error."""
    rows = _cells(lines, "\t", LEAST["project"], strict)
    return lexicon_rows(rows.select(_at(1).alias("form"), _at(2).alias("lemma"), part_of_speech(_at(3)).alias("pos"), project_tags(_at(4)).alias("tags"), _at(5).alias("lemma_id"), _at(6).alias("paradigm_id"), _at(7).alias("source_id"), _at(8).alias("stress")), source)


def read_opencorpora_csv(lines: DataFrame, source: str = "opencorpora", strict: bool = False) -> DataFrame:
    """form, lemma, pos, grammemes and up to four more, by tabs if a line has one, else by commas outside quotes."""
    rows = _cells(lines, None, LEAST["opencorpora"], strict)
    tags = F.concat(F.array(_at(3)), split_tags(_at(4)))
    return lexicon_rows(rows.select(_at(1).alias("form"), _at(2).alias("lemma"), part_of_speech(_at(3)).alias("pos"), tags.alias("tags"), _at(5).alias("lemma_id"), _at(6).alias("paradigm_id"), _at(7).alias("source_id"), _at(8).alias("stress")), source)


def read_pymorphy(lines: DataFrame, source: str = "pymorphy", strict: bool = False) -> DataFrame:
    """word, normal form, tag and up to four more; the part of speech is the first one among the tags."""
    rows = _cells(lines, "\t", LEAST["pymorphy"], strict)
    tags = split_tags(_at(3))
    return lexicon_rows(rows.select(_at(1).alias("form"), _at(2).alias("lemma"), first_part_of_speech(tags).alias("pos"), tags.alias("tags"), _at(4).alias("lemma_id"), _at(5).alias("paradigm_id"), _at(6).alias("source_id"), _at(7).alias("stress")), source)


def read_opencorpora_xml(spark: SparkSession, path: str, source: str = "opencorpora") -> DataFrame:
    """Lemma elements of the XML dictionary: the lemma's tags come before the form's."""
    tag = "array<struct<_v:string>>"
    schema = f"_id string, l struct<_t:string, g:{tag}>, f array<struct<_t:string, g:{tag}>>"
    lemmas = spark.read.format("xml").option("rowTag", "lemma").schema(schema).load(path)
    forms = lemmas.select("_id", "l", F.explode("f").alias("f"))
    tags = F.concat(F.coalesce(F.col("l.g._v"), F.array()), F.coalesce(F.col("f.g._v"), F.array()))
    rows = forms.select(
        F.col("f._t").alias("form"), F.coalesce("l._t", "f._t").alias("lemma"), first_part_of_speech(tags).alias("pos"), tags.alias("tags"),
        F.concat(F.lit("opencorpora:"), "_id").alias("lemma_id"), F.concat(F.lit("opencorpora:paradigm:"), "_id").alias("paradigm_id"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("stress"),
    )
    return lexicon_rows(rows, source)


def from_table(rows: DataFrame, tags: str, carry: list[str] | None = None, plain: bool = False) -> DataFrame:
    """The lexicon of a table with the eight dictionary columns; `tags` names the column of packed tags."""
    packed = split_tags(F.col(tags)) if plain else project_tags(F.col(tags))
    given = [F.col(c) for c in (carry or [])]
    return lexicon_rows(
        rows.select(*given, _empty(F.col("form")).alias("form"), _empty(F.col("lemma")).alias("lemma"), part_of_speech(F.col("pos")).alias("pos"), packed.alias("tags"), *[_empty(F.col(c)).alias(c) for c in ("lemma_id", "paradigm_id", "source_id", "stress")]),
        None, carry,
    )


def read_stress(lines: DataFrame, source: str = "stress") -> DataFrame:
    """form and stress, or form, lemma_id, paradigm_id, source_id and stress; rows without a stress are dropped."""
    rows = _cells(lines, "\t").filter((F.size("c") == 2) | (F.size("c") >= 5))
    long = F.size("c") >= 5
    pick = lambda i: F.when(long, _at(i))
    made = rows.select(F.lower(_at(1)).alias("form"), pick(2).alias("lemma_id"), pick(3).alias("paradigm_id"), F.coalesce(pick(4), F.lit(source)).alias("source_id"), F.when(long, _at(5)).otherwise(_at(2)).alias("stress"))
    return made.filter(F.col("stress").isNotNull())


def attach_stress(lexicon: DataFrame, records: DataFrame) -> DataFrame:
    """The lexicon with the stresses of matching records: same form, and same lemma and paradigm where the record names them.
    Of several matching records the one with the largest stress counts."""
    r = records.select(F.col("form").alias("r_form"), F.col("lemma_id").alias("r_lemma"), F.col("paradigm_id").alias("r_paradigm"), F.col("source_id").alias("r_source"), F.col("stress").alias("r_stress")).distinct()
    numbered = lexicon.withColumn("r_id", F.monotonically_increasing_id())
    fits = (F.col("form") == F.col("r_form")) & (F.col("r_lemma").isNull() | (F.col("r_lemma") == F.col("lemma_id"))) & (F.col("r_paradigm").isNull() | (F.col("r_paradigm") == F.col("paradigm_id")))
    best = numbered.join(r, fits).groupBy("r_id").agg(F.max(F.struct("r_stress", "r_source")).alias("r"))
    joined = numbered.join(best, "r_id", "left")
    return joined.withColumn("stress", F.coalesce("r.r_stress", "stress")).withColumn("source_id", F.coalesce("source_id", "r.r_source")).drop("r_id", "r")


def seed_lexicon(spark: SparkSession) -> DataFrame:
    """Prepositions and numerals as a lexicon: what agreement needs and dictionaries of other words may lack."""
    from slovotok.functions.morphology import preposition_cases
    from slovotok.operators.agreement import NUMERALS

    rows = [(w, w, "PREP", "") for w in preposition_cases()]
    rows += [(w, w, "NUMR", f"num_class={c}|{case}") for c, ws in NUMERALS.items() for w in ws if c != "one" for case in ("nom", "acc")]
    lines = spark.createDataFrame([("\t".join(r) + "\t" * 4,) for r in rows], "value string")
    return read_project(lines, "seed")


#: A small dictionary for examples: form, lemma, part of speech, features of each reading.
DEMO = """книга книга NOUN femn|sing|nom; книги книга NOUN femn|sing|gen; книги книга NOUN femn|plur|nom; книге книга NOUN femn|sing|dat; книгу книга NOUN femn|sing|acc; книг книга NOUN femn|plur|gen;
новая новый ADJF femn|sing|nom; новый новый ADJF masc|sing|nom; новой новый ADJF femn|sing|gen; новых новый ADJF plur|gen; красивая красивый ADJF femn|sing|nom;
упал упасть VERB past|sing|masc; упала упасть VERB past|sing|femn; читаю читать VERB pres|sing|1per; пять пять NUMR nom|num_class=many; двадцать двадцать NUMR nom|num_class=many; сто сто NUMR nom|num_class=many;
без без PREP -"""


def demo_lexicon(spark: SparkSession) -> DataFrame:
    """The words of the rules' examples."""
    rows = [x.split() for x in DEMO.split(";")]
    return read_project(spark.createDataFrame([("\t".join([f, lemma, pos, "" if tags == "-" else tags]),) for f, lemma, pos, tags in rows], "value string"), "demo")


def demo_government(spark: SparkSession) -> DataFrame:
    """The verb of the rules' examples with the case of its object, as agreement.government() gives them."""
    return spark.createDataFrame([("читать", ["accusative"], [])], "verb string, direct array<string>, through array<struct<preposition:string,case:string>>")


def write_lexicon(lexicon: DataFrame, path: str, files: int = 8) -> None:
    """Stores a lexicon clustered by key: each file holds a range of keys, so their statistics answer most look-ups."""
    lexicon.repartitionByRange(files, "key").sortWithinPartitions("key", "form", "lemma").write.mode("overwrite").parquet(path)


def read_lexicon(spark: SparkSession, path: str, forms: list[str] | DataFrame | None = None) -> DataFrame:
    """A stored lexicon; with `forms` only their keys: a short list is pushed into the scan, a table of forms is a semi-join."""
    lexicon = spark.read.parquet(path)
    if forms is None:
        return lexicon
    if isinstance(forms, list):
        return lexicon.filter(F.col("key").isin(sorted({f.lower().replace("ё", "е") for f in forms})))
    keys = forms.select(lookup_key(F.col("form")).alias("key")).distinct()
    return lexicon.join(keys, "key", "left_semi")

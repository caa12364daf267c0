"""Agreement and government in chains of words: modifier and noun, subject and predicate, preposition, numeral and verb with
their nominal groups.

Each distinct word is looked up once; its tags go to the texts, where a fold looks at each word and those that follow with
nothing but space of one line between. All comparisons are three-valued: a conflict is reported only if no reading could
agree and every reading says what is compared. Contextual disambiguation comes first; words that keep readings in other roles
are never reported. A clause candidate adds a pair that may stand apart: the first word of an island that may be a predicate and
the nearest word before it that may be a subject, if each has one reading left and the island is no zone.

Defined results: null texts and unknown words give nothing; repeated documents give their own rows, and need distinct ids only
where the vocabulary is too large to be sent and words are ordered by id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slovotok.functions.text import is_space, is_word, lookup_key, match_case, token_rows
from slovotok.operators.conflicts import CONFLICT, FIELD, ITEM, PART, READING, cut_rows, distinct_words, in_texts, in_words
from slovotok.operators.disambiguation import TAGS, eliminations, tagged
from slovotok.operators.morphology import negated_verbs
from slovotok.operators.unpack import unpack
from slovotok.plans.rules import Rule
from slovotok.session import BROADCAST_BYTES, checkpoint, small_enough

# The numerals of each class.
NUMERALS = {"one": ["один", "одна", "одно"], "paucal": ["два", "две", "три", "четыре"], "many": ["пять", "шесть", "семь", "восемь", "девять", "десять"]}
_LEXICON = ("form", "lemma", "pos", "case", "number", "gender", "tense", "person", "adjective_form", "degree", "verb_form")


def lexicon_by_key(lexicon: DataFrame) -> DataFrame:
    """(key, readings): distinct readings with the fields that agreement looks at, the numeral class among them."""
    tags = F.transform("raw_tags", lambda t: F.lower(t))
    given = F.coalesce(*[F.when(F.array_contains(tags, f"num_class={c}"), F.lit(c)) for c in ("ordinal", "collective", "one", "paucal", "many")])
    known = F.coalesce(*[F.when(F.lower("lemma").isin(w), F.lit(c)) for c, w in NUMERALS.items()])
    named = F.coalesce(*[F.when(F.array_contains("grammemes", c), F.lit(c)) for c in ("ordinal", "collective")])
    rows = lexicon.select("key", *_LEXICON, F.coalesce(named, given, known).alias("num_class")).dropDuplicates()
    return rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(*_LEXICON, "num_class"))).alias("readings"))


# Short names of cases.
_CASES = {"nom": "nominative", "gen": "genitive", "dat": "dative", "acc": "accusative", "ins": "instrumental", "prep": "prepositional", "loc": "locative", "part": "partitive"}


def government(table: DataFrame, key: str = "row_no") -> DataFrame:
    """(verb, direct, through): for each lemma of a government table the cases of its direct object, and of its objects by
    preposition. The packed cases are unpacked first; a case named with an addition counts as the case."""
    named = F.coalesce(*[F.when(F.col("val").rlike(rf"^{a}\b"), F.lit(c)) for a, c in _CASES.items()])
    cases = unpack(table, key, "cases").select(key, named.alias("case")).filter("case is not null")
    rows = table.select(key, F.lower(F.trim("lemma")).alias("verb"), "complement_kind", F.lower(F.trim(F.coalesce("preposition", F.lit("")))).alias("preposition")).join(cases, key)
    direct = F.array_sort(F.collect_set(F.when(F.col("complement_kind") == "direct_object", F.col("case"))))
    pairs = F.array_sort(F.collect_set(F.when((F.col("complement_kind") == "prepositional_object") & (F.col("preposition") != ""), F.struct("preposition", "case"))))
    return rows.filter("verb <> ''").groupBy("verb").agg(direct.alias("direct"), pairs.alias("through"))


def _surfaces(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, r) of the words that the lexicon knows."""
    return checkpoint(words.select("word").distinct().join(lexicon_by_key(lexicon), lookup_key(F.col("word")) == F.col("key")).select("word", readings_of_fields(F.col("word"), F.col("readings")).alias("r")))


def known_surfaces(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, r), the readings of each surface of documents that is known."""
    return _surfaces(documents.filter("text <> ''").select("text").mapInArrow(distinct_words, "word string"), lexicon)


def word_readings(documents: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, idx, word, s, e, linked) of the words of documents, and (word, r), the readings of each surface that is known; linked
    tells whether a word follows with nothing but space of one line between. Each distinct surface is looked up once."""
    rows = token_rows(documents.filter("text <> ''").select("doc_id", "text"), ["doc_id", "text"], 0, 2).filter(is_word(F.col("t")))
    linked = is_space(F.col("n1")) & ~F.coalesce(F.col("n1").contains("\n"), F.lit(False)) & is_word(F.col("n2"))
    words = rows.select("doc_id", "idx", F.col("t").alias("word"), "s", "e", linked.alias("linked"))
    surfaces = _surfaces(words, lexicon)
    return words, surfaces


def _light(df: DataFrame, column: str) -> bool:
    """Whether df may be broadcast."""
    return small_enough(df.select(F.col(column).alias("j")), "j", 4 << 20)


def ruled_out(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, idx, word, lemma, pos, case, constraint, evidence) of every reading that the context rules out."""
    words, surfaces = word_readings(documents, lexicon)
    tags = tagged(surfaces)
    found = eliminations(words, tags, _light(tags, "tags"))
    reading = F.element_at("r", F.col("at") + 1)
    return found.join(surfaces, "word").select("doc_id", "idx", "word", reading["lemma"].alias("lemma"), reading["pos"].alias("pos"), reading["case"].alias("case"), "constraint", "evidence")


def readings_of_fields(surface: Column, readings: Column) -> Column:
    """readings_of() for readings with fewer fields."""
    lower = F.lower(surface)
    exact = F.filter(readings, lambda r: r["form"] == lower)
    return F.when(lower.contains("ё") & (F.size(exact) > 0), exact).otherwise(readings)


KINDS = (
    "adj_noun_agreement_demo", "nominal_group_modifier_agreement_basic", "subject_predicate_agreement_basic", "preposition_government_basic", "preposition_nominal_group_government_basic", "numeral_noun_agreement_basic",
    "numeral_nominal_group_agreement_basic", "compound_numeral_nominal_group_agreement_basic", "typed_compound_numeral_nominal_group_agreement_basic", "verb_government_basic", "coordination_comma_basic",
)


def _tags(surfaces: DataFrame, verbs: DataFrame | None) -> DataFrame:
    """(word, tags): the readings of surfaces(word, r) as a text of conflicts.FIELDS, in their order."""
    lemmas = F.array_sort(F.array_distinct(F.array_compact(F.transform("r", lambda r: r["lemma"]))))
    frames = F.lit(None).cast("map<string,string>")
    if verbs is not None:
        pair = F.array_join(F.transform("through", lambda x: F.concat(x["preposition"], F.lit(" "), x["case"])), ITEM)
        frame = verbs.select(F.col("verb").alias("v"), F.concat(F.array_join("direct", ITEM), F.lit(PART), pair).alias("frame"))
        held = surfaces.select("word", F.explode(F.array_distinct(F.transform(F.filter("r", lambda r: r["pos"] == "verb"), lambda r: F.lower(r["lemma"])))).alias("v")).join(frame, "v")
        surfaces = surfaces.join(held.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("v", "frame"))).alias("frames")), "word", "left")
        frames = F.col("frames")
    made = surfaces.select("word", "r", lemmas.alias("lemmas"), frames.alias("frames"))

    def one(r: Column) -> Column:
        place = F.when(r["lemma"].isNotNull(), (F.array_position("lemmas", r["lemma"]) - 1).cast("string"))
        fields = [*[r[f] for f in TAGS], r["num_class"], place, F.when(r["pos"] == "verb", F.try_element_at("frames", F.lower(r["lemma"])))]
        return F.concat_ws(FIELD, *[F.coalesce(x, F.lit("")) for x in fields])

    return made.select("word", F.array_join(F.transform("r", one), READING).alias("tags"))


def _found(documents: DataFrame, surfaces: DataFrame, verbs: DataFrame | None, commas: bool, bytes_most: int) -> DataFrame:
    """(doc_id, and the columns of CONFLICT) of each conflict once. A vocabulary that is small goes to where the texts are; otherwise words
    are joined to it and sorted."""
    tags = checkpoint(_tags(surfaces, verbs))
    texts = documents.filter("text <> ''").select("doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    if small_enough(tags.select(F.concat("word", "tags").alias("j")), "j", bytes_most):
        known = documents.sparkSession.sparkContext.broadcast({r["word"]: r["tags"] for r in tags.collect()})
        return texts.mapInArrow(lambda batches: in_texts(known.value, commas)(batches), f"doc_id {kind}, {CONFLICT}")
    words = texts.mapInArrow(cut_rows, f"doc_id {kind}, idx int, word string, s int, e int, linked boolean, island int")
    rows = words.join(tags, "word", "left").select("doc_id", "idx", "word", "s", "e", "linked", "island", "tags").repartition("doc_id").sortWithinPartitions("doc_id", "idx")
    return rows.mapInArrow(in_words(commas), f"doc_id {kind}, {CONFLICT}")


def conflicts(documents: DataFrame, lexicon: DataFrame, verbs: DataFrame | None = None, commas: bool = False, bytes_most: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, kind, s, e, ws, we, form): each conflict once, with the only form of the dictionary that would mend the word from ws
    to we, if there is just one of the same lemma. With commas also the gaps between modifiers where one may be missing."""
    surfaces = known_surfaces(documents, lexicon)
    # Few rows, but of a fold over all texts; they are asked twice.
    found = checkpoint(_found(documents, surfaces, verbs, commas, bytes_most)).withColumn("wanted", F.to_json(F.struct("word", "lemma_at", "cases", "numbers", "genders")))
    lemma = F.get(F.array_sort(F.array_distinct(F.array_compact(F.transform("r", lambda r: r["lemma"])))), F.col("lemma_at"))
    # Forms are looked for once for each word and what is wanted of it.
    asked = found.filter("lemma_at is not null").select("wanted", "word", "lemma_at", "cases", "numbers", "genders").dropDuplicates(["wanted"])
    first = asked.join(surfaces, "word").select("wanted", "word", lemma.alias("lemma"), "cases", "numbers", "genders")
    forms = lexicon.select("lemma", "form", "case", "number", "gender").distinct()
    fits = (first["lemma"] == forms["lemma"]) & (F.lower(first["word"]) != forms["form"])
    within = lambda field, held: F.coalesce(F.array_contains(held, field), F.lit(True)) | (F.size(held) == 0) | field.isNull()
    plural = F.coalesce(forms["number"] == "plural", F.lit(False))
    strict = F.coalesce(F.array_contains(first["cases"], forms["case"]), first["cases"].isNull())
    fits = fits & strict & within(forms["number"], first["numbers"]) & (plural | within(forms["gender"], first["genders"]))
    mended = first.join(forms, fits).groupBy("wanted", "word").agg(F.collect_set("form").alias("forms")).filter(F.size("forms") == 1)
    only = mended.select("wanted", match_case(F.col("word"), F.element_at("forms", 1)).alias("form"))
    return found.join(only, "wanted", "left").select("doc_id", "kind", "s", "e", "ws", "we", "form")


def in_the_open() -> Column:
    """Whether a place (text, s) lies outside quotes and brackets."""
    before = F.left("text", F.col("s"))
    count = lambda c: F.length(before) - F.length(F.translate(before, c, ""))
    return (count("«") <= count("»")) & (count("(") <= count(")"))


def issues(documents: DataFrame, lexicon: DataFrame, rules: list[Rule], verbs: DataFrame | None = None) -> DataFrame:
    """(doc_id, text, rule_id, s, e, replacement) for the rules of KINDS; the replacement is the span with the mended word."""
    by = documents.sparkSession.createDataFrame([(r.kind, r.rule_id) for r in rules], "kind string, rule_id string")
    found = conflicts(documents, lexicon, verbs, any(r.kind == "coordination_comma_basic" for r in rules)).join(F.broadcast(by), "kind")
    # Only here is the text needed, and only of documents with conflicts; without them it would travel with every word.
    joined = found.join(documents.select("doc_id", "text"), "doc_id")
    joined = joined.filter((F.col("kind") != "coordination_comma_basic") | in_the_open())
    t = F.col("text")
    whole = F.concat(t.substr(F.col("s") + 1, F.col("ws") - F.col("s")), F.col("form"), t.substr(F.col("we") + 1, F.col("e") - F.col("we")))
    mended = F.when(F.col("kind") == "coordination_comma_basic", F.lit(", ")).when(F.col("form").isNotNull(), whole)
    return joined.select("doc_id", "text", "rule_id", "s", "e", mended.alias("replacement"))


def with_lexicon(lexicon: DataFrame, verbs: DataFrame | None = None) -> dict[str, Callable[[DataFrame, list[Rule]], DataFrame]]:
    """What check() takes as `extra` to run the rules that need a dictionary."""

    def made(documents: DataFrame, rules: list[Rule]) -> DataFrame:
        parts = [negated_verbs(documents, lexicon, r) for r in rules if r.kind == "negated_verb_spacing_basic"]
        grammar = [r for r in rules if r.kind in KINDS]
        parts += [issues(documents, lexicon, grammar, verbs)] if grammar else []
        return reduce(DataFrame.unionByName, parts)

    return {"lexicon": made}

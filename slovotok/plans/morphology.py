"""Queries of dictionaries and dictionary analysis, over the whole dictionary, sentence and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.functions.morphology import CATEGORIES, pos_tags, preposition_cases, tag_meanings
from slovotok.operators import morphology
from slovotok.plans import query
from slovotok.plans.rules import RULES
from slovotok.plans.surface import _TOK
from slovotok.sources.lexicon import from_table
from slovotok.session import table

_POS = "pos_(tag, pos) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in pos_tags().items()) + ")"
_TAGS = "tag_(tag, meaning) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in tag_meanings().items()) + ")"
_NORMAL = "replace(lower(trim({0})), '-', '_')"


def _category(c: str) -> str:
    return f"arg_max(split_part(meaning, '=', 2), i) filter (where starts_with(meaning, '{c}=')) as \"{c}\""


def _features_sql(name: str, field: str) -> str:
    return f"""with {_POS}, {_TAGS}, d as (select row_no, form, lemma, pos, list_filter([trim(x) for x in string_split(coalesce({field}, ''), '|')], lambda x: x <> '') as tags from {name} where trim(coalesce(form, '')) <> '' and trim(coalesce(lemma, '')) <> ''),
    u as (select row_no, i, tags[i] as raw from d, lateral (select unnest(range(1, len(tags) + 1)) as i)),
    m as (select u.*, meaning from u left join tag_ on tag_.tag = {_NORMAL.format('raw')}),
    f as (select row_no, {', '.join(_category(c) for c in CATEGORIES)}, count(*) filter (where meaning is null) as n_unrecognized from m group by row_no)
    select d.row_no, replace(lower(trim(form)), 'ё', 'е') as key, coalesce(p.pos, 'other') as pos, {', '.join(f'f."{c}"' for c in CATEGORIES)}, coalesce(n_unrecognized, 0)::int as n_unrecognized
    from d left join f using (row_no) left join pos_ p on p.tag = {_NORMAL.format('d.pos')}"""


def _features(name: str, field: str):
    @query(f"lexicon_features_{name}", _features_sql(name, field))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = from_table(table(spark, sf_dir, name), field, ["row_no"]).select("row_no", "key", "pos", *CATEGORIES)
        return rows.join(_unrecognized(spark, sf_dir, name, field), "row_no")

    return run


def _unrecognized(spark: SparkSession, sf_dir: str, name: str, field: str) -> DataFrame:
    from slovotok.functions.morphology import _literal_map, normalize_tag, project_tags

    missing = F.filter(project_tags(F.col(field)), lambda t: F.try_element_at(_literal_map(tag_meanings()), normalize_tag(t)).isNull())
    return table(spark, sf_dir, name).select("row_no", F.size(missing).alias("n_unrecognized"))


_features("opencorpora", "grammemes")
_features("project", "features")

_LEXICON = f"""lex as (select distinct replace(lower(trim(form)), 'ё', 'е') as key, lower(trim(form)) as form, trim(lemma) as lemma, coalesce(p.pos, 'other') as pos, trim(grammemes) as g, nullif(trim(lemma_id), '') as lemma_id, nullif(trim(paradigm_id), '') as paradigm_id, nullif(trim(source_id), '') as source_id, nullif(trim(stress), '') as stress
  from opencorpora o left join pos_ p on p.tag = {_NORMAL.format('o.pos')} where trim(coalesce(form, '')) <> '' and trim(coalesce(lemma, '')) <> '')"""


@query(
    "analyze_words",
    f"""with {_POS}, src as (select id as doc_id, text from sentences where text is not null and text <> ''){_TOK}, {_LEXICON},
    keys as (select distinct key, pos, form from lex), w as (select t, count(*) as n from tok where k = 'word' group by t),
    r as (select t, n, pos, form, bool_or(form = lower(t)) over (partition by t) as exact from w left join keys on replace(lower(t), 'ё', 'е') = key)
    select t as word, n as n_tokens, count(distinct pos) filter (where not (contains(lower(t), 'ё') and exact) or form = lower(t)) as n_pos from r group by t, n""",
)
def analyze_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct word of the learner sentences with its tokens and the number of parts of speech it may be."""
    lexicon = from_table(table(spark, sf_dir, "opencorpora"), "grammemes")
    rows = table(spark, sf_dir, "sentences").select(F.col("id").alias("doc_id"), "text")
    from slovotok.functions.text import is_word, token_rows

    words = token_rows(rows.filter("text <> ''"), ["doc_id"]).filter(is_word(F.col("t"))).groupBy(F.col("t").alias("word")).agg(F.count("*").alias("n_tokens"))
    found = morphology.analyze(words, lexicon)
    return found.select("word", "n_tokens", F.size(F.array_distinct(F.transform("readings", lambda r: r["pos"]))).cast("bigint").alias("n_pos"))


@query("token_ambiguity")
def token_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the documents by how ambiguous they are."""
    lexicon = from_table(table(spark, sf_dir, "opencorpora"), "grammemes")
    rows = morphology.token_readings(table(spark, sf_dir, "documents"), lexicon)
    return rows.groupBy(morphology.ambiguity(F.col("readings")).alias("class")).agg(F.count("*").alias("n_tokens"))


@query(
    "requested_keys",
    f"""with src as (select id as doc_id, text from sentences where text is not null and text <> ''){_TOK}, w as (select distinct lower(t) as t from tok where k in ('word', 'number'))
    select distinct replace(x, 'ё', 'е') as key from (select t as x from w union all select t[3:] from w where starts_with(t, 'не')) where x <> ''""",
)
def requested_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary keys that the learner sentences ask for."""
    return morphology.requested_keys(table(spark, sf_dir, "sentences").select(F.col("id").alias("doc_id"), "text"))


@query(
    "forms_by_lemma",
    f"with {_POS}, {_LEXICON} select lemma, count(distinct form) as n_forms, count(distinct key) as n_keys from lex group by lemma",
)
def forms_by_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct forms and keys of each lemma of the dictionary."""
    lexicon = from_table(table(spark, sf_dir, "opencorpora"), "grammemes")
    rows = morphology.forms_of_lemmas(lexicon.select("lemma"), lexicon).select("lemma", "form", F.translate("form", "ё", "е").alias("key"))
    return rows.groupBy("lemma").agg(F.countDistinct("form").alias("n_forms"), F.countDistinct("key").alias("n_keys"))


@query("preposition_cases", "with p(preposition, \"case\") as (values " + ", ".join(f"('{w}', '{c}')" for w, cs in preposition_cases().items() for c in cs) + ") select * from p")
def prepositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that prepositions govern."""
    return spark.createDataFrame([(w, c) for w, cs in preposition_cases().items() for c in cs], "preposition string, case string")


_VERBS = next(r for r in RULES if r.kind == "negated_verb_spacing_basic")


@query(
    "d_orthography_ne_with_common_verbs",
    f"""with {_POS}, src as (select doc_id, replace(replace(text, ' переставил', ' непереставил'), ' уточнил', ' НЕуточнил') as text from documents where text is not null and text <> ''){_TOK}, {_LEXICON},
    v as (select distinct key from lex where pos in ('verb', 'gerund', 'participle')), c as (select *, replace(lower(t), 'ё', 'е') as x from near where k = 'word' and starts_with(lower(t), 'не') and length(t) >= 4 and lower(t) not in ({', '.join(f"'{w}'" for w in morphology.LEXICAL_NE)}))
    select doc_id, s, e, 'не ' || case when regexp_matches(t[3], '\\p{{Lu}}') then upper(t[3]) || lower(t[4:]) else lower(t[3:]) end as replacement from c where x not in (select key from v) and x[3:] in (select key from v)""",
)
def negated_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verbs written together with не; some are joined in the text first."""
    lexicon = from_table(table(spark, sf_dir, "opencorpora"), "grammemes")
    text = F.replace(F.replace("text", F.lit(" переставил"), F.lit(" непереставил")), F.lit(" уточнил"), F.lit(" НЕуточнил"))
    return morphology.negated_verbs(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), lexicon, _VERBS).select("doc_id", "s", "e", "replacement")


def _whole_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slovotok.sources.lexicon import seed_lexicon

    return from_table(table(spark, sf_dir, "opencorpora"), "grammemes").unionByName(seed_lexicon(spark))


@query("grammar_conflicts")
def grammar_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts of agreement and government in all documents, with the form that mends each where there is only one."""
    from slovotok.operators import agreement

    verbs = agreement.government(table(spark, sf_dir, "verb_government"))
    return agreement.conflicts(table(spark, sf_dir, "documents").select("doc_id", "text"), _whole_lexicon(spark, sf_dir), verbs)


@query("check_with_lexicon")
def check_with_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all documents by rule, with the rules that need a dictionary."""
    from slovotok.operators import agreement
    from slovotok.operators.checking import check
    from slovotok.plans.rules import RuleFilter

    extra = agreement.with_lexicon(_whole_lexicon(spark, sf_dir), agreement.government(table(spark, sf_dir, "verb_government")))
    rows = check(table(spark, sf_dir, "documents").select("doc_id", "text"), chosen=RuleFilter("strict"), extra=extra)
    return rows.groupBy("rule_id").agg(F.count("*").alias("n_issues"))


@query("verb_government_cases")
def verb_government_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases that verbs govern, by lemma."""
    from slovotok.operators import agreement

    return agreement.government(table(spark, sf_dir, "verb_government")).select("verb", "direct", F.to_json("through").alias("through"))


@query("word_formation")
def word_formations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parse of every distinct word of the dictionary of the project's own dialect."""
    from slovotok.operators.word_formation import word_formation

    rows = word_formation(table(spark, sf_dir, "project"), "form")
    return rows.filter("rank = 1").select("word", "score", "confidence", "signature")


@query("eliminated_readings")
def eliminated_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that the context rules out in the learner sentences, by constraint and part of speech."""
    from slovotok.operators.agreement import ruled_out

    latest = F.max_by("text", F.struct(F.coalesce(F.col("loaded_at").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    rows = table(spark, sf_dir, "sentences").groupBy(F.col("id").alias("doc_id")).agg(latest.alias("text"))
    found = ruled_out(rows, _whole_lexicon(spark, sf_dir))
    return found.groupBy("constraint", "pos").agg(F.count("*").alias("n"))


_EDGES = (
    _features_sql("opencorpora", "grammemes").replace("select d.row_no, replace(", "lexf as (select distinct replace(", 1).replace("on p.tag = " + _NORMAL.format("d.pos"), "on p.tag = " + _NORMAL.format("d.pos") + ")", 1).replace("    lexf as", "    , lexf as", 1)
    + ", src as (select doc_id, text from documents where text is not null and text <> '')" + _TOK
    + """, pairs as (select replace(lower(p2), 'ё', 'е') as left_key, replace(lower(t), 'ё', 'е') as right_key, count(*) as n from near where k = 'word' and pk1 = 'whitespace' and not contains(p1, chr(10)) and pk2 = 'word' group by all),
    r as (select distinct key, pos, "case" as c, number as u, gender as g from lexf),
    x as (select left_key, right_key, n, case when a.c is null or b.c is null then 1 when a.c = b.c then 0 else 2 end as sc, case when a.u is null or b.u is null then 1 when a.u = b.u then 0 else 2 end as su,
      case when coalesce(a.u = 'plural', false) or coalesce(b.u = 'plural', false) then 0 when a.g is null or b.g is null then 1 when a.g = b.g or a.g = 'common' or b.g = 'common' then 0 else 2 end as sg
      from pairs join r a on a.key = left_key and a.pos in ('adjective', 'participle') join r b on b.key = right_key and b.pos = 'noun'),
    z as (select left_key, right_key, any_value(n) as n, min(greatest(sc, su, sg)) as worst, bool_or(sc = 2) as cc, bool_or(sg = 2) as cg, bool_or(su = 2) as cu, bool_or(sc = 1) as uc, bool_or(sg = 1) as ug, bool_or(su = 1) as uu from x group by left_key, right_key)
    select left_key, right_key, n, case worst when 0 then 'match' when 1 then 'unknown' else 'conflict' end as result,
      concat_ws(',', case when cc then 'case' end, case when cg then 'gender' end, case when cu then 'number' end) as conflicts, concat_ws(',', case when uc then 'case' end, case when ug then 'gender' end, case when uu then 'number' end) as unknown from z"""
)


@query("agreement_edges", _EDGES)
def agreement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How modifiers agree with the nouns right after them in all documents, with the features in conflict and the unknown ones."""
    from slovotok.operators.unification import agreement_edges as edges

    rows = edges(table(spark, sf_dir, "documents"), from_table(table(spark, sf_dir, "opencorpora"), "grammemes"))
    return rows.select("left_key", "right_key", "n", "result", F.array_join("conflicts", ",").alias("conflicts"), F.array_join("unknown", ",").alias("unknown"))


#: How ambiguous the words and numbers of the documents are, in SQL.
AMBIGUITY = (
    _features_sql("opencorpora", "grammemes").replace("select d.row_no, replace(", ", lexf as (select distinct lower(trim(form)) as form, trim(lemma) as lemma, nullif(trim(lemma_id), '') as l, nullif(trim(paradigm_id), '') as g, nullif(trim(source_id), '') as sc, nullif(trim(stress), '') as st, replace(", 1).replace(", coalesce(n_unrecognized, 0)::int as n_unrecognized\n    from d", "\n    from (select * from d join (select row_no, lemma_id, paradigm_id, source_id, stress from opencorpora) using (row_no)) d", 1)
    + "), src as (select doc_id, text from documents where text is not null and text <> '')" + _TOK
    + """, w as (select t, count(*) as n from tok where k in ('word', 'number') group by t),
    r as (select t, n, lexf.*, bool_or(lexf.form = lower(t)) over (partition by t) as exact from w left join lexf on replace(lower(t), 'ё', 'е') = lexf.key),
    c as (select t, any_value(n) as n, count(key) filter (where not (contains(lower(t), 'ё') and exact) or form = lower(t)) as readings, count(distinct pos) filter (where key is not null and (not (contains(lower(t), 'ё') and exact) or form = lower(t))) as parts from r group by t)
    select case when readings = 0 then 'unknown' when readings = 1 then 'certain' when parts = 1 then 'ambiguous_form' else 'ambiguous_pos' end as class, sum(n)::bigint as n_tokens from c group by 1"""
)


_PAIRS = _EDGES.split("    r as (select distinct key")[0]


def _numerals() -> dict[str, str]:
    from slovotok.operators.agreement import NUMERALS

    return {w.replace("ё", "е"): n for c, n in (("paucal", "singular"), ("many", "plural")) for w in NUMERALS[c]}


@query(
    "subject_predicate_edges",
    _PAIRS + """    r as (select distinct key, pos, "case" as c, "number" as u, gender as g, tense as z from lexf),
    x as (select left_key, right_key, n, case when a.u is null or b.u is null then 1 when a.u = b.u then 0 else 2 end as su,
      case when coalesce(a.u = 'plural', false) or coalesce(b.u = 'plural', false) then 0 when a.g is null or b.g is null then 1 when a.g = b.g or a.g = 'common' or b.g = 'common' then 0 else 2 end as sg
      from pairs join r a on a.key = left_key and a.pos in ('noun', 'pronoun') and coalesce(a.c, 'nominative') = 'nominative' join r b on b.key = right_key and b.pos = 'verb' and b.z = 'past')
    select left_key, right_key, any_value(n) as n, case min(greatest(su, sg)) when 0 then 'match' when 1 then 'unknown' else 'conflict' end as result from x group by left_key, right_key""",
)
def subject_predicate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How subjects agree with past verbs right after them in all documents."""
    from slovotok.operators.unification import agreement_edges as edges

    lexicon = from_table(table(spark, sf_dir, "opencorpora"), "grammemes")
    rows = edges(table(spark, sf_dir, "documents"), lexicon, ("noun", "pronoun"), ("verb",), ("number", "gender"), "coalesce(case, 'nominative') = 'nominative'", "tense = 'past'")
    return rows.select("left_key", "right_key", "n", "result")


@query(
    "government_frames",
    _PAIRS + "    p(prep, c) as (values " + ", ".join(f"('{w.replace('ё', 'е')}', '{c}')" for w, cs in preposition_cases().items() for c in cs) + """),
    r as (select distinct key, "case" as c from lexf where pos in ('noun', 'pronoun')),
    x as (select left_key, right_key, n, case when r.c is null then 1 when exists (select 1 from p where p.prep = left_key and p.c = r.c) then 0 else 2 end as w from pairs join r on r.key = right_key where left_key in (select prep from p))
    select left_key, right_key, any_value(n) as n, case min(w) when 0 then 'match' when 1 then 'unknown' else 'conflict' end as result from x group by left_key, right_key""",
)
def government_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepositions and the words right after them in all documents, by whether the case fits."""
    from slovotok.operators.unification import government_frames as frames

    lexicon = from_table(table(spark, sf_dir, "opencorpora"), "grammemes")
    return frames(table(spark, sf_dir, "documents"), lexicon, {w.replace("ё", "е"): tuple(c) for w, c in preposition_cases().items()})


@query(
    "numeral_frames",
    _PAIRS + "    q(num, asked) as (values " + ", ".join(f"('{w}', '{n}')" for w, n in _numerals().items()) + """),
    r as (select distinct key, "case" as c, "number" as u from lexf where pos = 'noun'),
    x as (select left_key, right_key, n, case when r.c = 'genitive' and r.u = asked then 0 when r.c is null and coalesce(r.u = asked, true) or r.u is null and coalesce(r.c = 'genitive', true) then 1 else 2 end as w from pairs join q on num = left_key join r on r.key = right_key)
    select left_key, right_key, any_value(n) as n, case min(w) when 0 then 'match' when 1 then 'unknown' else 'conflict' end as result from x group by left_key, right_key""",
)
def numeral_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals and the nouns right after them in all documents, by whether the form fits."""
    from slovotok.operators.unification import numeral_frames as frames

    return frames(table(spark, sf_dir, "documents"), from_table(table(spark, sf_dir, "opencorpora"), "grammemes"), _numerals())

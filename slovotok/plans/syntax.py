"""Queries of sentences, clauses and document context, over the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.operators import document_context, sentences
from slovotok.plans import query
from slovotok.plans.surface import _AL, _NORM, _TOK, _WS, _source
from slovotok.session import table

_LINES = f"""with {_source([])}, l0 as (select doc_id, text, string_split(text, chr(10)) as p from src), l1 as (select doc_id, text, i as n, p[i] as raw, (list_sum([length(x) for x in p[1:i]]) + i - 1 - length(p[i]))::int as s from l0, lateral (select unnest(range(1, len(p) + 1)) as i)),
l2 as (select *, (s + length(raw))::int as e, regexp_replace(raw, '^[{_WS}]+', '') as lead_, regexp_replace(raw, '^[{_WS}]+|[{_WS}]+$', '', 'g') as cut from l1),
items as (select doc_id, text, n, (e - length(lead_))::int as s, e, case when starts_with(lead_, '- ') then 'dash' when starts_with(lead_, '* ') then 'asterisk' when starts_with(lead_, '• ') then 'bullet' when regexp_matches(lead_, '^[0-9]+\\. ') then 'numbered' end as marker,
  regexp_replace(lead_[instr(lead_, ' ') + 1:], '^[{_WS}]+|[{_WS}]+$', '', 'g') as body from l2),
heads as (select doc_id, text, n, (s + length(raw) - length(lead_))::int as s, e, starts_with(cut, '#') as marked, case when starts_with(cut, '#') then regexp_replace(regexp_replace(cut, '^#+', ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') else cut end as title from l2
  where starts_with(cut, '#') or cut <> '' and length(cut) <= 80 and not regexp_matches(cut, '[.!?:;]$') and not (starts_with(cut, '- ') or starts_with(cut, '* ') or starts_with(cut, '• ') or regexp_matches(cut, '^[0-9]+\\. ')))"""


@query("headings", _LINES + " select doc_id, n::int as n, s, e, title, case when marked then 'marked' else 'plain' end as style, marked and regexp_matches(title, '[.!?:;]$') as terminal from heads")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of all documents."""
    rows = document_context.structure(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text <> ''"))
    return rows.select("doc_id", F.explode("headings").alias("x")).select("doc_id", "x.*")


@query("list_items", _LINES + " select doc_id, n::int as n, s, e, marker, body, regexp_matches(body, '[.!?:;]$') as terminal from items where marker is not null")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list items of all documents."""
    rows = document_context.structure(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text <> ''"))
    return rows.select("doc_id", F.explode("items").alias("x")).select("doc_id", "x.*")


@query(
    "document_style",
    _LINES + f""", h as (select doc_id, count(*) as n, count(distinct marked and regexp_matches(title, '[.!?:;]$')) as k from heads group by doc_id), i as (select doc_id, count(*) as n, count(distinct marker) as k from items where marker is not null group by doc_id)
    select src.doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '[{_WS}]+', '', 'g') <> ''))::int as paragraphs, coalesce(h.n, 0)::int as n_headings, coalesce(i.n, 0)::int as n_items, coalesce(h.k > 1, false) as mixed_headings, coalesce(i.k > 1, false) as mixed_markers
    from src left join h using (doc_id) left join i using (doc_id)""",
)
def document_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, headings, list items and mixed styles of all documents."""
    rows = document_context.structure(table(spark, sf_dir, "documents").select("doc_id", "text").filter("text <> ''"))
    return rows.select("doc_id", "paragraphs", F.size("headings").alias("n_headings"), F.size("items").alias("n_items"), "mixed_headings", "mixed_markers")


_HEADED = "# Глоссарий\n- слово — единица языка\n1. знак: точка или запятая\n\n"
_GLOSSARY = _LINES.replace(_source([]), "src as (select doc_id, '" + _HEADED + "' || text as text from documents where text is not null and text <> '')")


@query(
    "glossary",
    _GLOSSARY + """, r as (select doc_id, title, e as a, coalesce(lead(s) over (partition by doc_id order by s), 1 << 30) as b from heads),
    g as (select i.doc_id, i.s, i.e, i.body from items i where marker is not null and exists (select 1 from r where r.doc_id = i.doc_id and contains(lower(r.title), 'глоссар') and r.a <= i.s and i.s < r.b)),
    c as (select *, [x for x in [' — ', ' – ', ' - ', ': '] if instr(body, x) > 0 and trim(body[1:instr(body, x) - 1]) <> '' and trim(body[instr(body, x) + length(x):]) <> ''] as seps from g)
    select doc_id, trim(body[1:instr(body, seps[1]) - 1]) as term, trim(body[instr(body, seps[1]) + length(seps[1]):]) as definition, s, e from c where len(seps) > 0""",
)
def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary entries; a glossary heading is put before each document."""
    rows = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.concat(F.lit(_HEADED), "text").alias("text"))
    return document_context.glossary(rows)


@query(
    "document_terms",
    f"with {_source([])}{_TOK} select doc_id, term, count(*) as frequency, min(s)::int as first_start from (select doc_id, {_NORM.format(x='t')} as term, s from tok where k = 'word') where length(term) >= 4 and term not in ({', '.join(repr(w) for w in document_context.STOP_WORDS)}) group by doc_id, term",
)
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents with their frequencies and first places."""
    return document_context.terms(table(spark, sf_dir, "documents"))


@query(
    "abbreviations",
    f"with {_source([])}{_TOK}, a as (select doc_id, upper(regexp_replace(t, '[^{_AL}]', '', 'g')) as short, s from tok where k = 'word' and not regexp_matches(t, '[\\p{{Ll}}ªºʰ-ʸˀˁˠ-ˤ]')) select doc_id, short, count(*) as frequency, min(s)::int as s from a where length(short) between 2 and 10 group by doc_id, short",
)
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations of all documents with their frequencies and first places."""
    return document_context.abbreviations(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "short", "frequency", "s")


_EXPANDED = f"""with {_source([])}{_TOK}, a as (select doc_id, upper(regexp_replace(t, '[^{_AL}]', '', 'g')) as short, s from tok where k = 'word' and not regexp_matches(t, '[\\p{{Ll}}ªºʰ-ʸˀˁˠ-ˤ]')),
    f as (select doc_id, short, count(*) as frequency, min(s)::int as s from a where length(short) between 2 and 10 group by doc_id, short),
    b as (select f.*, text, left(text, s) as before, length(left(text, s)) - length(regexp_replace(left(text, s), '^.*\\(', '', 's')) as head_end from f join src using (doc_id)),
    x as (select *, regexp_extract(regexp_replace(left(text, (head_end - 1)::int), '[{_WS}]+$', ''), '[^.!?\\n]*$') as context from b where contains(before, '(') and not contains(regexp_replace(before, '^.*\\(', '', 's'), ')')),
    y as (select doc_id, short, frequency, s, regexp_replace(regexp_replace(regexp_replace(context, '^[{_WS}]+|[{_WS}]+$', '', 'g'), '^[:;,—-]+|[:;,—-]+$', '', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g') as expansion from x)"""


@query("abbreviation_expansions", _EXPANDED + " select doc_id, short, expansion, frequency from y where length(expansion) >= 6")
def abbreviation_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations that are explained where they come first."""
    rows = document_context.abbreviations(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.filter("expansion is not null").select("doc_id", "short", "expansion", "frequency")


@query("sentence_spans")
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents."""
    return sentences.sentences(table(spark, sf_dir, "documents"))


@query("clause_boundaries")
def clause_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause markers of all documents by kind of boundary."""
    rows = sentences.boundaries(table(spark, sf_dir, "documents"))
    return rows.groupBy("marker", "kind", "confidence").agg(F.count("*").alias("n"))


@query("cross_sentence_terms")
def cross_sentence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that occur in more than one sentence of a document."""
    return sentences.cross_sentence_terms(table(spark, sf_dir, "documents"), 4, document_context.STOP_WORDS)


@query("fact_counts")
def fact_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each layer found in every document."""
    from slovotok.operators.inspection import fact_counts as counts

    return counts(table(spark, sf_dir, "documents"))


@query("islands")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of every document within which words may be linked."""
    from slovotok.operators.inspection import islands as found

    return found(table(spark, sf_dir, "documents"))


@query("coordination_groups")
def coordination_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordination groups of all documents by size and repetition."""
    from slovotok.operators.coordination import coordination_groups as found

    rows = found(table(spark, sf_dir, "documents"))
    return rows.groupBy(F.size("members").alias("n_members"), "repeated").agg(F.count("*").alias("n_groups"))

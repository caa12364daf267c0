"""Queries of dataset import, evaluation and validation, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.operators import evaluation, validation
from slovotok.operators.checking import check
from slovotok.plans import query
from slovotok.plans.rules import RULES, RuleFilter
from slovotok.plans.surface import _TOK, _WS
from slovotok.session import table
from slovotok.sources.gec import learner_sentences, test_sentences

def _clean(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}::varchar, ''), '[\\r\\n\\t]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_LINE = "trim(regexp_replace(coalesce({0}, ''), '[\\r\\n\\t]+', ' ', 'g'))"


@query(
    "learner_records",
    f"""with r as (select {_clean('id')} as s_id, min({{'text': {_clean('text')}, 'corrected': {_clean('corrected')}, 'document_id': {_clean('document_id')}, 'i': {_clean('sentence_index')}, 'status': {_clean('status')}}}) as r
      from sentences where {_clean('text')} <> '' and ({_clean('corrected')} = '' or {_clean('corrected')} <> {_clean('text')}) group by s_id),
    d as (select id::varchar as d_id, min({{'a': coalesce(subcorpus, ''), 'b': coalesce(native, ''), 'c': coalesce(language_background, ''), 'd': coalesce(level, ''), 'e': coalesce(words::varchar, ''), 'f': coalesce(sentences::varchar, '')}}) as doc from rlc_documents group by d_id)
    select 'rlc-annotated/sentence-' || s_id as id, r.text as input, r.corrected as correction, r.document_id, r.status, {_clean('doc.a')} as subcorpus, {_clean('doc.d')} as level from r left join d on r.document_id = d_id""",
)
def learner_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction records of the learner sentences with what is known of their documents."""
    rows = learner_sentences(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "rlc_documents"))
    at = lambda k: F.try_element_at("metadata", F.lit(k))
    return rows.select("id", "input", "correction", at("document_id").alias("document_id"), at("status").alias("status"), F.coalesce(at("document.subcorpus"), F.lit("")).alias("subcorpus"), F.coalesce(at("document.level"), F.lit("")).alias("level"))


@query(
    "test_records",
    f"""with r as (select row_no, {_clean('text_orig')} as t, {_clean('text_cor')} as c, {_clean('tag')} as tag from rlc_test)
    select 'rlc-annotated/rlc-test-' || min(row_no) as id, t as input, c as correction, count(*)::int as n_edits, count(distinct tag) filter (where tag <> '')::int as n_labels from r where t <> '' group by t, c""",
)
def test_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction records of the test sentences: one per pair of sentence and correction."""
    rows = test_sentences(table(spark, sf_dir, "rlc_test"))
    return rows.select("id", "input", "correction", F.size("edits").alias("n_edits"), F.size("labels").alias("n_labels"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ~F.trim(F.coalesce("edits", F.lit(""))).isin("", "null", "[]", "{}", '""')
    return table(spark, sf_dir, "gec_dataset_regressions").select(F.col("rec_no").alias("rec"), "dataset", "input", "correction", "targets", "labels", held.alias("has_edits"))


_DIRTY = f"""g as (select rec_no as rec, dataset, labels, coalesce(input, '') as input, {_LINE.format('input')} as i, case when {_LINE.format('correction')} <> '' then {_LINE.format('correction')} else {_LINE.format('targets[1]')} end as target,
  trim(coalesce(edits, '')) not in ('', 'null', '[]', '{{}}', '""') as has_edits, lower(array_to_string(coalesce(labels, []), ' ')) as l from gec_dataset_regressions),
f as (select *, case when target <> '' then target <> i else has_edits or coalesce(len(labels), 0) > 0 end as dirty, list_filter([{', '.join(f"case when regexp_matches(l, '{'|'.join(p)}') then '{d}' end" for d, p in evaluation.LABEL_PARTS.items())}], lambda x: x is not null) as domains from g)"""


@query(
    "expected_dirty",
    f"with {_DIRTY} select dataset, count(*) as n, count(*) filter (where dirty) as n_dirty, count(*) filter (where len(domains) > 0) as n_mappable, count(*) filter (where list_contains(domains, 'punctuation')) as n_punctuation, sum(len(regexp_extract_all(input, '[^{_WS}]+')))::bigint as n_tokens from f group by dataset",
)
def expected_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by dataset: how many should have issues, and in which domains."""
    rows = _records(spark, sf_dir)
    target = evaluation.primary_target(F.col("correction"), F.col("targets"))
    domains = evaluation.label_domains(F.col("labels"))
    dirty = evaluation.expected_dirty(F.col("input"), target, F.col("has_edits"), F.col("labels"))
    return rows.groupBy("dataset").agg(
        F.count("*").alias("n"), F.count_if(dirty).alias("n_dirty"), F.count_if(F.size(domains) > 0).alias("n_mappable"), F.count_if(F.array_contains(domains, "punctuation")).alias("n_punctuation"), F.sum(evaluation.token_count(F.col("input"))).alias("n_tokens")
    )


_REPEATED = RuleFilter(include=("ru.grammar.repeated_word",))
_SIDES = f"""with {_DIRTY}, both_ as (select rec, labels, dirty, domains, 'source' as side, input as text from f union all select rec, labels, dirty, domains, 'target', target from f where target <> ''),
src as (select side || rec as doc_id, text from both_ where text <> ''){_TOK},
h as (select doc_id, count(*) as n from near where k = 'word' and pk1 = 'whitespace' and pk2 = 'word' and lower(p2) = lower(t) group by doc_id),
x as (select both_.*, coalesce(n, 0) as n from both_ left join h on side || rec = doc_id)"""


@query(
    "evaluation_report",
    _SIDES + f""", c as (select count(*) filter (where side = 'source') as examples, count(*) filter (where side = 'source' and dirty) as expected_dirty_examples, sum(case when side = 'source' then len(regexp_extract_all(text, '[^{_WS}]+')) else 0 end)::bigint as source_tokens,
      count(*) filter (where side = 'target') as targets, sum(case when side = 'source' then n else 0 end)::bigint as source_diagnostics, sum(case when side = 'target' then n else 0 end)::bigint as target_diagnostics,
      count(*) filter (where side = 'target' and n > 0) as fp, count(*) filter (where side = 'source' and dirty and n > 0) as tp, count(*) filter (where side = 'source' and len(domains) > 0) as mappable_examples,
      count(*) filter (where side = 'source' and n > 0 and list_contains(domains, 'grammar')) as domain_hits from x)
    select examples, expected_dirty_examples, source_tokens, targets, source_diagnostics, target_diagnostics, fp as false_positive_target_sentences, tp as source_detected_dirty_examples, mappable_examples, domain_hits,
      round(tp / expected_dirty_examples, 6) as recall_proxy, round(tp / (tp + fp), 6) as precision_proxy, round(1.25 * (tp / (tp + fp)) * (tp / expected_dirty_examples) / (0.25 * (tp / (tp + fp)) + tp / expected_dirty_examples), 6) as f0_5_proxy from c""",
)
def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and proxies of one rule on all correction records."""
    rows = evaluation.diagnosed(_records(spark, sf_dir), lambda d: check(d, chosen=_REPEATED))
    wanted = ["examples", "expected_dirty_examples", "source_tokens", "targets", "source_diagnostics", "target_diagnostics", "false_positive_target_sentences", "source_detected_dirty_examples", "mappable_examples", "domain_hits", "recall_proxy", "precision_proxy", "f0_5_proxy"]
    return evaluation.report(rows).select(*wanted)


@query(
    "evaluation_by_label",
    _SIDES + " select side, label, sum(n)::bigint as issues, count(*) as records from (select side, n, unnest(case when coalesce(len(labels), 0) = 0 then ['__unlabeled__'] else list_distinct(labels) end) as label from x where n > 0) group by side, label",
)
def evaluation_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of one rule by dataset label."""
    return evaluation.by_label(evaluation.diagnosed(_records(spark, sf_dir), lambda d: check(d, chosen=_REPEATED)))


def _by_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the whole strict rule set on inputs and targets."""
    return evaluation.diagnosed(_records(spark, sf_dir), lambda d: check(d, chosen=RuleFilter("strict")))


@query("evaluation_report_strict")
def evaluation_report_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and proxies of all rules of the strict profile on all correction records."""
    return evaluation.report(_by_all_rules(spark, sf_dir))


@query("evaluation_by_label_strict")
def evaluation_by_label_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of all rules of the strict profile by dataset label."""
    return evaluation.by_label(_by_all_rules(spark, sf_dir))


@query("evaluation_top_rules")
def evaluation_top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent rules on inputs and on targets under the strict profile."""
    return evaluation.top_rules(evaluation.diagnosed(_records(spark, sf_dir), lambda d: check(d, chosen=RuleFilter("strict"))))


@query(
    "government_violations",
    """select row_no, 'unknown_kind' as problem from verb_government where coalesce(complement_kind, '') not in ('direct_object', 'prepositional_object')
    union all select row_no, 'preposition_missing' from verb_government where complement_kind = 'prepositional_object' and trim(coalesce(preposition, '')) = ''
    union all select row_no, 'preposition_not_expected' from verb_government where complement_kind = 'direct_object' and trim(coalesce(preposition, '')) <> ''
    union all select row_no, 'lemma_missing' from verb_government where trim(coalesce(lemma, '')) = ''
    union all select row_no, 'cases_missing' from verb_government where trim(coalesce(cases, '')) = ''
    union all select row_no, 'duplicate_key' from (select row_no, count(*) over (partition by trim(coalesce(lemma, '')), coalesce(complement_kind, ''), trim(coalesce(preposition, ''))) as n from verb_government) where n > 1""",
)
def government_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the government table that break its rules."""
    return validation.government_violations(table(spark, sf_dir, "verb_government"), "row_no")


@query("rule_violations")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that break the contract of the rule table."""
    return spark.createDataFrame(validation.rule_violations(RULES), "rule_id string, problem string")


@query("example_failures")
def example_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of rules that do not behave as stated, those of dictionary rules with a small dictionary: none."""
    from slovotok.operators.agreement import with_lexicon
    from slovotok.sources.lexicon import demo_government, demo_lexicon

    return validation.example_failures(spark, RULES, with_lexicon(demo_lexicon(spark), demo_government(spark)))

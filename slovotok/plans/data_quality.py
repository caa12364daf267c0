"""Queries of the general problems: records that fail to parse, nested records, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.operators import inlining, rejects, unpack
from slovotok.plans import query
from slovotok.session import table

_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_POS = "|".join(rejects.OPENCORPORA_POS)
_PAIR = rf"(?:{'|'.join(rejects.FEATURE_KEYS)})=[A-Za-z0-9_-]+"
_RECORDS = rf"""
with r as (
  select line_id, feed, raw from raw_records
  where raw is not null and regexp_matches(raw, '\S')
    and not (feed = 'project.tsv' and starts_with(raw, '#'))
    and replace(raw, '"', '') not in ('form,lemma,pos,grammemes,lemma_id,paradigm_id,source_id,stress', 'text_orig,text_cor,quote,correction,tag')
    and raw <> concat_ws(chr(9), 'form', 'lemma', 'pos', 'features', 'lemma_id', 'paradigm_id', 'source_id', 'stress')
    and feed in ('opencorpora.csv', 'project.tsv', 'rlc_test.csv')
), c as (
  select *, case when feed = 'project.tsv' then string_split(raw, chr(9))
    when regexp_full_match(raw, '{_FIELD}(?:,{_FIELD})*') then
      [case when starts_with(x, '"') then replace(x[2:-2], '""', '"') else x end
       for x in regexp_extract_all(',' || raw, ',({_FIELD})', 1)] end as cells
  from r
), e as (
  select *, case when cells is null then 'quoting'
    when feed = 'opencorpora.csv' and len(cells) <> 8 or feed = 'rlc_test.csv' and len(cells) <> 5 or feed = 'project.tsv' and len(cells) not between 4 and 8 then 'columns'
    when feed = 'opencorpora.csv' and not (regexp_full_match(cells[3], '{_POS}') and regexp_full_match(cells[4], '[A-Za-z0-9-]+(?:\|[A-Za-z0-9-]+)*')) then 'value'
    when feed = 'project.tsv' and not regexp_full_match(cells[4], '{_PAIR}(?:\|{_PAIR})*') then 'value'
    when feed = 'rlc_test.csv' and (not regexp_matches(cells[1], '\pL') or contains(cells[1], chr(65533)) or regexp_matches(cells[1], '[\x00-\x09\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]')) then 'value'
  end as reason from c
)"""


@query("p1_found", _RECORDS + " select line_id, reason from e where reason is not null")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that cannot be loaded, with the reason."""
    return rejects.rejects(table(spark, sf_dir, "raw_records"))


def _loaded(feed: rejects.Feed):
    columns = ", ".join(f"nullif(cells[{i + 1}], '') as {c}" for i, c in enumerate(feed.columns))
    name = "p1_loaded_" + feed.name.partition(".")[0]

    @query(name, _RECORDS + f" select line_id, {columns} from e where reason is null and feed = '{feed.name}'")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rejects.loaded(table(spark, sf_dir, "raw_records"), feed)

    return run


for _f in rejects.FEEDS:
    _loaded(_f)


_JSON = r"""
with j as (
  select rec_no, try_cast(edits as json) as e, try_cast(metadata as json) as m0, try_cast(expectations as json) as x from gec_dataset_regressions
), r as (
  select rec_no, e, x, case when json_type(m0) = 'VARCHAR' then try_cast((m0->>'$') as json) else m0 end as m from j
), edit as (
  select rec_no, p1, (case when json_type(e) = 'ARRAY' then e->(p1 - 1) else e end) as o
  from r, lateral (select unnest(range(1, 1 + case when json_type(e) = 'ARRAY' then json_array_length(e)::int when json_type(e) = 'OBJECT' then 1 else 0 end))::int as p1) where e is not null
), alternative as (
  select rec_no, p1, p2, (case when json_type(a) = 'ARRAY' then a->(p2 - 1) else a end) as o
  from (select rec_no, p1, o->'alternatives' as a from edit), lateral (select unnest(range(1, 1 + case when json_type(a) = 'ARRAY' then json_array_length(a)::int when json_type(a) = 'OBJECT' then 1 else 0 end))::int as p2) where a is not null
), vote as (
  select rec_no, p1, p2, p3, (case when json_type(a) = 'ARRAY' then a->(p3 - 1) else a end) as o
  from (select rec_no, p1, p2, o->'votes' as a from alternative), lateral (select unnest(range(1, 1 + case when json_type(a) = 'ARRAY' then json_array_length(a)::int when json_type(a) = 'OBJECT' then 1 else 0 end))::int as p3) where a is not null
), review as (
  select rec_no, p1, (case when json_type(a) = 'ARRAY' then a->(p1 - 1) else a end) as o
  from (select rec_no, m->'reviews' as a from r), lateral (select unnest(range(1, 1 + case when json_type(a) = 'ARRAY' then json_array_length(a)::int when json_type(a) = 'OBJECT' then 1 else 0 end))::int as p1) where a is not null
), step as (
  select rec_no, p1, p2, (case when json_type(a) = 'ARRAY' then a->(p2 - 1) else a end) as o
  from (select rec_no, p1, o->'steps' as a from review), lateral (select unnest(range(1, 1 + case when json_type(a) = 'ARRAY' then json_array_length(a)::int when json_type(a) = 'OBJECT' then 1 else 0 end))::int as p2) where a is not null
), trigger_ as (
  select rec_no, p1, (case when json_type(a) = 'ARRAY' then a->(p1 - 1) else a end) as o
  from (select rec_no, x->'input_must_trigger' as a from r), lateral (select unnest(range(1, 1 + case when json_type(a) = 'ARRAY' then json_array_length(a)::int when json_type(a) in ('OBJECT', 'VARCHAR') then 1 else 0 end))::int as p1) where a is not null
), span as (
  select rec_no, p1, p2, (case when json_type(a) = 'ARRAY' then a->(p2 - 1) else a end) as o
  from (select rec_no, p1, o->'spans' as a from trigger_), lateral (select unnest(range(1, 1 + case when json_type(a) = 'ARRAY' then json_array_length(a)::int when json_type(a) = 'OBJECT' then 1 else 0 end))::int as p2) where a is not null
)
select rec_no, 'edit' as child, p1, 0 as p2, 0 as p3, coalesce(o->>'id', '') as ref from edit where json_type(o) = 'OBJECT'
union all select rec_no, 'alternative', p1, p2, 0, '' from alternative where json_type(o) = 'OBJECT'
union all select rec_no, 'vote', p1, p2, p3, '' from vote where json_type(o) = 'OBJECT'
union all select rec_no, 'review', p1, 0, 0, coalesce(o->>'reviewer', '') from review where json_type(o) = 'OBJECT'
union all select rec_no, 'step', p1, p2, 0, '' from step where json_type(o) = 'OBJECT'
union all select rec_no, 'trigger', p1, 0, 0, coalesce(case when json_type(o) = 'OBJECT' then o->>'rule_id' else o->>'$' end, '') from trigger_ where json_type(o) in ('OBJECT', 'VARCHAR')
union all select rec_no, 'span', p1, p2, 0, '' from span where json_type(o) = 'OBJECT'
"""


@query("p2_found", _JSON)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child objects of every correction record."""
    return inlining.child_objects(table(spark, sf_dir, "gec_dataset_regressions"))


@query("p2_tables")
def p2_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the flat tables that shared inlining makes of the JSON fields, with its keys and its inlined columns."""
    return inlining.table_rows(table(spark, sf_dir, "gec_dataset_regressions"), "rec_no", ["edits", "metadata", "expectations"])


_UNPACK = r"""
with f as (
  select 'opencorpora' as tbl, row_no, grammemes as v from opencorpora where grammemes is not null
  union all select 'project', row_no, features from project where features is not null
  union all select 'verb_government', row_no, cases from verb_government where cases is not null
), runs as (
  select tbl, row_no, list_filter(regexp_extract_all(v, '((?:"[^"]*(?:""[^"]*)*"|[^\s|;,/&\\+"]|")+)', 1), lambda x: lower(x) not in ('и', 'или', 'либо', 'and', 'or')) as r from f
), vals as (
  select tbl, row_no, list_filter([array_to_string([case when length(p) > 1 and starts_with(p, '"') then replace(p[2:-2], '""', '"') else p end
    for p in regexp_extract_all(x, '("[^"]*(?:""[^"]*)*"|[^"]+|")', 1)], '') for x in r], lambda x: x <> '') as r from runs
)
select tbl, row_no, i::int as pos, r[i] as val from vals, lateral (select unnest(range(1, len(r) + 1)) as i)
"""


@query("p4_found", _UNPACK)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every packed field with its position."""
    fields = (("opencorpora", "grammemes"), ("project", "features"), ("verb_government", "cases"))
    return unpack.unpack_all([(name, table(spark, sf_dir, name), "row_no", field) for name, field in fields]).withColumnRenamed("key", "row_no")

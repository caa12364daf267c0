"""Queries of the training-text problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slovotok.llm import charforms, encodings, grouped_splits, leaks, packing
from slovotok.session import shipped, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query of this subpackage."""

    def put(f: Query) -> Query:
        QUERIES[name] = shipped(f)
        if sql:
            ORACLE[name] = sql
        return f

    return put


# A value differs from its consistent form if it shows a trace of other characters; nothing is put into the form here.
_TRACES = r"""
with v as (
  select 'gec_dataset_regressions' as tbl, rec_no as row_no, 'input' as field, input as t from gec_dataset_regressions
  union all select 'gec_dataset_regressions', rec_no, 'correction', correction from gec_dataset_regressions
  union all select 'project', row_no, 'form', form from project
), w as (
  select tbl, row_no, field, t,
    regexp_matches(t, '[\x{AD}\x{34F}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]') as invisible,
    regexp_matches(t, '[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{2010}-\x{2012}\x{2043}\x{2212}\x{FB00}-\x{FB06}\x{FE50}-\x{FE6B}\x{FF01}-\x{FF5E}]') as other_mark,
    nfc_normalize(t) <> t as decomposed,
    list_transform(regexp_extract_all(t, '\pL[\pL\pM]*'), lambda x: [
      regexp_matches(x, '[бвгдёжзийклмнптфцчшщъыьэюяБГДЁЖЗИЙЛПУФЦЧШЩЪЫЬЭЮЯ]')::int, regexp_matches(x, '[bdf-nqrstuvwzDFGIJLNQRSUVWZ]')::int,
      regexp_matches(x, '\p{Cyrillic}')::int, regexp_matches(x, '\p{Latin}')::int, regexp_matches(x, '\p{Greek}')::int]) as words
  from v where t is not null
)
select tbl, row_no, field from w where invisible or other_mark or decomposed
  or len(list_filter(words, lambda x: x[3] + x[4] + x[5] > 1)) > 0
  or len(list_filter(words, lambda x: x[4] = 1 and x[2] = 0)) > 0 and not (len(list_filter(words, lambda x: x[2] = 1)) > 0 and len(list_filter(words, lambda x: x[1] = 1)) = 0)
  or len(list_filter(words, lambda x: x[3] = 1 and x[1] = 0)) > 0 and len(list_filter(words, lambda x: x[2] = 1)) > 0 and len(list_filter(words, lambda x: x[1] = 1)) = 0
  or len(list_filter(words, lambda x: x[5] = 1 and x[3] + x[4] = 0)) > 0 and regexp_matches(t, '\b[ΑΒΕΗΚΜΟΡΤΧΥΙονα]+\b')
"""


@query("p3_found", _TRACES)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that differ from their consistent form."""
    records = charforms.differing(table(spark, sf_dir, "gec_dataset_regressions"), "rec_no", ["input", "correction"], "gec_dataset_regressions")
    return records.unionByName(charforms.differing(table(spark, sf_dir, "project"), "row_no", ["form"], "project"))


_GROUPS = r"""
with recursive d as (select distinct id, author_id, continues_id from rlc_documents where id is not null),
a as (select id, min(id) over (partition by author_id) as other from d where author_id <> 0),
e0 as (select id as u, other as v from a where id <> other union select id, continues_id from d where continues_id in (select id from d) and continues_id <> id),
e as (select u, v from e0 union select v, u from e0),
reach as (select u as id, u as other from e union select r.id, e.v from reach r join e on r.other = e.u),
g as (select id, min(other) as group_id from reach group by id),
s as (
  select id as sentence_id, arg_max(n, coalesce(loaded_at::varchar, '') || lpad(coalesce(n, 0)::varchar, 20, '0')) as n
  from (select id, loaded_at, try_cast(regexp_extract(regexp_replace(document_id, '[\s\x{A0}]+', '', 'g'), '^([0-9]+)(\.0*)?$', 1) as bigint) as n from sentences where id is not null)
  group by id
)
select sentence_id, group_id from s join g on s.n = g.id
"""


@query("p5_found", _GROUPS)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of tied documents with their group."""
    return grouped_splits.grouped_sentences(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "rlc_documents"))


_SPLITS = _GROUPS[: _GROUPS.rindex("s as (")] + r"""
latest as (
  select id as sentence_id, arg_max(struct_pack(n := n, i := sentence_index), coalesce(loaded_at::varchar, '') || lpad(coalesce(n, 0)::varchar, 20, '0')) as x
  from (select id, loaded_at, sentence_index, try_cast(regexp_extract(regexp_replace(document_id, '[\s\x{A0}]+', '', 'g'), '^([0-9]+)(\.0*)?$', 1) as bigint) as n from sentences where id is not null)
  group by id
), placed as (
  select l.sentence_id, coalesce(g.group_id, k.id) as group_id, k.id as document_number, l.x.i as sentence_index
  from latest l left join (select distinct id from d) k on l.x.n = k.id left join g on k.id = g.id
), hashed as (
  select *, ('0x' || substr(md5(case when group_id is not null then 'd' || group_id else 's' || sentence_id end || '|split'), 1, 8))::bigint / 4294967296.0::double as h from placed
), shares as (
  select split_name, sum(share) over w / sum(share) over () as upto, row_number() over w = count(*) over () as is_last from split_shares window w as (order by share desc, split_name)
), bounds as (
  select *, coalesce(lag(upto) over (order by upto, is_last), 0) as low from shares
), result as (select sentence_id, group_id, document_number, sentence_index, split_name from hashed join bounds on h >= low and (h < upto or is_last))
"""


@query("p5_splits", _SPLITS + " select * from result")
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence with its group and split."""
    return grouped_splits.split_sentences(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "rlc_documents"), table(spark, sf_dir, "split_shares"))


_REPORT = " select split_name, count(*) as n_sentences, count(distinct document_number) as n_documents, round(count(*) / sum(count(*)) over (), 4) as share from result group by split_name"


@query("p5_report", _SPLITS + _REPORT)
def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the splits came out."""
    return grouped_splits.split_report(p5_splits(spark, sf_dir))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text that was decoded with a wrong encoding."""
    return encodings.garbled(table(spark, sf_dir, "documents")).select("doc_id")


@query("p8_restored")
def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with the encodings involved and the text as far as it can be restored."""
    return encodings.garbled(table(spark, sf_dir, "documents"))


@query("p6_packed")
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every piece of every text, for each capacity."""
    windows = packing.stated_windows(table(spark, sf_dir, "token_windows"))
    return packing.pack(packing.token_counts(table(spark, sf_dir, "documents")), windows).withColumnRenamed("key", "doc_id")


@query("p6_fill")
def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled."""
    return packing.fill_report(p6_packed(spark, sf_dir), packing.stated_windows(table(spark, sf_dir, "token_windows")))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the test items that leaked into them."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


@query("p7_leaks")
def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks with the number of the item's words that the passage has."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))

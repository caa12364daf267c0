"""Queries of tokens and of every surface, typography and orthography detector, over the whole documents table.

Where documents hold no such error, one is put into the text first by a plain replacement, the same in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.functions.text import byte_offset, kind, token_rows
from slovotok.operators import detectors
from slovotok.operators.checking import check, located, raw_issues
from slovotok.plans import query
from slovotok.plans.rules import RULES, Rule, RuleFilter, plan, rule_rows
from slovotok.session import table

_WS = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_AL = r"\p{L}\p{Nl}"
_P = r"«»—…“”„!-/:-@\[-`{-~"
_TOKEN = rf"[{_WS}]+|[0-9０-９]+|[{_AL}\-‑–']+|[{_P}–]+|[^{_WS}0-9０-９{_AL}\-‑–'{_P}]+"


def _source(replaced: list[tuple[str, str]]) -> str:
    text = "text"
    for a, b in replaced:
        text = f"replace({text}, '{a}', '{b}')"
    return f"src as (select doc_id, {text} as text from documents where text is not null and text <> '')"


_TOK = f""", tok0 as (select doc_id, regexp_extract_all(text, '{_TOKEN.replace("'", "''")}') as l from src),
tok1 as (select doc_id, unnest(l) as t, generate_subscripts(l, 1) as idx from tok0),
tok as (select *, case when regexp_matches(t, '^[{_WS}]') then 'whitespace' when regexp_matches(t, '^[0-9０-９]') then 'number'
  when regexp_matches(t, '^[{_AL}\\-‑–'']') then 'word' when regexp_matches(t, '^[{_P}–]') then 'punctuation' else 'other' end as k,
  (sum(length(t)) over (partition by doc_id order by idx) - length(t))::int as s from tok1),
near as (select *, (s + length(t))::int as e, lead(t) over w as n1, lead(k) over w as nk1, lead(t, 2) over w as n2, lead(k, 2) over w as nk2, lag(t) over w as p1, lag(k) over w as pk1, lag(t, 2) over w as p2, lag(k, 2) over w as pk2
  from tok window w as (partition by doc_id order by idx))"""
_CH = f""", ch0 as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from src),
ch as (select *, lag(c) over w as p, lead(c) over w as n, lag(c, 2) over w as pp from ch0 window w as (partition by doc_id order by i))"""
_CASE = "case when not regexp_matches({t}, '\\p{{Ll}}') then upper({r}) when regexp_matches({t}, '^\\p{{Lu}}') then upper({r}[1]) || {r}[2:] else {r} end"
_NORM = "lower(regexp_replace({x}, '[^\\p{{L}}\\p{{Nl}}-]', '', 'g'))"


def _scan(pattern: str, text: str = "text") -> str:
    """Spans of the matches of a pattern without looking around: m, s, e."""
    p = pattern.replace("'", "''")
    return f""", sc0 as (select doc_id, text, regexp_extract_all({text}, '{p}') as ms, string_split_regex({text}, '{p}') as gs from src),
sc as (select doc_id, text, ms[k] as m, (list_sum([length(g) for g in gs[1:k]]) + coalesce(list_sum([length(x) for x in ms[1:k-1]]), 0))::int as s
  from sc0, lateral (select unnest(range(1, len(ms) + 1)) as k))"""


def _values(forms: list[str]) -> str:
    return ", ".join(f"('{a.strip()}', '{b.strip()}')" for a, _, b in (f.partition("=>") for f in forms))


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql(rule: Rule) -> str | None:
    """The SQL of a rule's issues over src: doc_id, s, e, replacement."""
    p, k = rule.params, rule.kind
    line = "not contains(n1, chr(10))"
    if k == "multiple_spaces":
        return _scan(rf"[\t\x0B\x0C \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]{{2,}}") + " select doc_id, s, (s + length(m))::int as e, ' ' as replacement from sc"
    if k == "no_whitespace_before_punctuation":
        return _TOK + " select doc_id, s, (e + length(n1))::int as e, n1 as replacement from near where k = 'whitespace' and not contains(t, chr(10)) and nk1 = 'punctuation' and regexp_full_match(n1, '[,.;:!?]+')"
    if k == "missing_whitespace_after_punctuation":
        return _CH + rf""" select doc_id, (i - 1)::int as s, i::int as e, ' ' || c as replacement from ch where regexp_matches(c, '[{_AL}\pN]') and (p in (',', ';', ':', '!', '?', '…')
          or p = '.' and not (regexp_matches(pp, '[0-9]') and regexp_matches(c, '[0-9]')) and not (regexp_matches(pp, '[{_AL}]') and regexp_matches(c, '\p{{Lu}}')) or p = '.' and pp is null)"""
    if k == "repeated_word":
        return _TOK + " select doc_id, (s - length(p1) - length(p2))::int as s, e, t as replacement from near where k = 'word' and pk1 = 'whitespace' and pk2 = 'word' and lower(p2) = lower(t)"
    if k == "missing_sentence_terminal":
        trimmed = f"regexp_replace(text, '[{_WS}]+\\z', '')"
        return f" select doc_id, length({trimmed})::int as s, length({trimmed})::int as e, '.' as replacement from src where {trimmed} <> '' and not regexp_matches({trimmed}, '[.!?…]\\z')"
    if k == "unpaired_delimiters":
        pairs = [x.split() if " " in x else list(x) for x in p["pairs"]]
        opens, closes = "".join(a for a, _ in pairs), "".join(b for _, b in pairs)
        wanted = f"translate(ds[i + 1].m, '{closes}', '{opens}')"
        good = f"len(st) > 0 and st[-1].m = {wanted}"
        return _CH + f""", ds0 as (select doc_id, list(struct_pack(m := c, s := (i - 1)::int) order by i) as ds from ch where contains('{opens + closes}', c) group by doc_id),
        walk as (with recursive w as (select doc_id, ds, 0 as i, ds[:0] as st, ds[:0] as bad from ds0 union all
          select doc_id, ds, i + 1, case when contains('{opens}', ds[i + 1].m) then list_append(st, ds[i + 1]) else st[:len(st) - 1] end,
            case when contains('{opens}', ds[i + 1].m) or {good} then bad else list_append(bad, ds[i + 1]) end from w where i < len(ds)) select * from w)
        select doc_id, x.s as s, (x.s + 1)::int as e, null::varchar as replacement from (select doc_id, unnest(list_concat(bad, st)) as x from walk where i = len(ds))"""
    if k == "unbalanced_quotes":
        return _CH + """, q as (select doc_id, i, c, sum(case c when '«' then 1 else -1 end) over (partition by doc_id order by i) as d from ch where c in ('«', '»')),
          m as (select *, coalesce(min(d) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as low, coalesce(min(d) over (partition by doc_id order by i rows between 1 following and unbounded following), 1000000000) as later from q)
          select doc_id, (i - 1)::int as s, i::int as e, null::varchar as replacement from m where c = '»' and d < least(low, 0) or c = '«' and later >= d"""
    if k == "space_after_opening_punctuation":
        return _CH + " select doc_id, (i - 1)::int as s, i::int as e, '' as replacement from ch where c in (' ', chr(9)) and p in ('(', '[', '{', '«')"
    if k == "space_before_closing_quote":
        return _CH + " select doc_id, (i - 1)::int as s, i::int as e, '' as replacement from ch where c in (' ', chr(9)) and n = '»'"
    if k == "hyphen_instead_of_dash":
        return _scan(" - ") + " select doc_id, s, (s + length(m))::int as e, ' — ' as replacement from sc"
    if k == "dash_spacing":
        return _CH + f" select doc_id, (i - 1)::int as s, i::int as e, ' — ' as replacement from ch where c = '—' and (not coalesce(regexp_matches(p, '[{_WS}]'), false) or not coalesce(regexp_matches(n, '[{_WS}]'), false))"
    if k == "multiple_punctuation":
        return _scan(r"!{2,}|\?{2,}") + " select doc_id, s, (s + length(m))::int as e, m[1] as replacement from sc"
    if k == "regex":
        return _scan(r",[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*,") + " select doc_id, s, (s + length(m))::int as e, ',' as replacement from sc"
    if k == "number_unit_spacing":
        return _TOK + f" select doc_id, e as s, (e + length(n1))::int as e, ' ' || n1 as replacement from near where k = 'number' and nk1 = 'word' and {_NORM.format(x='n1')} in {_in(p['units'])}"
    if k == "clitic_hyphen_missing":
        bases, particles = detectors.CLITICS[p["group"]]
        return _TOK + f" select doc_id, s, (e + length(n1) + length(n2))::int as e, t || '-' || n2 as replacement from near where k = 'word' and nk1 = 'whitespace' and {line} and nk2 = 'word' and lower(t) in {_in(bases)} and lower(n2) in {_in(particles)}"
    if k == "separate_particle_hyphenated":
        return _TOK + " select doc_id, (e - length(m))::int as s, e, regexp_replace(m, '-([^-]*)$', ' \\1') as replacement from (select *, regexp_extract(t, '(?i)[а-яё]+-(?:же|бы|ли)$') as m from near where k = 'word') where m <> ''"
    if k == "phraseological_coordination_comma":
        rows = ", ".join("('" + "', '".join(x.split()) + "')" for x in detectors.PAIRED)
        fold = "replace(lower({0}), 'ё', 'е')"
        return _TOK + f""", w as (select doc_id, t, lead(t) over o as n1, lead(t, 2) over o as n2, lead(t, 3) over o as n3, lead(t, 4) over o as n4, lead(s, 2) over o as mark from tok where k <> 'whitespace' window o as (partition by doc_id order by idx))
          select doc_id, mark::int as s, (mark + 1)::int as e, '' as replacement from w where n2 = ',' and lower(n3) = lower(t) and ({fold.format('t')}, {fold.format('n1')}, {fold.format('n4')}) in (values {rows})"""
    if k == "mixed_alphabet_word":
        return _TOK + " select doc_id, s, e, null::varchar as replacement from near where k = 'word' and regexp_matches(t, '[A-Za-z]') and regexp_matches(t, '[\\x{400}-\\x{52F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}]')"
    if k == "confusable_tokens":
        return _TOK + f", v(bad, good) as (values {_values(p['forms'])}) select doc_id, s, e, {_CASE.format(t='t', r='good')} as replacement from near join v on bad = {_NORM.format(x='t')} where k = 'word'"
    if k == "phrase_map":
        parts = []
        for f in p["forms"]:
            bad, _, good = (x.strip() for x in f.partition("=>"))
            parts.append(f"select doc_id, text, '{bad}' as bad, '{good}' as good from src where contains(lower(text), '{bad}')")
        return f""", f as ({' union all '.join(parts)}), g as (select *, string_split(lower(text), bad) as gs from f),
          h as (select doc_id, text, bad, good, (list_sum([length(x) for x in gs[1:k]]) + (k - 1) * length(bad))::int as s from g, lateral (select unnest(range(1, len(gs))) as k))
          select doc_id, s, (s + length(bad))::int as e, good as replacement from h where (s = 0 or not regexp_matches(text[s], '[{_AL}]')) and not regexp_matches(coalesce(text[s + length(bad) + 1], ''), '[{_AL}]')"""
    if k == "zhi_shi_cha_shcha":
        fixed = "lower(t)"
        for a, b in (("жы", "жи"), ("шы", "ши"), ("чя", "ча"), ("щя", "ща"), ("чю", "чу"), ("щю", "щу")):
            fixed = f"replace({fixed}, '{a}', '{b}')"
        return _TOK + f" select doc_id, s, e, {_CASE.format(t='t', r='f')} as replacement from (select *, {fixed} as f from near where k = 'word') where f <> lower(t) and {_NORM.format(x='t')} not in {_in(p['exceptions'])}"
    if k == "tsya_heuristic":
        return _TOK + f""", w as (select doc_id, s, s + length(t) as e, t, {_NORM.format(x='t')} as x, {_NORM.format(x='lag(t) over (partition by doc_id order by idx)')} as y from tok where k = 'word')
          select doc_id, s, e::int as e, case when y in {_in(p['infinitive_triggers'])} and ends_with(x, 'тся') then t[1:length(t) - 3] || 'ться' else t[1:length(t) - 4] || 'тся' end as replacement
          from w where y in {_in(p['infinitive_triggers'])} and ends_with(x, 'тся') or y in {_in(p['finite_subjects'])} and ends_with(x, 'ться')"""
    if k == "pol_compound_hyphen_missing":
        return _TOK + f" select doc_id, s, (e + length(n1) + length(n2))::int as e, t || '-' || n2 as replacement from near where k = 'word' and lower(t) = 'пол' and nk1 = 'whitespace' and {line} and nk2 = 'word' and (regexp_matches(n2, '^\\p{{Lu}}') or regexp_matches(lower(n2), '^[аеёиоуыэюял]'))"
    if k == "prefix_final_z_s_assimilation":
        from slovotok.operators.word_formation import ROOTS

        rows = []
        for i, z in enumerate(detectors.ALTERNATING):
            s = z[:-1] + "с"
            rows += [f"({2 * i}, '{z}', '{s}', '{detectors.VOICELESS}')", f"({2 * i + 1}, '{s}', '{z}', '{detectors.VOICED_OR_VOWEL}')"]
        return _TOK + f""", v(o, wrong, good, after) as (values {', '.join(rows)}),
          h as (select doc_id, s, e, t, arg_min(good || lower(t)[length(wrong) + 1:], o) as f from near join v on starts_with(lower(t), wrong) and contains(after, lower(t)[length(wrong) + 1])
            where k = 'word' and lower(t)[length(wrong) + 1] <> '' and regexp_matches(lower(t)[length(wrong) + 1:], '^(?:{'|'.join(ROOTS)})') group by all)
          select doc_id, s, e, {_CASE.format(t='t', r='f')} as replacement from h"""
    return None


# What is put into the documents for rules that would find nothing in them.
_INJECTED = {
    "clitic_hyphen_missing": [("-то ", " то "), (" уже ", " я то "), (" ещё ", " давай ка ")],
    "separate_particle_hyphenated": [(" на ", "-бы ")],
    "confusable_tokens": [(" уже ", " незнаю "), (" ещё ", " Вобщем "), (" тихо ", " ЩАС "), (" снова ", " ниочём ")],
    "phrase_map": [
        (" уже ", " из за "), (" ещё ", " кое кто "), (" тихо ", " в течении дня "), (" снова ", " По приезду "), (" утром ", " оба стороны "),
        (" весной ", " главная суть "), (" осенью ", " согласно приказа "), (" вчера ", " ввиду этого обстоятельство "),
    ],
    "tsya_heuristic": [(" уже ", " надо учится "), (" ещё ", " он учиться ")],
    "number_unit_spacing": [("стр. ", "5кг "), (" в ", " 10мин ")],
    "pol_compound_hyphen_missing": [(" уже ", " пол яблока "), (" ещё ", " пол Москвы ")],
    "prefix_final_z_s_assimilation": [("рассказ", "разсказ"), ("Рассказ", "РАЗсказ"), (" уже ", " расбить бесименный ")],
    "phraseological_coordination_comma": [(" уже ", " ни рыба, ни мясо "), (" ещё ", " и Смех , и горе ")],
    "regex": [(", ", ",, "), (";", ", ,")],
    "missing_whitespace_after_punctuation": [(", ", ","), ("стр. ", "стр.")],
    "no_whitespace_before_punctuation": [(", ", " , ")],
    "multiple_spaces": [(". ", ".  ")],
    "hyphen_instead_of_dash": [(" — ", " - ")],
    "introductory_phrase_comma": [("Конечно, ", "Конечно "), ("Во-первых, ", "Во-первых ")],
}


def _documents(spark: SparkSession, sf_dir: str, replaced: list[tuple[str, str]]) -> DataFrame:
    text = F.col("text")
    for a, b in replaced:
        text = F.replace(text, F.lit(a), F.lit(b))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _detector_query(rule: Rule) -> None:
    replaced = _INJECTED.get(rule.kind, [])
    sql = _sql(rule)

    @query("d_" + rule.rule_id.removeprefix("ru.").replace(".", "_"), f"with {_source(replaced)}{sql}" if sql else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return raw_issues(_documents(spark, sf_dir, replaced), [rule]).select("doc_id", "s", "e", "replacement")


for _r in RULES:
    if _r.kind in detectors.REGISTRY and detectors.REGISTRY[_r.kind].level != "lexicon":
        _detector_query(_r)


@query("tokens", f"with {_source([])}{_TOK} select doc_id, (idx - 1)::int as idx, t as token, k as kind, s as start_c, e as end_c, strlen(t)::int as n_bytes from near")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens of all documents with their kinds and spans."""
    rows = token_rows(table(spark, sf_dir, "documents").filter("text <> ''"), ["doc_id"])
    return rows.select("doc_id", "idx", F.col("t").alias("token"), kind(F.col("t")).alias("kind"), F.col("s").alias("start_c"), F.col("e").alias("end_c"), F.octet_length("t").alias("n_bytes"))


@query("token_statistics", f"with {_source([])}{_TOK} select k as kind, count(*) as n_tokens, sum(strlen(t))::bigint as n_bytes, count(distinct t) as n_distinct from tok group by k")
def token_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, bytes and distinct tokens of each kind."""
    rows = token_rows(table(spark, sf_dir, "documents").filter("text <> ''"), ["doc_id"]).withColumn("kind", kind(F.col("t")))
    # Counted per distinct token first, so that the distinct count needs no second shuffle of tokens.
    by = rows.groupBy("kind", "t").agg(F.count("*").alias("n"))
    return by.groupBy("kind").agg(F.sum("n").alias("n_tokens"), F.sum(F.col("n") * F.octet_length("t")).alias("n_bytes"), F.count("*").alias("n_distinct"))


_REPEATED = next(r for r in RULES if r.kind == "repeated_word")


@query(
    "located_issues",
    f"""with {_source([])}{_TOK}, h as (select doc_id, (s - length(p1) - length(p2))::int as s, e from near where k = 'word' and pk1 = 'whitespace' and pk2 = 'word' and lower(p2) = lower(t)),
    j as (select h.*, text, text[1:s] as a, text[1:e] as b from h join src using (doc_id))
    select doc_id, strlen(a)::int as start_b, strlen(b)::int as end_b, (length(a) - length(replace(a, chr(10), '')) + 1)::int as line, (length(string_split(a, chr(10))[-1]) + 1)::int as "column",
      (length(b) - length(replace(b, chr(10), '')) + 1)::int as end_line, (length(string_split(b, chr(10))[-1]) + 1)::int as end_column,
      regexp_replace(regexp_extract(a, '[^.!?\\n]*$') || text[s + 1:e] || regexp_extract(text[e + 1:], '^[^.!?\\n]*[.!?\\n]?'), '^[{_WS}]+|[{_WS}]+$', '', 'g') as excerpt from j""",
)
def located_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words with lines, columns, byte spans and excerpts."""
    return located(raw_issues(table(spark, sf_dir, "documents"), [_REPEATED])).select("doc_id", "start_b", "end_b", "line", "column", "end_line", "end_column", "excerpt")


@query("check_documents")
def check_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues of all documents under the strict profile."""
    return check(table(spark, sf_dir, "documents"), chosen=RuleFilter("strict"))


@query("check_sentences")
def check_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by rule and severity of all learner sentences under the default profile."""
    rows = table(spark, sf_dir, "sentences").select(F.col("id").alias("doc_id"), "text")
    return check(rows).groupBy("rule_id", "severity").agg(F.count("*").alias("n_issues"))


@query(
    "suppressed_issues",
    f"""with {_source([])}{_TOK}, h as (select doc_id, (s - length(p1) - length(p2))::int as s from near where k = 'word' and pk1 = 'whitespace' and pk2 = 'word' and lower(p2) = lower(t)),
    j as (select doc_id, text[1:h.s] as a from h join src using (doc_id)), l as (select doc_id, (length(a) - length(replace(a, chr(10), '')) + 2)::int as line from j)
    select doc_id, line, line = 2 as suppressed from l""",
)
def suppressed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated words, where a directive before each text turns the rule off for the text's first line."""
    rows = table(spark, sf_dir, "documents").filter("text <> ''")
    rows = rows.select("doc_id", F.concat(F.lit("<!-- lint-disable-next-line ru.grammar.repeated_word -->\n"), "text").alias("text"))
    found = check(rows, chosen=RuleFilter(include=("ru.grammar.repeated_word",)), keep_suppressed=True)
    return found.select("doc_id", "line", "suppressed")


def _rule_values() -> str:
    rows = ", ".join(f"('{r.rule_id}', '{r.kind}', '{r.domain}', '{r.level}', '{r.severity}', {str(r.default_safe).lower()})" for r in RULES)
    return f"r(rule_id, kind, domain, level, severity, default_safe) as (values {rows})"


@query("rule_kinds", f"with {_rule_values()} select kind, count(*) as n_rules, count(*) filter (where default_safe) as n_default from r group by kind")
def rule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by detector kind."""
    return rule_rows(spark).groupBy("kind").agg(F.count("*").alias("n_rules"), F.count_if("default_safe").alias("n_default"))


@query("execution_plan", f"with {_rule_values()} select rule_id, domain, severity from r where default_safe and kind in {_in([k for k in detectors.REGISTRY])}")
def execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that run under the default profile."""
    made = plan(RULES, RuleFilter(), detectors.REGISTRY)
    return rule_rows(spark, made.rules).select("rule_id", "domain", "severity")


@query("issues_by_domain")
def issues_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of documents by domain and rule, with subtotals."""
    found = check(table(spark, sf_dir, "documents"), chosen=RuleFilter("strict"))
    return found.withColumn("domain", F.split("rule_id", r"\.")[1]).rollup("domain", "rule_id").agg(F.count("*").alias("n_issues"))

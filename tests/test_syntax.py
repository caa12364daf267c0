import json

import pytest

from slovotok.operators.checking import check
from slovotok.operators.document_context import abbreviations, glossary, structure
from slovotok.operators.sentences import clause_boundaries, introductory_gaps, sentence_spans, zones
from slovotok.plans.rules import RULES, RuleFilter, plan
from slovotok.sinks import reports
from slovotok.sources.rules import RuleFileError, load_rules


def parts(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_sentences():
    assert parts("  Раз. Два") == ["Раз.", "Два"]
    assert parts("Живёт в г. Орле давно... Потом дождь. См. также том 2.5 тут.") == ["Живёт в г. Орле давно...", "Потом дождь.", "См. также том 2.5 тут."]
    assert parts("Он сказал (вот так! да) и ушёл.") == ["Он сказал (вот так! да) и ушёл."]
    assert parts("«Кто там?» Он встал. «Где?» — спросил он.") == ["«Кто там?»", "Он встал.", "«Где?» — спросил он."]
    assert parts("А. С. Пушкин. Да") == ["А. С. Пушкин.", "Да"]
    assert parts("Раз\nдва") == ["Раз\n", "два"] and parts("") == [] and parts(" \n ") == []


def test_zones():
    assert zones("(а [б] в)") == [(0, 9, "parenthetical"), (3, 6, "parenthetical")]
    assert zones('«а "б" в') == [(3, 6, "direct_speech")]


def kinds(text):
    return [(m, k) for _, _, m, k, _ in clause_boundaries(text)]


def test_clause_boundaries():
    assert kinds("Знаю что он тут.") == [("что", "before_marker")]
    assert kinds("Знаю, что он тут.") == [("что", "punctuated")]
    assert kinds("Ушёл потому что устал.") == [("потому что", "before_marker")]
    assert kinds("Что делать?") == [("что", "sentence_start")]
    assert kinds("Дом который стоит.") == [("который", "ambiguous")]
    assert kinds("Он тут и если можно.") == [("если", "ambiguous")]
    assert kinds("«Знаю что он»") == [("что", "suppressed_safe_zone")]


def test_introductory_words():
    phrases = ("конечно", "во-первых", "своё")
    assert introductory_gaps("Конечно да. Конечно, нет. Я конечно тут.", phrases) == [(7, 8, ", ")]
    assert introductory_gaps("Во-первых это так. Во-первых, так.", phrases) == [(10, 11, ", э")]
    assert introductory_gaps("Своё дело.", phrases) == []


def test_structure_and_glossary(spark):
    text = "# Глоссарий\n- слово — единица\n* знак: точка\n\nДалее\n1. пункт."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    row = structure(df).filter("doc_id = 1").first()
    assert [h["title"] for h in row["headings"]] == ["Глоссарий", "Далее"] and [i["marker"] for i in row["items"]] == ["dash", "asterisk", "numbered"]
    assert row["mixed_markers"] and row["paragraphs"] == 2
    assert sorted((r["term"], r["definition"]) for r in glossary(df).collect()) == [("знак", "точка"), ("слово", "единица")]


def test_abbreviations(spark):
    df = spark.createDataFrame([(1, "Странное общество (СО) открылось. СО и НИИ, НИИ.")], "doc_id int, text string")
    assert sorted((r["short"], r["frequency"], r["expansion"]) for r in abbreviations(df).collect()) == [("НИИ", 2, None), ("СО", 2, "Странное общество")]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "Он он пришёл.\nда!!")], "doc_id int, text string")
    issues = check(df, chosen=RuleFilter("strict"))
    made = json.loads(reports.document_json(issues).first()["json"])
    assert [i["rule_id"] for i in made] == ["ru.grammar.repeated_word", "ru.orthography.sentence_initial_capital", "ru.style.multiple_question_exclamation_marks"]
    assert made[0]["span"] == {"start": 0, "end": 9} and made[2]["start"] == {"line": 2, "column": 3}
    for form in ("json", "text", "parquet"):
        reports.write_issues(issues, str(tmp_path / form), form)
    assert spark.read.json(str(tmp_path / "json")).count() == 3 and any(r[0].startswith("1:1:1: ") for r in spark.read.text(str(tmp_path / "text")).collect())
    planned = plan(RULES, RuleFilter(), ["regex"])
    assert json.loads(reports.plan_json(planned))["planned"] == 1 and len(reports.plan_lines(planned)) == 45 and len(reports.rule_list(list(RULES))) == len(RULES)


def test_rule_files(tmp_path):
    rule = {"id": "ru.style.own", "domain": "style", "level": "basic", "status": "implemented", "severity": "info", "source_refs": ["own"], "detector": {"kind": "regex", "pattern": "x", "message": "m"}}
    (tmp_path / "a.json").write_text(json.dumps({"source_refs": [{"id": "own"}], "rules": [rule]}))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.json").write_text("{}")
    loaded = load_rules(str(tmp_path))
    assert [(r.rule_id, r.params) for r in loaded] == [("ru.style.own", {"pattern": "x"})]
    for change in ({"severity": "bad"}, {"source_refs": ["none"]}, {"detector": {}}):
        (tmp_path / "a.json").write_text(json.dumps({"source_refs": [{"id": "own"}], "rules": [rule | change]}))
        with pytest.raises(RuleFileError):
            load_rules(str(tmp_path))
    (tmp_path / "a.json").write_text(json.dumps({"source_refs": [{"id": "own"}], "rules": [rule, rule]}))
    with pytest.raises(RuleFileError):
        load_rules(str(tmp_path))


def test_inspection(spark):
    from slovotok.operators.inspection import fact_counts, islands

    df = spark.createDataFrame([(1, "Он сказал (тихо) «да». Всё."), (2, None), (3, "")], "doc_id int, text string")
    text = "Он сказал (тихо) «да». Всё."
    got = [(r["sentence"], r["kind"], text[r["s"] : r["e"]]) for r in islands(df).filter("doc_id = 1").orderBy("n").collect()]
    assert got == [(1, "sentence", "Он сказал "), (1, "parenthetical", "(тихо)"), (1, "direct_speech", "«да»"), (1, "sentence", "."), (2, "sentence", "Всё.")]
    row = fact_counts(df).filter("doc_id = 1").first()
    assert (row["words"], row["sentences"], row["parentheticals"], row["direct_speech"], row["islands"]) == (5, 2, 1, 1, 5)
    assert fact_counts(df).filter("doc_id = 3").first()["tokens"] == 0


def test_coordination_groups():
    from slovotok.operators.coordination import groups

    get = lambda t: [(m, c, r) for _, _, m, c, r in groups(t)]
    assert get("мама и папа") == [(["мама", "папа"], ["и"], False)]
    assert get("умный, быстрый и надёжный прибор") == [(["умный", "быстрый", "надёжный"], [",", "и"], False)]
    assert get("ни дом, ни сад") == [(["дом", "сад"], [", ни"], True)]
    assert get("дом (и сад). Лес") == [] and get("") == []

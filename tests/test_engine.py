import io
import json

import pytest

from slovotok import cli
from slovotok.engine import Checker, check_text
from slovotok.operators import coordination, ledger, links, unification
from slovotok.plans.rules import RULES, RuleFilter
from slovotok.sources import lexicon, registry

BAD = "Он он пришел , и сказал - да"


def test_checker_is_built_step_by_step(spark):
    checker = Checker().with_filter(include=("ru.grammar.repeated_word",))
    assert [i["rule_id"] for i in checker.check_text(spark, BAD)] == ["ru.grammar.repeated_word"]
    assert checker.with_suppression("ru.grammar.repeated_word").check_text(spark, BAD) == []
    assert len(check_text(spark, BAD)) >= 3 and check_text(spark, "") == []
    strict = Checker().with_filter(profile="strict").with_capabilities("semantics")
    assert "semantics" in strict.capabilities and len(strict.plan().rules) >= len(checker.plan().rules)


def run(spark, *argv):
    out = io.StringIO()
    return cli.main(list(argv), spark, out), out.getvalue().splitlines()


def test_commands_without_a_session():
    code, lines = run(None, "list-rules", "--all")
    assert code == 0 and len(lines) == len(RULES)
    assert len(run(None, "list-rules")[1]) < len(RULES)
    assert json.loads("\n".join(run(None, "plan", "--profile", "strict", "--format", "json")[1]))["planned"] > 0
    assert run(None, "validate")[1][-1].startswith(f"{len(RULES)} rules")
    assert cli.parser().parse_args(["plan", "--profile", "Typography-Only", "--severity", "error,warning"]).profile == ("typography_only",)
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["plan", "--domain", "prices"])


def test_check_command(spark, tmp_path):
    (tmp_path / "a.txt").write_text(BAD, encoding="utf-8")
    code, lines = run(spark, "check", str(tmp_path / "a.txt"), "--timings")
    assert any("ru.grammar.repeated_word" in x for x in lines) and code in (0, 1)
    _, lines = run(spark, "check", str(tmp_path / "a.txt"), "--format", "json", "--include", "ru.grammar.repeated_word")
    assert [i["rule_id"] for i in json.loads(lines[0])["issues"]] == ["ru.grammar.repeated_word"]


def test_debug_command(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Он знал (и молчал), что дождь, снег и ветер пройдут. " * 60, encoding="utf-8")
    report = json.loads(run(spark, "debug", str(tmp_path / "a.txt"))[1][0])
    assert report["counts"]["sentences"] == len(report["sentences"]) == 60 and report["counts"]["tokens"] > len(report["tokens"]) == 256
    assert report["zones"][0]["kind"] == "parenthetical" and report["clause_markers"][0]["marker"] == "что" and report["counts"]["slots"] > len(report["slots"]) == 256
    assert report["coordination_groups"][0]["members"] == ["дождь", "снег", "ветер"]
    from slovotok.operators.inspection import debug_reports

    docs = spark.createDataFrame([(1, ""), (2, None)], "doc_id int, text string")
    assert [json.loads(r["report"])["counts"]["tokens"] for r in debug_reports(docs).collect()] == [0]


def test_convert_command_and_round_trip(spark, tmp_path):
    source, target = tmp_path / "in.csv", str(tmp_path / "out")
    source.write_text("form,lemma,pos,grammemes\nмира,мир,NOUN,inan|masc|gent|sing,1,2,,\nмир,мир,NOUN,inan|masc|nomn|sing,1,2,,\nмир,мир,NOUN,inan|masc|nomn|sing,1,2,,\n", encoding="utf-8")
    assert run(spark, "convert", "opencorpora", str(source), target)[0] == 0
    rows = lexicon.read_project(spark.read.text(target)).orderBy("form").collect()
    assert [(r["form"], r["case"], r["number"], r["gender"], r["lemma_id"]) for r in rows] == [("мир", "nominative", "singular", "masculine", "1"), ("мира", "genitive", "singular", "masculine", "1")]


def test_registry_of_datasets(spark, tmp_path):
    (tmp_path / "pairs.tsv").write_text("1\tr\tплохо\tхорошо\n", encoding="utf-8")
    listed = [{"name": "own", "importer": "pairs", "path": "pairs.tsv", "output": "out/own"}, {"name": "gone", "importer": "m2", "path": "none", "output": "out/gone"}]
    (tmp_path / "registry.json").write_text(json.dumps(listed), encoding="utf-8")
    datasets = registry.read_registry(str(tmp_path / "registry.json"))
    assert registry.import_all(spark, datasets, dry_run=True) == [("own", "planned", 0), ("gone", "planned", 0)] and not (tmp_path / "out").exists()
    assert registry.import_all(spark, datasets, then=lambda r: r.selectExpr("count(*) as n")) == [("own", "written", 1), ("gone", "missing", 0)]
    assert spark.read.json(str(tmp_path / "out/own")).first()["correction"] == "хорошо" and spark.read.json(str(tmp_path / "out/own-report")).first()["n"] == 1
    assert run(spark, "import", str(tmp_path / "registry.json"), "--dry-run")[1] == ["own\tplanned\t0", "gone\tplanned\t0"]
    for bad, message in (({"name": "x", "importer": "zip", "path": "p", "output": "o"}, "unknown importer"), ({"name": "x", "importer": "m2"}, "no path, output")):
        (tmp_path / "registry.json").write_text(json.dumps({"datasets": [bad]}), encoding="utf-8")
        with pytest.raises(ValueError, match=message):
            registry.read_registry(str(tmp_path / "registry.json"))


def test_counts_and_ledger(spark):
    texts = [(1, BAD), (2, "да да <!-- lint-disable-line ru.grammar.repeated_word -->"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    chosen = RuleFilter(include=("ru.grammar.repeated_word", "ru.grammar.adj_noun_agreement"))
    got = {r["rule_id"]: r for r in ledger.rule_counts(docs, chosen=chosen).collect()}["ru.grammar.repeated_word"]
    assert (got["n_raw"], got["n_suppressed"], got["n_emitted"], got["skipped"]) == (2, 1, 1, None)
    rows = {(r["doc_id"], r["n"], r["status"], r["family"]) for r in ledger.diagnostic_ledger(docs, chosen=chosen).collect()}
    assert rows == {(1, 1, "emitted", "surface"), (2, 1, "suppressed", "surface")}
    assert ledger.diagnostic_ledger(docs.limit(0), chosen=chosen).count() == 0
    assert {c[0] for c in ledger.contracts()} == {r.rule_id for r in RULES}


def test_slots_between_words(spark):
    slots = {(x[2], x[3]): x for x in links.document_slots("Конечно он пришёл, а Москва — Столица (или нет). «Да» сказал он потому что устал. Купил чай, хлеб, сыр")}
    assert slots["Конечно", "он"][6] == ["comma"] and slots["Конечно", "он"][8] == "strong"
    assert slots["Москва", "Столица"][5:7] == (["dash"], ["dash"])
    assert "unsafe_boundary" in slots["Столица", "или"][9] and "parenthesis_boundary" in slots["или", "нет"][9] and slots["или", "нет"][8] == "unsafe"
    assert slots["Да", "сказал"][9] == ["direct_speech_boundary", "unsafe_boundary"] and slots["он", "потому"][6] == ["comma"]
    assert slots["чай", "хлеб"][5:8] == (["comma"], ["comma"], ["colon"])
    docs = spark.createDataFrame([(1, "Конечно он пришёл."), (2, None), (3, ""), (4, "слово")], "doc_id int, text string")
    rows = links.punctuation_slots(docs)
    assert rows.count() == 2 and [r["left_word"] for r in links.missing_marks(rows).collect()] == ["Конечно"]


def test_members_share_cases(spark):
    docs = spark.createDataFrame([(1, "чай, хлеб и сыр")], "doc_id int, text string")
    readings = spark.createDataFrame([("чай", ["nominative", "accusative"], ["singular"]), ("хлеб", ["accusative", "genitive"], ["singular", "plural"])], "word string, cases array<string>, numbers array<string>")
    got = coordination.shared_values(coordination.coordination_groups(docs), readings).first()
    assert (got["cases"], got["numbers"]) == (["accusative"], ["singular"])


def test_unification_against_plain_code(spark):
    import itertools

    values = list(itertools.product(("nominative", "genitive", None), ("singular", "plural", None), ("masculine", "feminine", "common", None)))

    def state(a, b):
        plural = "plural" in (a[1], b[1])
        out = ["unknown" if None in (x, y) else "match" if x == y else "conflict" for x, y in zip(a[:2], b[:2])]
        gender = "match" if plural else "unknown" if None in (a[2], b[2]) else "match" if a[2] == b[2] or "common" in (a[2], b[2]) else "conflict"
        out.append(gender)
        return "conflict" if "conflict" in out else "unknown" if "unknown" in out else "match"

    rows = [(i, [a], [b]) for i, (a, b) in enumerate(itertools.product(values, values))] + [(-1, [values[0], values[20]], [values[0]]), (-2, [], [values[0]])]
    kind = "array<struct<case:string,number:string,gender:string>>"
    df = spark.createDataFrame(rows, f"i int, a {kind}, b {kind}").select("i", "a", "b", unification.unified(df_col("a"), df_col("b")).alias("u"))
    for r in df.collect():
        if r["i"] >= 0:
            assert r["u"]["result"] == state(tuple(r["a"][0]), tuple(r["b"][0])), r
        else:
            assert (r["u"]["result"] if r["u"] else None) == {-1: "match", -2: None}[r["i"]]


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_frames(spark):
    docs = spark.createDataFrame([(1, "две книги, пять книг; две книг и без книги, к книги\nк книге"), (2, None)], "doc_id int, text string")
    forms = [("книги", "genitive", "singular"), ("книги", "nominative", "plural"), ("книг", "genitive", "plural"), ("книге", "dative", "singular")]
    lex = spark.createDataFrame([(f, "noun", c, n, "feminine", None) for f, c, n in forms], "key string, pos string, case string, number string, gender string, tense string")
    got = {(r["left_key"], r["right_key"]): r["result"] for r in unification.numeral_frames(docs, lex, {"две": "singular", "пять": "plural"}).collect()}
    assert got == {("две", "книги"): "match", ("пять", "книг"): "match", ("две", "книг"): "conflict"}
    got = {(r["left_key"], r["right_key"]): r["result"] for r in unification.government_frames(docs, lex, {"без": ("genitive",), "к": ("dative",)}).collect()}
    assert got == {("без", "книги"): "match", ("к", "книги"): "conflict", ("к", "книге"): "match"}
    assert unification.agreement_edges(docs, lex).count() == 0


def test_debug_counts_in_parts(spark, monkeypatch):
    import json

    import pandas as pd

    from slovotok.operators import inspection

    texts = ["", "Дом. Сад (и лес), потому что дождь.", "а" * 50, "Он сказал: «Да». Она ушла, и он ушёл."]
    monkeypatch.setattr(inspection, "PART", 40)
    batch = pd.DataFrame({"doc_id": range(4), "text": texts})
    assert [ids for ids, _ in inspection._parts([batch, batch[:0], batch[3:]])] == [[0, 1], [2], [3], [3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    told = {r["doc_id"]: json.loads(r["report"]) for r in inspection.debug_reports(docs).collect()}
    counted = {r["doc_id"]: r.asDict() for r in inspection.debug_counts(docs).collect()}
    assert counted == {d: {"doc_id": d, "characters": r["characters"]} | r["counts"] for d, r in told.items()} and len(told) == 4

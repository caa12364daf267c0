import zipfile

from pyspark.sql import functions as F

from slovotok.operators.morphology import analyze, negated_verbs
from slovotok.plans.rules import RULES
from slovotok.sources import gec, lexicon


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


PROJECT = "# form\tlemma\nзамок\tзамок\tNOUN\tgender=masc|number=sing|case=nom|odd=1\tl:1\tp:1\ts\tза́мок\nкороткая\tстрока\nвсё\tвсё\tPRCL\t\nвсе\tвесь\tмест\tcase=nom|plur|кач\nзнаю\tзнать\tVERB\tpres|1per"


def test_project(spark):
    rows = {r["form"]: r.asDict() for r in lexicon.read_project(lines(spark, PROJECT)).collect()}
    assert set(rows) == {"замок", "всё", "все", "знаю"}
    assert (rows["замок"]["pos"], rows["замок"]["case"], rows["замок"]["gender"], rows["замок"]["unrecognized_tags"], rows["замок"]["stress"]) == ("noun", "nominative", "masculine", ["odd=1"], "за́мок")
    assert (rows["все"]["pos"], rows["все"]["number"], rows["все"]["grammemes"], rows["все"]["key"]) == ("pronoun", "plural", ["qualitative"], "все")
    assert rows["знаю"]["person"] == "first" and rows["знаю"]["source_id"] == "project"


def test_other_dictionaries(spark, tmp_path):
    csv = lexicon.read_opencorpora_csv(lines(spark, "form,lemma,pos,grammemes\nМира,мир,NOUN,inan|masc|gent|sing,o:1,p:1,,\n"))
    assert [(r["form"], r["pos"], r["case"], r["source_id"]) for r in csv.collect()] == [("мира", "noun", "genitive", "opencorpora")]
    pym = lexicon.read_pymorphy(lines(spark, "word\tnormal_form\ttag\nпила\tпила\tNOUN,inan,femn sing,nomn\nпила\tпить\tXX,VERB past"))
    assert sorted((r["lemma"], r["pos"]) for r in pym.collect()) == [("пила", "noun"), ("пить", "verb")]
    path = tmp_path / "d.xml"
    path.write_text('<d><lemmata><lemma id="1"><l t="кот"><g v="NOUN"/><g v="anim"/></l><f t="кот"><g v="nomn"/></f><f t="Кота"><g v="gent"/><g v="sing"/></f></lemma></lemmata></d>')
    xml = lexicon.read_opencorpora_xml(spark, str(path))
    assert sorted((r["form"], r["lemma"], r["pos"], r["animacy"], r["case"], r["lemma_id"]) for r in xml.collect()) == [("кот", "кот", "noun", "animate", "nominative", "opencorpora:1"), ("кота", "кот", "noun", "animate", "genitive", "opencorpora:1")]


def test_stress_store_and_lookup(spark, tmp_path):
    lex = lexicon.read_project(lines(spark, PROJECT))
    records = lexicon.read_stress(lines(spark, "form\tstress\nвсе\tвсе́\nзамок\tl:2\t\t\tзамо́к\nзнаю\t"))
    got = {r["form"]: r["stress"] for r in lexicon.attach_stress(lex, records).collect()}
    assert got == {"замок": "за́мок", "всё": None, "все": "все́", "знаю": None}
    lexicon.write_lexicon(lex, str(tmp_path / "lex"), 2)
    assert [r["form"] for r in lexicon.read_lexicon(spark, str(tmp_path / "lex"), ["Замок"]).collect()] == ["замок"]
    asked = spark.createDataFrame([("ВСЁ",)], "form string")
    assert lexicon.read_lexicon(spark, str(tmp_path / "lex"), asked).count() == 2


def test_analyze_folds_yo(spark):
    lex = lexicon.read_project(lines(spark, PROJECT))
    words = spark.createDataFrame([("все",), ("Всё",), ("нет",), ("все",)], "word string")
    got = sorted((r["word"], sorted(x["form"] for x in r["readings"])) for r in analyze(words, lex).collect())
    assert got == [("Всё", ["всё"]), ("все", ["все", "всё"]), ("все", ["все", "всё"]), ("нет", [])]


def test_negated_verbs(spark):
    lex = lexicon.read_project(lines(spark, PROJECT))
    df = spark.createDataFrame([(1, "Незнаю, неЗнаю, незамок, знаю."), (2, None)], "doc_id int, text string")
    rule = next(r for r in RULES if r.kind == "negated_verb_spacing_basic")
    assert sorted((r["s"], r["replacement"]) for r in negated_verbs(df, lex, rule).collect()) == [(0, "не знаю"), (8, "не Знаю")]


def test_m2_in_a_zip(spark, tmp_path):
    m2 = "S Это , слово .\nA 1 2|||del||||||REQUIRED|||-NONE-|||0\nA 2 3|||sub|||два слова|||REQUIRED|||-NONE-|||0\n\nS Ничего\nA bad\n\nX\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/LORuGEC.val.m2", m2)
    rows = gec.read_m2(gec.archive_members(spark, str(tmp_path), ".m2")).orderBy("id").collect()
    assert [(r["input"], r["correction"], r["labels"], r["metadata"]["subset"]) for r in rows] == [("Это, слово.", "Это два слова.", ["del", "sub"], "validation"), ("Ничего", "Ничего", [], "validation")]
    assert [e["id"] for e in rows[0]["edits"]] == ["LORuGEC.val.m2-1-edit-1", "LORuGEC.val.m2-1-edit-2"]


def test_pairs(spark, tmp_path):
    rows = gec.spelling_pairs(lines(spark, '{"source": "карова", "correction": "корова", "domain": "x"}\n{"source": "а", "correction": "а"}\n{"source": " "}'))
    assert [(r["input"], r["correction"], r["labels"]) for r in rows.collect()] == [("карова", "корова", ["x"])]
    table = gec.pairs_table(lines(spark, "id\trule\tbad\tgood\n1\tr\tа\tб\nshort"), "own", header="id\trule\tbad\tgood", strict=False)
    assert [(r["id"], r["input"], r["correction"], r["labels"]) for r in table.collect()] == [("own/1", "а", "б", ["r"])]
    table.write.json(str(tmp_path / "j"))
    assert gec.read_jsonl(spark, str(tmp_path / "j")).count() == 1
    assert gec.read_jsonl(spark, str(tmp_path / "j")).filter(F.col("input") == "а").first()["targets"] == ["б"]


def test_spreadsheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    titles = ["The rule", "Grammar section", "Initial sentence", "Correct sentence", "Prompt/Query"]
    shared = "".join(f"<si><t>{t}</t></si>" for t in [*titles, "р1", "раздел", "Он , тут", "Он тут"])
    cell = lambda ref, n: f'<c r="{ref}" t="s"><v>{n}</v></c>'
    header = "".join(cell(f"{c}1", i) for i, c in enumerate("ABCDE"))
    body = cell("A2", 5) + cell("B2", 6) + cell("C2", 7) + cell("D2", 8) + '<c r="E2" t="inlineStr"><is><t>Query</t></is></c>'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{shared}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{header}</row><row r="2">{body}</row><row r="3"><c r="A3"><v>1</v></c></row></sheetData></worksheet>')
    rows = gec.grammar_sheet(gec.read_xlsx(spark, str(tmp_path))).collect()
    assert [(r["id"], r["input"], r["correction"], r["labels"], r["metadata"]["subset"], len(r["edits"])) for r in rows] == [("lorugec/xlsx-1", "Он, тут", "Он тут", ["раздел", "р1"], "test", 1)]


def test_blocks_of_several_members_have_ids_of_their_own(spark):
    contents = spark.createDataFrame([("b/test.m2", "S Он пришел .\nA 1 2|||Sp|||пришёл|||R|||-NONE-|||0\n\nS Да ."), ("a/val.m2", "S Нет .\n\nS Так .")], "member string, content string")
    ids = sorted((r["id"], r["source_file"]) for r in gec.read_m2(contents).collect())
    assert ids == [("lorugec/m2-1", "a/val.m2"), ("lorugec/m2-2", "a/val.m2"), ("lorugec/m2-3", "b/test.m2"), ("lorugec/m2-4", "b/test.m2")]


def test_short_lines_are_errors_or_given_apart(spark):
    import pytest

    lines = spark.createDataFrame([("1\tr\tплохо\tхорошо\tn",), ("2\tr",), ("",)], "value string")
    assert [r["input"] for r in gec.pairs_table(lines, "d", strict=False).collect()] == ["плохо"]
    assert [tuple(r) for r in gec.short_lines(lines).collect()] == [("2\tr", 2)]
    with pytest.raises(Exception, match="too few columns"):
        gec.pairs_table(lines, "d").collect()
    rows = spark.createDataFrame([("дом\tдом\tnoun",), ("# x",), ("form\tlemma",)], "value string")
    assert [r["n_columns"] for r in lexicon.rejected(rows, "project").collect()] == [3]
    with pytest.raises(Exception, match="too few columns"):
        lexicon.read_project(rows, strict=True).collect()


def test_quoted_commas_of_a_dictionary(spark):
    rows = spark.createDataFrame([('"дом, дома",дом,NOUN,inan|masc,1,2,s,',)], "value string")
    assert [r["form"] for r in lexicon.read_opencorpora_csv(rows).collect()] == ["дом, дома"]


def test_spaces_around_marks(spark):
    from pyspark.sql import functions as F

    text = spark.createDataFrame([("« Да » , сказал он ( тихо ) — и  ушёл [ совсем ] .",)], "t string")
    assert text.select(gec.detokenize(F.col("t")).alias("t")).first()["t"] == "«Да», сказал он (тихо) — и ушёл [совсем]."

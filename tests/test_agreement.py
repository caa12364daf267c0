from slovotok.operators import agreement
from slovotok.plans.rules import RULES
from slovotok.sources.lexicon import read_project

LEXICON = """дом\tдом\tNOUN\tmasc|sing|nom
дом\tдом\tNOUN\tmasc|sing|acc
дома\tдом\tNOUN\tmasc|sing|gen
дому\tдом\tNOUN\tmasc|sing|dat
домов\tдом\tNOUN\tmasc|plur|gen
новый\tновый\tADJF\tmasc|sing|nom
новому\tновый\tADJF\tmasc|sing|dat
новая\tновый\tADJF\tfemn|sing|nom
новых\tновый\tADJF\tplur|gen
высокий\tвысокий\tADJF\tmasc|sing|nom
два\tдва\tNUMR\tnom
пять\tпять\tNUMR\tnom
двадцать\tдвадцать\tNUMR\tnom|num_class=many
к\tк\tPREP\t
соседка\tсоседка\tNOUN\tfemn|sing|nom
соседи\tсосед\tNOUN\tmasc|plur|nom
ушёл\tуйти\tVERB\tpast|sing|masc
ушла\tуйти\tVERB\tpast|sing|femn
ушли\tуйти\tVERB\tpast|plur
печь\tпечь\tNOUN\tfemn|sing|nom
печь\tпечь\tVERB\tinf
ждать\tждать\tVERB\tinf
думать\tдумать\tVERB\tinf
о\tо\tPREP\t
доме\tдом\tNOUN\tmasc|sing|prep"""


def run(spark, texts):
    lexicon = read_project(spark.createDataFrame([(x,) for x in LEXICON.split("\n")], "value string"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rules = [r for r in RULES if r.kind in agreement.KINDS]
    got = {}
    verbs = agreement.government(spark.createDataFrame([(1, "ждать", "direct_object", None, 'gen и "acc, anim"'), (2, "думать", "prepositional_object", "о", "prep")], "row_no int, lemma string, complement_kind string, preposition string, cases string"))
    for r in agreement.issues(df, lexicon, rules, verbs).collect():
        got.setdefault(texts[r["doc_id"]], set()).add((r["rule_id"].rpartition(".")[2], texts[r["doc_id"]][r["s"] : r["e"]], r["replacement"]))
    return got


def test_conflicts(spark):
    wrong = {
        "два дом": ("numeral_noun_agreement", "два дом", "два дома"),
        "Пять дом.": ("numeral_noun_agreement", "Пять дом", "Пять домов"),
        "двадцать два дом": ("compound_numeral_nominal_group_agreement_basic", "двадцать два дом", "двадцать два дома"),
        "пять новых дом": ("numeral_nominal_group_agreement_basic", "пять новых дом", "пять новых домов"),
        "К дом!": ("preposition_government_basic", "К дом", "К дому"),
        "к новому дом": ("preposition_nominal_group_government_basic", "к новому дом", "к новому дому"),
        "Соседка ушёл": ("subject_predicate_agreement_basic", "Соседка ушёл", "Соседка ушла"),
        "соседи ушла": ("subject_predicate_agreement_basic", "соседи ушла", "соседи ушли"),
        "новая дом": ("adj_noun_agreement_demo", "новая дом", "новый дом"),
        "Новый дому": ("adj_noun_agreement_demo", "Новый дому", "Новому дому"),
        "новая высокий дом": ("nominal_group_modifier_agreement_basic", "новая высокий дом", "новый высокий дом"),
        "ждать дому": ("verb_government_basic", "ждать дому", None),
        "думать о новых домов": ("verb_government_basic", "думать о новых домов", None),
        "новый высокий дом": ("comma_between_homogeneous_members", " ", ", "),
    }
    right = ["два дома", "пять домов", "двадцать два дома", "к дому", "к новому дому", "Соседка ушла", "соседи ушли", "новый дом", "ждать дома", "думать о доме", "«новый высокий дом»", "к, дом", "два\nдом", "новая печь ушёл", "неведомый дом", "", None]
    got = run(spark, [*wrong, *right])
    for text, issue in wrong.items():
        assert issue in got.get(text, set()), (text, got.get(text))
    for text in right:
        assert text not in got, (text, got[text])


def test_subject_and_predicate_apart(spark):
    wrong = {
        "Соседка вчера ушёл": ("subject_predicate_agreement_basic", "Соседка вчера ушёл", "Соседка вчера ушла"),
        "Соседи, как всегда рано утром и очень тихо, ушла.": ("subject_predicate_agreement_basic", "Соседи, как всегда рано утром и очень тихо, ушла", "Соседи, как всегда рано утром и очень тихо, ушли"),
        "Дома. Соседка (к дому) ушла. Соседка вчера ушли": ("subject_predicate_agreement_basic", "Соседка вчера ушли", "Соседка вчера ушла"),
    }
    # Another sentence, a zone between or around, an agreeing first predicate, a nearer subject, a word with two readings.
    right = ["Соседка. Вчера ушёл.", "Соседка (и дом) вчера ушёл", "Вот (соседка вчера ушёл)", "Соседка вчера ушла, потом ушёл", "Соседи и соседка вчера ушла", "Дом вчера ушла"]
    got = run(spark, [*wrong, *right])
    for text, issue in wrong.items():
        assert issue in got.get(text, set()), (text, got.get(text))
    for text in right:
        assert text not in got, (text, got[text])

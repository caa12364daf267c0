import pytest
from pyspark.sql import functions as F

from slovotok.operators.checking import check, directives, raw_issues
from slovotok.operators.detectors import REGISTRY, register
from slovotok.operators.validation import example_failures, rule_violations
from slovotok.plans.rules import RULES, RuleFilter, plan, with_params


def issues(spark, text, **kw):
    df = spark.createDataFrame([(1, text, "x")], "doc_id int, text string, rule_id string")
    return [(r["rule_id"], r["start_b"], r["end_b"], r["replacement"]) for r in check(df, **kw).orderBy("start_b", "end_b", "rule_id").collect()]


def unpaired(text, pairs=("()", "[]", "{}", "«»")):
    """Naive stack: a closer takes off whatever is on top."""
    close, stack, out = {p[1]: p[0] for p in pairs}, [], []
    for i, c in enumerate(text):
        if c in close.values():
            stack.append((c, i))
        elif c in close and (not stack or stack.pop()[0] != close[c]):
            out.append(i)
    return sorted(out + [i for _, i in stack])


def test_examples_of_rules(spark):
    from slovotok.operators.agreement import with_lexicon
    from slovotok.sources.lexicon import demo_government, demo_lexicon

    assert example_failures(spark, RULES, with_lexicon(demo_lexicon(spark), demo_government(spark))).collect() == []
    assert all(r.valid and r.invalid for r in RULES)
    assert rule_violations(RULES) == []


def test_delimiters_against_a_stack(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choices("()[]«»а ", k=12)) for _ in range(300)]
    rule = next(r for r in RULES if r.kind == "unpaired_delimiters")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in raw_issues(df, [rule]).collect():
        got.setdefault(r["doc_id"], []).append(r["s"])
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == unpaired(t), t


def test_order_and_spans(spark):
    got = issues(spark, "Он он пришёл , да!!", chosen=RuleFilter("strict"))
    assert got == [("ru.grammar.repeated_word", 0, 9, "он"), ("ru.punctuation.no_space_before_mark", 22, 24, ","), ("ru.style.multiple_question_exclamation_marks", 29, 31, "!")]


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (2, " \n ")], "doc_id int, text string")
    assert check(df, chosen=RuleFilter("strict")).count() == 0
    assert check(spark.createDataFrame([], "doc_id int, text string")).count() == 0


def test_suppression(spark):
    rule = "ru.grammar.repeated_word"
    line = f"дом дом. // lint-disable-line {rule}\nлес лес."
    assert [x[1] for x in issues(spark, line, chosen=RuleFilter(include=(rule,)))] == [len(line.split("\n")[0].encode()) + 1]
    assert issues(spark, "lint-disable-file\nдом дом.", chosen=RuleFilter(include=(rule,))) == []
    assert issues(spark, "lint-disable-next-line: *\nдом дом.", chosen=RuleFilter(include=(rule,))) == []
    assert len(issues(spark, "lint-disable-file ru.other\nдом дом.", chosen=RuleFilter(include=(rule,)))) == 1
    assert issues(spark, "дом дом.", chosen=RuleFilter(include=(rule,)), file_rules=["all"]) == []
    df = spark.createDataFrame([("a lint-disable-line x, y\r\nb",)], "t string")
    assert [tuple(d) for d in df.select(directives(F.col("t")).alias("d")).first()["d"]] == [(1, "line", ["x", "y"], 2, 24)]


def test_plan():
    made = plan(RULES, RuleFilter("strict"), ["regex"], ["regex"])
    assert [r.rule_id for r in made.rules] == ["ru.punctuation.double_comma"]
    assert ("ru.typography.multiple_spaces", "unknown_detector_kind", "multiple_spaces") in made.skipped
    assert len(plan(RULES, RuleFilter(), REGISTRY).rules) + len(plan(RULES, RuleFilter(), REGISTRY).skipped) == 44
    assert not plan(RULES, RuleFilter(exclude=("ru.punctuation.double_comma",), include=("ru.punctuation.double_comma",)), REGISTRY).rules


def test_registering_twice_fails():
    with pytest.raises(ValueError):
        register("regex", "text")(lambda r: None)


def test_custom_pattern(spark):
    rule = with_params(next(r for r in RULES if r.kind == "regex"), pattern="б+", replacement="в")
    df = spark.createDataFrame([(1, "абба б")], "doc_id int, text string")
    assert [(r["s"], r["e"]) for r in raw_issues(df, [rule]).orderBy("s").collect()] == [(1, 3), (5, 6)]

from slovotok.operators import rejects

SCHEMA = "line_id bigint, feed string, line_no bigint, raw string, cells string, reason string"


def run(spark, rows):
    df = spark.createDataFrame([(i, f, i, r, "x", "y") for i, (f, r) in enumerate(rows)], SCHEMA)
    return {r["line_id"]: r["reason"] for r in rejects.rejects(df).collect()}


def test_reasons(spark):
    o, p, r = "opencorpora.csv", "project.tsv", "rlc_test.csv"
    good = "дом,дом,NOUN,inan|masc,1,2,s,"
    rows = [
        (o, good), (o, '"до""м",дом,NOUN,inan,1,2,"a\nb",'), (o, 'до"м,дом,NOUN,inan,1,2,s,'), (o, '"дом"x,дом,NOUN,inan,1,2,s,'), (o, "дом,дом,NOUN"),
        (o, "дом,дом,noun,inan,1,2,s,"), (o, "дом,дом,NOUN,,1,2,s,"), (o, ""), (o, "  \t"), (o, None), (o, "form,lemma,pos,grammemes,lemma_id,paradigm_id,source_id,stress"),
        (p, "а\tа\tCONJ\tcase=nom"), (p, '"а\tа\tCONJ\tcase=nom|mood=x-1\t\t\t\t'), (p, "а\tа\tCONJ\tcase=nom\t\t\t\t\t"), (p, "а\tа\tCONJ"), (p, "# а\tб"), (p, "а\tа\tCONJ\tkind=nom"),
        (r, "текст,b,c,d,e"), (r, "123,b,c,d,e"), (r, "те�кст,b,c,d,e"), (r, '"те\nкст",b,c,d,e'), (r, "те\x07кст,b,c,d,e"), ("other", "x"), (r, '"открыто,b,c,d,e'), (r, "a,b,c,d,e,"),
    ]
    assert run(spark, rows) == {
        2: "quoting", 3: "quoting", 4: "columns", 5: "value", 6: "value", 13: "columns", 14: "columns", 16: "value", 18: "value", 19: "value", 21: "value", 23: "quoting", 24: "columns",
    }


def test_long_fields_and_repeats(spark):
    long = '"' + 'а""' * 200_000 + '",b,c,d,e'
    assert run(spark, [("rlc_test.csv", long), ("rlc_test.csv", long + '"'), ("rlc_test.csv", "1,2"), ("rlc_test.csv", "1,2")]) == {1: "quoting", 2: "columns", 3: "columns"}


def test_loaded_is_the_rest(spark):
    df = spark.createDataFrame([(1, "rlc_test.csv", 1, '"а ""б""",б,,г,', "", ""), (2, "rlc_test.csv", 2, "а,б", "", "")], SCHEMA)
    rows = [r.asDict() for r in rejects.loaded(df, rejects.FEEDS[2]).collect()]
    assert rows == [{"line_id": 1, "text_orig": 'а "б"', "text_cor": "б", "quote": None, "correction": "г", "tag": None}]


def test_empty(spark):
    assert run(spark, [("rlc_test.csv", "")]) == {}
    assert rejects.rejects(spark.createDataFrame([], SCHEMA)).count() == 0

from slovotok.plans.rules import RuleFilter
from slovotok.streaming.checks import check_stream


def test_checks_run_on_a_stream(spark, tmp_path):
    rows = [(1, "Он он пришёл."), (2, "лес шумит."), (3, "Всё хорошо.")]
    spark.createDataFrame(rows, "doc_id int, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id int, text string").json(str(tmp_path / "in"))
    q = check_stream(stream, RuleFilter("strict")).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["doc_id"], r["rule_id"]) for r in spark.table("found").collect())
    assert got == [(1, "ru.grammar.repeated_word"), (2, "ru.orthography.sentence_initial_capital")]

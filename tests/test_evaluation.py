import __spark_entry__ as entry


def test_report_and_labels_count_every_rule(spark, tmp_path):
    rows = [
        (1, "a", "Он видел видел дом.", "Он видел дом.", None, ["Rep"], None),
        (2, "a", "Надо учится в школе.", "Надо учиться в школе.", None, ["Spell"], None),
    ]
    df = spark.createDataFrame(rows, "rec_no bigint, dataset string, input string, correction string, targets array<string>, labels array<string>, edits string")
    df.write.parquet(f"{tmp_path}/gec_dataset_regressions.parquet")
    report, one = (entry.queries()[q](spark, str(tmp_path)).first() for q in ("evaluation_report_strict", "evaluation_report"))
    assert one["source_detected_dirty_examples"] == 1 and report["source_detected_dirty_examples"] == 2 and report["recall_proxy"] == 1.0
    labels = {r["label"]: r["issues"] for r in entry.queries()["evaluation_by_label_strict"](spark, str(tmp_path)).filter("side = 'source'").collect()}
    assert set(labels) == {"Rep", "Spell"}

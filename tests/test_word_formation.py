from slovotok.operators.word_formation import parses, word_formation


def test_parses():
    best = parses("рассказать")[0]
    assert best[2:4] == (["рас"], "сказ") and best[4] == ["а", "ть"]
    assert any(p[3] == "пис" and p[4][-2:] == ["тель", "ниц"] and p[5] == "а" for p in parses("писательница"))
    assert parses("абракадабр") == [(5, "root:абракадабр", [], "абракадабр", [], "")] and parses("я") == [] and len(parses("лесами")) <= 8


def test_words_once(spark):
    df = spark.createDataFrame([("Домами",), ("домами",), (None,), ("-",)], "word string")
    rows = word_formation(df).filter("rank = 1").collect()
    assert [(r["word"], r["root"], r["ending"], r["confidence"]) for r in rows] == [("домами", "дом", "ами", "medium")]

import random

from pyspark.sql import functions as F

from slovotok.functions.arrays import running_sum
from slovotok.functions.text import column_of, excerpt, line_of, matches, tokenize


def test_running_sum(spark):
    rng = random.Random(1)
    arrays = [[], [5], *([rng.randint(0, 9) for _ in range(n)] for n in (2, 255, 256, 257, 600, 5000))]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, a array<int>")
    for r in df.select("i", running_sum(F.col("a")).alias("s")).collect():
        a = arrays[r["i"]]
        assert r["s"] == [sum(a[:k]) for k in range(len(a))]


def test_tokens_join_to_the_text(spark):
    rng = random.Random(2)
    alphabet = "аяАЁёz9０ \n ,.-–—«»'№²́!?…$"
    texts = ["", ",-", "кто-то, «да»", *("".join(rng.choices(alphabet, k=40)) for _ in range(200))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", F.array_join(tokenize(F.col("text")), "").alias("again")).collect():
        assert r["text"] == r["again"]


def test_matches(spark):
    df = spark.createDataFrame([("a  b   c",), ("",), ("abc",), ("  ",)], "text string")
    got = [[(x["m"], x["s"], x["e"]) for x in r[0]] for r in df.select(matches(F.col("text"), " {2,}")).collect()]
    assert got == [[("  ", 1, 3), ("   ", 4, 7)], [], [], [("  ", 0, 2)]]


def test_positions(spark):
    text = "Раз.\nДва три! Пять"
    df = spark.createDataFrame([(text, 9, 12)], "t string, s int, e int")
    t, s, e = F.col("t"), F.col("s"), F.col("e")
    row = df.select(line_of(t, s), column_of(t, s), excerpt(t, s, e), excerpt(t, F.lit(14), F.lit(18))).first()
    assert tuple(row) == (2, 5, "Два три!", "Пять")

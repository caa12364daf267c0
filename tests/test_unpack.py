import random
import re

from slovotok.operators.unpack import EMPTY, QUOTED, WORD, resolve, unpack, unpack_all


def naive(text):
    """Values of a packed field, character by character; a quote that is never closed is an ordinary character."""
    if text is None:
        return []
    runs, run, i = [], "", 0
    while i < len(text):
        m = re.compile(r'"[^"]*+(?:""[^"]*+)*+"').match(text, i)
        if m:
            run += m.group()
            i = m.end()
        elif re.match(r"[\s\xa0|;,/&\\+]", text[i]):
            runs.append(run)
            run, i = "", i + 1
        else:
            run += text[i]
            i += 1
    runs.append(run)
    out = []
    for r in runs:
        if r and r.lower() not in ("и", "или", "либо", "and", "or"):
            v = re.sub(r'"([^"]*+(?:""[^"]*+)*+)"', lambda m: m.group(1).replace('""', '"'), r)
            if v:
                out.append(v)
    return out


def test_against_naive(spark):
    rng = random.Random(7)
    parts = ["inan", "case=nom", 'note="a; ""b"" | c"', "V-ie", "|", ";", ", ", " и ", " или ", " / ", "&", '"x|y"', '"', "  ", '""', "сущ."]
    texts = [None, "", "|", "и", '"', 'a"b', *("".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(400)), "a|" * 20_000, '"x|y"; b|' * 10_000]
    df = spark.createDataFrame([(i, t, "p", "v") for i, t in enumerate(texts)], "row_no int, f string, pos string, val string")
    got = {}
    for r in unpack(df, "row_no", "f").collect():
        got.setdefault(r["row_no"], {})[r["pos"]] = r["val"]
    for i, t in enumerate(texts):
        want = naive(t)
        assert [got.get(i, {})[k] for k in sorted(got.get(i, {}))] == want, t
        assert sorted(got.get(i, {})) == list(range(1, len(want) + 1))


def test_empty(spark):
    assert unpack(spark.createDataFrame([], "row_no int, f string"), "row_no", "f").count() == 0


def values(skel):
    return [(a, b) for a, b, _ in resolve(skel)]


def test_rules_are_resolved_from_the_skeleton():
    assert values("a|a, a-a") == [(1, 1), (2, 2), (3, 3)] and values(f"a {WORD} a") == [(1, 1), (3, 3)]
    assert values("a - a") == [(1, 1), (3, 3)] and values("• a; – ; a.") == [(2, 2), (4, 4)]
    assert values("a=a|a = a; a= a; a =a") == [(1, 1), (2, 4), (5, 6), (7, 8)] and values("a = ; a") == [(1, 2), (3, 3)]
    assert values(f"{EMPTY}; a{EMPTY}") == [(2, 2)] and resolve(f"{QUOTED}, a") == [(1, 1, True), (2, 2, False)]


def test_joined_values_and_several_tables(spark):
    a = spark.createDataFrame([(1, "case = nom;number= sg"), (2, "x - y")], "id int, f string")
    b = spark.createDataFrame([(1, None), (3, "«a» | b"), (4, "\x01|\x02z")], "id int, g string")
    got = sorted(map(tuple, unpack_all([("a", a, "id", "f"), ("b", b, "id", "g")]).collect()))
    assert got == [("a", 1, 1, "case=nom"), ("a", 1, 2, "number=sg"), ("a", 2, 1, "x"), ("a", 2, 2, "y"), ("b", 3, 1, "«a»"), ("b", 3, 2, "b"), ("b", 4, 1, "\x01"), ("b", 4, 2, "\x02z")]

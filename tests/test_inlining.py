import json

from slovotok.operators import inlining

SCHEMA = "rec_no bigint, edits string, metadata string, expectations string, ref string, p1 int"


def test_child_objects(spark):
    edits = [{"id": 7, "alternatives": [{"text": "a", "votes": {"score": 1}}, None, {"votes": [{}, None, {}]}]}, None, {"id": "e3", "alternatives": {"text": "b"}}]
    meta = json.dumps(json.dumps({"reviews": [{"reviewer": "r1", "steps": {"verdict": "ok"}}, {"steps": [{}, {}]}]}))
    exp = {"input_must_trigger": ["ru.a", {"rule_id": "ru.b", "spans": [{"start": 1}]}, None, 5]}
    rows = [(1, json.dumps(edits), meta, json.dumps(exp), "x", 9), (2, None, "", "not json", "x", 9), (3, '{"alternatives": []}', "null", '{"input_must_trigger": "ru.c"}', "x", 9), (4, "[]", '"x"', "[1]", None, None)]
    got = {tuple(r) for r in inlining.child_objects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        (1, "edit", 1, 0, 0, "7"), (1, "edit", 3, 0, 0, "e3"), (1, "alternative", 1, 1, 0, ""), (1, "alternative", 1, 3, 0, ""), (1, "alternative", 3, 1, 0, ""),
        (1, "vote", 1, 1, 1, ""), (1, "vote", 1, 3, 1, ""), (1, "vote", 1, 3, 3, ""), (1, "review", 1, 0, 0, "r1"), (1, "review", 2, 0, 0, ""), (1, "step", 1, 1, 0, ""),
        (1, "step", 2, 1, 0, ""), (1, "step", 2, 2, 0, ""), (1, "trigger", 1, 0, 0, "ru.a"), (1, "trigger", 2, 0, 0, "ru.b"), (1, "span", 2, 1, 0, ""), (3, "edit", 1, 0, 0, ""), (3, "trigger", 1, 0, 0, "ru.c"),
    }


def test_graph_and_tables(spark):
    rows = [(1, '[{"id": 1, "span": {"start": 1, "end": 2}, "votes": [{"n": 1}]}, {"id": 2}]', '{"doc": {"author": {"name": "x"}}, "reviews": []}', None, "x", 1), (2, None, None, None, "x", 1)]
    made = inlining.flat_tables(spark.createDataFrame(rows, SCHEMA), "rec_no", ["edits", "metadata"])
    assert set(made) == {"edits", "edits_votes", "metadata", "metadata_reviews"}
    edits = [r.asDict() for r in made["edits"].orderBy("p1").collect()]
    assert [(e["rec_no"], e["p1"], e["id"], e["span_start"], e["span_end"]) for e in edits] == [(1, 1, "1", "1", "2"), (1, 2, "2", None, None)]
    assert made["metadata"].first()["doc_author_name"] == "x"
    assert [tuple(r) for r in made["edits_votes"].select("rec_no", "p1", "p2", "n").collect()] == [(1, 1, 1, "1")]


def test_recursive_and_repeated_nodes():
    paths = [("t", "OBJECT"), ("t.node", "OBJECT"), ("t.node", "RECURSIVE"), ("t.node.x", "SCALAR"), ("t.many", "ARRAY"), ("t.many", "SCALAR_IN_ARRAY"), ("t.one", "OBJECT"), ("t.one.y", "SCALAR")]
    nodes = inlining.schema_graph(paths)
    assert nodes["t.node"].recursive and nodes["t.many"].repeated and not nodes["t.one"].own_table
    assert {t.name: (t.depth, set(t.columns)) for t in inlining.inline(nodes, ["t"])} == {"t": (1, {"one_y"}), "t_node": (0, {"x"}), "t_many": (2, set())}


def test_a_recursive_element_has_one_table_with_keys_to_itself(spark):
    text = json.dumps({"reply": {"n": "a", "reply": [{"n": "b"}, {"n": "c", "reply": {"n": "d"}}]}})
    parts = ['{"n": %d, "reply": ' % i for i in range(3000)]
    rows = [(1, text, None, None, None, None), (2, '{"reply": ' + "".join(parts) + "null" + "}" * 3001, None, None, None, None)]
    made = inlining.flat_tables(spark.createDataFrame(rows, SCHEMA), "rec_no", ["edits"])
    assert set(made) == {"edits", "edits_reply"}
    got = {(r["rec_no"], tuple(r["pos"]), r["parent_"], r["n"]) for r in made["edits_reply"].collect()}
    assert {g for g in got if g[0] == 1} == {(1, (1, 1), "edits", "a"), (1, (1, 1, 1), "edits.reply", "b"), (1, (1, 1, 2), "edits.reply", "c"), (1, (1, 1, 2, 1), "edits.reply", "d")}
    assert len(got) == 4 + 3000


def test_json_wrapped_in_strings_is_opened_however_often():
    text = '{"a": [1.50, "x", true, null, {"b": -2e3}]}'
    for _ in range(7):
        text = json.dumps(text)
    value = inlining.opened(text)
    assert inlining._text(value) == '{"a": [1.50, "x", true, null, {"b": -2e3}]}'
    assert inlining.opened("not json") is None and inlining.opened('"x"') == "x" and inlining.opened("{") is None


def test_the_parser_without_recursion_agrees_with_the_usual_one():
    good = ['{}', '[]', ' [1, [2, {"a": {"b": []}}], "x\\n\\u0416", -0.5e-3, true, false, null] ', '"s"', "12", '{"a": 1, "a": 2, "b": {}}', "[[], {}, [[]]]"]
    bad = ["", "[1,]", '{"a"}', '{"a": }', "[1 2]", "{,}", "[", "]", '{"a": 1]', "[1}", '"x', "01", "nul", "[] []", '{1: 2}', '{"a": 1,}', "[,1]", ":", ","]
    for t in good:
        assert inlining.parse_deep(t) == inlining._DECODER.decode(t.strip()), t
    for t in bad:
        try:
            inlining.parse_deep(t)
        except ValueError:
            continue
        raise AssertionError(t)


def test_empty(spark):
    assert inlining.child_objects(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shared_elements_have_one_table(spark):
    rows = [(1, '[{"id": 1, "votes": [{"by": {"name": "x"}}], "note": {"by": {"name": "y", "age": 3}}}]', None, None, "x", 1)]
    made = inlining.flat_tables(spark.createDataFrame(rows, SCHEMA), "rec_no", ["edits"])
    assert set(made) == {"edits", "edits_votes", "by"}
    got = {(r["parent_"], r["p1"], r["p2"], r["p3"], r["name"], r["age"]) for r in made["by"].collect()}
    assert got == {("edits.votes", 1, 1, 1, "x", None), ("edits.note", 1, 1, None, "y", "3")}


def test_child_objects_come_from_the_flat_tables(spark, monkeypatch):
    asked, real = [], inlining.inline
    monkeypatch.setattr(inlining, "inline", lambda *a, **k: asked.append(1) or real(*a, **k))
    # Spans occur below triggers and edits, so they share a table, and votes are nowhere an array.
    rows = [(1, '{"id": "e", "spans": {"start": 1}, "alternatives": [{"votes": {"n": 1}}]}', "[{}]", '{"input_must_trigger": {"rule_id": "r", "spans": {"start": 2}}}', "x", 1)]
    got = {tuple(r) for r in inlining.child_objects(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert asked and got == {(1, "edit", 1, 0, 0, "e"), (1, "alternative", 1, 1, 0, ""), (1, "vote", 1, 1, 1, ""), (1, "trigger", 1, 0, 0, "r"), (1, "span", 1, 1, 0, "")}


def test_rows_of_all_tables(spark):
    records = spark.createDataFrame([(1, '[{"id": "a", "votes": [{"by": "x", "n": 1}, {"by": "y"}]}, {"id": "b"}]', '{"source": {"name": "s"}}')], "rec_no bigint, edits string, metadata string")
    rows = {(r["table_name"], tuple(r["pos"])): {c["name"]: c["value"] for c in r["cells"]} for r in inlining.table_rows(records, "rec_no", ["edits", "metadata"]).collect()}
    assert rows == {
        ("edits", (1,)): {"id": "a"}, ("edits", (2,)): {"id": "b"}, ("edits_votes", (1, 1)): {"by": "x", "n": "1"}, ("edits_votes", (1, 2)): {"by": "y", "n": None},
        ("metadata", (1,)): {"source_name": "s"},
    }

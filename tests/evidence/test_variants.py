"""Documents of unknown shape."""

from weft.sources import variants

TEXTS = {
    "null": None, "empty": "", "text": "not json", "cut": '[{"a": 1', "twice": '{"a": 1, "a": 2}', "number": "7", "string": '"x"', "nothing": "null",
    "array": '[1, {"a": "x"}, null, [], {"a": 2.5, "b": {"c": [true]}}]', "object": '{"z": {"a": 1}, "b": 2, "é": {"a": "1"}}', "none": "[]", "bare": "{}",
}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, text string")


def test_what_is_kept_apart(spark):
    got = {r["path"]: (r["shape"], r["n_items"], r["problem"]) for r in variants.static_results(frame(spark, TEXTS)).collect()}
    assert got == {
        "null": (None, None, "missing"), "empty": (None, None, "malformed"), "text": (None, None, "malformed"), "cut": (None, None, "malformed"), "twice": (None, None, "malformed"),
        "number": (None, None, "value"), "string": (None, None, "value"), "nothing": (None, None, "value"), "array": ("array", 5, None), "object": ("object", 3, None), "none": ("array", 0, None), "bare": ("object", 0, None),
    }


def test_objects_and_members(spark):
    docs = variants.parsed(frame(spark, TEXTS))
    rows = variants.objects(docs).select("path", "ord", variants.field("item", "$.a").alias("a"), variants.field("item", "$.b.c[0]", "boolean").alias("c"))
    assert sorted(map(tuple, rows.collect())) == [("array", 1, "x", None), ("array", 4, "2.5", True)]
    rows = variants.members(docs).select("path", "key", variants.field("item", "$.a", "int").alias("a"))
    assert sorted(map(tuple, rows.collect())) == [("object", "z", 1), ("object", "é", 1)]


def test_predicates(spark):
    texts = {"both": '{"State_Definitions": [{"name": "s"}], "Predicates": [{"name": "p"}]}', "second": '{"State_Definitions": [], "Predicates": [{"name": "p"}, 3]}', "wrong": '{"State_Definitions": {"a": 1}, "Predicates": [{"name": "p"}]}', "null": '{"State_Definitions": null, "Predicates": [{"name": "p"}]}', "array": '[{"Predicates": []}]', "bad": "{"}
    rows = variants.predicates(frame(spark, texts)).select("path", "ord", variants.field("item", "$.name").alias("name"))
    assert sorted(map(tuple, rows.collect())) == [("both", 0, "s"), ("null", 0, "p"), ("second", 0, "p"), ("second", 1, None)]


def test_usages(spark):
    texts = {"u": '[{"anchor": {"resource_id": " R.a ", "anchor_name": 5}, "usages": [{"usage_point": {"node_id": "12", "file": "F", "start_line": 3}}, {"usage_point": {"node_id": 13}}, {"usage_point": {"node_id": "x"}}, 4, {}]}, 3, {"usages": [{}]}, {"anchor": []}]', "v": "{}", "w": None}
    got = sorted((r["ord"] >> 31, r["ord"] % (1 << 31), r["resource_id"], r["name"], r["node_id"], r["file"], r["line"]) for r in variants.usages(frame(spark, texts)).collect())
    assert got == [(0, 0, "R.a", "5", 12, "F", 3), (0, 1, "R.a", "5", 13, None, None), (0, 2, "R.a", "5", -1, None, None), (0, 4, "R.a", "5", -1, None, None), (2, 0, "UNKNOWN_RESOURCE", "", -1, None, None)]

"""Collectors, detectors and slices on a small program graph."""

import random

from pyspark.sql import functions as F

from weft.operators import cfg, program
from weft.sources.android import lines

NODE = "id long, label string, name string, full_name string, code string, type_full_name string, file string, line int, line_end int, ord int, argument_index int, method_id long"
# fun onCreate() { val save = findViewById(R.id.save); save.setText(x); helper(save) }  fun helper(v) { v.hide() }
NODES = [
    (1, "METHOD", "onCreate", "app.Main.onCreate:void()", "onCreate", None, "Main.kt", 1, 9, 0, None, None),
    (2, "METHOD", "helper", "app.Main.helper:void(View)", "helper", None, "Main.kt", 11, 13, 1, None, None),
    (10, "CALL", "<operator>.assignment", None, "val save = findViewById(R.id.save)", None, "Main.kt", 2, None, 0, None, 1),
    (11, "LOCAL", "save", None, "save", "android.widget.Button", "Main.kt", 2, None, 0, None, 1),
    (12, "CALL", "findViewById", None, "findViewById(R.id.save)", "android.view.View", "Main.kt", 2, None, 1, 2, 1),
    (20, "CALL", "setText", None, "save.setText(x)", None, "Main.kt", 3, None, 2, None, 1),
    (21, "IDENTIFIER", "save", None, "save", "android.widget.Button", "Main.kt", 3, None, 0, 0, 1),
    (30, "CALL", "helper", None, "helper(save)", "app.Item<app.Other>", "Main.kt", 4, None, 3, None, 1),
    (31, "IDENTIFIER", "save", None, "save", None, "Main.kt", 4, None, 1, 1, 1),
    (40, "PARAMETER", "v", None, "v", None, "Main.kt", 11, None, 1, None, 2),
    (41, "CALL", "hide", None, "v.hide()", None, "Main.kt", 12, None, 0, None, 2),
    (42, "IDENTIFIER", "v", None, "v", None, "Main.kt", 12, None, 0, 0, 2),
]
EDGES = [
    *[(s, d, "AST") for s, d in ((1, 10), (1, 11), (10, 12), (1, 20), (20, 21), (1, 30), (30, 31), (2, 40), (2, 41), (41, 42))],
    (21, 11, "REF"), (31, 11, "REF"), (42, 40, "REF"), (30, 2, "CALL"), (30, 31, "ARGUMENT"),
]


def tables(spark):
    return spark.createDataFrame(NODES, NODE), spark.createDataFrame(EDGES, "src long, dst long, kind string")


def test_occurrences_and_owners(spark):
    nodes, edges = tables(spark)
    decls = spark.createDataFrame([("R.id.save", None, "save", "save", "MainBinding", "main", "Button")], "resource_id string, owner string, name string, binding_field string, binding_class string, layout_name string, tag string")
    found = program.occurrences(nodes, decls)
    assert [(r["node_id"], r["resource_id"], r["collector"]) for r in found.collect()] == [(12, "R.id.save", "lookup")]
    owned = program.handle_owners(found, nodes, edges).first()
    assert (owned["handle_owner_node_id"], owned["handle_name"]) == ("10", "save")
    anchors = found.select(F.col("node_id").alias("node"))
    assert program.anchor_kinds(anchors, nodes, edges).first()["usage_type"] == "ASSIGNMENT"


def test_usages(spark):
    nodes, edges = tables(spark)
    anchors = spark.createDataFrame([("a", 12, "save", "ASSIGNMENT", 1, "android.widget.Button")], "anchor string, node long, name string, usage_type string, method_id long, view_type string")
    found = {(r["node_id"], r["kind"]) for r in program.anchor_usages(anchors, nodes, edges).collect()}
    assert {(20, "SETTER"), (41, "SETTER")} <= found and (10, "SETTER") not in found


def test_slices(spark):
    nodes, edges = tables(spark)
    types = spark.createDataFrame([("app.Item",), ("app.Other",), ("app.Unused",)], "type_full_name string")
    out = program.collect_slices(spark.createDataFrame([(2,)], "root long"), nodes, edges, types)
    assert [(r["callback"], r["kind"], r["depth"]) for r in out["callbacks"].collect()] == [(1, "LIFECYCLE", 1)]
    forward = program.collect_slices(spark.createDataFrame([(1,)], "root long"), nodes, edges, types)
    assert [(r["node"], r["depth"]) for r in forward["callees"].collect()] == [(2, 1)]
    assert {r["type"] for r in forward["types"].collect()} == {"app.Item", "app.Other"}
    methods = nodes.where("label = 'METHOD'")
    usages = spark.createDataFrame([("a", 20, "app.Main.lambda$onCreate$0:void()", "Main.kt", 3, "c", "SETTER"), ("a", 20, "app.Main.onCreate:void()", "Main.kt", 3, "c", "SETTER")], "anchor string, node_id long, method string, file string, line int, code string, kind string")
    got = program.slices(usages, methods.select("full_name", F.col("ord"))).collect()
    assert [(r["primary_method"], len(r["usages"])) for r in got] == [("app.Main.onCreate:void()", 1)]


def test_texts_and_files(spark):
    files = spark.createDataFrame([("A.kt", "x\nfun f() {\n  g(\n    1)\n}\ny")], "path string, text string")
    spans = spark.createDataFrame([("f", "A.kt", 2, 3)], "method string, path string, first_line int, last_line int")
    assert program.method_text(spans, lines(files)).first()["body"] == "fun f() {\n  g(\n    1)\n}"
    wanted = spark.createDataFrame([("tmp/app/src/A.kt",), ("no/B.kt",)], "path string")
    have = spark.createDataFrame([("src/A.kt",), ("A.kt",)], "file string")
    assert {r["path"]: r["file"] for r in program.resolved_files(wanted, have).collect()} == {"tmp/app/src/A.kt": "src/A.kt", "no/B.kt": None}
    nodes, edges = tables(spark)
    assert {r["node"]: (r["first_line"], r["last_line"]) for r in program.subtree_lines(nodes, edges).collect()}[1] == (1, 4)


def test_prototypes(spark):
    fields = spark.createDataFrame([("A", "b", "B"), ("A", "n", "int"), ("B", "a", "A"), ("B", "s", "String")], "owner string, name string, type string")
    got = {(r["path"], r["type"], r["circular"]) for r in program.expanded_fields(fields, spark.createDataFrame([("A",)], "root string")).collect()}
    assert got == {("b", "B", False), ("n", "int", False), ("b.a", "A", True), ("b.s", "String", False)}
    models = spark.createDataFrame([("M", "app.Store"), ("N", "int")], "model string, parameter_type string")
    assert {tuple(r) for r in program.store_injections(models, spark.createDataFrame([("app.Store",)], "store string")).collect()} == {("M", "app.Store"), ("N", None)}
    states = spark.createDataFrame([("s", "f", "C", "F")], "state string, function string, class string, file string")
    views = spark.createDataFrame([("v", "f", "C", "F"), ("w", "g", "C", "F"), ("x", "h", "D", "F")], "view string, function string, class string, file string")
    assert {(r["view"], r["level"]) for r in program.view_contexts(states, views).collect()} == {("v", 1), ("w", 2), ("x", 3)}


def test_contracts_and_usage(spark):
    predicates = spark.createDataFrame([(0, "Is on"), (1, "is-on"), (2, "other")], "ord int, name string")
    seeds = spark.createDataFrame([("__screen__", ["s"]), ("other", ["o"])], "name string, uids array<string>")
    got = {r["ord"]: (r["predicate_uid"], r["uids"]) for r in program.contract(predicates, seeds).collect()}
    assert got == {0: ("pred_is_on", ["s"]), 1: ("pred_is_on_2", ["s"]), 2: ("pred_other", ["o"])}
    raw = spark.createDataFrame([(1, '{"prompt_tokens": 10, "completion_tokens": 3, "prompt_tokens_details": {"cached_tokens": 4}}'), (2, '{"input_tokens": 7}'), (3, "x")], "request int, usage string")
    assert [tuple(r)[1:] for r in program.token_usage(raw).orderBy("request").collect()] == [(10, 3, 0, 4), (7, 0, 0, 0), (0, 0, 0, 0)]
    items = spark.createDataFrame([(1, 0, "message"), (1, 1, "compaction"), (2, 0, "message")], "window int, ord int, type string")
    assert {r["window"]: (r["items"], r["valid"]) for r in program.compaction_window(items).collect()} == {1: (["compaction"], True), 2: ([], False)}
    one = spark.createDataFrame([(1, "method", 0, "A.f"), (1, "method", 1, "B")], "page int, kind string, ord int, name string")
    assert program.provenance(one, one).first()["uids"] == ["method_a_f", "method_b"]


def test_lookups_and_aliases(spark):
    from weft.sources import android

    code = spark.createDataFrame([("A.java", 1, "int SAVE = R2.id.save;"), ("A.java", 2, "x = 1")], "path string, line int, code string")
    aliases = android.resource_aliases(code)
    assert [tuple(r) for r in aliases.collect()] == [("A.java", "SAVE", "R.id.save")]
    calls = spark.createDataFrame([(1, "A.java", "findViewById(R.id.a)"), (2, "A.java", "findViewById(SAVE)"), (3, "A.java", "findViewById(ids[i])")], "node long, path string, code string")
    assert sorted(tuple(r) for r in android.lookups(calls, aliases).collect()) == [(1, "R.id.a"), (2, "R.id.save"), (3, "UNKNOWN_DYNAMIC_RESOURCE")]


def test_external_resources_and_inventories(spark):
    from weft.sources import android

    xml = '<A xmlns:android="u"><B android:id="@+id/x"/></A>'
    files = spark.createDataFrame([("lib/one/res/layout/a.xml", xml), ("app/res/layout/b.xml", xml)], "path string, text string")
    merger = '<merger><dataSet config="g:one:1" from-dependency="true"><source path="lib/one/res"/></dataSet><dataSet config="main"><source path="app/res"/></dataSet></merger>'
    roots = android.dependency_roots(spark.createDataFrame([("m.xml", merger)], "path string, text string"))
    assert [tuple(r) for r in roots.collect()] == [("g:one:1", "lib/one/res")]
    assert [(r["name"], r["coordinate"]) for r in android.external_resources(files, roots).collect()] == [("x", "g:one:1")]
    docs = spark.createDataFrame([("i.json", '[{"resource_id": "R.id.a", "name": " a ", "owner": " ", "line": "7"}, {"name": "b", "line": "?"}]'), ("j.json", "{}")], "path string, text string")
    assert sorted((r["name"], r["owner"], r["line"]) for r in android.declared(docs).collect()) == [("a", None, 7), ("b", None, None)]


def test_property_uses_and_stats(spark):
    expressions = spark.createDataFrame([(1, "vm.state", "app.Vm"), (2, "x.state", "Vm"), (3, "y.state", "Other")], "expression int, text string, receiver_type string")
    properties = spark.createDataFrame([("p1", 1, "app.Vm", "state"), ("p0", 0, "lib.Vm", "state")], "property string, ord int, owner string, name string")
    assert {tuple(r) for r in program.property_uses(expressions, properties).collect()} == {(1, "p0"), (2, "p0")}
    before = spark.createDataFrame([(1, "A", False), (2, "B", False), (3, "C", True)], "chunk int, method string, oversized boolean")
    after = spark.createDataFrame([(1, "A", False), (1, "B", False), (2, "C", True)], "chunk int, method string, oversized boolean")
    found = program.packing_stats(before, after, spark.createDataFrame([("A", "r"), ("B", "r"), ("C", "s")], "method string, resource string")).first()
    assert (found["n_before"], found["n_after"], found["n_oversized"], found["n_resources"], found["saved"]) == (3, 2, 1, 2, 1)


def test_expansion_is_that_of_a_depth_first_walk(spark):
    r = random.Random(4)
    fields = {f"T{i}": [(f"f{k}", r.choice(["Int", f"T{r.randrange(40)}", f"T{r.randrange(40)}?", f"T{r.randrange(40)}<Int>", "Other"])) for k in range(r.randrange(5))] for i in range(40)}
    rows = [(o, n, t, k) for o, fs in fields.items() for k, (n, t) in enumerate(fs)]

    def walk(root):
        out, seen = [], set()

        def go(path, raw):
            kind = raw.rstrip("?")
            own = fields.get(kind.split("<")[0])
            if path:
                out.append((root, path, kind, raw.endswith("?"), bool(own) and kind in seen))
            if own and kind not in seen:
                seen.add(kind)
                for n, t in own:
                    go(f"{path}.{n}" if path else n, t)

        go("", root)
        return out

    frame = spark.createDataFrame([*rows, rows[0]], "owner string, name string, type string, ord long")
    got = program.expanded_fields(frame, spark.createDataFrame([(t,) for t in fields], "root string")).collect()
    assert sorted(map(tuple, got)) == sorted(x for t in fields for x in walk(t))


def test_expansion_takes_each_pair_once(spark):
    """A chain of types: one round a step, each with the newest classes only (all trees were built anew in every round: 17,406 s at 6 GB by their growth)."""
    rows = [(f"T{i}", n, t) for i in range(30) for n, t in (("a", f"T{i + 1}?"), ("b", f"T{i + 2}<Int>"), ("c", "Int"))]
    frame, roots = spark.createDataFrame(rows, "owner string, name string, type string"), spark.createDataFrame([("T0",), ("T20",), (None,), ("X",)], "root string")
    one = sorted(map(tuple, program.expanded_fields(frame, roots).collect()))
    assert one == sorted(map(tuple, program.expanded_fields(frame, roots, most=40).collect()))  # T0 in rounds, T20 in a task
    assert {r[0] for r in one} == {"T0", "T20"} and sum(not r[4] for r in one if r[0] == "T20") > 20


def test_paths_are_those_of_a_depth_first_walk(spark):
    r = random.Random(9)
    edges = sorted({(m, r.randrange(14), r.randrange(14)) for m in range(8) for _ in range(26)})
    after = lambda m, n: [d for k, s, d in edges if (k, s) == (m, n)]
    for most, deep in ((8, 20), (5, 6), (1, 1)):
        want = []
        for m in range(8):
            found, todo = [], [[0]]
            while todo and len(found) < most:
                path = todo.pop()
                further = [d for d in after(m, path[-1]) if d not in path[:-1]] if len(path) < deep else []
                if further:
                    todo += [[*path, d] for d in reversed(further)]
                else:
                    found.append(path)
            want += [(m, i, "/".join(map(str, p)), [f"{a}-{b}" for a, b in zip(p, p[1:])]) for i, p in enumerate(found, 1)]
        frame = spark.createDataFrame([(*e, f"{e[1]}-{e[2]}") for e in edges], "method long, src long, dst long, label string")
        got = cfg.block_paths(frame, spark.createDataFrame([(m, 0) for m in range(8)], "method long, node long"), most, deep).collect()
        assert sorted(map(tuple, got)) == want

"""Operators on the small domain inputs and against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from weft.operators import cfg, evidence, graph, merge, pack, ranked, render, resolve
from weft.sources import android, documents
from weft.streaming import accumulate


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


ANCHORS = [("R.id.title", "titleHeader", "Header.java:10", "TextView", "101"), ("R.id.title", "titleFooter", "Footer.java:20", "TextView", "202"), ("UNKNOWN_DYNAMIC_RESOURCE", "dynamic", "Dynamic.java:7", "UNKNOWN", "303")]


def test_bundle_resolves_the_footer(spark):
    anchors = spark.createDataFrame([(i, *a) for i, a in enumerate(ANCHORS)], "ord long, resource_id string, anchor_name string, location string, view_type string, cpg_node_id string")
    usage = [(0, "R.id.title", "titleFooter", "Footer.java:20", ["202"], "titleFooter.getText()", "GETTER", "pkg.Footer.render:void()"), (1, "R.id.title", "x", "y", ["9"], "c", "SETTER", "m"), (2, "R.id.title", "x", "y", ["101"], "d", "LISTENER", "m"), (3, "R.id.none", "", "", [], "e", "OTHER", "m"), (4, "R.id.title", "", "", [], "gone", "GETTER", " ")]
    usages = spark.createDataFrame(usage, "ord long, resource_id string, name string, location string, node_ids array<string>, code string, usage_kind string, method string")
    out = evidence.bundle(anchors, usages)
    uid = {r["name"]: r["uid"] for r in out["anchors"].collect()}
    assert set(uid) == {"titleHeader", "titleFooter"}
    got = {r["ord"]: (r["anchor_uid"], r["tier"], r["kind"], r["ambiguous"]) for r in out["usages"].collect()}
    assert got[0] == (uid["titleFooter"], 1, "read", False) and got[1] == (uid["titleHeader"], 3, "write", True) and got[2] == (uid["titleHeader"], 2, "sink", False)
    assert got[3][:2] == (None, None) and 4 not in got
    assert rows(out["warnings"]) == [("ambiguous_anchor", "R.id.title"), ("dynamic_resource_id", "UNKNOWN_DYNAMIC_RESOURCE")]


def test_missing_lambda_body(spark):
    slices = spark.createDataFrame([(0, "pkg.Editor.lambda$showSearchDialog$0:void()")], "slice int, primary_method string")
    out, warnings = evidence.method_slices(slices, spark.createDataFrame([], "method_full_name string, body string, ord int"))
    assert out.first()["nullable_reason"] == "lambda_or_anonymous_body_omitted" and rows(warnings) == [("missing_method_source", "pkg.Editor.lambda$showSearchDialog$0:void()")]


def test_method_sources(spark):
    methods = spark.createDataFrame([(0, "p.E.show:void()", "fun show"), (1, "p.E.hide:void()", "fun hide")], "ord int, method_full_name string, body string")
    types = spark.createDataFrame([(0, "p.Item", "class Item")], "ord int, type_full_name string, body string")
    refs = spark.createDataFrame([("p.E.hide:void()",), ("p.E.lambda$show$0:void()",), ("p.Item.<init>:void()",), ("p.X.y:void()",)], "method_full_name string")
    assert rows(resolve.method_sources(refs, methods, types), "source", "reason") == sorted([("fun hide", None), ("fun show", None), ("class Item", None), (None, "method_body_missing")], key=repr)


SLICES = [(1, "pkg.A.onClick:void()", ["R.id.a"], ["pkg.Shared.helper:void()"], ["pkg.Model"], False), (2, "pkg.B.onClick:void()", ["R.id.b"], ["pkg.Shared.helper:void()"], ["pkg.Model"], False), (3, "pkg.C.x:void()", ["R.id.c"], [], [], False), (4, "pkg.D.x:void()", ["R.id.a"], [], [], True)]


def test_payload(spark):
    slices = spark.createDataFrame(SLICES, "slice int, primary_method string, resource_ids array<string>, method_body_refs array<string>, domain_type_refs array<string>, incomplete boolean")
    visible = spark.createDataFrame([("R.id.a",), ("R.id.b",), ("R.id.empty",)], "resource_id string")
    bodies = spark.createDataFrame([(0, "pkg.A.onClick:void()", "a"), (1, "pkg.Shared.helper:void()", "h")], "ord int, method_full_name string, body string")
    types = spark.createDataFrame([(0, "pkg.Model", "CLASS", "class Model\n{}")], "ord int, type_full_name string, kind string, body string")
    out = evidence.payload(slices, visible, bodies, types)
    assert rows(out["methods"], "method", "role", "resource_ids", "source_code") == [("pkg.A.onClick:void()", "primary", ["R.id.a"], "a"), ("pkg.B.onClick:void()", "primary", ["R.id.b"], None), ("pkg.Shared.helper:void()", "body_ref", ["R.id.a", "R.id.b"], "h")]
    assert rows(out["types"], "type_full_name", "body_lines") == [("pkg.Model", 2)] and rows(out["stats"]) == [(2, 2, 2)] and out["missing"].count() == 0


def test_shared_helper_is_indexed_once(spark):
    seen = [(0, "R.id.a", "A", "Model"), (1, "R.id.a", "Shared", None), (2, "R.id.b", "B", "Model"), (3, "R.id.b", "Shared", None)]
    out = evidence.evidence_index(spark.createDataFrame(seen, "ord int, resource string, method string, type string"))
    assert rows(out["stats"]) == [("method", 3, 4, 1), ("type", 1, 2, 1)]
    assert rows(out["methods"], "method", "resources") == [("A", ["R.id.a"]), ("B", ["R.id.b"]), ("Shared", ["R.id.a", "R.id.b"])]


def test_attribution(spark):
    methods = spark.createDataFrame([("pkg.A.f", "val m: Model")], "method string, source_code string")
    types = spark.createDataFrame([("pkg.Model",), ("pkg.Unused",)], "type string")
    refs = spark.createDataFrame([("pkg.A.f", "pkg.Model"), ("pkg.A.f", "pkg.Unused")], "method string, type string")
    assert rows(evidence.attributed(methods, types, refs, "method_local")) == [("pkg.A.f", "pkg.Model", True), ("pkg.A.f", "pkg.Unused", False)]
    assert all(r[2] for r in rows(evidence.attributed(methods, types, refs, "slice_local")))


def test_canonical_handles(spark):
    schema = "resource_id string, binding_class string, binding_field string, handle_name string, handle_owner_node_id string, node_id long, location string, occurrence_role string, code string"
    data = [
        ("R.id.a", None, "a", "v", "7", 1, "F:1", "USAGE", "v.show()"),
        ("R.id.a", None, "a", "v", "7", 2, "F:2", "HANDLE", "val v = findViewById(R.id.a)"),
        ("R.id.a", None, "a", "v", "7", 3, "F:3", "HANDLE", "run(v)"),
        ("R.id.b", None, "b", None, None, 4, "F:4", "USAGE", "x {\n R.id.b }"),
    ]
    assert rows(ranked.canonical_handles(spark.createDataFrame(data, schema)), "node_id") == [(2,)]


def test_cross_anchor(spark):
    schema = "resource_id string, node_id long, file string, line int, code string, kind string, report int, ord int"
    data = [("a", 1, "F", 1, "x.setText(y)", "SETTER", 0, 0), ("a", 1, "F", 1, "x.setText", "GETTER", 0, 1), ("a", 2, "F", 1, "setText(y)", "SETTER", 0, 2), ("a", 3, "F", 2, "tmp_1", "OTHER", 0, 3), ("a", 4, "F", 3, "org.app.some.name", "OTHER", 0, 4)]
    once = ranked.cross_anchor(spark.createDataFrame(data, schema))
    assert rows(once, "node_id") == [(1,)] and rows(ranked.cross_anchor(once), "node_id") == [(1,)]


def test_containment_against_all_pairs(spark):
    r = random.Random(1)
    texts = sorted({(r.randint(0, 2), "".join(r.choices("ab", k=r.randint(0, 9)))) for _ in range(150)})
    want = sorted(t for t in texts if not any(k == t[0] and len(u) > len(t[1]) and t[1] in u for k, u in texts if t[1]))
    assert rows(ranked.not_contained(spark.createDataFrame(texts, "k int, t string"), ["k"], "t"), "k", "t") == want


def test_resource_matches(spark):
    decls = spark.createDataFrame([("R.id.a", "p", "a", 1), ("R.id.b", "p", "b", 2), ("R.id.b", "q", "b", 3)], "resource_id string, owner string, name string, d int")
    refs = spark.createDataFrame([("R.id.a", None, "a"), ("x", "q", "b"), ("y", None, "b"), ("z", "r", "b")], "ref string, owner string, name string")
    got = rows(resolve.resource_matches(refs, decls, fallback=True), "ref", "d", "tier")
    assert got == sorted([("R.id.a", 1, 1), ("x", 3, 2), ("y", 2, 3), ("y", 3, 3), ("z", None, 4)], key=repr)


def test_predicates_merge(spark):
    p = spark.createDataFrame([(0, " login ", "d0", None), (1, "cart", "c", "e1"), (2, "login", " ", "e2"), (3, None, "x", "y")], "ord int, name string, description string, evidence string")
    v = spark.createDataFrame([("login", 0, 0, "a", "String", "x", None), ("login", 2, 0, "a", None, "y", None), ("cart", 1, 0, "n", "Number", "p", None), ("cart", 1, 1, "n", "Number", "q", None)], "predicate string, pred_ord int, ord int, name string, type string, description string, value_options array<string>")
    ps, vs = merge.merge_predicates(p, v)
    assert rows(ps, "name", "seen", "description", "evidence") == [("cart", 1, "c", "e1"), ("login", 0, "d0", "e2")]
    assert rows(vs, "predicate", "name", "type", "description") == [("cart", "n", "Number", "p"), ("cart", "n", "Number", "q"), ("login", "a", None, "y")]


def test_candidates(spark):
    data = [(0, "Is Open", "x", "Boolean", "first", "c1"), (1, "is-open", "X", "String", "second", "c2"), (2, "other", "x", "String", "", "c1")]
    kept, duplicates = merge.candidates(spark.createDataFrame(data, "ord int, predicate string, variable string, type string, description string, chunk_id string"))
    assert rows(kept, "predicate", "type", "chunks", "n") == [("Is Open", "Boolean", ["c1", "c2"], 2), ("other", "String", ["c1"], 1)]
    assert rows(duplicates, "ord", "nth") == [(1, 2)]


def test_verdicts(spark):
    have = spark.createDataFrame([("P001", "V001"), ("P001", "V002"), ("P002", "V001")], "p string, v string")
    said = spark.createDataFrame([("P001", "V001", "drop"), ("P001", "V001", "keep"), ("P009", "V001", "drop"), ("P002", "V001", "keep")], "p string, v string, verdict string")
    assert rows(merge.monotone_decrease(have, said, ["p", "v"])) == [("P001", "V002"), ("P002", "V001")]
    assert rows(merge.verdict_counts(said.withColumn("c", F.lit(1)), have, ["p", "v"], ["c"])) == [(1, 1, 2, 1)]


def plain_shortest(roots, edges, depth):
    after = {}
    for s, d in edges:
        after.setdefault(s, set()).add(d)
    out = {}
    for root in roots:
        best = {root: [root]}
        front = [root]
        for _ in range(depth):
            found = {}
            for n in front:
                for d in after.get(n, ()):
                    if d not in best:
                        found[d] = min(found.get(d, [*best[n], d]), [*best[n], d])
            best |= found
            front = list(found)
        out |= {(root, n): p for n, p in best.items()}
    return out


def test_shortest_paths_on_random_graphs(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 14), r.randint(0, 14)) for _ in range(40)]
    got = graph.shortest_paths(spark.createDataFrame([(0,), (3,)], "root long"), spark.createDataFrame(edges, "src long, dst long"), 4)
    assert {(x["root"], x["node"]): x["path"] for x in got.collect()} == plain_shortest([0, 3], edges, 4)


def test_callbacks_over_lambdas(spark):
    calls = spark.createDataFrame([("screen.onTap", "helper"), ("fw.run", "helper")], "src string, dst string")
    hosts = spark.createDataFrame([("screen.onCreate", "screen.onTap")], "src string, dst string")
    nodes = spark.createDataFrame([("helper", None, False), ("screen.onTap", "LISTENER", False), ("screen.onCreate", "LIFECYCLE", False), ("fw.run", "OVERRIDE", True)], "node string, callback_kind string, framework boolean")
    found = graph.backward_callbacks(spark.createDataFrame([("helper",)], "root string"), calls, hosts, nodes, 10)
    assert rows(found, "callback", "relation", "depth") == [("screen.onCreate", "LAMBDA_REGISTRATION_CHAIN", 2), ("screen.onTap", "CALLER_CHAIN", 1)]


def test_walks_without_a_bound(spark):
    chain = spark.createDataFrame([(n, n + 1) for n in range(20)] + [(20, 0)], "src long, dst long")
    roots = spark.createDataFrame([(20,)], "root long")
    assert rows(graph.shortest_paths(roots, chain, None), "node", "depth") == sorted([(20, 0)] + [(n, n + 1) for n in range(20)], key=repr)
    nodes = spark.createDataFrame([(n, "LISTENER" if n == 3 else None, False) for n in range(21)], "node long, callback_kind string, framework boolean")
    found = graph.backward_callbacks(roots, chain, chain.limit(0), nodes)
    assert [(r["callback"], r["depth"], r["path"]) for r in found.collect()] == [(3, 17, list(range(3, 21)))]
    deep = spark.createDataFrame([(n, n - 1) for n in range(1, 80)], "node long, parent long")
    assert rows(graph.ancestors(deep), "node", "ancestor", "distance") == sorted(((n, a, n - a) for n in range(1, 80) for a in range(n)), key=repr)
    with pytest.raises(ValueError, match="cycle"):
        graph.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long"))


def test_ancestors(spark):
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5)], "node long, parent long")
    up = graph.ancestors(tree, 8)
    assert rows(up, "node", "ancestor", "distance") == sorted(((n, a, n - a) for n in range(1, 7) for a in range(1, n)), key=repr)
    assert rows(graph.nearest_ancestor(up, tree, F.col("node") % 2 == 0), "node", "ancestor") == [(3, 2), (4, 2), (5, 4), (6, 4)]


def plain_blocks(nodes, edges):
    pred, succ = {}, {}
    for s, d in set(edges):
        pred.setdefault(d, set()).add(s)
        succ.setdefault(s, set()).add(d)
    back = {n: next(iter(pred[n])) for n in nodes if len(pred.get(n, ())) == 1 and len(succ[next(iter(pred[n]))]) == 1 and n not in pred[n]}
    out = {}
    for n in nodes:
        walk = [n]
        while walk[-1] in back and back[walk[-1]] not in walk:
            walk.append(back[walk[-1]])
        out[n] = min(walk) if walk[-1] in back else walk[-1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_basic_blocks_on_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 24
    edges = [(i, i + 1) for i in range(n - 1) if r.random() < 0.8] + [(r.randrange(n), r.randrange(n)) for _ in range(4)] + [(30, 31), (31, 32), (32, 30)]
    nodes = [*range(n), 30, 31, 32]
    found = cfg.basic_blocks(spark.createDataFrame([(1, i, i) for i in nodes], "method long, node long, line long"), spark.createDataFrame([(1, *e) for e in edges], "method long, src long, dst long"))
    assert {x["node"]: x["leader"] for x in found.collect()} == plain_blocks(nodes, edges)


def test_paths_and_labels(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 4), (1, 3, 4), (1, 4, 1)], "method long, src long, dst long")
    entries = spark.createDataFrame([(1, 1)], "method long, node long")
    assert rows(cfg.block_paths(edges, entries), "n", "path") == [(1, "1/2/4"), (2, "1/3/4")]
    assert cfg.block_paths(edges, entries, max_paths=1).count() == 1
    blocks = spark.createDataFrame([(1, 1, "condition", 1), (1, 2, "other", 5), (1, 3, "other", 2), (1, 4, "other", 9)], "method long, block long, kind string, first_line int")
    assert {(x["src"], x["dst"]): x["label"] for x in cfg.edge_labels(edges, blocks).collect()} == {(1, 2): "false", (1, 3): "true", (2, 4): "", (3, 4): "", (4, 1): ""}


def plain_pack(sizes, target, most):
    out, used, chunk = [], 0, 1
    for s in sizes:
        if used and (used >= target or used + s > most):
            chunk, used = chunk + 1, 0
        used += s
        out.append(chunk)
    return out


def test_ordered_packing(spark):
    r = random.Random(6)
    data = [(g, i, r.randint(1, 120)) for g in ("a", "b", None) for i in range(60)]
    got = pack.pack_ordered(spark.createDataFrame(data, "g string, i long, n long"), "g", "i", "n", 80, 100)
    for g in ("a", "b", None):
        mine = [x for x in data if x[0] == g]
        assert [c for _, c in sorted((x["i"], x["chunk"]) for x in got.collect() if x["g"] == g)] == plain_pack([x[2] for x in mine], 80, 100)
    assert all(x["oversized"] == (x["n"] > 100) for x in got.collect())


def test_segments_fold_as_one(spark):
    r = random.Random(8)
    for _ in range(3000):
        target = r.randint(1, 60)
        most = target + r.randint(0, 40)
        parts = [[r.randint(1, r.choice((3, 30, 120))) for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 5))]
        used, chunk, got = 0, 1, []
        for sizes in parts:
            got.append(chunk)
            s = pack.Segment(sizes, target, most)
            closed, used = pack.entered(used, s.sums, s.after, s.last, s.total, target, most)
            chunk += closed
        flat = plain_pack([x for p in parts for x in p], target, most)
        at, want = 0, []
        for p in parts:
            want.append(flat[at - 1] if at else 1)
            at += len(p)
        assert got == want and chunk == flat[-1], (parts, target, most, got, want)


def test_text_packing_is_lossless(spark):
    r = random.Random(7)
    texts = ["".join(r.choices("ab\n", k=r.randint(0, 400))) for _ in range(20)] + ["x" * 333, "", "\n\n"]
    got = pack.pack_text(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t", 40, 50).collect()
    for i, t in enumerate(texts):
        mine = sorted((x for x in got if x["id"] == i), key=lambda x: x["chunk"])
        assert "".join(x["body"] for x in mine) == t and all(len(x["body"]) <= 50 for x in mine)
        units = [line[k : k + 50] for line in t.splitlines(keepends=True) for k in range(0, len(line), 50)]
        assert [x["chunk"] for x in mine] == sorted(set(plain_pack([len(u) for u in units], 40, 50)))


def test_graph_packing(spark):
    methods = spark.createDataFrame([(1, i, m, c) for i, (m, c) in enumerate([("A", 100), ("B", 100), ("Shared", 50), ("Big", 5000)])], "page long, ord int, method string, chars long")
    domains = spark.createDataFrame([(1, "A", "Model", 300), (1, "B", "Model", 300), (1, "Big", "Model", 300)], "page long, method string, domain string, chars long")
    one = rows(pack.pack_graph(methods, domains, 1, 1000), "chunk", "method", "oversized")
    assert one == [(1, "A", False), (1, "B", False), (1, "Shared", False), (2, "Big", True)]
    two = pack.pack_graph(methods, domains, 400, 500).collect()
    assert sorted(x["method"] for x in two) == ["A", "B", "Big", "Shared"] and {x["method"]: x["chunk"] for x in two}["A"] == {x["method"]: x["chunk"] for x in two}["B"]


def test_graph_packing_keeps_its_promises(spark):
    """Every method once, nothing over the limit but single methods, no two chunks left that fit together, the same from rows in any order."""
    r = random.Random(3)
    methods = [(p, i, f"m{i}", r.randint(5, 90)) for p in range(3) for i in range(120)]
    domains = [(p, f"m{i}", f"d{d}", 10 + d) for p in range(3) for i in range(120) for d in r.sample(range(30), r.randint(0, 4))]
    frames = lambda a, b: (spark.createDataFrame(a, "page long, ord int, method string, chars long"), spark.createDataFrame(b, "page long, method string, domain string, chars long"))
    found = sorted(map(tuple, pack.pack_graph(*frames(methods, domains), 300, 400).collect()))
    assert sorted((p, m) for p, _, m, _ in found) == sorted((p, m) for p, _, m, _ in methods)
    chars = {(p, m): c for p, _, m, c in methods}
    types = {}
    for p, m, d, c in domains:
        types.setdefault((p, m), {})[d] = c
    size = lambda p, ms: sum(chars[p, m] for m in ms) + sum({d: c for m in ms for d, c in types.get((p, m), {}).items()}.values())
    chunks = {}
    for p, n, m, over in found:
        chunks.setdefault((p, n, over), []).append(m)
    assert all(over == (size(p, ms) > 400) and (not over or len(ms) == 1) for (p, _, over), ms in chunks.items())
    for p in range(3):
        mine = [ms for (q, _, over), ms in chunks.items() if q == p and not over]
        assert all(size(p, x + y) > 400 for i, x in enumerate(mine) for y in mine[:i])
    r.shuffle(methods)
    r.shuffle(domains)
    assert sorted(map(tuple, pack.pack_graph(*frames(methods, domains), 300, 400).collect())) == found


def test_rendering(spark):
    methods = spark.createDataFrame([(1, 1, "B", "b()", ["R.id.b"]), (1, 0, "A", "a()", ["R.id.a"])], "page long, ord int, method string, source_code string, resource_ids array<string>")
    types = spark.createDataFrame([(1, 0, "T", "class T")], "page long, ord int, type_full_name string, body string")
    assert render.method_blobs(methods, types).first()["blob"] == "## A\na()\n\n## B\nb()\n\n### T\nclass T"
    diff = spark.createDataFrame([("a", "x", "FN"), ("b", "y", "FP"), ("c", "z", "TP")], "p string, v string, side string")
    assert render.difference_question(diff, ["p", "v"]).first()["text"] == "Missing:\na.x\n\nUnexpected:\nb.y"
    assert render.difference_question(diff.where("side = 'TP'"), ["p", "v"]).count() == 0
    got = spark.range(1).select(render.limited(F.array(*[F.lit(f"{i:02d}") for i in range(14)])).alias("a"), render.filled("{a}-{b}", a=F.lit("x"), b=F.lit(None)).alias("b")).first()
    assert got["a"].endswith("11 (+2 more)") and got["b"] == "x-"


def test_screens_and_resources(spark):
    dumps = spark.createDataFrame([(1, "<hierarchy><node resource-id='org.app:id/a' package='p' clickable=\"false\" text=''/><node resource-id='R.id.b'><node/></node></hierarchy>"), (2, "<hierarchy />")], "page int, text string")
    assert rows(android.visible_ids(dumps)) == [(1, "R.id.a"), (1, "R.id.b")]
    assert [set(x["attributes"]) for x in android.screen_nodes(dumps).orderBy("ord").collect()][0] == {"resource-id"}
    xml = '<LinearLayout xmlns:android="u"><TextView android:id="@+id/top_title"\n android:text="x"/><View android:text="no"/><Button android:id="@id/save"/></LinearLayout>'
    files = spark.createDataFrame([("res/layout-land/activity_main.xml", xml), ("res/values/strings.xml", "<r/>")], "path string, text string")
    got = android.resources(files)
    assert rows(got, "resource_id", "tag", "binding_class", "binding_field", "qualifiers") == [("R.id.save", "Button", "ActivityMainBinding", "save", "land"), ("R.id.top_title", "TextView", "ActivityMainBinding", "topTitle", "land")]
    assert rows(android.id_lines(files, got), "name", "line") == [("save", 2), ("top_title", 1)]
    with pytest.raises(Exception):
        android.resources(spark.createDataFrame([("res/layout/x.xml", "<a><b></a>")], "path string, text string")).collect()


def test_backward_parts(spark, monkeypatch):
    """Parts walked in tasks give the rows that rounds over the tables give, also where edges cross them, a part is large or a node has none."""
    r = random.Random(5)
    nodes = [(i, r.choice([None, "click", "signup"]), r.random() < 0.1) for i in range(60)]
    near = lambda i: (i // 10) * 10 + r.randrange(10)
    calls = [(near(i), i) for i in range(60) for _ in range(3)] + [(3, 14), (25, 58)]
    hosts = [(near(i), i) for i in range(0, 60, 7)]
    of = lambda xs, schema: spark.createDataFrame(xs, schema)
    args = of([(i,) for i in range(0, 60, 4)] + [(99,)], "root long"), of(calls, "src long, dst long"), of(hosts, "src long, dst long"), of(nodes, "node long, callback_kind string, framework boolean")
    parts = of([(i, i // 10 if i != 33 else None) for i in range(60)], "node long, part long")
    for depth in (None, 2):
        want = rows(graph.backward_callbacks(*args, depth))
        assert rows(graph.backward_callbacks(*args, depth, parts=parts)) == want == rows(graph.backward_callbacks(*args, depth, parts=parts, most=5))
    # nothing goes by rounds where all parts are small and closed: the plan is a fixed number of steps, however long the chains
    monkeypatch.setattr(graph, "backward_rounds", None)
    chain = of([(i, i + 1) for i in range(200) if i % 50 != 49], "src long, dst long")
    found = graph.backward_callbacks(of([(49,), (199,)], "root long"), chain, chain.limit(0), of([(i, "click", False) for i in range(200)], "node long, callback_kind string, framework boolean"), parts=of([(i, i // 50) for i in range(200)], "node long, part long"))
    assert found.count() == 100 and found.agg(F.max("depth")).first()[0] == 49


def test_bindings_and_sources(spark):
    code = "package p.d;\nimport android.widget.TextView;\npublic final class MainBinding {\n public final TextView a;\n public final p.V b;\n public final X c;\n}"
    got = android.binding_fields_of(spark.createDataFrame([("MainBinding.java", code)], "path string, text string"))
    assert rows(got, "field", "type", "resolution", "line") == [("a", "android.widget.TextView", "import", 4), ("b", "p.V", "qualified", 5), ("c", "X", "raw", 6)]
    # a file is read where it lies: many do not meet in one task, and two rows of one path do not mix
    other = code.replace("MainBinding", "OtherBinding").replace("android.widget.", "z.").replace("p.d", "q")
    plan = android.binding_fields_of(spark.createDataFrame([("x", code), ("x", other), ("y", "class No {}"), (None, code), ("z", None)], "path string, text string"))
    assert rows(plan, "binding_class", "field", "type")[::3] == [("p.d.MainBinding", "a", "android.widget.TextView"), ("q.OtherBinding", "a", "z.TextView")] and plan.count() == 6
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([("app/src/main/A.kt", "x"), ("app/src/test/B.kt", "x"), ("app/build/C.kt", "x"), ("D.java", "y\nz"), ("E.kt", " ")], "path string, text string")
    assert rows(android.source_files(files), "path", "n_lines") == [("D.java", 2), ("app/src/main/A.kt", 1)]
    assert rows(android.language_census(files)) == [("java", 1), ("kotlin", 4)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "u.json").write_text('[{"anchor": {"resource_id": "R.id.a", "anchor_name": "a", "cpg_node_id": "7"}, "usages": [{"anchor_id": "7", "usage_point": {"node_id": "9", "file": "F", "start_line": 3, "code": "a.x()", "usage_kind": "GETTER"}, "enclosing_method_full_name": "m"}]}]')
    (tmp_path / "m.json").write_text('{"z.m": {"body": "1"}, "a.m": {"method_full_name": "a.m", "body": "2"}}')
    files = documents.whole_texts(spark, str(tmp_path))
    got = documents.usages(files.where("path like '%u.json'")).first()
    assert (got["resource_id"], got["node_id"], got["line"], got["method"]) == ("R.id.a", 9, 3, "m")
    assert rows(documents.method_bodies(files.where("path like '%m.json'")), "ord", "method_full_name", "body") == [(0, "z.m", "1"), (1, "a.m", "2")]
    assert documents.usages(files.where("path like '%m.json'")).count() == 0


def test_pages_and_manifests(spark):
    files = spark.createDataFrame([(f"run/page_{n}/x.xml",) for n in (1, 2, 10)] + [("run/other.xml",)], "path string")
    assert [rows(documents.pages(files, s), "page") for s in (None, "2:", ":2", "10")] == [[(1,), (10,), (2,)], [(10,), (2,)], [(1,), (2,)], [(10,)]]
    with pytest.raises(ValueError):
        documents.pages(files, "5")
    schema = "page int, fields map<string,string>, outputs map<string,string>"
    merged = documents.merge_manifest(spark.createDataFrame([(1, {"a": "1", "b": "1"}, {})], schema), spark.createDataFrame([(1, {"a": "2"}, {"v": "x"}), (2, {}, {})], schema))
    assert rows(merged) == [(1, {"a": "2", "b": "1"}, {"v": "x"}), (2, {}, {})]
    runs = spark.createDataFrame([("r/1/a", 5), ("r/1/b", 5), ("r/2/a", 9), ("r/3/a", 7), ("r/3/b", 6)], "path string, modified long")
    assert documents.latest_run(runs, ["a", "b"]).first()["run"] == "r/3"


def test_stream_equals_batch(spark, tmp_path):
    schema = "predicate string, page int, description string, evidence string"
    pages = [[("login", 1, "d", None), ("cart", 1, "c", "e")], [("login", 2, " ", "e2")], [("pay", 3, "p", None), ("cart", 3, "c3", None)]]
    for i, p in enumerate(pages):
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = accumulate.start(stream, ["predicate"], "page", ["description", "evidence"], str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = accumulate.current(spark.read.parquet(str(tmp_path / "out")), ["predicate"])
    want = accumulate.accumulated(spark.read.parquet(str(tmp_path / "in")), ["predicate"], "page", ["description", "evidence"])
    cols = ("predicate", "seen", "description", "evidence")
    assert rows(got, *cols) == rows(want, *cols) == [("cart", 1, "c3", "e"), ("login", 1, "d", "e2"), ("pay", 3, "p", None)]


def test_replay(spark):
    requests = spark.createDataFrame([(1, "good"), (2, "bad")], "request_id long, prompt string")

    def call(prompt):
        if prompt == "bad":
            raise ValueError
        return prompt.upper()

    assert rows(accumulate.replayed(requests, call, 2), "request_id", "attempt", "ok", "output") == [(1, 1, True, "GOOD"), (2, 1, False, "ValueError"), (2, 2, False, "ValueError")]
    chunks = spark.createDataFrame([(1, 1, ["a"], False)], "page int, chunk long, resource_ids array<string>, synthetic boolean")
    pages = spark.createDataFrame([(1, ["a"]), (2, ["b", "c"])], "page int, resource_ids array<string>")
    assert rows(accumulate.with_fallback(chunks, pages)) == [(1, 1, ["a"], False), (2, 1, ["b", "c"], True)]


def test_savings_need_no_pairs(spark):
    """Savings were counted over all pairs of a key and its values: 3,700 MB of one task's memory at 6 GB by their growth."""
    rows = [(1, "r", "m", "t"), (2, "r", "m", "t"), (3, "s", "m", None), (4, None, "n", "u"), (5, "r", None, "t")]
    stats = evidence.evidence_index(spark.createDataFrame(rows, "ord long, resource string, method string, type string"))["stats"]
    assert sorted(tuple(r) for r in stats.collect()) == [("method", 2, 4, 2), ("type", 2, 4, 2)]
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "resource" in line and "LogicalRDD" not in line]

"""Screen trees and their compacted text against a plain parser."""

import io
import random
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

from weft.sources import screens

VALUES = ["", "true", "FALSE", "false", " true ", "a & b", "<x>", 'say "hi"', "it's", "né 漢", "  two words ", "[0,0][1,1]", "a>b", "tab\tline\nend"]


def dump(r: random.Random, depth: int = 0) -> str:
    names = r.sample(["text", "resource-id", "package", "bounds", "clickable", "content-desc"], r.randrange(6))
    attributes = "".join(f" {n}={quoteattr(r.choice(VALUES))}" for n in names)
    kids = "".join(dump(r, depth + 1) for _ in range(r.randrange(4) if depth < 4 else 0))
    gap = r.choice(["", "\n", "  ", "<!-- <node a='b'> -->"])
    return f"<node{attributes}/>{gap}" if not kids and r.random() < 0.7 else f"<node{attributes}>{gap}{kids}</node>{gap}"


def tidy(attributes: dict) -> dict:
    out = {}
    for k, v in attributes.items():
        if k == "bounds":
            out[k] = v
        elif k != "package" and v.strip().lower() not in ("", "false"):
            out[k] = "true" if v.strip().lower() == "true" else v.strip()
    return out


BAD = ["<a><b></a></b>", "<a>", "</a>", "<a x='1' x='2'/>", "<a/><b/>", "<a x=1/>", "<a><b</a>", "<a></a></a>"]


def test_trees_and_texts(spark):
    r = random.Random(2)
    good = {i: f"<?xml version='1.0'?>\n<hierarchy rotation=\"0\" a='&#233;&#x6F22;&amp;lt;'>{''.join(dump(r) for _ in range(r.randrange(3)))}</hierarchy>" for i in range(40)}
    bad = {100 + i: t for i, t in enumerate(BAD)}
    frame = spark.createDataFrame([*good.items(), *bad.items(), (200, ""), (201, "  "), (202, None)], "page long, text string")
    want, texts = [], {**bad, 200: "", 201: "", 202: ""}
    for i, t in good.items():
        tree = ET.ElementTree(ET.fromstring(t))
        count = 0

        def go(e, parent, level):
            nonlocal count
            n, count = count, count + 1
            want.append((i, n, parent, level, e.tag, tuple(tidy(e.attrib).items())))  # noqa: B023
            for k in e:
                go(k, n, level + 1)  # noqa: B023

        go(tree.getroot(), None, 0)
        for e in tree.getroot().iter():
            kept = tidy(e.attrib)
            e.attrib.clear()
            e.attrib.update(kept)
            e.text = e.tail = None
        ET.indent(tree)
        out = io.BytesIO()
        tree.write(out, encoding="utf-8", xml_declaration=True)
        texts[i] = out.getvalue().decode()
    got = [(x["page"], x["ord"], x["parent"], x["level"], x["name"], tuple((a["name"], a["value"]) for a in x["attributes"])) for x in screens.elements(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {x["page"]: x["text"] for x in screens.compacted(frame).collect()} == texts
    assert screens.elements(frame.limit(0)).count() == 0


def test_pages_are_not_shuffled(spark):
    """Tags were exploded and sorted once for each window: 512,984 MB at 6 GB by their growth."""
    frame = spark.createDataFrame([(1, "<a b='&#x110000;&#55296;x'><c/></a>"), (1, "<d></d>")], "page long, text string")
    for rows in (screens.elements(frame), screens.compacted(frame)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan
    assert [(x["page"], x["ord"], x["parent"], x["name"]) for x in screens.elements(frame).collect()] == [(1, 0, None, "a"), (1, 1, 0, "c"), (1, 0, None, "d")]
    assert screens.elements(frame).first()["attributes"][0]["value"] == "��x"

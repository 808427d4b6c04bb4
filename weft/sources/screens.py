"""Screen dumps as trees: elements with parents, and the compacted text.

A dump is one text, so it is read where it lies: its tags are matched against a stack, and no tag is shuffled or sorted.
A page whose tags don't match, whose attributes repeat, or that holds anything that looks like a tag and isn't one, is
malformed: it has no elements, and its compacted text is the text as it came. Comments, declarations and text between tags are left
out. The predefined entities and numeric ones are decoded, numbers that are no characters as U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NAME = r"[A-Za-z_][\w.:-]*"
_ATTRIBUTE = re.compile(rf"""({_NAME})\s*=\s*(?:"([^"<]*)"|'([^'<]*)')""", re.ASCII)
_TAG = re.compile(rf"""</?{_NAME}(?:\s+{_NAME}\s*=\s*(?:"[^"<]*"|'[^'<]*'))*\s*/?>""", re.ASCII)
_HEAD = re.compile(rf"</?({_NAME})", re.ASCII)
_ASIDE = re.compile(r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", re.ASCII | re.DOTALL)
_NUMBERS = [(re.compile(r"&#(\d{1,7});", re.ASCII), 10), (re.compile(r"&#x([0-9A-Fa-f]{1,6});"), 16)]
# The predefined entities; the ampersand is decoded last and encoded first.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
#: Attributes that are always left out, and one that always stays.
DROPPED, KEPT = ["package"], ["bounds"]
#: So many elements, or characters of text, go out at once.
MOST = 1 << 14


def decoded(v: str) -> str:
    """A value with its entities replaced."""
    if "&" in v:
        for pattern, base in _NUMBERS:
            v = pattern.sub(lambda m: letter(int(m[1], base)), v)  # noqa: B023
        for entity, char in ENTITIES:
            v = v.replace(entity, char)
    return v


def letter(code: int) -> str:
    return chr(code) if code < 0xD800 or 0xDFFF < code < 0x110000 else "\ufffd"


def encoded(v: str) -> str:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;"), ("\n", "&#10;"), ("\t", "&#09;")):
        v = v.replace(char, entity)
    return v


def kept(attributes: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Attributes (name, value) without what is always left out, false or empty; true in lower case, others trimmed."""
    out = []
    for name, value in attributes:
        tidy = value.strip(" ")
        if name in KEPT:
            out.append((name, value))
        elif name not in DROPPED and (low := tidy.lower()) not in ("", "false"):
            out.append((name, "true" if low == "true" else tidy))
    return out


def tags(text: str | None) -> list[tuple[str, bool, bool, int, list[tuple[str, str]]]] | None:
    """(name, closes, alone, level of the element, attributes) of the tags of a page in order; None if it is malformed."""
    plain = _ASIDE.sub("", text or "")
    if "<" in _TAG.sub("", plain):
        return None
    out, stack = [], []
    for tag in _TAG.findall(plain):
        name, closes, alone = _HEAD.match(tag)[1], tag.startswith("</"), tag.endswith("/>")
        found = _ATTRIBUTE.findall(tag) if "=" in tag else []
        if closes:
            if alone or found or not stack or stack.pop() != name:
                return None
        elif out and not stack or len({a for a, _, _ in found}) < len(found):
            return None
        out.append((name, closes, alone, len(stack), [(a, decoded(x or y)) for a, x, y in found]))
        if not closes and not alone:
            stack.append(name)
    return None if stack else out


def elements(dumps: DataFrame) -> DataFrame:
    """page, ord, parent, level, name, attributes: the elements of well-formed pages in order; the root's parent is null.

    dumps: page, text.
    """
    kind = pa.struct([("name", pa.string()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text in enumerate(b.column(1)):
                above, count = [], 0
                for name, closes, alone, level, attributes in tags(text.as_py()) or []:
                    if closes:
                        above.pop()
                        continue
                    rows.append((i, count, above[-1] if above else None, level, name, kept(attributes)))
                    if not alone:
                        above.append(count)
                    count += 1
                    if len(rows) >= MOST:
                        yield sent(b, rows)
                        rows = []
            if rows:
                yield sent(b, rows)

    def sent(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, ord_, parent, level, name, attributes = zip(*rows, strict=True)
        offsets = [0]
        for x in attributes:
            offsets.append(offsets[-1] + len(x))
        flat = [pa.array([a[k] for x in attributes for a in x], pa.string()) for k in (0, 1)]
        pairs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(kind)))
        cols = [b.column(0).take(pa.array(at)), pa.array(ord_, pa.int32()), pa.array(parent, pa.int32()), pa.array(level, pa.int64()), pa.array(name, pa.string()), pairs]
        return pa.RecordBatch.from_arrays(cols, names=["page", "ord", "parent", "level", "name", "attributes"])

    fields = T.StructType.fromDDL("ord int, parent int, level long, name string, attributes array<struct<name: string, value: string>>")
    return dumps.select("page", "text").mapInArrow(run, T.StructType([dumps.schema["page"], *fields]))


def written(found: list[tuple[str, bool, bool, int, list[tuple[str, str]]]]) -> str:
    """The tags of a page, one a line."""
    lines = ["<?xml version='1.0' encoding='utf-8'?>"]
    for i, (name, closes, alone, level, attributes) in enumerate(found):
        if closes:
            if not (found[i - 1][1] or found[i - 1][2]):
                continue  # the element is empty, so its first tag stands for both
            lines.append(f"{'  ' * level}</{name}>")
        else:
            end = " />" if alone or found[i + 1][1] else ">"
            lines.append(f"{'  ' * level}<{name}{''.join(f' {a}="{encoded(v)}"' for a, v in kept(attributes))}{end}")
    return "\n".join(lines)


def compacted(dumps: DataFrame) -> DataFrame:
    """page, text: the dump with its attributes tidied, a tag a line, indented by level; blank pages are empty, malformed ones as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, size, out = 0, 0, []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                blank = not (text or "").strip(" ")
                found = None if blank else tags(text)
                out.append("" if blank else written(found) if found else text)
                size += len(out[-1])
                if size >= 64 * MOST:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(out)), pa.array(out, pa.string())], names=["page", "text"])
                    start, size, out = i + 1, 0, []
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start), pa.array(out, pa.string())], names=["page", "text"])

    return dumps.select("page", "text").mapInArrow(run, T.StructType([dumps.schema["page"], T.StructField("text", T.StringType())]))

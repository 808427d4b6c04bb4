"""Column functions on small values."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weft.functions import classify, text


def value(spark, column, **fields):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])
    return row.select(column.alias("x")).first()["x"]


def test_uids_and_keys(spark):
    uid = value(spark, text.stable_uid("anchor", "a", "b", "c"), a="R.id.x", b=None, c="F.java:3")
    assert uid == "anchor_" + hashlib.sha1(b"R.id.x||||F.java:3").hexdigest()[:12]
    assert value(spark, text.slug("a"), a="  Is Valid? (yes) ") == "is_valid_yes"
    assert value(spark, text.slug("a", "unnamed"), a=" ?? ") == "unnamed"
    assert value(spark, text.norm_key("a"), a="Is-Valid 2") == "isvalid2"
    assert value(spark, text.coerced("a", ["Boolean", "String"], "String"), a="BOOLEAN") == "Boolean"
    assert value(spark, text.coerced("a", ["Boolean"], "String"), a=" ") == "String"
    assert value(spark, text.numbered("P", F.lit(7))) == "P007"


def test_places_and_names(spark):
    assert value(spark, text.file_of("a"), a="Main.kt:12") == "Main.kt"
    assert value(spark, text.line_of("a"), a="C:/x/Main.kt:12") == 12
    assert value(spark, text.line_of("a"), a="nowhere") is None
    assert value(spark, text.resource_name("a"), a="org.app:id/save") == "R.id.save"
    assert value(spark, text.resource_name("a"), a="R.id.save") == "R.id.save"
    assert value(spark, text.resource_name("a"), a="save") is None
    assert value(spark, text.short_method("a"), a="org.app.Main.onClick:void(View)") == "Main.onClick:void(View)"
    assert value(spark, text.lambda_host("a"), a="p.Editor.lambda$show$0:void()") == "p.Editor.show"
    assert value(spark, text.constructor_owner("a"), a="p.Item.<init>:void()") == "p.Item"
    assert value(spark, text.missing_body_reason("a"), a="p.Editor.lambda$show$0:void()") == "lambda_or_anonymous_body_omitted"
    assert value(spark, text.snake_to_camel("a", True, "Binding"), a="activity_main_screen") == "ActivityMainScreenBinding"
    assert value(spark, text.snake_to_camel("a"), a="save_button") == "saveButton"
    assert value(spark, text.camel_to_snake("a"), a="saveButtonTop") == "save_button_top"
    assert value(spark, text.is_test_source_set("a"), a="app/src/androidTest/java/X.kt") is True
    assert value(spark, text.is_test_source_set("a"), a="app/src/main/java/X.kt") is False
    assert value(spark, text.contains_token("a", "b"), a="val m: Model = x", b="Model") is True
    assert value(spark, text.contains_token("a", "b"), a="val m: Models = x", b="Model") is False
    assert value(spark, text.distinct_non_blank(F.array(F.lit(" a"), F.lit("b"), F.lit("a "), F.lit("")))) == ["a", "b"]


@pytest.mark.parametrize("name, kind", [("setOnClickListener", "LISTENER"), ("setText", "SETTER"), ("getText", "GETTER"), ("hideKeyboard", "SETTER"), ("println", None), ("createView", None), ("foo", "OTHER")])
def test_call_signals(spark, name, kind):
    assert value(spark, classify.call_signal("a"), a=name) == kind


def test_classifiers(spark):
    assert value(spark, classify.java_signal("a", "b"), a="append", b="android.widget.TextView") == "SETTER"
    assert value(spark, classify.java_signal("a", "b"), a="append", b="List") == "OTHER"
    assert [value(spark, classify.evidence_kind("a"), a=k) for k in ("SETTER", "getter", "LISTENER", "DELEGATE")] == ["write", "read", "sink", "unknown"]
    kinds = [(None, "USAGE", "1", "2"), (None, "HANDLE", "1", "2"), (None, "HANDLE", "1", "1"), (None, " ", "1", "2"), ("SCOPE", "USAGE", "1", "2")]
    got = [value(spark, classify.usage_type(*[F.lit(v).cast("string") for v in k])) for k in kinds]
    assert got == ["DIRECT_USAGE", "ASSIGNMENT", "CHAINING", None, "SCOPE"]
    call = lambda n, p, s, o: value(spark, classify.callback_kind(F.lit(n), F.lit(p), F.lit(s), F.lit(o)))
    assert [call("onCreate", False, True, True), call("onTap", False, True, False), call("getView", False, False, False), call("onTap", False, False, False), call("onTap", True, True, True)] == ["LIFECYCLE", "LISTENER", "ADAPTER", None, None]
    assert value(spark, classify.type_kind("a"), a="// x\n@Keep\ndata class Item(val a: Int)") == "DATA_CLASS"
    assert value(spark, classify.resource_refs("a"), a="findViewById(R.id.a); x(app.R.id.b, R.id.a)") == ["R.id.a", "app.R.id.b"]
    assert value(spark, classify.binding_fields("a"), a="binding.save.x(binding.root, binding.save)") == ["save"]
    assert value(spark, classify.stream_kind("a"), a="kotlinx.MutableStateFlow<Int>") == "MutableStateFlow"
    assert value(spark, classify.is_domain_type("a"), a="java.util.List") is False and value(spark, classify.is_domain_type("a"), a="org.app.Item") is True


def test_backoff(spark):
    assert [value(spark, text.backoff(F.lit(n), 30.0, 120.0)) for n in (1, 2, 3, 4)] == [30.0, 60.0, 120.0, 120.0]
    assert value(spark, text.backoff(F.lit(1), 30.0, 120.0, F.lit(500.0))) == 120.0
    assert value(spark, text.retryable(F.lit("RateLimitError"), F.lit(None).cast("int"))) is True
    assert value(spark, text.retryable(F.lit(None).cast("string"), F.lit(404))) is False


@pytest.mark.parametrize("code, kind", [("true", "Boolean"), ("12", "Int"), ("12L", "Long"), ("1.5f", "Float"), ("1.5", "Double"), ('"x"', "String"), ("mutableListOf(1)", "List"), ("Item(1)", "Item"), ("null", None), ("foo()", None)])
def test_expression_types(spark, code, kind):
    assert value(spark, classify.expression_type("a"), a=code) == kind

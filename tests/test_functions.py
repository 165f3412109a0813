import hashlib

import pytest
from pyspark.sql import functions as F

from sparrowmill.cli import CASES, selftest
from sparrowmill.functions import text as X
from sparrowmill.functions.extract import extract


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def letters(*x):
    return F.array(*map(F.lit, x))


def found(spark, response, labels="ABCDE", texts=("12", "15", "18", "21", "25")):
    texts = None if texts is None else F.array(*(F.lit(t) for t in texts))
    r = one(spark, extract(F.lit(response), letters(*labels), texts))
    return r["pred"], r["method"]


@pytest.mark.parametrize("response,pred", CASES)
def test_cases_of_the_selftest(spark, response, pred):
    assert found(spark, response)[0] == pred


def test_selftest(spark):
    assert selftest(spark)


@pytest.mark.parametrize(
    "response,pred,method",
    [
        ("the answer is $1,500", "A", "value_match"),
        ("answer is 1.5", None, None),  # the candidate ends at the full stop
        ("FINAL ANSWER: nothing. The answer is 15", None, None),  # the second wording is not tried
        ("x (B) y\nmore", "B", "tail_letter"),
        ("so\n C.\nmore text", "C", "tail_letter"),
        ("the answer is a number", "A", "answer_is"),
        ("**C**", None, None),
        ("<think>never closed FINAL ANSWER: A", None, None),
        ("FINAL ANSWER: A\nFINAL ANSWER: B", "B", "final_answer"),
        ("FINAL ANSWER - (d)", "D", "final_answer"),
        (None, None, None),
        ("", None, None),
    ],
)
def test_cascade(spark, response, pred, method):
    texts = ("1500", "2", "3", "4", "5") if response and "1,500" in response else ("12", "15", "18", "21", "25")
    assert found(spark, response, texts=texts) == (pred, method)


def test_value_match_needs_exactly_one_hit(spark):
    assert found(spark, "FINAL ANSWER: 7.5", texts=("x", "7.5", "7.50", "y", "z")) == (None, None)
    assert found(spark, "FINAL ANSWER: 40000007", texts=("2", "40000009", "3", "4", "5")) == ("B", "value_match")
    assert found(spark, "FINAL ANSWER: 60kg", texts=("60", "2", "3", "4", "5")) == (None, None)


def test_numeric_labels_and_short_texts(spark):
    assert found(spark, "FINAL ANSWER: 3", labels="1234", texts=("a", "b"))[0] == "3"
    assert found(spark, "FINAL ANSWER: b", labels="", texts=("a", "b")) == (None, None)


def test_norm_value(spark):
    for a, b in (("$1,500.", "1500"), ("1e3", "1000"), (" 1_000 ", "1000"), ("-0", "0"), ("NaN", "nan"), ("+inf", "infinity"), ("A b", "ab")):
        assert one(spark, X.norm_value(F.lit(a))) == one(spark, X.norm_value(F.lit(b)))
    assert one(spark, X.norm_value(F.lit("18d"))) == "18d"
    assert one(spark, X.norm_value(F.lit(None).cast("string"))) is None


def test_hash_mod(spark):
    for text in ("", "a", "model|id"):
        assert one(spark, X.hash_mod(F.lit(text), 29_100)) == int(hashlib.sha256(text.encode()).hexdigest(), 16) % 29_100


def test_tokens_and_words(spark):
    assert one(spark, X.tokens(F.lit("Área 1,234.5 x2 3.7"))) == ["rea", "1,234", "5", "x", "2", "3.7"]
    assert one(spark, X.numeric_density(X.tokens(F.lit("")))) == 0
    assert one(spark, X.word_count(F.lit(" a\n b c "))) == 3
    assert one(spark, X.norm_text(F.lit("  A\t b\n"))) == "a b"
    assert one(spark, X.option_length(F.array().cast("array<string>"))) is None


def test_split_inference(spark):
    rows = [("d/arc_train.parquet", "train", "train"), ("DEV.parquet", "validation", "unknown"), ("x.parquet", "test", "unknown"), ("Valid.json", "validation", "unknown")]
    for name, loose, strict in rows:
        assert one(spark, X.infer_split(F.lit(name))) == loose
        assert one(spark, X.infer_split(F.lit(name), True)) == strict


def test_slug(spark):
    assert one(spark, X.slug(F.lit("--Quill 7B/Think!"))) == "quill_7b_think"

"""Scalar helpers against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quireflow.functions import text as X


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, c {kind}").select("k", f("c").alias("v")).collect()
    return [r.v for r in sorted(rows)]


def test_numbers(spark):
    cases = {"1,234.5": 1234.5, " 84.6% ": 84.6, "-3e2": -300.0, "": None, "%": None, "n/a": None, "12 %": 12.0, "1.2.3": None, None: None}
    assert column(spark, cases, "string", X.number) == list(cases.values())
    assert column(spark, ["0.4", "7", "-1", "x", None], "string", X.clamped) == [0.4, 1.0, 0.0, 0.5, 0.5]
    assert column(spark, [["1", "x", None, "2.5"], [], None], "array<string>", X.floats) == [[1.0, 2.5], [], []]


def test_vectors(spark):
    assert column(spark, ["[1, 2.5]", '["3", "4"]', "[]", "[1, null]", '[1, "x"]', "no", "{}", None], "string", X.vector_from_json) == [[1.0, 2.5], [3.0, 4.0], [], [], [], [], [], []]
    back = column(spark, [[0.5, -1.0, 1e-9], []], "array<double>", X.vector_to_json)
    assert [json.loads(b) for b in back] == [[0.5, -1.0, 1e-9], []]
    assert column(spark, [[0.5, -1.0, 1e-9], []], "array<double>", lambda c: X.vector_from_json(X.vector_to_json(c))) == [[0.5, -1.0, 1e-9], []]


def plain_cut(t, most):
    if len(t or "") <= most:
        return t or ""
    head = t[:most]
    stop = max(head.rfind(x) for x in "。！？")
    comma = max(head.rfind(x) for x in "，,、")
    return head[: stop + 1] if stop > most * 0.7 else head[: comma + 1] if comma > most * 0.6 else head + "..."


@pytest.mark.parametrize("most", [10, 25])
def test_cut_at_sentence(spark, most):
    rng = random.Random(most)
    texts = ["".join(rng.choice("ab 日，,。！.\n") for _ in range(rng.randrange(60))) for _ in range(200)] + [None, "", "x" * 40]
    assert column(spark, texts, "string", lambda c: X.cut_at_sentence(c, most)) == [plain_cut(t, most) for t in texts]


def test_sentences_keep_decimals(spark):
    assert column(spark, ["It is 91.5 % now. Next!\nThird… 。四", "v1.2.3 ends.", ".5", "a..5"], "string", X.sentences) == [["It is 91.5 % now", "Next", "Third…", "四"], ["v1.2.3 ends"], [".5"], ["a", ".5"]]


def test_once_is_the_same_value(spark):
    assert spark.range(3).select("id", X.once(F.col("id") * 2).alias("x")).agg(F.sum("x")).first()[0] == 6

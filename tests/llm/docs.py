"""Awkward documents for the operators of rankweave.llm."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, id string, key int, `start` string, node double, `odd name.x` string"
LONG = " ".join(f"word{i % 701}" for i in range(20000))
TEXTS = [
    (1, "plain words of a plain text that says nothing at all"),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (6, "plain words of a plain text that says nothing at all"),
    (6, "plain words of a plain text that says nothing at all"),
    (None, "a row without a number, still a row"),
    (None, None),
    (7, "one"),
    (8, "日本語 と ñ é \U0001f600 end."),
    (9, "x" * 5000),
    (10, "it's 5 o'clock. <|endoftext|> \x85 a　b"),
]


def awkward(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", None, None, 1.0, "y") for i, t in texts], SCHEMA)


def nothing(spark):
    return awkward(spark, [])

"""Known texts on long lines."""

from __future__ import annotations

from shelfcast.llm import licences


def test_one_line_licence_within_a_document(spark):
    line = " ".join(licences.ISC.split())
    padded = "Licensed under" + " -" * 400 + " MIT License"
    df = spark.createDataFrame([(1, f"some code\n{line}\nmore code"), (2, f"x\n{padded}\ny")], "doc_id long, text string")
    assert {r["doc_id"]: r["notices"] for r in licences.scan(df).collect()} == {1: "ISC", 2: "MIT"}

"""Whole licence texts in every wrapping, under the usual headings and copyright lines; the SQL agrees."""

from __future__ import annotations

import textwrap

import duckdb
import pytest

from shelfcast.llm import licences, queries

OWNERS = ("Copyright (c) 2020 Jane Doe", "Copyright 2019-2021 Jane Doe. All rights reserved.", "© Jane Doe", "Copyright Jane Doe\nCopyright 2001 X")


def _wrapped(text: str, width: int) -> str:
    paragraphs = (" ".join(p.split()) for p in text.split("\n\n"))
    return "\n\n".join(textwrap.fill(p, width) if width else p for p in paragraphs)


def _same(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in licences.scan(df).collect()), key=str)
    duck = duckdb.connect()
    duck.register("documents", df.toPandas())
    names = "doc_id, digest, licence, notices"
    told = [tuple(None if x != x else x for x in r) for r in duck.execute(f"SELECT {names} FROM ({queries.SQL['op8_licences']})").fetchall()]
    assert got == sorted(told, key=str)
    return {r[0]: r for r in got}


@pytest.mark.parametrize("part", range(len(licences.WHOLE)))
def test_whole_texts_in_any_wrapping(spark, part):
    spdx, text, headings = licences.WHOLE[part]
    rows = []
    for width in (60, 72, 76, 77, 78, 79, 80, 100, 0):
        body = _wrapped(text, width)
        rows += [body, body.replace("\n", "\r\n"), body.upper(), *(f"{o}\n\n{body}" for o in OWNERS)]
        rows += [f"{h}\n\n{OWNERS[i % len(OWNERS)]}\n\n{body}\n" for i, h in enumerate(headings)]
        rows.append("\n".join("# " + line for line in f"{OWNERS[0]}\n\n{body}".split("\n")))
    rows.append(" ".join(text.split()))
    rows.append(" ".join(f"{headings[0]} {text}".split()))
    got = _same(spark, list(enumerate(rows)))
    assert {i: got[i][2] for i in got} == {i: spdx for i in range(len(rows))}


def test_prose_on_copyright_is_no_licence(spark):
    rows = [
        "Words on licences.\nCopyright holders be liable, they said.",
        licences.MIT.replace("without restriction", "with restriction"),
        "Copyright Jane Doe",
        "(c) You must keep this line",
        "© 2020",
        "copyright",
        "",
        None,
        "a\n\nCopyright law is old.\nPermission",
        "Licensed under the MIT License\nCopyright 2020 X",
    ]
    got = _same(spark, list(enumerate(rows)))
    assert all(r[2] is None for i, r in got.items() if i < 9)
    assert got[2][1] is None and got[4][1] is None and got[3][1] is not None
    assert got[0][1] != _same(spark, [(0, "Words on licences.")])[0][1]
    assert got[9][2:] == ("MIT", "MIT")

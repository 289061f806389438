"""The text operators on edge tables, against brute force, and by exact round trips."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfcast.llm import ann, chat, decontaminate, licences, lm, near_dedup, packing, quality, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, score string"
PATH = public_tokenizers.path("word_bpe_49k.json")


def _prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeilmnorstu"), rng.integers(2, 9))) for _ in range(n)]
    return ". ".join(" ".join(words[i : i + 9]) for i in range(0, n, 9)) + "."


@pytest.fixture(scope="module")
def docs(spark):
    base = [_prose(i, 60) for i in range(12)]
    near = base[0].split()
    near[30] = "changed"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[1]), (20, base[1]), (21, " ".join(near)), (22, None), (23, ""), (None, "no id here"), (24, "!!! ??? ***")]
    rows += [(25, _prose(99, 30_000)), (26, "one two"), (27, base[2].upper())]
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, i % 3 == 0) for i in range(12)] + [(None, 1, False), (3, None, None), (3, 1, True)]
    return spark.createDataFrame([(i, q, None if t is None else int(t)) for i, q, t in rows], "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_cover_edge_rows(spark, docs, labels):
    for module in (quality, toxicity):
        got = module.classify(docs, labels).collect()
        assert len(got) == docs.count()
        assert all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        same = collections.defaultdict(set)
        for r in got:
            same[r["doc_id"]].add(r["score"])
        assert len(same[20]) == 1
        assert module.classify(docs.limit(0), labels).count() == 0
        assert module.classify(docs, labels.limit(0)).count() == docs.count()
        keep = module.keep_good if module is quality else module.keep_clean
        assert keep(docs, labels).columns == docs.columns


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    folder = "/root/testdata/sf0.01"
    d, l = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = module.classify(d, l).filter("held_out").join(l, "doc_id").select("predicted", label).collect()
    assert sum(r["predicted"] == r[label] for r in got) / len(got) > 0.93


def test_nonnegative_risk_finds_the_prior():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(2, 1, (3000, 2)), rng.normal(-2, 1, (900, 2))
    unl = np.concatenate([rng.normal(2, 1, (2100, 2)), neg])
    prior = quality.class_prior(pos, rng.permutation(unl))
    assert abs(prior - 0.7) < 0.08
    net = quality.fit(pos, unl, prior)
    assert (net.score(neg) < 0.5).mean() > 0.95 and (net.score(pos) > 0.5).mean() > 0.95


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = np.random.default_rng(2)
    entries = ["loser", "pathetic", "worthless", "scum", "abc"]
    lexicon = toxicity.Lexicon(entries, ["vequ"])
    words = ["".join(rng.choice(list("lopserathicwum"), rng.integers(2, 11))) for _ in range(500)]
    for w in list(entries):
        for _ in range(60):
            chars = list(w)
            for _ in range(rng.integers(0, 3)):
                chars[rng.integers(len(chars))] = rng.choice(list("xyz", ))
                chars.insert(rng.integers(len(chars)), "q") if rng.random() < 0.3 else None
            words.append("".join(chars))
    for w in words:
        near = [d for e in entries if (d := _edits(w, e)) <= toxicity.Lexicon.edits(e)]
        assert lexicon.distance(w) == (min(near) if near else -1), w
    assert lexicon.distance("vequment") == 0
    assert toxicity.is_quotation('he said "you idiot" to', 13, 18) and not toxicity.is_quotation("you idiot, go", 4, 9)


def test_base_scores_equal_brute_force_and_model_is_better(spark, sf_dir, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for frame, trained in ((table, True), (docs, False)):
        rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in frame.select("doc_id", "text").collect()]
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i, _ in rows]
        counts = collections.Counter(w for (_, ws), h in zip(rows, held) if not h for w in ws)
        total = sum(counts.values())
        unit = math.log10(total + 0.1 * (len(counts) + 1))
        want = sorted(
            (str(i), len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10(counts[w] + 0.1) - unit for w in ws), 5)) for i, ws in rows
        )
        got = lm.score(frame, lookup=3_000, vocabulary_size=800).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
        assert {r["train_tokens"] for r in got} == {total}
        if trained:
            out = [r for r in got if r["held_out"]]
            assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)
    assert lm.score(docs.limit(0)).count() == 0


def test_network_is_a_probability_and_its_gradient_is_right():
    rng = np.random.default_rng(0)
    net = lm.Network.from_counts(np.sort(rng.integers(1, 50, 40))[::-1].astype(float))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    h = rng.normal(size=(3, lm.HIDDEN))
    every = np.array([lm.target_scores(net, h, np.full(3, y)) for y in range(40)])
    assert np.allclose(np.exp(every).sum(0), 1)
    doc = rng.integers(0, 40, 30)
    whole = lm.document_scores(net, [doc])[0]
    old = lm.WINDOW
    try:
        lm.WINDOW = 7  # the state is carried from window to window
        assert np.allclose(lm.document_scores(net, [doc, doc[:9]])[0], whole, atol=1e-4)
    finally:
        lm.WINDOW = old
    before = lm.document_scores(net, [doc] * 4).sum()
    trainer = lm.Trainer(net)
    for _ in range(30):
        trainer.documents([doc] * 40)
    assert lm.document_scores(trainer.net, [doc] * 4).sum() > before


def test_packing_round_trip(spark, docs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    got = packing.pack(docs, PATH).collect()
    want = collections.Counter(zlib.crc32(np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect())
    whole = collections.Counter(r["ids_crc32"] for r in got if r["length"] == r["doc_tokens"])
    assert not whole - want
    for i, n in ((25, None), (22, 1), (23, 1)):
        own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == i)
        ends = np.cumsum([x[1] for x in own])
        assert [x[0] for x in own] == [0, *ends[:-1]] and ends[-1] == own[0][2] and (n is None or ends[-1] == n)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(3)
    old, packing.LEAST_POWER = packing.LEAST_POWER, 2
    try:
        for _ in range(40):
            place = np.unique(rng.integers(1, 60, 14))
            place = np.unique(np.r_[place, np.arange(6, 60, 6)])
            cost = rng.integers(0, 4, len(place)).astype(float)

            def price(cuts):
                at = dict(zip(place.tolist(), cost.tolist()))
                spans = np.diff([0, *cuts])
                return sum(0 if n & (n - 1) == 0 and n > 1 else 8 - n for n in spans.tolist()) + sum(at[c] for c in cuts)

            best = {0: 0.0}
            for j, c in zip(place.tolist(), cost.tolist()):
                best[j] = min(best[i] + (0 if (j - i) & (j - i - 1) == 0 and j - i > 1 else 8 - j + i) + c for i in best if 0 < j - i <= 8)
            assert price(packing.best_cuts(place, cost, 8)) == best[place[-1]]
    finally:
        packing.LEAST_POWER = old


def test_near_duplicates_equal_brute_force(spark, docs):
    def brute(rows):
        grams = [near_dedup.kmers(near_dedup.word_hashes(t or "")) for _, t in rows]
        cls = list(range(len(rows)))
        for i in range(len(rows)):
            for j in range(i):
                same = (rows[i][1] or "") == (rows[j][1] or "")
                if same or (len(grams[i]) and near_dedup.similarity(grams[i], grams[j]) >= 0.8):
                    a, b = cls[i], cls[j]
                    cls = [min(a, b) if c in (a, b) else c for c in cls]
        return cls

    rng = np.random.default_rng(4)
    base = _prose(500, 150).split()
    family = []
    for k in range(40):  # a chain of copies, so that a class holds members that are not alike
        base = list(base)
        base[rng.integers(len(base))] = f"new{k}"
        family.append(" ".join(base))
    many = spark.createDataFrame([(100 + i, t) for i, t in enumerate(family)], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), many):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        cls = brute(rows)
        want = collections.defaultdict(set)
        for (i, t), c in zip(rows, cls):
            want[c].add((i, t or ""))
        got = collections.defaultdict(set)
        key = {hashlib.md5(f"{'-' if i is None else i} {t or ''}".encode()).hexdigest(): (i, t or "") for i, t in rows}
        found = near_dedup.near_duplicates(frame).collect()
        assert len(found) == len(rows)
        for r in found:
            got[(r["class_id"], r["words_key"] if r["class_id"] is None else None)].add(key[r["row_key"]])
        assert sorted(map(str, map(lambda s: sorted(map(str, s)), got.values()))) == sorted(map(str, map(lambda s: sorted(map(str, s)), want.values())))
        assert near_dedup.keep_one(frame).count() == len(want)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_alignment_equals_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, 30, rng.integers(1, 40)).astype(np.uint64)
        b = a.copy()
        for _ in range(rng.integers(0, 5)):
            b[rng.integers(len(b))] = rng.integers(0, 30)
        b = np.delete(b, rng.integers(0, len(b), rng.integers(0, 2))) if len(b) > 2 else b
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        lcs = table[-1, -1]
        true = lcs / (len(a) + len(b) - lcs)
        assert near_dedup.similarity(a, b, 0.6) == (pytest.approx(true) if true >= 0.6 else 0.0)


def test_leaks_also_with_other_values(spark, docs):
    item = "Alice bought 12 apples for 5 dollars at the market and then she sold 12 apples to her friend Bob for 9 dollars"
    texts = [
        "Some words before. " + item + ". And after it.",
        "Intro. " + item.replace("12", "37").replace("Bob", "Carol").replace(" 5 ", " 8 "),
        "Intro. " + item.replace("12 apples for", "40 apples for"),  # one value stands for two
        "nothing of the kind",
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (9, None, "x")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(7, item), (8, None), (9, "too short"), (7, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontaminate.matches(d, b).collect()}
    assert got == {(0, 7, True), (1, 7, False)}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(d, b).collect()} == {2, 3, 9}
    assert decontaminate.matches(d.limit(0), b).count() == 0 and decontaminate.matches(d, b.limit(0)).count() == 0
    plan = decontaminate.matches(docs, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=24)]) for i in range(1500)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 24), (2003, [float("nan")] + [1.0] * 23), (2004, [None] + [1.0] * 23), (None, [1.0] * 24)]
    rows += [(3000 + i, rows[20][1]) for i in range(30)] + [(2020, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    got, want = (f(df, F.col("vec_id") % 20 == 0).collect() for f in (ann.nearest, ann.nearest_exact))
    pairs = lambda rs: {(r["query_id"], r["vec_id"]) for r in rs}
    assert len(pairs(got) & pairs(want)) / len(pairs(want)) >= 0.9
    tied = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 20]
    assert tied == list(range(3000, 3020))
    assert not any(r["query_id"] == r["vec_id"] or 2000 <= r["vec_id"] <= 2004 for r in got)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_licences(spark, docs):
    assert "MIT" in {r["licence"] for r in licences.scan(spark.createDataFrame([(1, "Copyright 2020 A. Person\n\n" + licences.MIT.upper())], "doc_id long, text string")).collect()}
    rows = [(1, "Hello\nLicensed under the Apache Licence, version 2.0!\nReleased under MIT License"), (2, None), (3, "Licensed under it")]
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (None, "Apache-2.0,MIT"), 2: (None, None), 3: (None, None)}
    assert licences.scan(docs).count() == docs.count() and licences.scan(docs.limit(0)).count() == 0


def test_shards(spark, docs):
    many = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.repeat(F.col("id").cast("string"), (F.col("id") % 40).cast("int"))).alias("text")
    )
    for frame, exact in ((docs, False), (many, True)):
        got = sharding.shard(frame).collect()
        assert len(got) == frame.count() and all(0 <= r["shard"] < 24 for r in got)
        by = collections.defaultdict(list)
        for r in got:
            by[r["shard"]].append(r)
        for own in by.values():
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
        if exact:
            sizes = [sum(r["size"] for r in own) for own in by.values()]
            assert len(by) == 24 and (max(sizes) - min(sizes)) / np.mean(sizes) < 0.05
    assert sharding.shard(docs.limit(0)).count() == 0


def test_chats_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", r"[\INST] \\</s> [\\SEP]", "", None, "a<s>b[SEP]c[ROLE]x[/ROLE]", "plain é 你"]
    rows = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", "a"), (2, 1, "user", "b[SEP]"), (2, 2, "tool[/ROLE]", "c"), (2, 3, None, "d"), (2, 4, "assistant", "e"), (2, 5, "assistant", "f</s>")]
    rows += [(3, 1, "user", "same"), (3, 1, "user", "same"), (3, None, "system", "first"), (None, 0, "assistant", "no id")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chats(df)
    read = done.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("spans")).alias("l"), "formatted")
    for r in read.collect():
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["l"] == "".join(x[3] or "" for x in own if x[2] == "assistant")
        if r["conv_id"] == 2:
            assert r["formatted"].startswith(r"<s>[INST]a[SEP]b[\SEP][/INST]</s><s>[ROLE]tool[\/ROLE][/ROLE]c</s>")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_chats(df.limit(0)).count() == 0


def test_pipeline_keeps_rows_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        before, after = ({tuple(r) for r in x.collect()} for x in (kept, out))
        assert after <= before and after, name
        kept = spark.createDataFrame(sorted(after, key=str), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf_dir)
    assert {r["doc_id"] for r in last.collect()} == {r["doc_id"] for r in kept.collect()}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_word_pattern_is_plain():
    assert re.fullmatch(toxicity.WORD, "word") and near_dedup.WORDS == 5

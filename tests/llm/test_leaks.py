"""Leaks against a brute force over tokens that knows the slots by construction."""

from __future__ import annotations

import numpy as np

from shelfcast.llm import decontaminate

WORDS = ["if", "apple", "cost", "and", "then", "many", "left", "shop", "more", "buys"]
SUM = "If 3 kg cost 12 dollars and 5 kg cost 20 dollars how much is 7 kg"


def _leaks(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = decontaminate.matches(d, b).collect()
    return {(r["doc_id"], r["item_id"], r["word_offset"], r["windows"], r["verbatim"]) for r in rows}


def _brute(docs, items):
    """A token that is a number is a slot."""
    out = set()
    for di, d in enumerate(docs):
        for ii, it in enumerate(items):
            d_, i_ = d.split(), it.split()
            kinds = lambda ws: ["#" if w.isdigit() else w for w in ws]
            dk, ik = kinds(d_), kinds(i_)
            span = min(8, len(ik))
            spots = list(range(len(ik) - span + 1)) if ik else []
            good = [a for a in spots if sum(k != "#" for k in ik[a : a + span]) >= 4]
            whole = len(ik) < 8 or not good
            usable, need = (spots, len(spots)) if whole else (good, min(6, len(good)))
            for off in range(-len(ik), len(dk)):
                hit = [a for a in usable if a + off >= 0 and dk[a + off : a + off + span] == ik[a : a + span]]
                if not hit or len(hit) < need:
                    continue
                pairs = {(i_[p], d_[p + off]) for a in hit for p in range(a, a + span) if ik[p] == "#"}
                same = all(x == y for x, y in pairs)
                if len({x for x, _ in pairs}) == len(pairs) and (same or sum(k != "#" for k in ik) >= 4):
                    out.add((di, ii, off, len(hit), same))
    return out


def test_sums_rich_in_slots_are_found(spark):
    other = SUM.replace("12", "21").replace("20", "35").replace("7", "9")
    got = _leaks(spark, [f"so {SUM} then", f"so {other} then", "nothing of it"], [SUM])
    assert {(d, v) for d, _, _, _, v in got} == {(0, True), (1, False)}


def test_slots_behind_the_passage_do_not_count(spark):
    item = "many apple trees were left in the old shop when we came to buy 4 more and then 4 again there"
    head = item.rsplit(" ", 2)[0].rsplit(" 4", 1)[0]
    got = _leaks(spark, [f"{head} once 9 more", item.replace("then", "then once")], [item])
    assert {d for d, *_ in got} == {0, 1}


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(11)

    def some(n, share):
        return " ".join(str(rng.integers(10, 14)) if rng.random() < share else str(rng.choice(WORDS)) for _ in range(n))

    items = [some(n, share) for n in (2, 4, 6, 7, 8, 9, 12, 15, 20) for share in (0.2, 0.5, 0.8)]
    docs = []
    for it in items:
        words = it.split()
        moved = [str(int(w) + 3) if w.isdigit() else w for w in words]
        mixed = [str(int(w) + int(rng.integers(2))) if w.isdigit() else w for w in words]
        cut = words[: max(1, len(words) * 3 // 4)]
        docs += [" ".join([some(5, 0.5), *body, some(5, 0.5)]) for body in (words, moved, mixed, cut)]
        at = int(rng.integers(len(words)))
        docs.append(" ".join([*words[:at], "more", *words[at:]]))
    want = _brute(docs, items)
    assert _leaks(spark, docs, items) == want and len(want) > 60

"""Counts over permuted pages, by brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import arrays
from lexiloom.operators import pairs, tallies
from lexiloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_md5_of_any_message():
    pages = [None, "", "12", "x" * 30, "é|ß"]
    for some in (pages, [*pages, "y" * 60]):
        page, pos = [i % len(some) for i in range(400)], [i * i for i in range(400)]
        keys = arrays.Keys(some, arrays.np.array(page), arrays.np.array(pos))
        for k in (1, 10, 123, 12345):
            got = [f"{hi:016x}{lo:016x}" for hi, lo in keys.of(k).T.tolist()]
            assert got == [hashlib.md5("|".join([str(k), *([] if some[p] is None else [some[p]]), str(i)]).encode()).hexdigest() for p, i in zip(page, pos)]


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("strata", [(), ("role",)])
def test_tallies_by_brute_force(spark, monkeypatch, whole, strata):
    """Null properties, pages across batches, parts sent on early; a page wider than a chunk."""
    rng = random.Random(5)
    rows = [(c, f"p{p}", i, rng.choice(["a", "m", None]), rng.choice(["ok", "dy", "qok", "y"])) for p, (c, n) in enumerate([("x", 700), ("y", 1), ("x", 3), (None, 260), ("y", 90), ("x", 40)]) for i in range(n)]
    monkeypatch.setattr(tallies, "CHUNK", 64)
    monkeypatch.setattr(tallies, "MOST", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        toks = spark.createDataFrame(rows if whole else rng.sample(rows, len(rows)), "corpus string, page string, pos int, role string, w string")
        toks = toks.coalesce(1) if whole else toks
        asked = [tallies.Tally("slot", "slot", "role", "w", 3), tallies.Tally("pair", "next", "y", "w", 2), tallies.Tally("same", "equal", "w", "", 1), tallies.Tally("late", "seen", "w", "", 2, 3)]
        moved = {"w": F.col("w"), "y": F.when(F.col("w").endswith("y"), F.col("w"))}
        got = tallies.tallied(toks, ("corpus",), ("corpus", "page", *strata), {"role": F.col("role")}, moved, asked, whole).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pages, want = {}, Counter()
    for r in rows:
        pages.setdefault(r[:2], []).append(r)
    for (c, p), rs in pages.items():
        for k in range(4):
            ws, groups = [None] * len(rs), {}
            for i, r in enumerate(rs):
                groups.setdefault(r[3] if strata else 0, []).append(i)
            for at in groups.values():
                drawn = sorted(at, key=lambda i: (hashlib.md5(f"{k}|{p}|{i}".encode()).hexdigest() if k else "", i))
                for i, j in zip(at, drawn):
                    ws[i] = rs[j][4]
            for i, w in enumerate(ws):
                want[c, k, "slot", rs[i][3], w] += rs[i][3] is not None
                if i and k <= 2:
                    want[c, k, "pair", ws[i - 1], w] += ws[i - 1].endswith("y")
                    want[c, k, "late", "seen", None] += w in ws[max(0, i - 3) : i]
                    want[c, k, "late", "all", None] += 1
                if i and k <= 1:
                    want[c, k, "same", "equal", None] += ws[i - 1] == w
                    want[c, k, "same", "all", None] += 1
    assert Counter({(r.corpus, r.round, r.kind, r.a, r.b): r.c for r in got}) == +want


@pytest.mark.parametrize("name", ["feature_slot_z_20", "positional_z_10", "boundary_excess_qo", "repeat_ratio"])
def test_rounds_make_no_rows(spark, name):
    """Pages are permuted where they are read: tokens are neither gathered nor multiplied by rounds."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan and "explode(sequence" not in plan.lower() and "Window" not in plan.split("MapInArrow")[-1]


def test_lags_by_brute_force(spark):
    rng = random.Random(8)
    pages = {p: [rng.choice("abc") for _ in range(n)] for p, n in (("p", 90), ("q", 1), ("r", 7))}
    toks = spark.createDataFrame([("x", p, i, w) for p, ws in pages.items() for i, w in enumerate(ws)], "corpus string, page string, pos int, w string")
    got = {r.lag: (r.n, r.hits) for r in pairs.lag_curve(toks, 12).collect()}
    assert got == {k: (sum(max(0, len(ws) - k) for ws in pages.values()), sum(x == y for ws in pages.values() for x, y in zip(ws, ws[k:]))) for k in range(1, 13)}
    plan = registry.queries()["lag_baseline"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "collect_list" not in plan


def test_lines_and_samples_move_no_words(spark):
    """Lines come from their text's row; a sample's edge is a row a group; a lag curve makes no row a lag."""
    plans = {name: registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString() for name in ("tercile_rate", "corr_last_z", "line_sharing_30", "downsample_equal", "lag_baseline", "kappa_scan")}
    assert not any("collect_list(struct(word_idx" in p for p in plans.values())
    assert "WindowGroupLimit" not in plans["downsample_equal"] and "posexplode" not in plans["lag_baseline"].split("MapInArrow")[0]
    assert all("MapInArrow" in plans[k] for k in ("lag_baseline", "kappa_scan")) and "explode(words" not in plans["line_sharing_30"]


def test_near_pages_in_tiles(spark, monkeypatch):
    """Blocks that a corpus's size sets, compared in smaller tiles, find what blocks of one size do."""
    from lexiloom.operators import vectors
    from lexiloom.sources import tables

    toks = tables.documents(spark, SF)
    want = sorted(map(tuple, vectors.near_pages(toks).collect()))
    monkeypatch.setattr(vectors, "NEAR_BLOCKS", (7, 40))
    monkeypatch.setattr(vectors, "NEAR_TILE", 5)
    assert sorted(map(tuple, vectors.near_pages(toks).collect())) == want


def test_near_pages_are_copied_a_bounded_number_of_times(spark):
    from lexiloom.operators import vectors

    low, high = vectors.NEAR_BLOCKS
    blocks = lambda n: -(-n // max(low, min(high, -(-n // vectors.NEAR_MANY))))
    assert max(blocks(n) for n in range(1, vectors.NEAR_MANY * high, 997)) <= vectors.NEAR_MANY


def test_corpora_shuffled_in_one_move(spark, monkeypatch):
    """Numbers, ranges and gaps of a shuffled corpus take one exchange of its tokens, and gaps are those of plain lists."""
    from lexiloom.operators import lexical, nulls, order

    rng = random.Random(9)
    rows = [("x", f"p{i // 50}", i % 50, rng.choice("abcd")) for i in range(3000)]
    toks = spark.createDataFrame(rows, "corpus string, page string, pos int, w string")
    drawn = order.dense(nulls.rounds(toks, 2, False), ("corpus", "round"), nulls.key("round", "page", "pos"), ("page", "pos"), "gpos", cell=True)
    found = lexical.gaps(drawn, ("corpus", "round"), cells=True)
    want = {}
    for k in (1, 2):
        placed = {}
        for at, r in enumerate(sorted(rows, key=lambda r: hashlib.md5(f"{k}|{r[1]}|{r[2]}".encode()).hexdigest())):
            placed.setdefault(r[3], []).append(at)
        want |= {(k, w): (len(at), at[0], at[-1], sum((y - x) ** 2 for x, y in zip(at, at[1:]))) for w, at in placed.items()}
    assert {(r.round, r.w): (r.n, r["first"], r["last"], r.squares) for r in found.collect()} == want
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1

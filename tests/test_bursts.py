"""Gaps in shuffled corpora, by brute force."""

import hashlib
import random

import pytest

from lexiloom.operators import bursts, chunks, lexical


@pytest.mark.parametrize("whole,moved", [(False, 1), (True, 1 << 28)])
def test_corpora_shuffle_in_cells(spark, monkeypatch, whole, moved):
    """Medians of every round as plain Python has them; packed numbers move, not tokens."""
    rng = random.Random(2)
    pages = [(c, p, rng.randrange(1, 60)) for p, c in enumerate(["x", "x", "y", "x", None, "y", "x", "x", None])]
    before = lambda c, p: sum(n for d, q, n in pages if d == c and q < p)
    rows = [(c, p, i, rng.choice("abcdefgh") + ("" if i % 9 else str(i)), before(c, p) + i) for c, p, n in pages for i in range(n)]
    toks = spark.createDataFrame(rows, "corpus string, page int, pos int, w string, gpos bigint")
    toks = toks.coalesce(1) if whole else toks.repartition(4)
    for module, name, n in ((chunks, "CHUNK", 32), (bursts, "CELL", 16), (bursts, "MOVED", moved)):
        monkeypatch.setattr(module, name, n)
    sent, real = [], bursts.stage.written
    monkeypatch.setattr(bursts.stage, "written", lambda df, name, **o: sent.append((name, df)) or real(df, name, **o))
    got = {r[0]: tuple(r)[1:] for r in lexical.shuffled_medians(toks, 3, least=4, **({"whole": True} if whole else {})).collect()}
    assert len([n for n, df in sent if n == "gaps"]) == (4 if moved == 1 else 1)
    want = {}
    for corpus in {r[0] for r in rows}:
        medians = []
        for k in range(4):
            own = sorted((r for r in rows if r[0] == corpus), key=lambda r: (hashlib.md5(f"{k}|{r[1]}|{r[2]}".encode()).hexdigest() if k else "", r[1], r[2]))
            at, cvs = {}, []
            for i, r in enumerate(own):
                at.setdefault(r[3], []).append(i)
            for places in at.values():
                if len(places) >= 4:
                    gaps = [b - a for a, b in zip(places, places[1:])]
                    mean = sum(gaps) / len(gaps)
                    cvs.append((sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5 / mean)
            medians.append(sorted(cvs)[len(cvs) // 2] if cvs else None)
        want[corpus] = (medians[0], sum(medians[1:]) / 3, min(medians[1:]), max(medians[1:]))
    assert got.keys() == want.keys()
    for corpus, values in want.items():
        assert got[corpus] == pytest.approx(values, abs=1e-9)


def test_shuffles_go_with_what_is_written(spark):
    """What is written needs its shuffle no more: the files don't stay until the driver collects its garbage."""
    import glob
    import os
    import time

    where = spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf())
    found = lambda: {f for f in glob.glob(f"{os.path.dirname(where)}/**/shuffle_*.data", recursive=True)}
    before = found()
    out = bursts.stage.written(spark.range(100_000).repartition(5), "numbers")
    for _ in range(50):  # block managers are told, not waited for
        if not found() - before:
            break
        time.sleep(0.1)
    assert not found() - before and out.count() == 100_000


def test_near_pages_go_in_passes(spark, monkeypatch):
    """Pairs of blocks move some at a time, packed, with the same rows as at once."""
    from lexiloom.operators import vectors

    rng = random.Random(8)
    rows = [("c", p, i, rng.choice("abc") + str(p % 4)) for p in range(40) for i in range(rng.randrange(1, 12))]
    toks = spark.createDataFrame(rows, "corpus string, page int, pos int, w string").coalesce(1)
    want = sorted(map(str, vectors.near_pages(toks, block=7).collect()))
    sent, real = [], vectors.stage.written
    monkeypatch.setattr(vectors.stage, "written", lambda df, name, **o: sent.append(name) or real(df, name, **o))
    monkeypatch.setattr(vectors, "NEAR_MOVED", 1000, raising=False)
    assert sorted(map(str, vectors.near_pages(toks, block=7, whole=True).collect())) == want
    assert sent.count("found") > 1 and len(want) == 40


def test_samples_of_lines_by_brute_force(spark, monkeypatch):
    """Each round takes the lines with the least hashes; no round makes rows of lines."""
    from pyspark.sql import functions as F

    from lexiloom.operators import layout, order

    monkeypatch.setattr(order, "least", lambda *a: pytest.fail("lines are made rows of rounds"))
    rng = random.Random(4)
    rows = [(c, p, i, [rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(rng.randrange(1, 6))]) for p in range(12) for c in ("u", "v" if p % 2 else None) for i in range(rng.randrange(1, 9))]
    lines = spark.createDataFrame(rows, "corpus string, page int, line_idx int, ws array<string>").repartition(3)
    got = {(r.corpus, r.kind): (r.n_lines, r.shared, r.deviation) for r in layout.sampled_sharing(lines, F.when(F.col("line_idx") == 0, "first").otherwise("body"), 4).collect()}
    of = {}
    for r in rows:
        of.setdefault((r[0], "body" if r[2] else "first"), []).append(r)
    want = {}
    for (c, kind), own in of.items():
        size, shares = min(len(x) for (d, _), x in of.items() if d == c), []
        for k in range(1, 5):
            taken = sorted(own, key=lambda r: (hashlib.md5(f"{k}|{r[1]}|{r[2]}".encode()).hexdigest(), r[1], r[2]))[:size]
            words = [w for r in taken for w in r[3]]
            shares.append(sum(sum(w in r[3] for r in taken) >= 2 for w in words) / len(words))
        mean = sum(shares) / 4
        want[c, kind] = (size, mean, (sum((x - mean) ** 2 for x in shares) / 4) ** 0.5)
    assert got.keys() == want.keys() and len(got) == 6
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9)

"""Words fetched by their number, by brute force."""

import hashlib
import math
import random

import pytest

from lexiloom.operators import chunks, generators


def made(spark, seed=4):
    """Rows of pages of two corpora, one page wider than a chunk, and one without a corpus."""
    rng = random.Random(seed)
    pages = [("x", 90), ("y", 1), ("x", 3), (None, 26), ("y", 40), ("x", 12), ("x", 5), ("x", 33)]
    rows = [(c, p, i // 5, i % 5, min(5, n - i // 5 * 5), i, rng.choice(["qol", "é", "dy", "", "odar"]) + str(i % 4)) for p, (c, n) in enumerate(pages) for i in range(n)]
    return rows, spark.createDataFrame(rows, "corpus string, page int, line_idx int, word_idx int, line_len int, pos int, w string")


def small(monkeypatch):
    for name, n in (("CHUNK", 16), ("CELL", 8), ("LEAST", 4)):
        monkeypatch.setattr(chunks, name, n)


def bucket(r):
    return r[0], r[2] == 0, "first" if r[3] == 0 else "last" if r[3] == r[4] - 1 else "mid"


@pytest.mark.parametrize("whole", [False, True])
def test_places_draw_without_moving(spark, monkeypatch, whole):
    """Every place gets its bucket's word of the drawn number, and no join moves places or words."""
    small(monkeypatch)
    rows, toks = made(spark)
    got = generators.iid(toks.coalesce(1) if whole else toks.repartition(5), **({"whole": True} if whole else {}))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    of = {}
    for r in sorted((r for r in rows if r[0]), key=lambda r: (str(r[1]), r[5])):
        of.setdefault(bucket(r), []).append(r[6])
    draw = lambda r: int(hashlib.md5(f"1|{r[1]}|{r[5]}".encode()).hexdigest()[:12], 16)
    want = sorted((r[0], str(r[1]), *r[2:6], of[bucket(r)][draw(r) % len(of[bucket(r)])]) for r in rows if r[0])
    assert sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.parametrize("habits", [generators.PLAIN, generators.FLOW, generators.MEMORY])
def test_copyists_draw_without_moving(spark, monkeypatch, habits):
    """Pages are written from the same draws, whatever the chunks and cells are."""
    rows, toks = made(spark)
    first = sorted(tuple(r) for r in generators.copyist(toks, habits).collect())
    small(monkeypatch)
    got = generators.copyist(toks.repartition(3), habits)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == first and len(first) == sum(r[0] is not None for r in rows)


def test_table_walks_page_by_page(spark, monkeypatch):
    """Only pages go through the scan; a page's places walk where they are, and pages without a chosen row too."""
    from lexiloom.operators import scan

    rng = random.Random(7)
    rows = [("c" if p % 4 else "d", p, i // 6, i % 6, 6, i, rng.choice(["qokedy", "okchey", "dcheey", "shaiin"])) for p in range(90) for i in range(rng.randrange(1, 5))]
    toks = spark.createDataFrame(rows, "corpus string, page int, line_idx int, word_idx int, line_len int, pos int, w string")
    scanned, walked = [], scan.walked
    monkeypatch.setattr(scan, "walked", lambda r, *a, **k: scanned.append(r.count()) or walked(r, *a, **k))
    monkeypatch.setattr(chunks, "CHUNK", 16)
    got = {(r.corpus, int(r.page), r.pos): r.w for r in generators.table_words(toks).collect()}
    assert scanned[0] == 90
    parts: dict = {}
    for r in generators.part_table(toks).collect():
        parts.setdefault((r.corpus, r.column), {})[r.row] = r.part
    at, want = {}, {}
    for corpus, page, pos in sorted((r[0], str(r[1]), r[5]) for r in rows):
        w = ""
        for k in range(3):
            draw, last = hashlib.md5(f"3|{page}|{pos}|{k}".encode()).hexdigest(), max(parts.get((corpus, k), {0: ""}))
            if int(draw[:8], 16) < generators.ANEW * 16**8:
                at[corpus, k] = min(int(math.log((int(draw[8:20], 16) + 1) / 16**12) / math.log(generators.ONWARD)), last)
            else:
                at[corpus, k] = min(max(at.get((corpus, k), 0) + (-1, 0, 0, 1)[int(draw[20], 16) % 4], 0), last)
            w += parts.get((corpus, k), {}).get(at[corpus, k], "")
        want[corpus, int(page), pos] = w or "ol"
    assert got == want


@pytest.mark.parametrize("whole", [False, True])
def test_phrases_count_without_moving(spark, monkeypatch, whole):
    """Repeat events of every round and section by brute force; phrases go to tasks as packed numbers."""
    from lexiloom.operators import phrases

    rng = random.Random(3)
    pages = [(c, p, f"s{p % 3}" if p % 4 else None, rng.randrange(1, 40)) for p, c in enumerate(["x", "x", "y", None, "x", "y", None, "x", "x"])]
    rows = [(c, s, p, i, rng.choice("ab")) for c, p, s, n in pages for i in range(n)]
    toks = spark.createDataFrame(rows, "corpus string, section string, page int, pos int, w string")
    toks = toks.coalesce(1) if whole else toks.repartition(4)
    monkeypatch.setattr(chunks, "CHUNK", 32)
    monkeypatch.setattr(phrases, "GROUP", 16)
    made = phrases.counted(toks, 3, 2, ("corpus",), "section", **({"whole": True} if whole else {}))
    types = {(r.corpus, r.of_): r.n_own for r in made.where("round = 0 and n_own > 0").collect()}
    got = {(r.corpus, r.round, r.of_): r.events for r in made.collect()}
    want: dict = {}
    for k in range(3):
        found: dict = {}
        for c, p, s, n in pages:
            own = sorted((r for r in rows if r[2] == p), key=lambda r: (hashlib.md5(f"{k}|{p}|{r[3]}".encode()).hexdigest() if k else "", r[3]))
            for i in range(n - 2):
                found.setdefault((c, "".join(r[4] for r in own[i : i + 3])), []).append((p, s))
        for (c, _), at in found.items():
            for s in {s for _, s in at} if not k else ():
                types[c, s] -= 1
            for p, s in at:
                want[c, k, s] = want.get((c, k, s), 0) + (p > min(at, key=lambda x: x[0])[0])
    assert got == want and sum(want.values()) > 50 and set(types.values()) == {0}


def test_pages_merge_without_moving(spark, monkeypatch):
    """Pairs of whole pages are counted and merged where pages are read, as joins of tokens have them."""
    from lexiloom.operators import pairs

    rng = random.Random(9)
    rows = [(c, p, i, rng.choice(["a", "b", "ab", "ba", "aa"])) for p, c in enumerate("xyxxy") for i in range(60)]
    toks = spark.createDataFrame(rows, "corpus string, page int, pos int, w string").coalesce(1)
    candidates = pairs.pmi_candidates(toks, 2, -9.0, whole=True)
    merged = pairs.merge(toks, candidates, whole=True)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in merged.collect())
    monkeypatch.setattr(pairs, "BROADCAST_ROWS", 0)
    assert got == sorted(tuple(r) for r in pairs.merge(toks, candidates).collect()) and len(got) < len(rows)


def test_grams_without_moving(spark, monkeypatch):
    from lexiloom.operators import phrases

    rows, toks = made(spark)
    monkeypatch.setattr(chunks, "CHUNK", 16)
    got = phrases.grams(toks.coalesce(1), 3, whole=True)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, phrases.ngrams(toks, 3).select("corpus", "gram").collect()))


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_every_word_of_the_corpus_is_attested(spark, monkeypatch, bits):
    """A word splits into any words of its corpus, the rarest too, and into no others, however often the filter errs."""
    rng = random.Random(5)
    words = ["darchol", "qokedy", "okchey", "dar", "chol", "okaiin", "qo", "kedy"] + [f"dar{x}y" for x in "abcde"]
    rows = [(c, p, i // 5, i % 5, 5, i, rng.choice(words if c == "x" else words[:3])) for p, c in enumerate("xxyxyxx") for i in range(60)]
    toks = spark.createDataFrame(rows, "corpus string, page int, line_idx int, word_idx int, line_len int, pos int, w string")
    monkeypatch.setattr(generators, "ATTESTED", 1, raising=False)  # the former bound
    monkeypatch.setattr(generators, "FILTER_BITS", bits, raising=False)
    monkeypatch.setattr(generators, "BLOCK", 8, raising=False)
    monkeypatch.setattr(chunks, "CHUNK", 100)
    habits = generators.replace(generators.MEMORY, split=0.9)
    got = {(r.corpus, int(r.page), r.pos): r.w for r in generators.copyist(toks, habits, 8).collect()}
    of = {}
    for r in sorted(rows, key=lambda r: (str(r[1]), r[5])):
        of.setdefault(bucket(r), []).append(r[6])
    number = lambda head: int(hashlib.md5(head.encode()).hexdigest()[:12], 16)
    want, splits = {}, set()
    for p, c in enumerate("xxyxyxx"):
        own = [r for r in rows if r[1] == p]
        turns = [number(f"turn8|{p}|{r[5]}") / 16**12 for r in own]
        many = [1 + (habits.pull_draws if t < habits.pull else habits.avoid_draws if t < habits.avoid else 0) for t in turns]
        draws = [[of[bucket(r)][number(f"8|{p}|{r[5]}|{k}") % len(of[bucket(r)])] for k in range(n)] for r, n in zip(own, many)]
        page = generators.write_page(draws, turns, habits, {r[6] for r in rows if r[0] == c}, random.Random(generators._seed(8, c, p)))
        want |= {(c, p, i): w for i, w in enumerate(page)}
        splits |= {(a, b) for a, b in zip(page, page[1:]) if a + b in words}
    assert got == want and len(got) == len(rows) and splits


def test_chunks_are_small(spark):
    """A reader holds a row group's chunks at once: they have a few bytes a token, and give the places back."""
    rng = random.Random(6)
    rows = [("c", p, i // 8, i % 8, 8, i, rng.choice(["qokedy", "okchey", "dar", "shaiin"])) for p in range(40) for i in range(400)]
    toks = spark.createDataFrame(rows, "corpus string, page int, line_idx int, word_idx int, line_len int, pos int, w string")
    got = [r.asDict() for r in generators.chunked(toks).collect()]
    assert sum(len(v) for r in got for v in r.values() if isinstance(v, (bytes, bytearray))) < 8 * len(rows)
    each = [chunks.Chunk({k: bytes(v) if isinstance(v, bytearray) else v for k, v in r.items()}) for r in got]
    back = [(c.corpora[p], int(c.pages[p]), *at, w) for c in each for p, *at, w in zip(c.page.tolist(), *(c.columns[x].tolist() for x in chunks.PLACES), c.words().to_pylist())]
    assert sorted(back) == rows

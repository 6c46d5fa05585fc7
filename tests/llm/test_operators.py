"""Training-data operators against DuckDB, brute force, round trips and held-out accuracy."""

import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import components, exact, jaccard, kernels, langid, mixing, pieces, quality, queries, scratch, substring, suffix_tree, toxicity, warc
from tests.compare import compare

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
CLASHING = ("kept", "score", "rk", "copy", "lang_pred", "keep_id", "n_words", "text_sha256", "n_copies", "held_out", "group_size", "base_failed")


def edge_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    line = " ".join(word() for _ in range(70))
    shared = [line + " " + " ".join(word() for _ in range(5)) for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.01 else "zz" for w in line.split()) for _ in range(4)]
    texts = [None, "", "   \n\t", "one", "one", "A b  c\nd", "a B c d", "Ab cd", line, line, line.upper(), " " + line, *shared, *near, "x " * 300, "dup line here\n" * 12, "é" * 40, "12 34 \x0b 56", " ".join(word() for _ in range(4000)), "b" * 30_000]
    rows = [(i if i != 7 else None, t, None if i % 5 == 0 else "en" if i % 2 else "fr", "hot" if i % 3 else None) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (rows[8][0], "another text with the same id", "en", "hot")]
    return rows


def conversation_rows():
    """Shared beginnings, copies, missing group heads, negative ids, nulls, ties and repeated rows."""
    rng = random.Random(5)
    rows = []
    for c in [*range(-205, -195), *range(0, 40), *range(101, 160), *range(300, 330)]:
        chosen = rng.randrange(4)
        for t in range(rng.randrange(1, 9)):
            text = rng.choice(["same", "same", "other", "", None]) if chosen else "hello é"
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), text))
    rows += [(None, 1, "user", "nowhere"), rows[3], rows[3], (17, 2, "user", "b"), (17, 2, "user", "a"), (17, 2, "assistant", "z"), (17, 2, "user", "x" * 50_000)]
    return rows


def folder(tmp_path_factory, rows, name):
    where = tmp_path_factory.mktemp(name)
    df = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})
    extra = {c: pa.array([1.5] * len(rows)) for c in CLASHING}
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), **{c: pa.array([r[i] for r in rows], pa.string()) for i, c in ((1, "text"), (2, "lang"), (3, "source"))}, "n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64()), **extra})
    import pyarrow.parquet as pq

    pq.write_table(table, where / "documents.parquet")
    pq.write_table(pa.table({"doc_id": table["doc_id"], "quality": pa.array([1] * len(rows), pa.int32()), "toxic": pa.array([k % 2 if k % 7 else None for k in range(len(rows))], pa.int32())}), where / "labels.parquet")
    pages = [(i, f"http://x/{i}" if i % 4 else None, t) for i, t in enumerate([None, "", "short", "short", "y" * 100, "y" * 100, "y" * 99, "y" * 99, "é" * 60, "é" * 60, "a\r\n\r\nWARC/1.1\r\n" * 9] * (1 if rows else 0))]
    pages += pages[4:6]
    pq.write_table(pa.table({"page_id": pa.array([p[0] for p in pages], pa.int64()), "url": pa.array([p[1] for p in pages], pa.string()), "html": pa.array([p[2] for p in pages], pa.string())}), where / "pages.parquet")
    turns = conversation_rows() if rows else []
    kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}
    columns = {c: pa.array([t[i] for t in turns], kind) for i, (c, kind) in enumerate(kinds.items())}
    pq.write_table(pa.table({**columns, **{c: pa.array([2] * len(turns)) for c in ("depth", "c", "pos", "node", "weight")}}), where / "conversations.parquet")
    del df
    return str(where)


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    return folder(tmp_path_factory, edge_rows(), "edges")


@pytest.fixture(scope="module")
def nothing(tmp_path_factory):
    return folder(tmp_path_factory, [], "nothing")


#: The recursion of this one's SQL has no place for null or repeated ids; brute force below.
SQL_EDGES = sorted(set(queries.ORACLES) - {"op7_jaccard_join"})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", SQL_EDGES)
def test_agrees_with_sql_on_edges(spark, edges, name):
    assert compare(spark, edges, queries.QUERIES[name], queries.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_edges_and_empty_tables(spark, edges, nothing, name):
    n = spark.read.parquet(f"{edges}/{'pages' if name.startswith(('op1_', 'op13_')) else 'documents'}.parquet").count()
    rows = queries.QUERIES[name](spark, edges).collect()
    assert name.startswith(("op4_", "op11_", "op12_")) or len(rows) == n
    assert queries.QUERIES[name](spark, nothing).count() == 0


def test_values_on_edges(spark, edges):
    blank = [r.doc_id for r in spark.read.parquet(f"{edges}/documents.parquet").collect() if not words_of(r.text)]
    assert len(blank) == 3
    got = {name: {r.doc_id: r for r in queries.QUERIES[name](spark, edges).collect()} for name in ("op6_language_id", "op8_toxicity", "op9_sentencepiece", "op10_suffix_tree")}
    for i in blank:
        assert (got["op6_language_id"][i].lang_pred, got["op6_language_id"][i].score) == ("und", 0.0)
        assert got["op10_suffix_tree"][i].n_tokens == 1 and got["op10_suffix_tree"][i].n_known == 1
    ends = {round(got["op10_suffix_tree"][i].score, 9) for i in blank} | {round(got["op10_suffix_tree"][i].base_score, 9) for i in blank}
    assert len(ends) == 1  # the end alone, in the root
    assert got["op9_sentencepiece"][0].n_tokens == got["op9_sentencepiece"][1].n_tokens == 0 and got["op9_sentencepiece"][0].round_trip
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got["op8_toxicity"].values())
    assert len({got["op8_toxicity"][i].score for i in blank}) == 1
    assert all(r.lang_pred in ("en", "fr", "und") for r in got["op6_language_id"].values())


def test_carried_columns(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet").withColumns({c: F.lit(7) for c in ("cdf", "rate", "mix_u", "mix_source", "mix_id", "ids", "_text", "c0", "at_")})
    texts = sorted(str(r.text) for r in docs.collect())
    out = pieces.encoded(docs, carry=tuple(docs.columns)).collect()
    assert sorted(str(r.text) for r in out) == texts and all(r.cdf == 7 and r.round_trip and len(r.ids) == r.n_tokens for r in out)
    out = langid.identified(docs, carry=tuple(docs.columns))
    assert out.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score"] and sorted(str(r.text) for r in out.collect()) == texts
    out = mixing.replicate(docs)
    assert out.columns == [c for c in docs.columns if c not in ("copy", "n_copies")] + ["n_copies", "copy"] and {r.cdf for r in out.collect()} == {7}
    out = exact.groups(docs)
    assert out.count() == docs.count() and {r.cdf for r in out.collect()} == {7}
    assert quality.judged(docs).count() == docs.count()


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """A text of several slices, a copy of it, and a near copy, among short ones."""
    rng = random.Random(12)
    long = [str(rng.randint(0, 99_999)) + rng.choice(["a", "b", "\n"]) for _ in range(400_000)]
    near = [w if i % 4000 else "x" for i, w in enumerate(long)]
    texts = [" ".join(long), "a b c", " ".join(long), " ".join(near), None, "a b c d e f"]
    return folder(tmp_path_factory, [(i, t, "en" if i % 2 else "fr", "s") for i, t in enumerate(texts)], "long"), [words_of(t) for t in texts]


def test_very_long_texts(spark, long_texts):
    where, words = long_texts
    got = {name: {r.doc_id: r for r in q(spark, where).collect()} for name, q in queries.QUERIES.items() if not name.startswith(("op1_", "op4_", "op11_", "op12_", "op13_"))}
    n = len(words[0])
    assert [got["op2_rlz_substrings"][i].n_removed for i in range(6)][:3] == [0, 0, n] and got["op2_rlz_substrings"][3].n_removed > 0.9 * n
    assert got["op3_quality_cascade"][3].n_words == n
    assert [got["op5_patricia_dedup"][i].keep_id for i in range(6)] == [0, 1, 0, 3, 4, 5]
    assert [got["op7_jaccard_join"][i].component_id for i in range(6)] == [0, 1, 0, 0, 4, 5] and got["op7_jaccard_join"][0].n_links == 2
    assert got["op9_sentencepiece"][0].round_trip and got["op9_sentencepiece"][0].n_tokens > n
    assert got["op10_suffix_tree"][0].n_tokens == n + 1 and got["op10_suffix_tree"][0].score == got["op10_suffix_tree"][2].score
    assert got["op6_language_id"][0].lang_pred in ("en", "fr") and 0 <= got["op8_toxicity"][0].score <= 1
    copies = {(r.doc_id, r.copy): len(r.text or "") for r in queries.QUERIES["op4_poisson_mixing"](spark, where).collect()}
    assert all(k[1] >= 1 for k in copies)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{where}/documents.parquet"), where).count() >= 1


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def test_jaccard_by_brute_force(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    want = []
    for i, (doc, _) in enumerate(rows):
        near = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        want.append((doc, len(sets[i]), min(near, default=None) if sets[i] else doc))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    for small in (40, 2_000_000):  # small groups: pairs of blocks
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(docs, group_shingles=small).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_jaccard_counts_every_link(spark, edges):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = [r.text for r in spark.read.parquet(f"{edges}/documents.parquet").collect()]
    for k in range(24):  # near copies that differ in up to two words each, some of them repeated
        w = list(base)
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = f"x{k % 7}"
        texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words_of(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    want = [sum(bool(a and b) and i != j and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    assert max(want) >= 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for small in (40, 2_000_000):
        got = {r.doc_id: r.n_links for r in jaccard.joined(docs, group_shingles=small).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_divide_skip_and_links():
    for seed in range(150):
        rng = random.Random(seed)
        base = [set(rng.sample(range(60), rng.randint(5, 30))) for _ in range(3)]
        sets = []
        for _ in range(rng.randint(2, 14)):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.5:
                    s.add(rng.randint(0, 80))
                elif len(s) > 2:
                    s.pop()
            sets.append(np.array(sorted(s), dtype=np.uint64))
        lists = [np.sort(rng.sample(range(30), rng.randint(1, 20))) for _ in range(9)]
        for least in range(1, 9):
            want = {m: c for m in range(30) if (c := sum(m in x.tolist() for x in lists)) >= least}
            assert jaccard.divide_skip(lists, least) == want
        brute = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))]
        assert parts(brute, len(sets)) == parts(jaccard.linked(sets), len(sets))
        assert len(jaccard.linked(sets)) < len(sets)
        assert sorted((j, i) for i, js in jaccard.all_links(sets) for j in js.tolist()) == sorted(brute)


def parts(edges, n):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        p[find(a)] = find(b)
    return [min(y for y in range(n) if find(y) == find(x)) for x in range(n)]


def test_longer_prefixes_lose_no_link():
    k = lambda n: jaccard.least_shared(n, jaccard.SHARED_PERCENT)
    required = lambda n: -(-80 * n // 100)
    for a in range(1, 1500):
        for b in range(a, int(1.25 * a) + 1):
            overlap = -(-80 * (a + b) // 180)
            if overlap <= a:
                assert overlap >= required(a) + k(b) - k(a) and overlap >= required(b) + k(a) - k(b)


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components.label(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and {got[i] for i in (100, 101, 102)} == {100}


def test_word_kernel():
    texts = ["", " a", "b ", "a b\x0bc", "é ß\n", "x" * 50, "a\tb  c", None]
    data, at = kernels.buffer(pa.array(texts))
    w = kernels.Words(data, at)
    raw = data.tobytes()
    for i, t in enumerate(texts):
        lo, hi = w.first[i], w.first[i + 1]
        assert [raw[w.start[k] : w.end[k]].decode() for k in range(lo, hi)] == words_of(t)
    h = w.hashes()
    same = [h[k] for k in range(len(h)) if raw[w.start[k] : w.end[k]] == b"a"]
    assert len(set(same)) == 1 and len(set(h)) == len({raw[s:e] for s, e in zip(w.start, w.end)})


def test_least_positions():
    g = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 5, 26):
        want = [i + int(np.argmin(g[i : i + width])) for i in range(len(g) - width + 1)]
        assert substring.least_positions(g, width).tolist() == want


def test_substring_spans_on_random_copies(spark):
    rng = random.Random(9)
    pool = [" ".join(str(rng.randint(0, 5000)) for _ in range(40)) for _ in range(8)]
    docs = [" ".join(rng.choice(pool) if rng.random() < 0.6 else str(rng.randint(0, 9)) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring.remove(df).collect()}
    for small in ({"block_words": 60}, {"anchor_fragments": 1}):  # a block an anchor; anchors dealt by window
        assert {r.doc_id: (r.n_removed, r.kept_text) for r in substring.remove(df, **small).collect()} == got
    seen: dict[tuple, int] = {}
    words = [d.split() for d in docs]
    for i, w in enumerate(words):
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p : p + 50]), i)
    for i, w in enumerate(words):
        gone = {p + k for p in range(len(w) - 49) if seen[tuple(w[p : p + 50])] < i for k in range(50)}
        assert got[i] == (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_factors_by_brute_force():
    for seed in range(120):
        rng = random.Random(seed)
        size = [rng.randint(0, 14) for _ in range(rng.randint(1, 9))]
        first = np.concatenate(([0], np.cumsum(size)))
        w = np.array([rng.randint(0, 2) for _ in range(first[-1])], np.int64)
        doc = np.array([rng.randint(0, 4) for _ in size], np.int64)
        if not len(w):
            continue
        length, source = substring.longest_matches(w, first, doc)
        row = np.repeat(np.arange(len(size)), size)
        for p in range(len(w)):
            best = 0
            for q in range(len(w)):
                if doc[row[q]] < doc[row[p]]:
                    n = 0
                    while p + n < first[row[p] + 1] and q + n < first[row[q] + 1] and w[p + n] == w[q + n]:
                        n += 1
                    best = max(best, n)
            assert length[p] == best
            if best:
                q = source[p]
                assert doc[row[q]] < doc[row[p]] and (w[p : p + best] == w[q : q + best]).all()
        want = []
        for i in range(len(size)):
            p = first[i]
            while p < first[i + 1]:
                want.append((p, max(1, length[p])))
                p += max(1, length[p])
        start, n = substring.factors(length, first)
        assert sorted(zip(start.tolist(), n.tolist())) == want
        start, n = substring.spans_of(length, first, 4)
        covered = {p + k for p, m in zip(start.tolist(), n.tolist()) for k in range(m)}
        assert covered == {p + k for p in range(len(w)) if length[p] >= 4 for k in range(4)}


@pytest.mark.parametrize("prefix", [0, 1, 1200, 100_000])
def test_trie_spills_and_merges(tmp_path, prefix):
    """Strings with a long shared prefix spill behind it, however long it is."""
    rng = random.Random(2)
    texts = [b"p" * prefix + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(600)] + [b"p" * (prefix // 2) + b"q", b"", b"zz"]
    want: dict[bytes, tuple] = {}
    trie = exact.Trie(most=prefix + 6000, folder=str(tmp_path))
    for i, t in enumerate(texts):
        owner = (-(i % 3), i % 5 == 0, i, 1)
        trie.add(t, owner)
        want[t] = exact.merge(want.get(t), owner)
    assert trie.spills
    got = list(trie.items())
    assert len(got) == len(want) and dict(got) == want and not list(tmp_path.iterdir())


def test_warc_parse_and_deduplicated_archive(spark, tmp_path, edges):
    where = str(tmp_path / "w")
    warc.write_archive(warc.from_pages(spark.read.parquet(f"{edges}/pages.parquet")), where, 3)
    rows = warc.read_archive(spark, where).collect()
    html = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{edges}/pages.parquet").collect()}
    assert len(rows) == 13 and all(bytes(r.payload) == html[r.page_id] for r in rows)
    assert len({r.record_id for r in rows}) == 13


def test_cascade_order_changes_no_verdict(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet")
    counted = quality.counted(docs.select("doc_id", "text"))
    got = []
    for rules in (quality.RULES, quality.RULES[::-1]):
        chain = quality.first_rejection(rules)
        got.append(sorted((r.doc_id or -1, r.x is None) for r in counted.withColumn("x", chain).collect()))
    assert got[0] == got[1]
    estimates = [quality.Estimate(quality.RULES[0], 1.0, 0.2), quality.Estimate(quality.RULES[1], 0.1, 0.1)]
    assert quality.ordered(estimates) == [quality.RULES[1], quality.RULES[0]]


def test_mixing_rates_hold(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as source", "repeat('x', 10) as text")
    weights = spark.createDataFrame([("a", 2.0), (None, 0.5), ("b", 0.0)], "mix_source string, weight double")
    got = {r.source: r["count"] for r in mixing.replicate(docs, weights).groupBy("source").count().collect()}
    assert "b" not in got and abs(got["a"] / 4800 - 1) < 0.06 and abs(got[None] / 1200 - 1) < 0.1
    once, again = (sorted((r.doc_id, r.copy) for r in mixing.replicate(docs.repartition(n), weights).collect()) for n in (2, 7))
    assert once == again


def test_language_held_out_accuracy(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").toPandas()
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"])
    both = got.merge(docs, on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert (held.lang == held.lang_pred).mean() > 0.97 and both.score.between(0, 1).all()


def test_language_by_brute_force(spark):
    """Every prediction equals a plain scorer's, given the trained model."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(docs)
    multiply = [int(x) for x in langid._MULTIPLY]

    def plain(text):
        c = [(ord(x.lower()) if len(x.lower()) == 1 else ord(x)) if x.isalpha() else 32 for x in text or ""]
        if all(x == 32 for x in c):
            return "und", 0.0
        logits, total = np.zeros(len(model.languages)), 0
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                if any(x != 32 for x in c[i : i + n]):
                    h = n * 0x27D4EB2F & 0xFFFFFFFF
                    for k in range(n):
                        h = (h ^ c[i + k]) * multiply[k] & 0xFFFFFFFF
                        h ^= h >> 15
                    logits += model.weights[h >> (32 - langid.BITS)]
                    total += 1
        p = langid.softmax(((logits / total + model.bias) / model.temperature)[None, :])[0]
        return model.languages[int(p.argmax())], float(p.max())

    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identified(docs).collect()[:80]:
        name, score = plain(rows[r.doc_id])
        assert r.lang_pred == name and abs(r.score - score) < 1e-4


def test_rare_language_is_learned(spark):
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    rows = [(i, " ".join(word("abcde" if i % 50 else "vwxyz") for _ in range(30)), "aa" if i % 50 else "bb") for i in range(2500)]
    out = langid.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=40).collect()
    assert all(r.lang_pred == rows[r.doc_id][2] for r in out)


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(logits)])
    assert abs(langid.calibrate(logits * 4, y) - 4) < 0.6


def test_network_gradients():
    text = b"the cat sat on a mat with idiot words here and there the cat"
    v = toxicity.Vocabulary(np.frombuffer(text, np.uint8), np.array([0, 30, len(text)]))
    net = toxicity.Net.fresh(1, v.word[::2])
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    idx, mask = toxicity.layout(v, *toxicity.windows(np.diff(v.first)))
    y = np.array([1.0, 0.0])

    def loss():
        p = toxicity.sigmoid(net.forward(net.embed(v).astype(np.float64), idx, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(v, net.embed(v).astype(np.float64), idx, mask, y)
    for k, a in net.p.items():
        flat = a.reshape(-1)
        i = int(np.argmax(np.abs(g[k].reshape(-1))))
        old = flat[i]
        flat[i] = old + 1e-4
        up = loss()
        flat[i] = old - 1e-4
        down = loss()
        flat[i] = old
        assert abs((up - down) / 2e-4 - g[k].reshape(-1)[i]) < 1e-3 * max(1.0, abs(g[k].reshape(-1)[i]))


def test_toxicity_held_out():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ta", "re", "no", "li", "su", "ke"]) for _ in range(3))
    texts, labels = [], []
    for i in range(500):
        w = [word() for _ in range(rng.randint(5, 150))]
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(["idiot", "moron!", "SCUM"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    net = toxicity.train(texts[:400], labels[:400])
    at = np.cumsum([0, *[len(t.encode()) for t in texts[400:]]])
    logits = toxicity.row_logits(net, toxicity.Vocabulary(np.frombuffer("".join(texts[400:]).encode(), np.uint8), at))
    assert ((logits > net.shift) == np.array(labels[400:], bool)).mean() > 0.95


def test_toxicity_by_brute_force(spark):
    """Scores on documents and labels equal a plain network, word by word; held-out rows are told apart."""
    where = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    net = toxicity.learn(docs, labels)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    known = {int(h): i + 1 for i, h in enumerate(net.known)}

    def embedding(word):
        code = [int.from_bytes(bytes([a, b, c]), "big") for a, b, c in zip(b" " + word[:-1], word, word[1:] + b" ")]
        rows = (kernels.mix(np.array(code, np.uint64)) >> np.uint64(64 - toxicity.CHAR_BITS)).astype(int)
        hashed = int(kernels.Words(np.frombuffer(word, np.uint8), np.array([0, len(word)])).hashes()[0])
        return np.concatenate((p["ew"][known.get(hashed, 0)], p["ec"][rows].sum(axis=0) / np.sqrt(len(word))))

    def states(xs, d):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for x in xs:
            g, u = x @ p[f"w{d}"] + p[f"b{d}"], p[f"u{d}"]
            r, z = toxicity.sigmoid(g[:n] + h @ u[:, :n]), toxicity.sigmoid(g[n : 2 * n] + h @ u[:, n : 2 * n])
            c = np.tanh(g[2 * n :] + r * (h @ u[:, 2 * n :]))
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    def plain(text):
        words = re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())
        words = [w.lower() for w in words]
        words = [w for i, w in enumerate(words) if not i or w != words[i - 1]]
        best, start = None, 0
        while best is None or start - toxicity.STRIDE + toxicity.LENGTH < len(words):
            xs = [embedding(w) for w in words[start : start + toxicity.LENGTH]]
            pooled = np.zeros(2 * toxicity.HIDDEN)
            if xs:
                h = np.array([np.concatenate(x) for x in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])])
                s = np.tanh(h @ p["a"] + p["ab"]) @ p["v"][:, 0]
                a = np.exp(s - s.max())
                pooled = (a / a.sum()) @ h
            logit = float(pooled @ p["o"][:, 0] + p["ob"][0])
            best = logit if best is None else max(best, logit)
            start += toxicity.STRIDE
        return toxicity.sigmoid(best - net.shift)

    got = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in list(texts)[:60]:
        assert abs(got[i].score - plain(texts[i])) < 1e-3
    held = [(r.toxic, got[r.doc_id].predicted) for r in labels.where("toxic is not null").collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert {r.doc_id for r in got.values() if r.held_out} == {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0}
    # 330 labelled rows to learn from; at sf0.1 held-out accuracy is 0.98
    assert np.mean([a == b for a, b in held]) > 0.8


def test_pieces_parity_and_round_trip(spark):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    texts = pd.read_parquet(f"{SF}/documents.parquet").text.tolist()
    assert pieces.verify(data, [*pieces.PROBES, *texts]) == []
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for r in pieces.encoded(docs.limit(30), carry=("doc_id", "text")).collect():
        assert list(r.ids) == theirs.encode(r.text) and r.round_trip and r.n_tokens == len(r.ids)


def test_unigram_models_are_rebuilt():
    def field(n, wire, value):
        return bytes([n << 3 | wire]) + value

    def piece(s, score, kind):
        body = field(1, 2, bytes([len(s.encode())]) + s.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    model = b"".join([piece("<unk>", 0, 2), piece("▁a", -1, 1), piece("▁ab", -1.5, 1), piece("b", -2, 1), piece("▁", -3, 1), *[piece(f"<0x{b:02X}>", -9, 6) for b in range(256)]])
    trainer = field(3, 0, b"\x01") + b"\x98\x02\x01"  # type unigram, byte fallback
    model += field(2, 2, bytes([len(trainer)]) + trainer)
    m = pieces.parse(model)
    assert m.kind == pieces.UNIGRAM and m.byte_fallback and len(m.pieces) == 261
    ids, ends, back = pieces.Backend(model).run(["ab b", "a é"])
    assert [m.pieces[i][0] for i in ids[: ends[1]]] == ["▁ab", "▁", "b"] and back == ["ab b", "a é"]


def test_suffix_tree_by_brute_force(spark):
    got = suffix_tree.scores(spark.read.parquet(f"{SF}/documents.parquet")).toPandas().sort_values("doc_id")
    split = suffix_tree.scores(spark.read.parquet(f"{SF}/documents.parquet"), most_words=50).toPandas().sort_values("doc_id")
    assert np.allclose(got.base_score, split.base_score) and (got.n_known.values == split.n_known.values).all()
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    tokens = [[*(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)), None] for t in docs.text]
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i in docs.doc_id]
    counts: dict = {}
    for t, use in zip(tokens, train):
        for w in t if use else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = [sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in t) for t in tokens]
    assert np.allclose(got.base_score, want) and (got.train_tokens == n).all()
    assert (got.n_known.values == [sum(w in counts for w in t) for t in tokens]).all()
    assert (got.n_tokens.values == [len(t) for t in tokens]).all() and (got.held_out.values == [not u for u in train]).all()


def plain_tree_scores(rows, depth, cutoff, kappa, most_words):
    """The operator's model with dictionaries: (doc_id, text) -> log10 probabilities."""
    seqs = [[*(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words_of(t)), None] for _, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    n: dict = {}
    for q, use in zip(seqs, train):
        for w in q if use else ():
            n[w] = n.get(w, 0) + 1
    total, distinct = sum(n.values()), len(n)
    floor = max(1, -(-total // most_words))
    rare = [w for w, c in n.items() if c < floor]
    whole = total + distinct + 1
    other = (sum(n[w] + 1 for w in rare) + 1) / whole / (len(rare) + 1)
    root = lambda w: (n[w] + 1) / whole if n.get(w, 0) >= floor else other
    tables: list[dict] = [{} for _ in range(depth + 1)]
    for q, use in zip(seqs, train):
        for i, w in enumerate(q if use else ()):
            for k in range(1, min(depth, i) + 1):
                c = tables[k].setdefault(tuple(q[i - k : i]), {})
                c[w] = c.get(w, 0) + 1
    kept: dict = {}
    for k in range(1, depth + 1):
        for context, c in tables[k].items():
            t = sum(c.values())
            gain = sum(x * np.log(((x - 1 + kappa * root(w)) / (t - 1 + kappa)) / root(w)) for w, x in c.items())
            if t >= suffix_tree.LEAST and gain >= cutoff:
                kept[context] = (c, t)
    out = []
    for q in seqs:
        log = 0.0
        for i, w in enumerate(q):
            state = next((tuple(q[i - k : i]) for k in range(min(depth, i), 0, -1) if tuple(q[i - k : i]) in kept), None)
            c, t = kept.get(state, ({}, 0))
            log += np.log10((c.get(w, 0) + kappa * root(w)) / (t + kappa) if state else root(w))
        out.append(log)
    return out, kept


def test_suffix_tree_states_and_probabilities(spark, edges):
    """Scores equal a plain walk: the longest retained context's smoothed distribution, word by word."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["ta", "To", "no", "ri", "que", "so"] if rng.random() < 0.9 else ["x" + str(rng.randint(0, 40))]) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    phrase = "one two three four five six seven"
    rows += [(400 + i, phrase if i % 3 else None) for i in range(30)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{edges}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for depth, cutoff, kappa, most in ((1, 4.0, 8.0, 1 << 22), (3, 4.0, 8.0, 1 << 22), (2, 0.5, 2.0, 60)):
        want, kept = plain_tree_scores(rows, depth, cutoff, kappa, most)
        assert {len(c) for c in kept} == set(range(1, depth + 1))
        got = suffix_tree.scores(docs, depth=depth, cutoff=cutoff, kappa=kappa, most_words=most).collect()
        assert np.allclose(sorted(r.score for r in got), sorted(want), atol=1e-4)
    same = {r.doc_id: r.score for r in suffix_tree.scores(docs, piece=1 << 40).collect()}
    split = {r.doc_id: r.score for r in suffix_tree.scores(docs, piece=20).collect()}
    assert same != split and all(x <= 0 for x in split.values())


def test_suffix_tree_is_the_same_however_it_is_dealt(spark, edges):
    """Neither dealing out frequent contexts nor joining the counts of rarer words changes a score."""
    rng = random.Random(6)
    word = lambda: rng.choice(["ta", "To", "no", "ri", "que"]) if rng.random() < 0.8 else "x" + str(int(rng.random() ** 3 * 300))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{edges}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    # with 300 some frequent contexts aren't retained
    for cutoff, most, ways in ((4.0, None, ((20, 1 << 22), (1 << 18, 30))), (300.0, None, ((20, 1 << 22),)), (4.0, 60, ((150, 90),))):
        want, kept = plain_tree_scores(rows, 3, cutoff, 8.0, most or 1 << 40)
        times = [t for _, t in kept.values()]
        assert max(times) > 400 and any(len(c) == 3 and t > 20 for c, (_, t) in kept.items())
        plain = {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in suffix_tree.scores(docs, cutoff=cutoff, most_words=most).collect()}
        for part, broadcast in ways:
            got = suffix_tree.scores(docs, cutoff=cutoff, most_words=most, part=part, broadcast=broadcast).collect()
            assert np.allclose(sorted(r.score for r in got), sorted(want), atol=1e-4)
            assert {(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got} == plain


def test_suffix_tree_has_no_bound_by_size():
    """Contexts and words beyond the former bounds keep their own counts unless options say otherwise."""
    signature = inspect.signature(suffix_tree.scores).parameters
    assert signature["piece"].default is None and signature["most_words"].default is None
    heavy = suffix_tree.Heavy(np.arange(3), np.array([1000, 400, 120]), 100)
    bucket, keys, at = heavy.held(16)
    assert np.bincount(at).tolist() == [10, 4, 2] and (np.diff(bucket) >= 0).all()
    hashes = kernels.mix(np.arange(5000, dtype=np.uint64))
    used = {suffix_tree.dealt(heavy.dealt(np.zeros(1, int), hashes[i : i + 1]), np.zeros(1, np.uint64), 16)[0][0] for i in range(200)}
    assert len(used) > 3  # one context's pairs are in several partitions
    root = suffix_tree.Root(np.arange(2, dtype=np.uint64), np.array([9, 7]), 30, 8, 1, 6, 14)
    assert np.isclose(root.p[:2].sum() + root.share(np.full(6, 1 << 23), np.array([4, 3, 2, 2, 2, 1])).sum() + root.p[-1], 1)


def test_suffix_tree_distributions_sum_to_one():
    rng = np.random.default_rng(2)
    root = suffix_tree.Root(np.arange(5, dtype=np.uint64), np.array([9, 7, 5, 3, 2]), 30, 8)
    assert np.isclose(root.p[:-1].sum() + root.p[-1] * 4, 1)  # three rarer words and the unseen
    n = rng.integers(1, 9, 5)
    at, c, t = suffix_tree.retained(np.arange(5, dtype=np.uint64), n, root, -1e9, 8.0)
    assert at.tolist() == [0, 1, 2, 3, 4] and (c == n).all() and (t == n.sum()).all()
    log = np.log((c + 8.0 * root.p[:5]) / (t + 8.0))
    for x in (n, np.zeros(0, np.int32), rng.integers(0, 1 << 62, 999).astype(np.uint64)):
        assert (suffix_tree.unpacked(suffix_tree.packed(x), len(x), x.dtype) == x).all()
    unseen = 8.0 * root.p[-1] * 4 / (n.sum() + 8.0)
    assert np.isclose(np.exp(log).sum() + unseen, 1)


def test_suffix_tree_grows_with_the_corpus(spark):
    """A text that occurs twice in any amount of others is remembered."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    once, twice = (" ".join(word() for _ in range(30)) for _ in range(2))
    for others in (50, 500):
        rows = [" ".join(word() for _ in range(30)) for _ in range(others)] + [once, twice, twice]
        got = {r.doc_id: r.score for r in suffix_tree.scores(spark.createDataFrame([(7 * i, t) for i, t in enumerate(rows)], "doc_id long, text string").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) <> 2")).collect()}
        if {7 * others, 7 * others + 7, 7 * others + 14} <= set(got):
            assert got[7 * others + 7] > got[7 * others] + 20


def test_pipeline_keeps_columns_and_decides(spark, edges, nothing):
    for where in (edges, nothing):
        docs = spark.read.parquet(f"{where}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, where)
            assert out.dtypes == docs.dtypes
        assert corpus_pipeline.run(spark, where).columns[:2] == ["doc_id", "n_tokens"]


def test_pipeline_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = [r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()]
    assert len(kept) >= 0.98 * len(rows)
    best: dict[str, tuple] = {}
    for i, t in rows.items():
        best.setdefault(SPACE.sub("", t), []).append((-len(t), i))
    want_exact = {min(x)[1] for x in best.values()}
    assert {r.doc_id for r in corpus_pipeline.exact_dedup(spark, docs, SF).collect()} == want_exact
    # near dedup: the smallest id of each component, sets compared pair by pair
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for i, w in ((i, words_of(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in rows.items())}
    ids = sorted(sets)
    edges_ = [(a, b) for a, i in enumerate(ids) for b, j in enumerate(ids[:a]) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = parts(edges_, len(ids))
    heads = {i for k, i in enumerate(ids) if root[k] == k}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == heads
    # mixing: Poisson quantiles of md5 numbers
    own = [(r.doc_id, r.source, max(len(r.text or ""), 1)) for r in docs.collect()]
    chars: dict = {}
    for _, source, n in own:
        chars[source] = chars.get(source, 0) + n
    weight = {k: v**0.7 for k, v in chars.items()}
    want = []
    for i, source, _ in own:
        rate = round(weight[source] / sum(weight.values()) * sum(chars.values()) / chars[source], 9)
        u = int(hashlib.md5(f"11|{i}".encode()).hexdigest()[:13], 16) / 16.0**13
        term = total = np.exp(-rate)
        k = 0
        while total <= u:
            k += 1
            term *= rate / k
            total += term
        want += [i] * k
    assert sorted(r.doc_id for r in corpus_pipeline.mix(spark, docs, SF).collect()) == sorted(want)
    # encoding, against the library that the model is made for
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        ids = theirs.encode(rows[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.round_trip
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert out.round_trip.all() and set(out.doc_id) <= heads & want_exact

"""The prefix trie, the filter audit and the page extraction against brute force and known texts."""

import hashlib
import html
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import audit, extract, hot, kernels, prefixes
from tests.llm.test_operators import conversation_rows, edge_rows

TURNS = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    """Every node by walking each rebuilt conversation's prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        g = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        whole = tuple(own.get(g, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[n] for n in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = []
    for node, who in members.items():
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        up = min(members[node[:-1]]) if node else None
        out.append((min(who), len(node), up, len(who), len(children.get(node, [])), *sums[node], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def long_rows():
    """One conversation of thousands of turns, a copy that leaves it late, and a hot group of copies."""
    long = [(200, t, "user", f"turn {t % 7}") for t in range(5000)]
    late = [(201, t, "user", f"turn {t % 7}" if t < 4000 else "left") for t in range(4500)]
    hot_ = [(c, t, "user", f"hot {t}") for c in range(1000, 1400) for t in range(3)]
    return long + late + hot_


@pytest.mark.parametrize("rows", [conversation_rows(), long_rows()], ids=["edges", "long"])
def test_trie_by_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(prefixes, "BLOCK", 64)
    monkeypatch.setattr(prefixes, "RUN", 16)
    got = [tuple(r) for r in prefixes.trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()]
    assert sorted(got, key=str) == plain_trie(rows)


def test_trie_levels_are_logarithmic(spark):
    """A comb: every prefix of one conversation is left by another, so light nodes are many, levels few."""
    rows = [(c, t, "u", "x" if t < c % 50 else f"{c}") for c in range(0, 200) for t in range(c % 50 + 1)]
    got = [tuple(r) for r in prefixes.trie(spark.createDataFrame(rows, TURNS)).collect()]
    assert sorted(got, key=str) == plain_trie(rows)


def test_attach_deals_hot_keys(spark):
    rows = spark.range(10_000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id")).alias("k"))
    facts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.max("id") * 2).alias("twice")).where("k is not null")
    got = {r.id: r.twice for r in hot.attach(rows, facts, ["k"], "n", ["id"]).collect()}
    assert len(got) == 10_000 and got[0] == got[9999] == 2 * 9999 and got[1] == 2 and got[2] is None


def plain_failures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    text = text or ""
    return (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + 8 * bool(re.search(r"[#$%&*|]", text))


def test_scan_by_brute_force():
    rng = random.Random(3)
    texts = [r[1] for r in edge_rows()] + ["".join(rng.choice(" \n\tabABé#ß𝄞") for _ in range(rng.randrange(0, 900))) for _ in range(300)]
    column = pa.array(texts, pa.string())
    data, offsets = kernels.buffer(column)
    want = [plain_failures(t) for t in texts]
    assert audit.failures(data, offsets).tolist() == want
    data, offsets = kernels.buffer(column.slice(5, 100))
    assert audit.failures(data, offsets).tolist() == want[5:105]
    # every word has the same hash: all neighbours lie or agree, and words decide
    assert audit.failures(data, offsets, lambda words: np.zeros(len(words.start), np.uint64)).tolist() == want[5:105]


def test_audit_by_brute_force(spark):
    rows = edge_rows() + [(500 + i, "the same text " * 20, None, s) for i, s in enumerate(["", None, "hot", "rare"])]
    labels = [(8, 1, 0), (8, 0, 1), (500, 1, None), (503, None, 1), (None, 1, 1), (9, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("mask", F.lit("x")).withColumn("good", F.lit(3))
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    first = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    seen = [(s or "", plain_failures(t) + 16 * (i is not None and i > first[t or ""]), any(l[0] == i and l[1] == 1 for l in labels if i is not None), any(l[0] == i and l[2] == 1 for l in labels if i is not None)) for i, t, _, s in rows]
    parts = {s[0] for s in seen}
    shapley = dict.fromkeys([(p, f) for p in parts for f in range(5)], 0)
    want = {}
    for part in parts:
        for order in permutations(range(5)):
            left = [s for s in seen if s[0] == part]
            everyone = left
            for step, f in enumerate(order):
                out = [s for s in left if s[1] >> f & 1]
                shapley[part, f] += len(out)
                kept = [s for s in left if not s[1] >> f & 1]
                failing = [s for s in everyone if s[1] >> f & 1]
                only = sum(s[1] == 1 << f for s in everyone)
                want[part, "".join("ABCDE"[i] for i in order), step + 1] = [len(kept), len(out), len(failing) - len(out), only, sum(s[2] for s in out), sum(s[3] for s in out), f]
                left = kept
    want = {k: (*v[:6], shapley[k[0], v[6]]) for k, v in want.items()}
    assert len(got) == 600 * len(parts) and got == want


BODY = [f"Paragraph {k} of the story goes on for a while, with enough words that windows see it as text and not as chrome." for k in range(6)]


def page(*parts):
    return "<!DOCTYPE html><html><head><title>A title</title><style>p > b {x}</style><script>if (a < b) document.write('<p>no</p>')</script></head><body>" + "".join(parts) + "</body></html>"


PAGES = {
    "article": (page("<nav><a href=/>Home</a></nav><article><h1>Story</h1>", *[f"<p>{b}</p>" for b in BODY], "<p>Be.</p></article><footer>&copy; us</footer>"), ["Story", *BODY, "Be."]),
    "no article element": (page("<div id='top-nav'><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></div><div class='content'><h2>Story</h2>", *[f"<p>{b}" for b in BODY], "</div><div class='side-bar sidebar'>Best of us</div><div class=footer>Legal text that is not the story at all, however long it may be, so that windows alone would keep it.</div>"), ["Story", *BODY]),
    "comments and adverts inside": (page("<main><article><h1>Story</h1><p>", BODY[0], "</p><div class='ad-slot'>Buy this, buy that, and come back for more tomorrow.</div><p>", BODY[1], "</p><section id='comments'><h3>2 comments</h3><article class='comment'><p>I don't agree with a word of it, and here is a long reply to say so.</p></article></section></article><aside>More</aside></main>"), ["Story", *BODY[:2]]),
    "references and white space": (page("<article><p>a &lt;b&gt; &amp; c&nbsp;d\n\t e &#233;&eacute;</p><p>x<b>y</b>z<br>w</p></article>"), ["a <b> & c d e éé", "xyz w"]),
    "forms, notices and hidden parts": (page("<div class='cookie-notice'>We use cookies to make this site better for you and for all of our many partners.</div><form><label>Name</label><input name=a><button>Send it</button></form><article><p>", BODY[0], "</p><p hidden>Not seen</p><p style='display: none'>Nor this</p><script>x='</p>'</script><p>", BODY[1], "</p></article>"), BODY[:2]),
    "unclosed elements": ("<body><nav><a href='/'>Home</a></nav><article><p><b>" + BODY[0] + "<p>" + BODY[1] + "<ul><li>one<li>two</ul><p>end < of it", [*BODY[:2], "one", "two", "end < of it"]),
    "attributes with brackets": (page("<article><p data-x='a > b' title=\"</p>\">", BODY[0], "</p></article>"), [BODY[0]]),
    "plain text": ("no markup at all,\n just words", ["no markup at all, just words"]),
    "unclosed comment": ("<p>" + BODY[0] + "</p><!-- open <p>" + BODY[1], [BODY[0]]),
    "cut tag": ("<p>" + BODY[0] + "</p><a href='x", [BODY[0]]),
    "links only": ("<ul><li><a href=/a>a</a><li><a href=/b>b</a></ul>", []),
    "nothing": ("", []),
    "null": (None, []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page_text(name):
    source, want = PAGES[name]
    assert extract.main_text(source or "") == "\n".join(want)


def test_pages_by_their_articles(spark):
    """The given pages mark their article; every block of it stays, and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract.extracted(pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))


def test_pages_by_windows_alone(spark):
    """The same pages without their marks: windows find the text again, short ends aside."""
    found = whole = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        unmarked = re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", r.html).replace('class="ad"', "")
        want = extract.main_text(r.html)
        got = set(extract.main_text(unmarked).split("\n"))
        found += sum(len(b) for b in want.split("\n") if b in got)
        whole += sum(len(b) for b in want.split("\n"))
    assert found / whole > 0.95


def test_long_page_is_linear():
    import time

    source = "<p>" + "word " * 50 + "<a href='x" * 3 + "<b " * 20_000 + "</p><p>" + "é" * 2_000_000 + "</p>" + "<li>x" * 100_000
    began = time.time()
    extract.main_text(source)
    assert time.time() - began < 20


def test_archives_of_mixed_sizes(spark, tmp_path, monkeypatch):
    """A large page takes a file of its own; the small ones still share theirs."""
    from lexiloom.llm import warc

    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 21)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 256)
    rows = [(i, f"http://x/{i}", f"page {i} " * 20) for i in range(600)] + [(1000, None, "é" * 2_000_000), (1001, "u", "é" * 2_000_000), (1002, "u", "m" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    where = str(tmp_path / "a")
    warc.write_archive(warc.from_pages(pages), where)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(where).select("content").collect()
    many = sorted(sum(1 for _ in warc.parse(f.content)) for f in files)
    assert sum(many) == 603 and many == [1, 1, 1, 88, 256, 256]
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(got) == 603 and got[1001].refers_to == 1000 and got[1001].record_type == "revisit" and got[1000].payload_bytes == 4_000_000
    assert {r.record_type for i, r in got.items() if i != 1001} == {"response"}


def test_cascade_samples_rows_without_ids(spark):
    from lexiloom.llm import quality

    docs = spark.range(0, 20_000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    assert quality.sampled(docs, 500).count() == 500
    assert quality.sampled(docs.withColumn("doc_id", F.lit(7)), 500).count() == 500
    assert 0 < quality.sampled(docs, 500, 1000).count() < 130
    assert quality.sampled(docs, 30_000).count() == 20_000 and quality.sampled(docs.limit(0), 500).count() == 0
    named = spark.createDataFrame([(1, "a b c", 5, 6)], "doc_id long, text string, _words int, _lines int")
    row = quality.counted(named).collect()[0]
    assert (row["_words"], row["_lines"], row["n_words"], row["n_lines"]) == (5, 6, 3, 1)


def test_poisson_tables_by_the_sum(spark):
    """Tables that begin late agree with the whole sum, and the search by halves with counting."""
    import math

    from lexiloom.llm import mixing

    rates = [0.3, 1.0, 17.5, 399.0, 401.0, 5000.0, 250_000.0]
    table = mixing.quantiles(spark.createDataFrame([(str(r), r) for r in rates], "mix_source string, rate double"))
    for r in table.collect():
        assert len(r.cdf) < 25 * math.sqrt(r.rate) + 480 and abs(r.cdf[-1] - 1) < 1e-6
        k = r.least + len(r.cdf) // 2
        log_p = lambda i, m=r.rate: -m + i * math.log(m) - math.lgamma(i + 1)
        assert r.cdf[k - r.least] == pytest.approx(math.fsum(math.exp(log_p(i)) for i in range(max(0, int(r.rate - 15 * math.sqrt(r.rate)) - 5), k + 1)), rel=1e-6)
    us = [0.0, 1e-12, 0.1, 0.5, 0.73, 0.999999, 1 - 2**-52]
    both = table.crossJoin(spark.createDataFrame([(u,) for u in us], "u double"))
    for r in both.withColumn("n", mixing.drawn_count(F.col("u"))).collect():
        assert r.n == r.least + sum(p <= r.u for p in r.cdf)

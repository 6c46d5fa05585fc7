"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Base counts are computed for every row. Rules are then judged in an order estimated on a
sample: each rule's cost (seconds of a job that evaluates it alone on many copies of the sample,
less those of an idle job, the least of some runs, as a power of two of the cheapest rule's) and
selectivity (share of sampled rows it rejects) give rejection per cost, and the verdict is one ``CASE``
chain in falling order of it, so later rules aren't evaluated for a rejected row. The order
changes cost only, never a verdict.

Defined cases. Null text: no words, every count zero, base_failed. Repeated rows are judged
one by one. Rules of equal worth keep their order. A very long text is judged whole, as one row.
Empty table: no rows. Extra columns are carried along; a column that has the name of a computed
one is replaced.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SAMPLE_ROWS = 2000
#: Text that a sample may have, but for its last row.
SAMPLE_BYTES = 32 << 20
#: Copies of each sampled row that a rule is timed on, and runs of which the fastest counts.
TIMED_COPIES, TIMED_RUNS = 8, 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value once: lambda bodies would evaluate an inlined expression per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the same array.

    Windows are sorted with their positions; equal neighbours are the repeated ones. Their
    sorted positions cover ``least(3, gap to the next)`` words each.
    """

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: (i >= 0) & (j < n) & (F.get(s, i)["h"] == F.get(s, j)["h"])
        hit = F.sort_array(F.transform(F.filter(s, lambda x, j: same(j - 1, j) | same(j, j + 1)), lambda x: x["i"]))
        return let(hit, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    def from_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    def grams(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    return let(ws, lambda w: let(grams(w), from_hashes))


def solid_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda s: F.octet_length(without(s, SPACES)) > 0)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts (:data:`COUNTS`)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    solid = without(t, SPACES)
    # names that no column has: carried columns may be called anything
    w, lines = (next(n for n in (name, *(f"{name}{k}" for k in range(len(docs.columns) + 1))) if n not in docs.columns) for name in ("_words", "_lines"))
    out = docs.drop(*COUNTS).withColumns({w: words(t), lines: solid_lines(t)})
    return out.select(
        "*",
        F.size(w).cast("long").alias("n_words"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(solid) - F.length(without(solid, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        repeated_words(F.col(w)).alias("n_repeat_words"),
    ).drop(w, lines)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """``reject`` is a boolean column over the counts; null counts as not rejected."""

    name: str
    reject: Callable[[], Column]


def _c(name: str) -> Column:
    return F.col(name)


def share_of(pattern: str) -> Column:
    """Characters of the text that the pattern's class has."""
    return F.length("text") - F.length(F.regexp_replace("text", pattern, ""))


#: Thresholds are ratios of whole numbers, so that every engine decides alike.
RULES: tuple[Rule, ...] = (
    Rule("shouting", lambda: 2 * share_of("[A-ZÀ-ÖØ-Þ]") > _c("word_chars")),
    Rule("digits", lambda: 4 * share_of("[0-9]") > _c("word_chars")),
    Rule("exclamations", lambda: 10 * (F.length("text") - F.length(without(_c("text"), "!?"))) > 3 * _c("n_words")),
    Rule("symbols", lambda: 10 * _c("n_symbols") > _c("n_words")),
    Rule("repeated_lines", lambda: 100 * _c("n_dup_lines") > 30 * _c("n_lines")),
    Rule("short_words", lambda: _c("word_chars") < 2 * _c("n_words")),
    Rule("long_words", lambda: _c("word_chars") > 15 * _c("n_words")),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejection per cost."""
        return self.rejected / self.cost


def estimate(sample: DataFrame, rules: Sequence[Rule] = RULES) -> list[Estimate]:
    """Cost and selectivity of each rule, each by a job of its own over the sample."""

    several = scratch.keep(sample.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.lit(TIMED_COPIES)))), "cascade-timed")

    def run(reject: Column) -> tuple[float, float]:
        seconds = []
        for _ in range(TIMED_RUNS):
            began = time.perf_counter()
            share = several.agg(F.avg(F.coalesce(reject, F.lit(False)).cast("double"))).first()[0]
            seconds.append(time.perf_counter() - began)
        return min(seconds), share or 0.0

    run(F.lit(False))
    idle = run(F.lit(False))[0]
    found = [(rule, *run(rule.reject())) for rule in rules]
    scratch.release(several)
    costs = [max(seconds - idle, 1e-3) for _, seconds, _ in found]
    # a power of two: what lies within the noise of a job counts as equal
    return [Estimate(rule, 2.0 ** round(math.log2(cost / min(costs))), share) for (rule, _, share), cost in zip(found, costs)]


def ordered(estimates: Sequence[Estimate]) -> list[Rule]:
    return [e.rule for e in sorted(estimates, key=lambda e: -e.worth)]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``rows`` rows and about ``most_bytes`` of text, the ones with the least hashes of id
    and place in the table, so that rows without an id or with a shared one count like others."""
    text = F.col("text").cast("string")
    hashed = docs.withColumn("at_", F.xxhash64(F.lit("cascade"), "doc_id", F.monotonically_increasing_id()))
    n = docs.count()
    near = hashed if n <= rows else hashed.where(F.pmod("at_", F.lit(1 << 30)) < F.lit(int(min(1.0, 2 * rows / n) * (1 << 30))))
    # sizes first: a window over bounded rows, no texts in it
    few = near.select("at_", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes_")).orderBy("at_").limit(rows)
    before = F.sum("bytes_").over(Window.orderBy("at_").rowsBetween(Window.unboundedPreceding, -1))
    chosen = scratch.keep(few.withColumn("before_", F.coalesce(before, F.lit(0))).where(F.col("before_") < most_bytes).select("at_"), "cascade-chosen")
    return near.join(F.broadcast(chosen), "at_", "left_semi").drop("at_")


def first_rejection(rules: Sequence[Rule]) -> Column:
    """The first rule in the chain that rejects the row, or null; later ones aren't evaluated."""
    chain = None
    for rule in rules:
        chain = F.when(rule.reject(), rule.name) if chain is None else chain.when(rule.reject(), rule.name)
    return F.lit(None).cast("string") if chain is None else chain


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with counts, base_failed, kept and rejected_by (null if kept or base_failed)."""
    slim = docs.drop("base_failed", "kept", "rejected_by")
    chosen = scratch.keep(counted(sampled(slim.select("doc_id", "text"), rows)).where(~base_failed()), "cascade-sample")
    chain = first_rejection(ordered(estimate(chosen, rules)))
    out = counted(slim).withColumn("base_failed", base_failed())
    out = out.withColumn("rejected_by", F.when(~F.col("base_failed"), chain))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())

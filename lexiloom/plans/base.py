"""Registration of queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; doubles of its result are rounded alike in both engines."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c), DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expr: str) -> str:
    """The same rounding in SQL, without a negative zero."""
    return f"round(({expr})::double, {DIGITS}) + 0.0"


#: Tokens of documents in DuckDB, as ``sources.tables.documents`` has them.
TOK = """
lines_ as (
  select lang as corpus, source as section, doc_id as page, li - 1 as line_idx, regexp_extract_all(lower(ls[li]), '[a-z]+') as ws
  from (select *, string_split(text, chr(10)) as ls from documents), unnest(range(1, len(ls) + 1)) as u(li)
), tok as (
  select corpus, section, page, line_idx, wi - 1 as word_idx, len(ws) as line_len, ws[wi] as w,
         row_number() over (partition by page order by line_idx, wi) - 1 as pos
  from lines_, unnest(range(1, len(ws) + 1)) as v(wi)
)"""
VOC = "voc as (select corpus, w, count(*) as cnt from tok group by all)"
RANKED = "ranked as (select *, row_number() over (partition by corpus order by cnt desc, w) as rank from voc)"
TOP150 = "top as (select corpus, w from ranked where rank <= 150)"


def sql(*ctes: str, select: str) -> str:
    return "with " + ", ".join((TOK, *ctes)) + " " + select


def mutual(pairs: str, by: str, name: str = "mi") -> str:
    """CTEs and select for mutual information of pairs (by, a, b, c)."""
    return (
        f"m_ as (select {by}, c::double as c, sum(c) over (partition by {by})::double as n, sum(c) over (partition by {by}, a)::double as la, "
        f"sum(c) over (partition by {by}, b)::double as rb from {pairs}), "
        f"mi_ as (select {by}, sum(c)::bigint as n_pairs, sum(c / n * log2(c * n / (la * rb))) as {name} from m_ group by {by})"
    )


def flag(c: Column) -> Column:
    return c.cast("double")

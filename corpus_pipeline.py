"""A training-corpus pipeline over ``documents``.

Five stages, each on all that its predecessor kept: language identification (texts without
a letter or without a clear language go), exact dedup, near dedup by the n-gram Jaccard join
(the smallest id of each component stays), mixing of sources to target weights by Poisson
replication, and SentencePiece encoding. Each stage's rows are written as Parquet and reread.

Stages before the last return the columns of ``documents``. Rows that share an id are kept
apart by their texts: a component keeps one row, the one with the least (id, hash of text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import exact, jaccard, langid, mixing, pieces, scratch

#: The least calibrated probability of the best language that a text is kept with.
MIN_LANGUAGE_SCORE = 0.3

#: Models and hashes have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


#: Columns that stages read by name; others are renamed while a stage runs, so none can clash.
READ = ("doc_id", "text", "lang", "source")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """The stage on documents whose other columns can't clash with any that it adds."""

    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in READ else f"column_{i}_" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), sf_dir)
        return out.select(*[F.col(n).alias(c) for c, n in names.items()])

    return run_apart


@apart
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is identified."""
    found = langid.identified(docs, carry=tuple(docs.columns))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


@apart
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    kept = scratch.keep(exact.groups(docs).where("kept"), "exact-kept")
    # repeated rows of one winner are all marked kept: one of them stays, by a partial aggregate,
    # so that a row repeated in a third of the table is one row a task before anything is shuffled
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    several = kept.where("group_size > 1").groupBy("text_sha256", "keep_id").agg(F.min_by(row, F.xxhash64(row)).alias("row_"))
    return kept.where("group_size = 1").select(docs.columns).unionByName(several.select("row_.*").select(docs.columns))


@apart
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the n-gram Jaccard join."""
    found = jaccard.joined(docs)
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "rk")
    alone = found.where("n_shingles = 0").select("rk", F.col("doc_id").alias("id_"))
    heads = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(key).alias("head")).select("head.rk", F.col("head.doc_id").alias("id_"))
    keep = scratch.keep(heads.unionByName(alone).distinct(), "near-dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("rk_", F.xxhash64(F.col("doc_id").cast("long"), text))
    same = (F.col("rk_") == F.col("rk")) & F.col("doc_id").cast("long").eqNullSafe(F.col("id_"))
    return keyed.join(keep.hint("merge"), same, "left_semi").select(docs.columns)


@apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to the sources' target weights, in a global random order."""
    return mixing.replicate(docs).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text."""
    out = pieces.encoded(docs.select("doc_id", "text"))
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return out.select("doc_id", "n_tokens", digest.alias("ids_sha256"), "round_trip")


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training corpus from raw documents: five stages, each on what the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
``run`` writes each result to the shared folder and reads it again, so a lost executor costs at most
one stage's lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.llm import decontaminate, mixture, secrets, simhash, toxicity
from corpusflow.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``stage`` with columns beyond doc_id and text renamed, so no name of theirs can clash."""
    names = {c: c if c in ("doc_id", "text") else f"__c{i}" for i, c in enumerate(docs.columns)}
    out = stage(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    labels = _table(spark, sf_dir, "labels")
    return _plain(docs, lambda d: toxicity.toxicity(d, labels).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays, the least doc_id: 3-word shingles, links at 3 or fewer differing bits."""
    return _plain(docs, lambda d: simhash.keep_one(d, shingle=3, bits=3))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go."""
    benchmark = _table(spark, sf_dir, "benchmark")
    return _plain(docs, lambda d: decontaminate.clean(d, benchmark))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; found secrets are replaced and n_chars follows."""
    out = _plain(docs, secrets.redact)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights, with the words taken of each document."""
    return mixture.mixed(docs, _table(spark, sf_dir, "labels"))


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("mixing to target weights", mix_sources),
]

# Learned scores, fingerprints and a network have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

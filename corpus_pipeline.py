"""The corpus pipeline: documents in, a mixed training corpus out, in five stages.

Each stage takes (spark, docs, sf_dir) with docs as its predecessor wrote them, and returns the rows that it keeps,
with the columns of documents; the last adds how often and how many words the mix takes of each.

Defined results, of all stages: rows are judged each by its own, also where they repeat a doc_id or each other; null
ids, texts and sources are values like others; a very long text is one row like any other; an empty table gives an
empty result with the same columns; further columns are carried through, whatever their names, except that mix
replaces copies, size, source_size, target and taken.  A missing table labels or benchmark is an error.  Blank texts
fall to the quality stage; without labels its base rule decides alone.

A stage's intermediate tables go when the next stage is called on the same thread, as its result is written by then;
tables of other operators are left alone.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.llm import decontaminate, line_dedup, minhash, mixing, quality_rules
from nearmark.llm.common import Workspace, free_name, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_OWN = threading.local()


def stage(f: Stage) -> Stage:
    """f, which first removes the tables of the stage before it in this thread's pipeline."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session, spaces = getattr(_OWN, "spaces", (None, []))
        if session == spark.sparkContext.applicationId:
            for space in spaces:
                space.drop("")
        with Workspace.collected() as mine:
            out = f(spark, docs, sf_dir)
        _OWN.spaces = (spark.sparkContext.applicationId, mine)
        return out

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality_rules.filter_documents(spark, docs, read_table(spark, sf_dir, "labels"))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to many documents stay in one; n_chars follows the text where lines went, null texts stay null."""
    carried = {c: free_name(f"_{c}", docs) for c in docs.columns if c.lower() in ("n_lines", "n_dropped", "kept_text")}
    out = line_dedup.dedup_lines(spark, docs.withColumnsRenamed(carried))
    text = F.when(F.col("text").isNull(), F.col("text")).otherwise(F.col("kept_text"))
    size = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    out = out.withColumn("text", text).withColumn("n_chars", size).drop("n_lines", "n_dropped", "kept_text")
    return out.withColumnsRenamed({new: old for old, new in carried.items()}).select(docs.columns)


@stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, of the smallest doc_id; rows without words all stay."""
    return minhash.one_of_each(spark, docs)


@stage
def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go."""
    return decontaminate.drop_leaks(spark, docs, read_table(spark, sf_dir, "benchmark"))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, with copies, size, source_size, target and taken."""
    return mixing.mix_documents(spark, docs)


STAGES = [("quality", quality), ("lines", lines), ("near", near), ("leaks", leaks), ("mix", mix)]

#: Learned rules and similarity components aren't SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, f in STAGES[:-1]:
        df = f(spark, docs, sf_dir)
        own = Workspace(spark, f"stage-{name}")
        docs = own.keep(df, "docs")
        if before is not None:
            before.drop("")
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)

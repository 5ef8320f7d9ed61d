"""A corpus pipeline in five stages: language, lines, near duplicates, mixture, packing.

Each stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as the docs of
the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import langid, linededup, mixing, ngramjoin, packing
from lodestar.llm.common import Scratch, quoted

#: Words of a shingle and hundredths of the similarity of near duplicates.
WORDS, PERCENT = 5, 80
#: Least posterior of the language predicted for a document that stays.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language stays in doubt, go."""
    found = langid.identify(docs, langid.train(docs.select("doc_id", "text", "lang")))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CERTAIN)).select(*(F.col(quoted(c)) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of like lines the first stays; a document left without words goes."""
    scratch = Scratch(spark)
    return linededup.rewrite(docs, linededup.dedup(docs, scratch), scratch)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one of smallest doc_id stays; rows without a doc_id stay, and
    so does every row of a doc_id that stays."""
    scratch = Scratch(spark)
    groups = ngramjoin.join(docs, scratch, k=WORDS, percent=PERCENT)
    gone = scratch.save(groups.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*(F.col(quoted(c)) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, as its source's weight asks."""
    return mixing.mix(docs, Scratch(spark), carry=True).select(*(F.col(quoted(c)) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs), Scratch(spark))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mixture", mixture), ("packing", pack)]
#: No SQL: the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{i}_{name}")
        if i:
            scratch.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs

"""Places named in texts: the first one, by the longest name that begins there.

Names and texts are cut into the same tokens. Only a token that begins some name, and is not part of one set apart, is looked
at further: it is tried with as many following tokens as the names that begin with it have. So a text is never compared with
the gazetteer as a whole, and what meets by equi joins are single tokens and short runs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.joins import small

#: A word with its inner hyphens and apostrophes.
TOKEN = r"(?U)\p{L}[\p{L}\p{M}\d'’]*(?:-\p{L}[\p{L}\p{M}\d'’]*)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def names(places: DataFrame, place: str = "place", name: str = "name", weight: Column | None = None) -> DataFrame:
    """(words, first, n, place): each name once, for the place of most weight (of equal ones the first in order)."""
    x = places.where(F.col(place).isNotNull()).select(F.col(place).alias("place"), F.transform(tokens(F.lower(name)), lambda w: w).alias("_t"), (F.lit(0) if weight is None else weight).alias("_w")).where(F.size("_t") > 0)
    x = x.select("place", "_w", F.array_join("_t", " ").alias("words"), F.col("_t")[0].alias("first"), F.size("_t").alias("n"))
    return x.groupBy("words", "first", "n").agg(F.min_by("place", F.struct((-F.col("_w")).alias("w"), "place")).alias("place"))


def mentions(texts: DataFrame, known: DataFrame, key: str = "id", text: str = "text", proper: bool = False, apart: tuple[str, ...] = ()) -> DataFrame:
    """(key, at, n, place): the longest of the known names (of `names`) that begins at each token, from 0.

    With proper, a name has to begin with a capital letter in the text. Names set apart (lower case) are no mentions, and hide
    shorter names that begin where they do.
    """
    every = texts.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_t")).select("_key", "_t", F.posexplode("_t").alias("at", "_w"))
    if proper:
        every = every.where(F.initcap(F.substring("_w", 1, 1)) == F.substring("_w", 1, 1))
    aside = known.sparkSession.createDataFrame([(w, w.split(" ")[0], len(w.split(" "))) for w in apart] or [("", "", 1)], "words string, first string, n int")
    both = known.select("words", "first", "n", "place").unionByName(aside.where("words <> ''").withColumn("place", F.lit(None).cast(known.schema["place"].dataType)))
    begins = both.groupBy("first").agg(F.collect_set("n").alias("sizes"), F.max("n").alias("most"))
    # A few names are sent to the texts: the tokens of all texts are then not exchanged to find the few that begin one.
    # Before the join a row holds no more of its text than the longest name may take.
    longest = both.agg(F.max("n")).first()[0] or 1
    near = every.select("_key", "at", F.lower("_w").alias("first"), F.slice("_t", F.col("at") + 1, longest).alias("_run")).join(small(begins), "first")
    tried = near.select("_key", "at", "_run", F.explode("sizes").alias("n")).where(F.col("n") <= F.size("_run"))
    found = tried.select("_key", "at", F.lower(F.array_join(F.slice("_run", F.lit(1), F.col("n")), " ")).alias("words")).join(small(both.select("words", "n", "place")), "words")
    # A name that is set apart wins over the same name as a place.
    best = found.groupBy("_key", "at").agg(F.max_by(F.struct("n", "place"), F.struct("n", F.col("place").isNull().alias("aside"))).alias("x"))
    return best.where("x.place IS NOT NULL").select(F.col("_key").alias(key), "at", "x.n", "x.place")


def first_place(texts: DataFrame, known: DataFrame, key: str = "id", text: str = "text", proper: bool = False, apart: tuple[str, ...] = ()) -> DataFrame:
    """(key, at, n, place): the first mention of each text; texts without one, and repeats of a key, have no row of their own."""
    found = mentions(texts, known, key, text, proper, apart).where(F.col(key).isNotNull())
    return found.groupBy(key).agg(F.min_by(F.struct("at", "n", "place"), F.struct("at", "place")).alias("x")).select(key, "x.*")

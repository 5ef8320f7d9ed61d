"""Mixing sources to target weights by temperature, DataFrame functions only.

Source shares p are raised to an exponent a and normalised, w = p^a / sum(p^a). Lowering a from 1 to 0 moves from
the natural mixture to a uniform one: entropy rises, and so does the repetition of small sources. Bisection finds
the largest a whose entropy reaches the target; if that repeats some source more often than the limit allows,
bisection finds the smallest a that keeps the limit instead. Only sums over sources reach the driver.

The budget gives each source w * budget tokens. By default it is the least budget that shows every document at
least once, so nothing is lost; a smaller one cuts the last epoch of a source at a document's end. An epoch is a
permutation of the source's documents by hash. A document's place in its source, over the source's weight, gives
the block it falls in; each block thus holds every source by its weight, in an order of its own.

Defined results: null sources are one source; a document's tokens are its words, one at least, so empty and null
texts count; repeated rows are distinct items of equal standing; an empty table gives an empty result; columns
of the input that clash with the result's are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free, prefix_sums, quoted, words_of

#: Share of the greatest possible entropy, most repetitions, tokens of a block.
ENTROPY, REPEAT, BLOCK, SEED = 0.97, 2.0, 1_000_000, 17
STEPS, AT_ONCE = 40, 4


def _moments(sources: DataFrame, exponents: list[float]) -> dict[float, tuple[float, float]]:
    """Entropy of the weights and most repetition under the covering budget, for each exponent, in one job."""
    p = F.col("tokens") / F.col("all_tokens")
    rows = (
        sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        .select("a", "p", F.pow("p", "a").alias("u"))
        .groupBy("a")
        .agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("s"), F.min(F.col("p") / F.col("u")).alias("lo"), F.max(F.col("p") / F.col("u")).alias("hi"))
        .collect()
    )
    return {r["a"]: (math.log(r["z"]) - r["s"] / r["z"], r["hi"] / r["lo"]) for r in rows}


def _bisect(sources: DataFrame, good, low: float, high: float, steps: int = STEPS) -> tuple[float, float]:
    """Halve [low, high] where good holds at low and not at high. A job tries all midpoints of a few halvings."""
    for _ in range(0, steps, AT_ONCE):
        n = 1 << AT_ONCE
        mids = [low + (high - low) * i / n for i in range(1, n)]
        found = _moments(sources, mids)
        i, j = 0, n
        while j - i > 1:
            m = (i + j) // 2
            i, j = (m, j) if good(*found[mids[m - 1]]) else (i, m)
        low, high = low + (high - low) * i / n, low + (high - low) * j / n
    return low, high


def exponent(sources: DataFrame, entropy: float = ENTROPY, repeat: float = REPEAT) -> float:
    """The exponent for a share of the greatest entropy, held by the repetition limit. sources: tokens, all_tokens."""
    n = sources.count()
    if n < 2:
        return 1.0
    target = entropy * math.log(n)
    at = _moments(sources, [0.0, 1.0])
    reached = lambda h, r: h >= target
    allowed = lambda h, r: r <= repeat * (1 + 1e-12)
    a = 1.0 if reached(*at[1.0]) else _bisect(sources, reached, 0.0, 1.0)[0]
    if not allowed(*_moments(sources, [a])[a]):
        a = _bisect(sources, lambda h, r: not allowed(h, r), a, 1.0)[1]
    return a


def weights(docs: DataFrame, scratch: Scratch, entropy: float = ENTROPY, repeat: float = REPEAT, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, target): each source's weight and its tokens in the mixture."""
    sources = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = scratch.save(sources.withColumn("all_tokens", F.lit(float(total))), "sources")
    a = exponent(sources, entropy, repeat)
    u = F.pow(F.col("tokens") / F.col("all_tokens"), F.lit(a))
    z = sources.agg(F.sum(u)).first()[0]
    if z is None:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    weighted = sources.select("source", "tokens", (u / F.lit(z)).alias("weight"))
    if budget is None:
        budget = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0]
    return weighted.withColumn("target", F.greatest(F.col("weight") * F.lit(float(budget)), F.when(F.lit(budget) >= total, F.col("tokens")).otherwise(F.lit(0.0))))


def mix(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", entropy: float = ENTROPY, repeat: float = REPEAT, budget: float | None = None, block: int = BLOCK, seed: int = SEED, carry: bool = False) -> DataFrame:
    """One row for each showing of a document: key, source, epoch, n_tokens, weight, block, place (its rank key there).

    With carry, the input's own columns come along instead of only its key and source.
    """
    made = ("epoch", "n_tokens", "weight", "block", "place")
    own = [c for c in docs.columns if c.lower() not in made] if carry else list(dict.fromkeys((key, "source")))
    content = (F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce("source", F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    # Two hashes and the source tell items apart, however many there are.
    identity = [F.xxhash64(F.lit(seed), *content), F.xxhash64(F.lit(-seed - 1), *content), F.coalesce("source", F.lit(""))]
    item = ["_id", "_id2", "_source"]
    # Equal rows are one item of their joint size and are shown together.
    sized = docs.select(*(x.alias(c) for x, c in zip(identity, item)), F.greatest(words_of(F.col(text)), F.lit(1).cast("long")).alias("_n"))
    base = scratch.save(sized.groupBy(*item).agg(F.max("_n").alias("n_tokens"), F.sum("_n").alias("_all")), "sized")
    plan = scratch.save(weights(base.select(F.col("_source").alias("source"), F.col("_all").alias("n_tokens")), scratch, entropy, repeat, budget), "weights")
    epochs = F.ceil(F.col("target") / F.col("tokens") - 1e-9).cast("int")
    # Sources are few beside documents; adaptive execution broadcasts them where they fit the threshold.
    shown = base.join(plan.withColumnRenamed("source", "_source"), "_source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(epochs, F.lit(1)) - 1)))
    shown = scratch.save(shown.withColumn("_order", F.xxhash64(F.lit(seed), "_id", "_id2", "epoch")).withColumn("_group", F.concat_ws("\x1f", "_source", F.col("epoch").cast("string"))), "shown")
    placed = prefix_sums(shown, "_group", "_order", "_all", "_before", scratch, "mix")
    at = F.col("epoch") * F.col("tokens") + F.col("_before")
    kept = placed.where(at < F.col("target") - 1e-6).withColumn("block", F.floor(at / F.col("weight") / F.lit(float(block))).cast("long"))
    out = scratch.save(kept.select(*item, "epoch", "n_tokens", "weight", "block", F.xxhash64(F.lit(seed + 1), "_order").alias("place")), "plan")
    # Both sides are read anew, so adaptive execution may split what very many equal rows share.
    names = [free(docs, c[1:]) for c in item]
    shows = out.select(*(F.col(c).alias(n) for c, n in zip(item, names)), *made)
    rows = docs.select(*(F.col(quoted(c)) for c in own), *(x.alias(n) for x, n in zip(identity, names)))
    return rows.join(shows, names).select(*(F.col(quoted(c)) for c in own), *made)


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, Scratch(spark))

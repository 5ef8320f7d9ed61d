"""Language identification by word-first backoff.

A word seen in training scores by its log frequency in each language. An unseen word scores by its character
n-grams, longest first: the word is covered from the left by the longest known n-gram at each place, down to
single characters; a character no language knows adds nothing. Scores of words add up; score is the posterior.

The model is fitted on a bounded sample: of each language's labelled rows that are not held out, those whose hash
falls in a share of `per_language` over their number, so that many are expected. Every other count and every prediction covers all rows and
whole texts. Defined results: null text or a text without a letter is `und` with score 0; without training rows
everything is `und`; repeated rows are predicted alike; ties go to the language first in order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_batches

UNKNOWN = "und"
#: Training documents expected of each language, the longest n-gram, and words a worker remembers.
PER_LANGUAGE, LONGEST, REMEMBER = 500, 4, 60_000
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Numerals that are no digits, like fractions and Roman ones, are no letters."""
    return any(any(map(str.isalpha, m[0])) for m in _WORD.finditer(text))


def _hashes(keys: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys], np.uint64)


def held_out(doc_id: Column) -> Column:
    """True for rows whose crc32(doc_id as text) leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
    for lang, c in words.items():
        items = list(c.items())
        for i in range(0, len(items), 20_000):
            part = items[i : i + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "n"])


class Table:
    """Keys, as sorted 64-bit hashes, to rows of one matrix of log frequencies, a column for each language."""

    def __init__(self, counts: dict[str, list[int]], k: int):
        m = np.array(list(counts.values()), np.float64).reshape(len(counts), k)
        keys = _hashes(list(counts))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.log = np.log((m + 0.5) / (m.sum(0) + 0.5 * len(m) + 1)).astype(np.float32)[order]

    def find(self, keys: list[str]) -> np.ndarray:
        """Rows of keys, -1 for those not known."""
        h = _hashes(keys)
        if not len(self.keys) or not len(h):
            return np.full(len(h), -1)
        i = np.minimum(self.keys.searchsorted(h), len(self.keys) - 1)
        return np.where(self.keys[i] == h, i, -1)


class Model:
    """Per-language log frequencies of words and of n-grams by length."""

    def __init__(self, rows: list[tuple[str, str, int]], longest: int = LONGEST):
        self.langs = sorted({r[0] for r in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        k = len(self.langs)
        words: dict[str, list[int]] = {}
        grams: list[dict[str, list[int]]] = [{} for _ in range(longest + 1)]
        for lang, word, n in rows:
            j = at[lang]
            words.setdefault(word, [0] * k)[j] += n
            padded = f" {word} "
            for size in range(1, longest + 1):
                table = grams[size]
                for i in range(len(padded) - size + 1):
                    g = padded[i : i + size]
                    if g != " ":
                        table.setdefault(g, [0] * k)[j] += n
        self.words = Table(words, k)
        self.grams = [Table(t, k) for t in grams]
        self.longest = longest

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; words not seen in training go by n-grams, looked up for all at once."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = self.words.find(words)
        out[at >= 0] = self.words.log[at[at >= 0]]
        rest = np.flatnonzero(at < 0).tolist()
        padded = [f" {words[i]} " for i in rest]
        starts = np.cumsum([0, *map(len, padded)]).tolist()
        known = []
        for size in range(1, self.longest + 1):
            # An n-gram that would pass its word's end is the empty text, which no table knows.
            known.append(self.grams[size].find([p[i : i + size] if i + size <= len(p) else "" for p in padded for i in range(len(p))]).tolist())
        for i, first, end in zip(rest, starts, starts[1:]):
            while first < end:
                for size in range(self.longest, 0, -1):
                    if (g := known[size - 1][first]) >= 0:
                        out[i] += self.grams[size].log[g]
                        first += size
                        break
                else:
                    first += 1
        return out

    def predictor(self, remember: int = REMEMBER):
        """A function from texts to pairs of language and score."""
        memo: dict[str, int] = {}
        rows = np.zeros((0, max(1, len(self.langs))), np.float32)

        def predict(texts: list[str | None]) -> list[tuple[str, float]]:
            nonlocal rows
            words = [_WORD.findall(t.lower()) if self.langs and t and has_letter(t) else None for t in texts]
            fresh = list(dict.fromkeys(w for ws in words if ws for w in ws if w not in memo))
            base = len(memo)
            for i, w in enumerate(fresh):
                memo[w] = base + i
            if fresh:
                rows = np.concatenate([rows, self.vectors(fresh)])
            out = []
            for ws in words:
                if ws is None:
                    out.append((UNKNOWN, 0.0))
                    continue
                total = rows[np.array([memo[w] for w in ws], np.int64)].sum(0, dtype=np.float64)
                best = int(total.argmax())
                out.append((self.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())))
            # Words met first, which hold the frequent ones, stay.
            for w in fresh[max(0, remember - base) :]:
                del memo[w]
            rows = rows[: len(memo)]
            return out

        return predict


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on the sample described above; what reaches the driver is bounded by per_language and the number of languages."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([])
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    rank = F.crc32(F.concat(F.lit("sample"), F.col("doc_id").cast("string")).cast("binary")) / F.lit(float(1 << 32))
    sample = rows.where(rank < share[F.col("lang")]).select("text", "lang")
    counted = sample.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counted.collect()])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred and score."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(*(F.col(quoted(c)) for c in docs.columns if c.lower() not in ("lang_pred", "score")))
    columns, at = docs.columns, [c.lower() for c in docs.columns].index("text")
    docs = docs.toDF(*(f"c{i}" for i in range(len(columns))))  # mapInArrow can't take every name

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predictor()
        for b in batches:
            found = predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*b.schema.names, "lang", "score"])

    schema = ", ".join(f"{c} {kind}" for c, kind in docs.dtypes) + ", lang string, score double"
    return docs.mapInArrow(run, schema).toDF(*columns, "lang_pred", "score")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

"""Quality rules from tokeniser fertility.

A public vocabulary with byte fallback measures each whole text: characters per token, share of byte-fallback
tokens and entropy of the tokens, over eight bits or, of a short text, over the most that its length allows. Each
language, or script where no language is given, has its own bands, fitted on the quartiles of all rows that pass the
base rules on words: a text far outside the quartiles in one measure, or below them in both characters per token and
entropy, is rejected. A class of few rows is judged by fixed bands of its script.

Defined results: null and empty texts have no words and fail the base rule; a text without letters is of script
`other`; repeated rows are judged alike and count as often as they come; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_batches

VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
#: Entropy that counts as full; a text of fewer tokens can reach only the logarithm of their number.
FULL_BITS = 8.0


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, least relative entropy."""

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float


#: Fences lie so many interquartile ranges, of the least width given, beyond the quartiles: outer ones for each measure,
#: and inner ones that reject a text below both. FEW rows or less don't fit a band.
OUTER = {"chars_per_token": 5.0, "byte_share": 8.0, "entropy": 1.5}
INNER = {"chars_per_token": 2.5, "entropy": 1.0}
WIDTH = {"chars_per_token": 0.03, "byte_share": 0.005, "entropy": 0.01}
FEW = 30
#: A vocabulary spends more tokens on scripts it holds few pieces of; the bands follow that.
BANDS = {
    "latin": Band(1.3, 8.0, 0.10, 0.45),
    "cyrillic": Band(1.0, 8.0, 0.20, 0.45),
    "greek": Band(0.7, 8.0, 0.30, 0.40),
    "cjk": Band(0.4, 4.0, 0.75, 0.35),
    "other": Band(0.25, 8.0, 0.98, 0.20),
}
#: First and last code points of letters by script.
RANGES = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "cjk": ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF)),
}


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x32000)), bool, 0x32000)


_LETTERS = _letters()


def script(text: str) -> str:
    """The script of most letters; ties go to the one first in RANGES."""
    if text.isascii():
        return "latin" if any(c.isalpha() for c in text) else "other"
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = {s: sum(int(((cp >= a) & (cp <= b)).sum()) for a, b in spans) for s, spans in RANGES.items()}
    rest = int(_LETTERS[cp[cp < len(_LETTERS)]].sum()) - sum(n.values())
    best = max(n, key=n.get)
    return best if n[best] and n[best] >= rest else "other"


def base(text: str) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated three-word windows."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c")))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeated = len(lines) - len(set(lines))
    return n, chars, symbols, repeated, repeated_words(words)


def repeated_words(words: list[bytes], k: int = 3) -> int:
    """Words that lie in a k-word window found twice or more, its first place included."""
    n = len(words)
    if n <= k:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    key = ids[: n - k + 1]
    for j in range(1, k):  # at each step the keys are numbered anew, so that none overflows
        if j > 1:
            _, key = np.unique(key, return_inverse=True)
        key = key * len(number) + ids[j : n - k + 1 + j]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - k + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(k):
        covered[j : n - k + 1 + j] |= twice
    return int(covered.sum())


class Fertility:
    def __init__(self, file: str = VOCABULARY, directory: str | None = None):
        import os

        import sentencepiece

        if directory is None:
            import public_tokenizers

            path = public_tokenizers.path(file)
        else:
            path = os.path.join(directory, file)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def measure(self, text: str) -> tuple[int, float, float, float]:
        """Tokens, characters per token, byte share and relative entropy."""
        ids = np.array(self.model.encode(text, num_threads=1), np.int64) if text else np.zeros(0, np.int64)
        if not len(ids):
            return 0, 0.0, 0.0, 0.0
        counts = np.unique(ids, return_counts=True)[1] / len(ids)
        entropy = float(-(counts * np.log2(counts)).sum())
        most = min(np.log2(len(ids)), FULL_BITS)
        return len(ids), len(text) / len(ids), float(self.byte[ids].mean()), entropy / most if most > 0 else 1.0


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, byte_share double, entropy double, usual boolean"


def measure(docs: DataFrame, key: str, text: str, lang: str | None = None, bands: dict[str, Band] | None = None, least_words: int = 50, most_repeated: int = 50, file: str = VOCABULARY, directory: str | None = None) -> DataFrame:
    """The key, its language or null, and the measures of each row; usual: within the fixed bands of its script."""
    bands = bands or BANDS
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("key"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = Fertility(file, directory)
        for b in batches:
            rows = []
            for t in b.column(2).to_pylist():
                t = t or ""
                words, chars, symbols, lines, again = base(t)
                failed = words < least_words or 100 * again > most_repeated * words
                kind = script(t)
                n, per, share, entropy = fertility.measure(t)
                x = bands.get(kind) or bands["other"]
                good = x.chars_low <= per <= x.chars_high and share <= x.bytes_high and entropy >= x.entropy_low
                rows.append((words, chars, symbols, lines, again, failed, kind, n, per, share, entropy, good))
            names = [f.split()[0] for f in FIELDS.split(", ")]
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}
            columns = [pa.array([r[i] for r in rows], kinds[f.split()[1]]) for i, f in enumerate(FIELDS.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["key", "lang", *names])

    return docs.mapInArrow(run, f"key {docs.dtypes[0][1]}, lang string, {FIELDS}")


def fences(measured: DataFrame) -> DataFrame:
    """A row for each class, lang or else script, with the fences of each measure; no more rows than languages."""
    quartiles = measured.where(~F.col("base_failed")).groupBy("class").agg(F.count("*").alias("rows"), *(F.percentile_approx(m, [0.25, 0.75], 10_000).alias(m) for m in WIDTH))
    wide = lambda m: F.greatest(F.col(m)[1] - F.col(m)[0], F.lit(WIDTH[m]))
    under = lambda m, k: (F.col(m)[0] - k * wide(m))
    over = lambda m, k: (F.col(m)[1] + k * wide(m))
    return quartiles.where(F.col("rows") > FEW).select(
        "class", under("chars_per_token", OUTER["chars_per_token"]).alias("chars_low"), over("chars_per_token", OUTER["chars_per_token"]).alias("chars_high"),
        over("byte_share", OUTER["byte_share"]).alias("bytes_high"), under("entropy", OUTER["entropy"]).alias("entropy_low"),
        under("chars_per_token", INNER["chars_per_token"]).alias("chars_inner"), under("entropy", INNER["entropy"]).alias("entropy_inner"))


def judge(docs: DataFrame, key: str, text: str, scratch: Scratch, lang: str | None = None, **options) -> DataFrame:
    """The measures and the verdict of each row, with its key."""
    measured = measure(docs, key, text, lang, **options).withColumn("class", F.coalesce("lang", "script"))
    measured = scratch.save(measured, "measured")
    bands = scratch.save(fences(measured), "fences")
    judged = measured.join(F.broadcast(bands), "class", "left")
    inside = (
        F.col("chars_per_token").between(F.col("chars_low"), F.col("chars_high")) & (F.col("byte_share") <= F.col("bytes_high")) & (F.col("entropy") >= F.col("entropy_low"))
        & ((F.col("chars_per_token") >= F.col("chars_inner")) | (F.col("entropy") >= F.col("entropy_inner"))))
    names = [f.split()[0] for f in FIELDS.split(", ")][:-1]
    return judged.select(F.col("key").alias(key), *names, (~F.col("base_failed") & F.coalesce(inside, F.col("usual"))).alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judge(docs, "doc_id", "text", Scratch(spark), "lang")

"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches in a unit; a dynamic programme carries the best
score and its number of pieces to each position. Ties are the tokenizer's: at an end, candidates come by
ascending start and only a strictly better one replaces; a character that no single-character piece covers may
be an unknown, scored ten below the lowest score, and counts one piece for each of its UTF-8 bytes. No piece
holds a space mark but at its head or alone, nor a line feed, so units are counted apart and remembered.

The vocabulary is that of a public model with byte pieces, each piece scored as its file says. Null and empty
texts count 0; repeated rows count alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_batches

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
PENALTY = 10.0


def read_vocabulary(file: str = VOCABULARY, directory: str | None = None) -> list[tuple[str, float]]:
    import os

    import sentencepiece

    if directory is None:
        import public_tokenizers

        path = public_tokenizers.path(file)
    else:
        path = os.path.join(directory, file)
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class _Bounded(dict):
    def __init__(self, count, limit: int):
        super().__init__()
        self.count, self.limit = count, limit

    def __missing__(self, unit: str) -> int:
        n = self.count(unit)
        if len(self) < self.limit:
            self[unit] = n
        return n


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]], remember: int = 400_000):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        pieces = [p for p, _ in vocabulary]
        if any("\n" in p for p in pieces) or any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("units of this vocabulary can't be counted apart")
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        known = set(pieces)
        self.bytes = all(f"<0x{i:02X}>" in known for i in range(256))
        self.feed = 1
        self.marked = _Bounded(lambda w: self.pieces(MARK + w), remember)
        self.bare = _Bounded(self.pieces, remember // 4)

    def pieces(self, unit: str) -> int:
        """Number of pieces of the best segmentation."""
        n = len(unit)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # ends settled so far

        def unknown_only(end: int) -> None:
            best[end] = best[end - 1] + self.unknown
            count[end] = count[end - 1] + (len(unit[end - 1].encode()) if self.bytes else 1)

        found: list[tuple[int, float]] = []

        def settle(end: int) -> None:
            top, pieces, single = None, 0, False
            for size, score in sorted(found, reverse=True):
                s = best[end - size] + score
                single = single or size == 1
                if top is None or s > top:
                    top, pieces = s, count[end - size] + 1
            if not single and (top is None or best[end - 1] + self.unknown > top):
                unknown_only(end)
            else:
                best[end], count[end] = top, pieces

        for last, match in self.auto.iter(unit):
            if last + 1 > done + 1 and found:
                settle(done + 1)
                done += 1
                found.clear()
            while done < last:
                unknown_only(done + 1)
                done += 1
            found.append(match)
        if found:
            settle(done + 1)
            done += 1
        while done < n:
            unknown_only(done + 1)
            done += 1
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        total = 0
        marked, bare = self.marked.__getitem__, self.bare.__getitem__
        for i, line in enumerate(text.replace(MARK, " ").split("\n")):
            words = line.split(" ")
            head = words.pop(0)
            if i == 0:
                total += marked(head) if head or not words else 0
            else:
                total += self.feed + (bare(head) if head else 0)
            total += sum(map(marked, words))
        return total


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", file: str = VOCABULARY, directory: str | None = None) -> DataFrame:
    """All columns of docs with the number of pieces of each whole text."""
    text_batches(docs.sparkSession)
    columns = [c for c in docs.columns if c.lower() != out.lower() or c == text]
    docs = docs.select(*(F.col(quoted(c)) for c in columns)).toDF(*(f"c{i}" for i in range(len(columns))))  # mapInArrow can't take every name
    at = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(read_vocabulary(file, directory))
        for b in batches:
            n = pa.array(map(counter.text, b.column(at).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, "n"])

    return docs.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in docs.dtypes) + ", n long").toDF(*columns, out)


def op2_token_count(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_tokens")

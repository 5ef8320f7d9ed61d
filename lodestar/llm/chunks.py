"""Byte-pair encoding with content-defined chunks that are encoded once, and decoding.

A rolling hash over the last code points cuts texts where its leading bits are zero, so equal passages are cut alike
wherever they stand. Chunks are counted by 128-bit hashes; one seen twice or more, in one document or in many, is
shared. Shared chunks are brought together by hash, each is encoded once, and its ids are joined back to every place.
The other chunks stay with their text and are encoded there: one exchange of what is shared, and none for texts that
share nothing.

Ids of two neighbours needn't be those of their joint text. Around each join the text of the last units of one and the
first of the other is encoded again. The join is repaired when the new ids agree exactly, on both sides, with ids that
the neighbours had; else the window grows, in the end to the whole of both.

What a text shares is first asked of a filter of FILTER bits, built from the shared hashes and sent to all: its size is
fixed. A wrong yes only brings one more chunk to the exchange.

Defined results: null text is the empty text, without ids; equal texts are encoded once; special tokens' names in a text
are tokens, as in the library; ids that the vocabulary lacks decode to nothing and bytes that are no UTF-8 to U+FFFD; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, quoted, text_batches
from .tokens import _LETTERS, Encoder

FILE = "byte_bpe_50k.json"
#: Leading bits that are zero at a cut (a chunk of 2^10 code points on average), and the bounds of a chunk's length.
BITS, LEAST, MOST = 10, 256, 8192
#: Bits of the filter of shared chunks: 8 MB.
FILTER = 1 << 26
#: Ids on either side of a join that are looked at first.
AROUND = 12
#: Texts and chunks one task remembers having sent.
REMEMBER = 200_000
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 1 << 12, np.uint32)


def rolling(code: np.ndarray) -> np.ndarray:
    """For each place the hash of the 32 code points that end there."""
    h = _GEAR[code & 0xFFF] + code.astype(np.uint32) * np.uint32(0x9E3779B1)
    for k in (1, 2, 4, 8, 16):
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # the right side is worked out before it is written
    return h


def cuts(texts: list[str], special: re.Pattern | None = None) -> list[list[int]]:
    """Ends of each text's chunks. Special tokens stand alone: the library finds them before any cut."""
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) for t in texts])
    found = np.flatnonzero(rolling(code) >> np.uint32(32 - BITS) == 0) + 1 if len(code) else np.zeros(0, np.int64)
    out = []
    for t, end in zip(texts, ends.tolist()):
        start = end - len(t)
        here = (found[np.searchsorted(found, start) : np.searchsorted(found, end, side="right")] - start).tolist()
        own: list[int] = []
        last = 0
        bounds = [x for m in special.finditer(t) for x in m.span()] if special else []
        for stop in [*bounds, len(t)]:
            for c in here:
                if c <= last:
                    continue
                if c >= stop:
                    break
                while c - last > MOST:
                    last += MOST
                    own.append(last)
                if c - last >= LEAST:
                    own.append(c)
                    last = c
            while stop - last > MOST:
                last += MOST
                own.append(last)
            if stop > last:
                own.append(stop)
                last = stop
        out.append(own)
    return out


class Decoder:
    """Bytes of ids by table look-up."""

    def __init__(self, encoder: Encoder):
        back = {ord(c): b for b, c in _LETTERS.items()}
        added = {i: t.content for i, t in encoder.tokenizer.get_added_tokens_decoder().items()}
        self.added = frozenset(added)
        self.table: list[bytes] = [b""] * encoder.vocabulary
        for token, i in encoder.tokenizer.get_vocab(with_added_tokens=False).items():
            self.table[i] = bytes(back[ord(c)] for c in token)
        for i, token in added.items():
            self.table[i] = token.encode()
        self.size = np.array([len(x) for x in self.table], np.int64)

    def raw(self, ids: np.ndarray) -> bytes:
        table = self.table
        return b"".join([table[i] for i in ids.tolist() if i < len(table)])

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")


#: A character other than white space before a space or line feed: tokens never cross such a place.
_SYNC = re.compile(r"\S(?=[ \n])")


class Joiner:
    """Ids of texts from the ids of their chunks."""

    def __init__(self, file: str = FILE, directory: str | None = None):
        self.encoder = Encoder(file, directory)
        self.decoder = Decoder(self.encoder)
        self.size, self.added = self.decoder.size, self.decoder.added

    def _syncs(self, raw: bytes) -> list[int]:
        """Byte offsets of those places in raw, which may begin or end inside a character."""
        text = raw.decode("utf-8", "surrogateescape")
        if text.isascii():
            return [m.end() for m in _SYNC.finditer(text)]
        return [len(text[: m.end()].encode("utf-8", "surrogateescape")) for m in _SYNC.finditer(text) if not "\ud800" <= m[0] <= "\udfff"]

    def _at(self, ids: np.ndarray, offset: int) -> int | None:
        """Number of ids whose bytes are the first `offset`, if an id ends there."""
        ends = np.cumsum(self.size[ids])
        i = int(np.searchsorted(ends, offset))
        return i + 1 if i < len(ids) and ends[i] == offset else None

    def _window(self, left: np.ndarray, right: np.ndarray, around: int, first: bool, last: bool) -> tuple | None:
        """Bytes to encode again, ids kept of the left, ids skipped of the right, and the ids that have to come out at either end.

        The window takes two units of each side, or what there is at the text's own ends, which need no agreement.
        """
        a, b = left[max(0, len(left) - around) :], right[:around]
        ra, rb = self.decoder.raw(a), self.decoder.raw(b)
        sa, sb = self._syncs(ra), self._syncs(rb)
        if len(sa) >= 2:
            start, i, j = sa[-2], self._at(a, sa[-2]), self._at(a, sa[-1])
        elif first and len(a) == len(left):
            start, i, j = 0, 0, 0
        else:
            return None
        if len(sb) >= 2:
            stop, k, m = sb[1], self._at(b, sb[0]), self._at(b, sb[1])
        elif last and len(b) == len(right):
            stop, k, m = len(rb), len(b), len(b)
        else:
            return None
        if i is None or j is None or k is None or m is None:
            return None
        return ra[start:] + rb[:stop], len(left) - len(a) + i, m, a[i:j], b[k:m]

    def _encoded(self, windows: list[tuple]) -> list[np.ndarray | None]:
        """Ids of the windows; None where they don't agree with both sides."""
        got = self.encoder.encode([w[0].decode() for w in windows])
        fits = lambda ids, head, tail: len(ids) >= len(head) + len(tail) and np.array_equal(ids[: len(head)], head) and np.array_equal(ids[len(ids) - len(tail) :], tail)
        return [ids if fits(ids, w[3], w[4]) else None for ids, w in zip(got, windows)]

    def join(self, texts: list[list[np.ndarray]]) -> list[np.ndarray]:
        """For each text the ids of its chunks one after the other, as the whole text has them."""
        open_ = [(t, i) for t, parts in enumerate(texts) for i in range(len(parts) - 1) if not self._apart(parts[i], parts[i + 1])]
        repaired: dict[tuple[int, int], tuple[int, int, np.ndarray]] = {}
        around = AROUND
        while open_ and around <= MOST:
            windows = []
            for t, i in open_:
                parts = texts[t]
                first = i == 0 or self._apart(parts[i - 1], parts[i])
                last = i + 2 == len(parts) or self._apart(parts[i + 1], parts[i + 2])
                if w := self._window(parts[i], parts[i + 1], around, first, last):
                    windows.append(((t, i), w))
            for (at, w), ids in zip(windows, self._encoded([w for _, w in windows])):
                if ids is not None:
                    repaired[at] = (w[1], w[2], ids)
            open_ = [at for at in open_ if at not in repaired]
            around *= 8
        return [self._spliced(t, parts, repaired) for t, parts in enumerate(texts)]

    def _apart(self, left: np.ndarray, right: np.ndarray) -> bool:
        """Whether a special token stands at the join: nothing is joined across it."""
        return int(left[-1]) in self.added or int(right[0]) in self.added

    def _spliced(self, t: int, parts: list[np.ndarray], repaired: dict) -> np.ndarray:
        """One text's ids; encoded as a whole, between special tokens, where joins found no agreement or met each other."""
        out, start = [], 0
        for i, part in enumerate(parts):
            stop = len(part)
            own: np.ndarray | None = None
            if i + 1 < len(parts) and not self._apart(part, parts[i + 1]):
                if (t, i) not in repaired or repaired[t, i][0] < start:
                    break
                stop, after, own = repaired[t, i]
            else:
                after = 0
            out.append(part[start:stop])
            if own is not None:
                out.append(own)
            start = after
        else:
            return np.concatenate(out).astype(np.uint32) if out else np.zeros(0, np.uint32)
        return self.encoder.encode([b"".join(map(self.decoder.raw, parts)).decode()])[0]


def _two(digest: int) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    high, low = digest >> 64, digest & ((1 << 64) - 1)
    return high - (1 << 64) * (high >> 63), low - (1 << 64) * (low >> 63)


def _hash(chunk: str) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    return _two(xxh3_128_intdigest(chunk.encode()))


def _chunked(texts: list[str], special: re.Pattern | None) -> Iterator[list[str]]:
    for t, ends in zip(texts, cuts(texts, special)):
        yield [t[a:b] for a, b in zip([0, *ends], ends)]


def _slot(h1: np.ndarray) -> np.ndarray:
    return h1.astype(np.int64).view(np.uint64) >> np.uint64(64 - FILTER.bit_length() + 1)


def shared_chunks(texts: DataFrame, file: str, directory: str | None) -> DataFrame:
    """(h1, h2) of the chunks that stand in two places or more of texts(text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = Encoder(file, directory, remember=1).special
        for b in batches:
            found = [_hash(c) for parts in _chunked([t or "" for t in b.column(0).to_pylist()], special) for c in parts]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["h1", "h2"])

    return texts.mapInArrow(run, "h1 long, h2 long").groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")


def filter_of(shared: DataFrame) -> np.ndarray:
    """A bit for each leading part of a shared chunk's hash: FILTER bits, whatever the table's size."""
    word = F.shiftrightunsigned("h1", 64 - FILTER.bit_length() + 1)
    words = shared.groupBy(F.shiftright(word, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h1, {64 - FILTER.bit_length() + 1}) & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER // 64, np.int64)
    got = words.toArrow()  # FILTER / 64 rows at most
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(np.uint64)


_PART = "key1 long, key2 long, seq long, h1 long, h2 long, first boolean, body binary, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
_WHOLE = _PART[_PART.index("n_tokens") :]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(zip(*rows), fields)], names=[f for f, _ in fields])


class _Worker:
    """What a task needs to turn chunks into results."""

    def __init__(self, file: str, directory: str | None, digest: bool):
        import zstandard

        self.joiner = Joiner(file, directory)
        self.kind = "<u2" if self.joiner.encoder.vocabulary <= 1 << 16 else "<u4"
        self.names = [str(i) for i in range(self.joiner.encoder.vocabulary)] if digest else None
        self.pack, self.unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return self.pack(ids.astype(self.kind).tobytes())

    def ids_of(self, data: bytes) -> np.ndarray:
        return np.frombuffer(self.unpack(data), self.kind).astype(np.uint32)

    def encoded(self, chunks: list[list[str | np.ndarray]]) -> list[tuple]:
        """n_tokens, ids_sha256, decoded_sha256 and ids of texts from chunks that are text still or ids."""
        fresh = iter(self.joiner.encoder.encode([c for parts in chunks for c in parts if isinstance(c, str)]))
        whole = self.joiner.join([[next(fresh) if isinstance(c, str) else c for c in parts] for parts in chunks])
        if self.names is None:
            return [(len(x), None, None, x.astype("<u4").tobytes()) for x in whole]
        out = []
        for ids in whole:
            listed = ",".join([self.names[i] for i in ids.tolist()])
            out.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.joiner.decoder.decode(ids).encode()).hexdigest(), None))
        return out


def encode(docs: DataFrame, scratch: Scratch, text: str = "text", file: str = FILE, directory: str | None = None, digest: bool = True) -> DataFrame:
    """key1, key2 (of `keys`), n_tokens, ids_sha256 and decoded_sha256 of each distinct text that isn't empty.

    Without digest the hashes are null and ids holds the ids as little-endian unsigned 32-bit integers.
    """
    spark = docs.sparkSession
    text_batches(spark)
    full = docs.where(F.length(text) > 0).select(*keys(F.col(text)), F.col(text).alias("text"))
    shared = scratch.save(shared_chunks(full.select("text"), file, directory), "shared")
    sent = spark.sparkContext.broadcast(filter_of(shared))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of texts that may share one; results at once of those that don't."""
        worker = _Worker(file, directory, digest)
        special, bits = worker.joiner.encoder.special, sent.value
        texts_sent: set[tuple[int, int]] = set()
        chunks_sent: set[tuple[int, int]] = set()
        for b in batches:
            rows: list[tuple] = []
            own: list[tuple] = []
            for key, parts in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), _chunked(b.column(2).to_pylist(), special)):
                if key in texts_sent:
                    continue  # a copy of a text that this task has sent
                hashes = [_hash(c) for c in parts]
                slot = _slot(np.array([h for h, _ in hashes], np.int64))
                maybe = ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
                if not maybe.any():
                    own.append((key, parts))
                    continue
                if len(texts_sent) < REMEMBER:
                    texts_sent.add(key)
                for seq, (chunk, h, m) in enumerate(zip(parts, hashes, maybe.tolist())):
                    first = m and h not in chunks_sent
                    if first and len(chunks_sent) < REMEMBER:
                        chunks_sent.add(h)
                    rows.append((*key, seq, *(h if m else (None, None)), first, worker.pack(chunk.encode()) if first or not m else None, None, None, None, None))
            rows += [(*key, None, None, None, False, None, *found) for (key, _), found in zip(own, worker.encoded([parts for _, parts in own]))]
            if rows:
                yield _table(rows, _PART)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One encoding of each chunk, from sorted rows."""
        worker = _Worker(file, directory, False)
        before = None
        for b in batches:
            fresh = {}
            for h1, h2, body in zip(*(c.to_pylist() for c in b.columns)):
                if (h1, h2) != before:
                    fresh[h1, h2] = worker.unpack(body).decode()
                before = (h1, h2)
            if fresh:
                yield _table([(*h, worker.bytes_of(ids)) for h, ids in zip(fresh, worker.joiner.encoder.encode(fresh.values()))], "h1 long, h2 long, ids binary")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Results of texts from their sorted chunks; a chunk sent by several tasks counts once."""
        worker = _Worker(file, directory, digest)
        ready: list[tuple] = []
        held, at, parts = 0, None, []

        def flush() -> list[tuple]:
            out = [(*key, *found) for (key, _), found in zip(ready, worker.encoded([p for _, p in ready]))]
            ready.clear()
            return out

        for b in batches:
            for k1, k2, seq, body, ids in zip(*(c.to_pylist() for c in b.columns)):
                if at != (k1, k2):
                    if parts:
                        ready.append((at, parts))
                    at, parts = (k1, k2), []
                    if held >= 2000:
                        yield _table(flush(), f"key1 long, key2 long, {_WHOLE}")
                        held = 0
                if seq == len(parts):
                    parts.append(worker.ids_of(ids) if body is None else worker.unpack(body).decode())
                    held += 1
        if parts:
            ready.append((at, parts))
        if ready:
            yield _table(flush(), f"key1 long, key2 long, {_WHOLE}")

    parts = scratch.save(full.mapInArrow(split, _PART), "parts")
    known = ["h1", "h2"]
    chunks = parts.where("first").select(*known, "body").repartition(*(F.col(c) for c in known)).sortWithinPartitions(*known)
    ids = scratch.save(chunks.mapInArrow(once, "h1 long, h2 long, ids binary"), "ids")
    # Both sides are read anew, so that adaptive execution may split the places of one very common chunk.
    placed = parts.where("h1 is not null").select("key1", "key2", "seq", *known).join(ids, known).select("key1", "key2", "seq", F.lit(None).cast("binary").alias("body"), "ids")
    alone = parts.where("seq is not null and h1 is null").select("key1", "key2", "seq", "body", "ids")
    ordered = placed.unionByName(alone).repartition("key1", "key2").sortWithinPartitions("key1", "key2", "seq")
    whole = ordered.mapInArrow(assemble, f"key1 long, key2 long, {_WHOLE}")
    columns = ["key1", "key2", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    return whole.select(*columns).unionByName(parts.where("seq is null").select(*columns))


def keys(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(F.lit(s), text).alias(f"key{s}") for s in (1, 2)]


def decode(ids: DataFrame, column: str = "ids", out: str = "text", file: str = FILE, directory: str | None = None) -> DataFrame:
    """ids with the text of a column of lists of ids; null is null."""
    others = [c for c in ids.columns if c.lower() != out.lower() or c == column]
    ids = ids.select(*(F.col(quoted(c)) for c in others))
    at = others.index(column)
    plain = ids.toDF(*(f"c{i}" for i in range(len(others))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Encoder(file, directory, remember=1))
        for b in batches:
            made = [None if x is None else decoder.decode(np.array([i for i in x if i is not None and i >= 0], np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, "made"])

    return plain.mapInArrow(run, ", ".join(f"{c} {kind}" for c, kind in plain.dtypes) + ", made string").toDF(*others, out)


def op11_bpe_chunks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    places = scratch.save(docs.select("doc_id", F.coalesce(F.length("text") > 0, F.lit(False)).alias("full"), *keys(F.col("text"))), "places")
    found = scratch.save(encode(docs, scratch).select("key1", "key2", "n_tokens", "ids_sha256", "decoded_sha256"), "found")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    empty = places.where("not full").select("doc_id", F.lit(0).cast("long").alias("n_tokens"), none.alias("ids_sha256"), none.alias("decoded_sha256"))
    return places.where("full").join(found, ["key1", "key2"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(empty)

"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank in the whole corpus, so that frequent ones take one byte. Lengths stand apart in
control bytes: one bit for each id where the vocabulary fits two bytes, else two bits. A table with an entry for
each control byte gives all lengths at once, so numpy decodes a block without a loop over ids.

Files. `ranks.bin`: ids by rank, little-endian 32-bit. Segment: b"LDVB", version and bits (a byte each), two zero
bytes; then blocks of: documents, ids, control bytes, data bytes (32-bit each), document ids (64-bit), ids of
each document (32-bit), control bytes, data bytes. Segments hold documents in ascending order and a manifest
orders them. A segment is written under a name of its own and moved, so a task that runs again is harmless.

Defined results: null text is the empty text, a document of the end id alone; repeated rows follow each other;
rows without a document id come first; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_batches, unsigned_crc
from .tokens import Encoder

END, MAGIC = 2, b"LDVB"
#: Characters of text in one shard, and ids at which a segment of a shard ends.
SHARD_CHARS = 24 << 20
BLOCK_IDS, SEGMENT_IDS = 1 << 20, 64 << 20
#: Ranges of document ids that texts are dealt to at most; beyond it shards grow and hold several segments.
SHARDS = 16_384


class Codec:
    """Variable-length codes of ranks, `bits` of control for each."""

    def __init__(self, bits: int):
        self.bits, self.per = bits, 8 // bits
        codes = (np.arange(256)[:, None] >> (np.arange(self.per) * bits)) & ((1 << bits) - 1)
        self.lengths = (codes + 1).astype(np.uint8)

    def encode(self, ranks: np.ndarray) -> tuple[bytes, bytes]:
        ranks = ranks.astype(np.uint32)
        extra = (ranks > 0xFF).astype(np.uint8)
        if self.bits == 2:
            extra += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
        padded = np.zeros(-(-len(ranks) // self.per) * self.per, np.uint8)
        padded[: len(ranks)] = extra
        control = np.zeros(len(padded) // self.per, np.uint8)
        for j in range(self.per):
            control |= padded[j :: self.per] << (j * self.bits)
        size = extra.astype(np.int64) + 1
        at = np.cumsum(size) - size
        data = np.zeros(int(size.sum()), np.uint8)
        data[at] = ranks & 0xFF
        for j in range(1, 1 << self.bits if self.bits == 2 else 2):
            more = extra >= j
            data[at[more] + j] = (ranks[more] >> (8 * j)) & 0xFF
        return control.tobytes(), data.tobytes()

    def decode(self, control: bytes, data: bytes, n: int) -> np.ndarray:
        size = self.lengths[np.frombuffer(control, np.uint8)].ravel()[:n]
        at = np.cumsum(size, dtype=np.int64) - size
        raw = np.frombuffer(data, np.uint8)
        out = raw[at].astype(np.uint32)
        for j in range(1, 4 if self.bits == 2 else 2):
            more = size > j
            out[more] |= raw[at[more] + j].astype(np.uint32) << np.uint32(8 * j)
        return out


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def _write_block(out, codec: Codec, rank: np.ndarray, docs: list[int], ids: list[np.ndarray]) -> int:
    lengths = np.array([len(x) for x in ids], "<u4")
    flat = np.concatenate(ids)
    control, data = codec.encode(rank[flat])
    out.write(struct.pack("<4I", len(docs), len(flat), len(control), len(data)))
    for part in (np.array(docs, "<i8").tobytes(), lengths.tobytes(), control, data):
        out.write(part)
    return len(flat)


def _bisect(bounds: list[int], x: Column) -> Column:
    """Number of the ascending bounds below x, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.lit(np.array(bounds, np.int64))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda lo, b: F.when(F.try_element_at(table, lo + b) < x, lo + b).otherwise(lo))


def write_tokens(docs: DataFrame, out: str, scratch: Scratch, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", directory: str | None = None, shard_chars: int = SHARD_CHARS, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode the texts into files under out; the manifest: shard, seq, path, n_docs, n_ids, base (ids before)."""
    spark = docs.sparkSession
    text_batches(spark)
    null = -(1 << 63)  # stands for a missing document id
    doc_id = F.coalesce(F.col(key).cast("long"), F.lit(null)).alias("doc_id")
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    shards = int(min(SHARDS, max(1, -(-chars // shard_chars))))
    # Bounds come from a scan of the ids alone; a range exchange would sample whole texts.
    bounds = docs.select(doc_id).agg(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)] or [0.5], max(10_000, 20 * shards))).first()[0] or []
    bounds = bounds if shards > 1 else []

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(tokenizer, directory)
        narrow = encoder.vocabulary <= 1 << 16
        shard, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = [np.append(x, np.uint32(END)).astype("<u2" if narrow else "<u4") for x in encoder.encode(b.column(1).to_pylist())]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard)), pa.array(np.arange(seq, seq + n)), b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=["shard", "seq", "doc_id", "n", "ids"])
            seq += n

    ordered = docs.select(doc_id, F.col(text).alias("text")).repartitionById(shards, _bisect(bounds, F.col("doc_id"))).sortWithinPartitions("doc_id", F.xxhash64("text"))
    draft = scratch.save(ordered.mapInArrow(encode, "shard long, seq long, doc_id long, n long, ids binary"), "draft", "zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = np.bincount(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    # One row for each id of the vocabulary at most reaches the driver.
    freq = draft.select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = np.array([r[0] for r in sorted(freq, key=lambda r: (-r[1], r[0]))], np.int64)
    top = int(order.max()) + 1 if len(order) else 1
    rank = np.zeros(top, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    fs, root = _fs(out)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/ranks.bin") as f:
        f.write(order.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast(rank)
    bits = 1 if len(order) <= 1 << 16 else 2

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out)
        codec, rank = Codec(bits), shared.value
        open_: dict = {}
        done: list[tuple] = []

        def flush() -> None:
            if open_ and open_["docs"]:
                open_["n_ids"] += _write_block(open_["file"], codec, rank, open_["docs"], open_["ids"])
                open_["n_docs"] += len(open_["docs"])
                open_.update(docs=[], ids=[], held=0)

        def close() -> None:
            if open_:
                flush()
                open_["file"].close()
                fs.move(open_["draft"], open_["path"])
                done.append((open_["shard"], open_["seq"], open_["path"].removeprefix(root + "/"), open_["n_docs"], open_["n_ids"]))
                open_.clear()

        for b in batches:
            for shard, seq, doc, n, raw in zip(*(c.to_pylist() for c in b.columns)):
                if not open_ or open_["shard"] != shard or open_["next"] != seq or open_["n_ids"] + open_["held"] >= segment_ids:
                    close()
                    path = f"{root}/segment-{shard:08d}-{seq:012d}.ldvb"
                    draft_ = f"{root}/.{uuid.uuid4().hex}"
                    file = fs.open_output_stream(draft_)
                    file.write(MAGIC + bytes([1, bits, 0, 0]))
                    open_.update(shard=shard, seq=seq, path=path, draft=draft_, file=file, docs=[], ids=[], held=0, n_docs=0, n_ids=0)
                open_["docs"].append(doc)
                open_["ids"].append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
                open_["held"] += n
                open_["next"] = seq + 1
                if open_["held"] >= BLOCK_IDS:
                    flush()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string() if i == 2 else pa.int64()) for i in range(5)], names=["shard", "seq", "path", "n_docs", "n_ids"])

    wrote = scratch.save(draft.mapInArrow(write, "shard long, seq long, path string, n_docs long, n_ids long"), "segments")
    scratch.drop("draft")
    # Ids before a shard, from a row for each of the SHARDS at most; then those before a segment within its shard.
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = wrote.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", before(Window.orderBy("shard")).alias("first"))
    manifest = wrote.join(first, "shard").withColumn("base", F.col("first") + before(Window.partitionBy("shard").orderBy("seq"))).drop("first")
    manifest.write.mode("overwrite").parquet(f"{out}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{out}/manifest")


def blocks(file, ranks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, ids of each, all ids) of each block of an open segment."""
    head = file.read(8)
    if head[:4] != MAGIC:
        raise ValueError("not a token segment")
    codec = Codec(head[5])
    while len(head := file.read(16)) == 16:
        docs, n, n_control, n_data = struct.unpack("<4I", head)
        ids = np.frombuffer(file.read(8 * docs), "<i8")
        lengths = np.frombuffer(file.read(4 * docs), "<u4").astype(np.int64)
        yield ids, lengths, ranks[codec.decode(file.read(n_control), file.read(n_data), n)]


def read_tokens(spark, out: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids, or with digest their crc32, of every document in the files."""
    manifest = spark.read.parquet(f"{out}/manifest")
    many = manifest.count()
    null = -(1 << 63)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(out)
        with fs.open_input_stream(f"{root}/ranks.bin") as f:
            ranks = np.frombuffer(f.read(), "<u4")
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(f"{root}/{path}") as f:
                    for docs, lengths, ids in blocks(f, ranks):
                        ends = np.cumsum(lengths)
                        each = [ids[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist())]
                        last = pa.array([unsigned_crc(x) for x in each], pa.int64()) if digest else pa.array([x.tolist() for x in each], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array(docs, mask=docs == null), pa.array(base + ends - lengths), pa.array(lengths), last], names=["doc_id", "start", "n_tokens", "last"])
                        base += int(ends[-1]) if len(ends) else 0

    kind = "long" if digest else "array<long>"
    dealt = manifest.select("path", "base").repartition(max(1, min(many, 4096)))
    return dealt.mapInArrow(read, f"doc_id long, start long, n_tokens long, last {kind}").withColumnRenamed("last", "ids_crc32" if digest else "ids")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    out = scratch.path("tokens")
    write_tokens(docs, out, scratch)
    return read_tokens(spark, out, digest=True)

"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles. Tokens (shingles) are in one global order, rarest first, and
fall into two classes by document frequency. Two sets that reach the threshold lack few of each other's tokens,
so a short prefix of each must share something: one rare token, or frequent ones. Rare prefix tokens are indexed
alone. Where frequent tokens stand in the prefix, it is extended by m more, so that two linked sets share m + 1
of them; the tokens are dealt to m groups by hash, two shared ones fall in one group, and the pairs within each
group are indexed, which far fewer documents share than single tokens. m is 1 for short documents and grows with
the length, which keeps the pairs of a set in proportion to its prefix.

A document with more tokens of its own than the threshold lets differ has no partner. Most leave by half of their
tokens: leading bits of these go to buckets of the token space, which return the documents of those met once; where
two tokens share the bits, a document stays. Equal sets are one class from then on, and one document of each class
is read again, by a filter of fixed size. Their frequencies come from an exchange of packed token arrays: a bucket
counts its tokens and returns only those that another document has too; what has too many of its own leaves here.
A token found twice or more in one batch of documents is sent as a count, so a bucket gets a very common token once
a batch and not once a document. Candidates are verified in full: first each index entry's smallest member with the others, then, among
what these links have not joined, all remaining pairs; entries with many members are compared block by block as
matrix products. Such entries share most of their members, so those that share any are one family, whose members meet
once and not in every entry, wherever that is less work.

Defined results: a text without words, or null, has the empty set and links with nothing; fewer words than a
shingle make one shingle of all; repeated rows are copies of one another; a row without a doc_id links with
nothing and has no component_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import _slot, filter_of
from .common import Scratch, connected_components, partitions, text_batches

WORDS, PERCENT = 3, 90
#: Tokens in more documents than this are frequent; members of an entry compared as pairs.
FREQUENT, PAIRS = 64, 128
#: Prefix tokens up to which all pairs are indexed, and words a worker remembers.
WHOLE, REMEMBER = 32, 100_000
BUCKET_CHARS, BLOCK = 8 << 20, 512
#: Documents and tokens that travel as one chunk: what stands for a chunk in each bucket grows with neither alone.
ROWS, TOKENS = 8192, 1 << 20
#: Stands for a missing document id while arrays of ids travel.
NULL = -(1 << 63)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Word to 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word, 11)
        if len(self) < REMEMBER:
            self[word] = h
        return h


def shingles(text: str | None, hashes: _Hashes, k: int = WORDS) -> np.ndarray:
    """Distinct k-word shingles of a text as ascending 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    m = min(k, len(w))
    h = np.zeros(len(w) - m + 1, np.uint64)
    for j in range(m):
        h += w[j : len(w) - m + 1 + j] * np.uint64(_ODD[j % 5]) + np.uint64(j * m)
        if j % 5 == 4:
            h = mix(h)
    return np.unique(mix(h + np.uint64(m)))


def allowance(n: np.ndarray | int, percent: int = PERCENT):
    """Tokens of a set of n that a partner may lack."""
    return n - -(-(n * percent) // 100)


def _prints(tokens: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that tell sets apart."""
    return tuple(int(np.bitwise_xor.reduce(mix(tokens + np.uint64(s))) ^ mix(tokens * np.uint64(s)).sum(dtype=np.uint64)) - (1 << 63) for s in (_ODD[1], _ODD[3]))


def _chunks(batches: Iterator[pa.RecordBatch], k: int, bits: np.ndarray | None = None) -> Iterator[tuple]:
    """(ids, n, fingerprints, characters, tokens, place of each token's document) of many documents at a time; with bits, of those that the filter holds."""
    hashes, ids, sets, chars, held = _Hashes(), [], [], [], 0
    done = lambda: (np.array(ids, np.int64), np.array([len(s) for s in sets], np.int64), np.array([_prints(s) if len(s) else (0, 0) for s in sets], np.int64).reshape(-1, 2), np.array(chars, np.int64), np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets]))
    for b in batches:
        if bits is not None and b.num_rows:
            slot = _slot(mix(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            b = b.filter(pa.array((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1))
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            sets.append(shingles(t, hashes, k))
            chars.append(len(t or ""))
            held += len(sets[-1])
            if len(ids) >= ROWS or held >= TOKENS:
                yield done()
                ids, sets, chars, held = [], [], [], 0
    if ids:
        yield done()


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL)).alias("doc_id"), F.col(text).alias("text"))


def _edges(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among ascending tokens, and where the last ends."""
    return np.searchsorted(((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))


def suspects(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint), chars, slot (of the filter) and may: false only if the document has no partner, not even a copy."""
    spark = docs.sparkSession
    text_batches(spark)
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    buckets = int(max(partitions(spark), -(-chars // (4 * BUCKET_CHARS))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for ids, n, prints, chars, tokens, doc in _chunks(batches, k):
            half = tokens & np.uint64(1) == 0
            tokens, doc = tokens[half], doc[half]
            order = np.argsort(tokens, kind="stable")
            tokens, doc = tokens[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
            once = np.diff(np.append(first, len(tokens))) == 1
            one, who, many = tokens[first[once]], doc[first[once]], tokens[first[~once]]
            a, z = _edges(one, buckets), _edges(many, buckets)
            at = [i for i in range(buckets) if a[i + 1] > a[i] or z[i + 1] > z[i] or i == chunk % buckets]
            head = pickle.dumps((ids, n, prints, chars))
            # Ascending, so the upper bits of a bucket's tokens are nearly one value.
            high, low = lambda x: (x >> np.uint64(48)).astype(np.uint16).tobytes(), lambda x: (x >> np.uint64(16)).astype(np.uint32).tobytes()
            parts = [[f(x[e[i] : e[i + 1]]) for i in at] for x, e in ((one, a), (many, z)) for f in (high, low)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([chunk] * len(at), pa.int64()), pa.array([head if i == chunk % buckets else None for i in at], pa.binary()),
                 pa.array([who[a[i] : a[i + 1]].tobytes() for i in at], pa.binary()), *(pa.array(x, pa.binary()) for x in parts)],
                names=["bucket", "chunk", "head", "doc", "high", "low", "high2", "low2"])
            chunk += 1

    def count(g: pd.DataFrame) -> pd.DataFrame:
        whole = lambda h, x: (np.frombuffer(h, np.uint16).astype(np.uint64) << np.uint64(32)) | np.frombuffer(x, np.uint32)
        ones = [whole(h, x) for h, x in zip(g["high"], g["low"])]
        every = np.concatenate([*ones, *(whole(h, x) for h, x in zip(g["high2"], g["low2"]))])
        order = np.argsort(every, kind="stable")
        same = every[order][1:] == every[order][:-1]
        own = np.zeros(len(every), bool)
        own[order] = ~(np.append(same, False) | np.insert(same, 0, False)) if len(every) else True
        edge = np.cumsum([0, *map(len, ones)])
        return pd.DataFrame({"chunk": g["chunk"], "head": g["head"], "doc": [np.frombuffer(d, np.uint16)[own[s:e]].tobytes() for d, s, e in zip(g["doc"], edge[:-1], edge[1:])]})

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        ids, n, prints, chars = pickle.loads(next(h for h in g["head"] if h is not None))
        own = np.zeros(len(ids), np.int64)
        for x in g["doc"]:
            own += np.bincount(np.frombuffer(x, np.uint16), minlength=len(ids))
        slot = mix(ids.view(np.uint64)).view(np.int64)
        return pd.DataFrame({"doc_id": ids, "n": n, "f1": prints[:, 0], "f2": prints[:, 1], "chars": chars, "slot": slot, "may": (n > 0) & (own <= allowance(n, percent))})

    dealt = _named(docs, key, text).mapInArrow(deal, "bucket int, chunk long, head binary, doc binary, high binary, low binary, high2 binary, low2 binary")
    counted = dealt.groupBy("bucket").applyInPandas(count, "chunk long, head binary, doc binary")
    return counted.groupBy("chunk").applyInPandas(gather, "doc_id long, n long, f1 long, f2 long, chars long, slot long, may boolean")


def profile(docs: DataFrame, key: str, text: str, k: int, percent: int, chars: int, bits: np.ndarray) -> DataFrame:
    """Of the documents that the filter holds, with chars characters or a few more: doc_id, n, f1, f2 (fingerprint),
    own (tokens of no other of them), and for those that may have a partner the tokens others have, in global order,
    with their document frequencies."""
    spark = docs.sparkSession
    text_batches(spark)
    buckets = int(max(partitions(spark), -(-chars // BUCKET_CHARS)))
    sent = spark.sparkContext.broadcast(bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        for ids, n, prints, _, tokens, doc in _chunks(batches, k, sent.value):
            order = np.argsort(tokens, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(tokens[order]) != 0])) if len(tokens) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(tokens)))
            again = np.zeros(len(tokens), bool)
            again[order] = np.repeat(times > 1, times)
            # Which documents hold a token of several travels with the head; buckets get the token and its count.
            head = pickle.dumps((ids, n, prints, doc[again], tokens[again]))
            some = times > 1
            common, counts = tokens[order][first[some]], np.minimum(times[some], 65535).astype(np.uint16)
            tokens, doc = np.concatenate([tokens[~again], common]), np.concatenate([doc[~again], np.zeros(len(common), doc.dtype)])
            counts = np.concatenate([np.ones(len(tokens) - len(common), np.uint16), counts])
            bucket = (((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tokens, doc, counts, bucket = tokens[order], doc[order], counts[order], bucket[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            at = [i for i in range(buckets) if edge[i + 1] > edge[i] or i == chunk % buckets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int32()), pa.array([chunk] * len(at), pa.int64()), pa.array([head if i == chunk % buckets else None for i in at], pa.binary()),
                 pa.array([doc[edge[i] : edge[i + 1]].tobytes() for i in at], pa.binary()),
                 pa.array([tokens[edge[i] : edge[i + 1]].tobytes() for i in at], pa.binary()), pa.array([counts[edge[i] : edge[i + 1]].tobytes() for i in at], pa.binary())],
                names=["bucket", "chunk", "head", "doc", "tokens", "times"])
            chunk += 1

    def count(g: pd.DataFrame) -> pd.DataFrame:
        every = [np.frombuffer(x, np.uint64) for x in g["tokens"]]
        tokens, times = np.concatenate(every), np.concatenate([np.frombuffer(x, np.uint16) for x in g["times"]])
        order = np.argsort(tokens, kind="stable")
        sorted_ = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        df = np.zeros(len(tokens), np.uint16)
        if len(tokens):
            df[order] = np.repeat(np.minimum(np.add.reduceat(times[order].astype(np.int64), first), 65535), np.diff(np.append(first, len(tokens))))
        out, a = [], 0
        for chunk, head, doc, t in zip(g["chunk"], g["head"], g["doc"], every):
            d, k = df[a : a + len(t)], times[a : a + len(t)]
            a += len(t)
            where, one, shared = np.frombuffer(doc, np.uint16), k == 1, d > 1
            mine, many = shared & one, ~one
            out.append((chunk, head, where[~shared].tobytes(), where[mine].tobytes(), t[mine].tobytes(), d[mine].tobytes(), t[many].tobytes(), d[many].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "head", "own", "doc", "tokens", "df", "common", "common_df"])

    def gather(g: pd.DataFrame) -> pd.DataFrame:
        ids, n, prints, doc_c, tokens_c = pickle.loads(next(h for h in g["head"] if h is not None))
        m, f1, f2 = len(ids), prints[:, 0], prints[:, 1]
        own = np.zeros(m, np.int64)
        for x in g["own"]:
            own += np.bincount(np.frombuffer(x, np.uint16), minlength=m)
        doc, tokens, df, common, common_df = (np.concatenate([np.frombuffer(x, t) for x in g[c]]) for c, t in (("doc", np.uint16), ("tokens", np.uint64), ("df", np.uint16), ("common", np.uint64), ("common_df", np.uint16)))
        order = np.argsort(common)
        common, common_df = common[order], common_df[order]
        doc, tokens, df = np.concatenate([doc, doc_c]), np.concatenate([tokens, tokens_c]), np.concatenate([df, common_df[np.searchsorted(common, tokens_c)]])
        may = (n > 0) & (own <= allowance(n, percent))
        keep = may[doc]
        doc, tokens, df = doc[keep], tokens[keep], df[keep]
        order = np.lexsort((tokens, df, doc))
        doc, tokens, df = doc[order], tokens[order], df[order]
        edge = np.searchsorted(doc, np.arange(m + 1))
        cut = lambda x: [x[edge[i] : edge[i + 1]].tobytes() if may[i] else None for i in range(m)]
        return pd.DataFrame({"doc_id": ids, "n": n, "f1": f1, "f2": f2, "own": own, "tokens": cut(tokens), "df": cut(df)})

    dealt = _named(docs, key, text).mapInArrow(deal, "bucket int, chunk long, head binary, doc binary, tokens binary, times binary")
    counted = dealt.groupBy("bucket").applyInPandas(count, "chunk long, head binary, own binary, doc binary, tokens binary, df binary, common binary, common_df binary")
    return counted.groupBy("chunk").applyInPandas(gather, "doc_id long, n long, f1 long, f2 long, own long, tokens binary, df binary")


def groups(n: int, percent: int = PERCENT) -> int:
    """Groups that the tokens of a set of n are dealt to, a power of two."""
    return 1 << max(0, (int(allowance(n, percent)) // WHOLE).bit_length())


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, own: int, percent: int = PERCENT) -> np.ndarray:
    """Index entries of a set whose tokens are in global order after its `own` unmatched ones."""
    need = int(allowance(n, percent)) + 1
    rare = int(np.searchsorted(df, FREQUENT, side="right"))
    singles = tokens[: min(rare, max(0, need - own))]
    parts = [mix(singles ^ np.uint64(_ODD[0]))]
    if own + rare < need:
        # A linked pair goes by the groups of its larger set, which has n tokens at least and this many at most.
        m, last = groups(n, percent), groups(n * 100 // percent, percent)
        while m <= last:
            t = tokens[rare : need - own + m]
            group = (mix(t ^ np.uint64(_ODD[3])) % np.uint64(m)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            edge = np.searchsorted(group[order], np.arange(m + 1))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a > 1:
                    i, j = np.triu_indices(b - a, 1)
                    own_ = t[order[a:b]]
                    parts.append(mix(own_[i] * np.uint64(_ODD[1]) + mix(own_[j] ^ np.uint64(_ODD[2])) + np.uint64(m)))
            m *= 2
    return np.unique(np.concatenate(parts))


def _index(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rep, n, own, tokens, df = (c.to_pylist() for c in b.columns)
        for s in range(0, len(rep), 200):
            every = [signatures(np.frombuffer(t, np.uint64), np.frombuffer(d, np.uint16), k, o, percent) for t, d, k, o in zip(tokens[s : s + 200], df[s : s + 200], n[s : s + 200], own[s : s + 200])]
            sizes = [len(x) for x in every]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(every).view(np.int64)), pa.array(np.repeat(np.array(rep[s : s + 200], np.int64), sizes)), pa.array(np.repeat(np.array(n[s : s + 200], np.int64), sizes))], names=["sig", "rep", "n"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose sets reach the threshold."""
    one = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ia, ib, na, ta, nb, tb = (b.column(c).to_pylist() for c in ("a", "b", "na", "ta", "nb", "tb"))
            good = []
            for i in range(len(ia)):
                both = np.concatenate([np.frombuffer(ta[i], np.uint64), np.frombuffer(tb[i], np.uint64)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                if 100 * same >= percent * (na[i] + nb[i] - same):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([ia[i] for i in good], pa.int64()), pa.array([ib[i] for i in good], pa.int64())], names=["a", "b"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "ta", "nb", "tb").mapInArrow(run, "a long, b long")


def _families(many: DataFrame, scratch: Scratch) -> DataFrame:
    """family, sig, rep, n, part, chunks: the groups whose members all meet, of entries many(sig, a, rep, n, members, part).

    Entries that share members, directly or by others, are one family. Its members meet once (sig is 0), if these are no
    more pairs than those of its entries one by one; else each entry stays a group of its own.
    """
    family = connected_components(many.select("a", F.col("rep").alias("b")).distinct(), scratch, "family")
    named = scratch.save(many.join(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep"), "named")
    members = named.groupBy("family", "rep").agg(F.max("n").alias("n"), F.max("part").alias("part"), F.sum("members").alias("work"))
    members = scratch.save(members, "relatives")
    # Blocks hold so many members and tokens at most, a longest document apart.
    chunks = F.greatest(F.ceil(F.count("*") / F.lit(float(BLOCK))), F.ceil(F.sum("n") / F.lit(float(TOKENS)))).cast("int").alias("chunks")
    sizes = members.groupBy("family").agg(chunks, F.count("*").alias("size"), F.sum("work").alias("work"))
    sizes = scratch.save(sizes.select("family", "chunks", (F.col("size") * F.col("size") <= F.col("work")).alias("once")), "families")
    once, each = sizes.where("once").select("family", "chunks"), sizes.where("not once").select("family")
    apart = named.join(each, "family").select("family", "sig", "rep", "n", "part")
    apart = apart.join(apart.groupBy("sig").agg(chunks), "sig")
    columns = ("family", "sig", "rep", "n", "part", "chunks")
    groups_ = members.join(once, "family").withColumn("sig", F.lit(0).cast("long")).select(*columns).unionByName(apart.select(*columns))
    groups_ = scratch.save(groups_, "groups")
    scratch.drop("named", "relatives", "families")
    return groups_


def _block_links(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in groups of many members: entries(family, sig, rep, n, part, chunks)."""
    own = entries.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own = own.select("family", "sig", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), "mine", "rep", "n", "part").join(sets.select("rep", "tokens"), "rep")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        every = [np.frombuffer(t, np.uint64) for t in g["tokens"]]
        universe, at, times = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(every)), [len(t) for t in every])
        # A token of one member alone is common to no two.
        row, at = row[times[at] > 1], (np.cumsum(times > 1) - 1)[at[times[at] > 1]]
        universe = universe[times > 1]
        same = np.zeros((len(every), len(every)), np.float32)
        for s in range(0, len(universe), 8192):
            m = (at >= s) & (at < s + 8192)
            table = np.zeros((len(every), min(8192, len(universe) - s)), np.float32)
            table[row[m], at[m] - s] = 1
            same += table @ table.T
        n, part, mine, rep = (g[c].to_numpy() for c in ("n", "part", "mine", "rep"))
        near = (100 * same.astype(np.int64) >= percent * (n[:, None] + n[None, :] - same.astype(np.int64))) & (part[:, None] != part[None, :])
        if i != j:
            near &= mine[:, None] != mine[None, :]
        x, y = np.nonzero(np.triu(near, 1))
        edge = {}
        for a, b in zip(x.tolist(), y.tolist()):
            edge.setdefault((min(part[a], part[b]), max(part[a], part[b])), (int(rep[a]), int(rep[b])))  # one link joins two components
        return pd.DataFrame(list(edge.values()), columns=["a", "b"]).astype("int64")

    return own.groupBy("family", "sig", "i", "j").applyInPandas(compare, "a long, b long")


def join(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest doc_id reachable by links."""
    rows = scratch.save(suspects(docs, key, text, k, percent), "rows")
    alike = rows.where("may").where(F.col("doc_id") != NULL).groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "slot", "chars")).alias("_one")).select("n", "f1", "f2", F.col("_one.doc_id").alias("rep"), F.col("_one.slot").alias("h1"), F.col("_one.chars").alias("chars"))
    alike = scratch.save(alike, "alike")
    chars = alike.agg(F.sum("chars")).first()[0] or 0
    near = scratch.save(profile(docs, key, text, k, percent, chars, filter_of(alike)), "profile")
    fit = near.where((F.col("doc_id") != NULL) & F.col("tokens").isNotNull())
    sets = fit.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("own").alias("own"), F.first("tokens").alias("tokens"), F.first("df").alias("df"))
    sets = scratch.save(sets, "sets")
    scratch.drop("profile")
    index = sets.where("n > 1").select("rep", "n", "own", "tokens", "df").mapInArrow(lambda it: _index(it, percent), "sig long, rep long, n long")
    index = scratch.save(index, "index")
    heads = scratch.save(index.groupBy("sig").agg(F.min("rep").alias("a"), F.count("*").alias("members")).where("members > 1"), "heads")
    # Lengths further apart than the threshold can't link.
    apart = lambda x, y: (100 * F.least(x, y) < percent * F.greatest(x, y))
    shared = scratch.save(index.join(heads, "sig"), "shared")
    scratch.drop("index", "heads")
    stars = scratch.save(shared.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "stars")
    links = scratch.save(_verify(stars, sets, percent), "links")
    part = scratch.save(connected_components(links, scratch, "first"), "parts")
    grouped = shared.join(part.withColumnRenamed("node", "rep"), "rep", "left").select("sig", "a", "rep", "n", "members", F.coalesce("component", "rep").alias("part"))
    grouped = scratch.save(grouped, "grouped")
    scratch.drop("shared", "parts")
    mixed = grouped.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("sig")
    open_ = scratch.save(grouped.join(scratch.save(mixed, "mixed"), "sig"), "open")
    scratch.drop("grouped", "mixed")
    few = open_.where(F.col("members") <= PAIRS).select("sig", "rep", "n", "part")
    pairs = (
        few.alias("x").join(few.alias("y"), "sig").where("x.rep < y.rep and x.part <> y.part").where(~apart(F.col("x.n"), F.col("y.n")))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    )
    more = _verify(scratch.save(pairs, "pairs"), sets, percent)
    many = open_.where(F.col("members") > PAIRS)
    if not many.isEmpty():
        more = more.unionByName(_block_links(_families(many, scratch), sets, percent))
    links = scratch.save(links.unionByName(more), "all_links")
    part = connected_components(links, scratch, "last")
    facts = alike.select("n", "f1", "f2", "rep").join(part.withColumnRenamed("node", "rep"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component_id"))
    facts = scratch.save(facts, "facts")
    scratch.drop("sets", "open", "pairs", "stars")
    found = rows.select("doc_id", "n", "f1", "f2").join(facts, ["n", "f1", "f2"], "left")
    real = F.col("doc_id") != NULL
    return found.select(F.when(real, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(real, F.coalesce("component_id", "doc_id")).alias("component_id"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs, Scratch(spark))

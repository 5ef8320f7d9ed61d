"""Fuzzy line dedup by MinHash, DataFrame functions only.

A line's signature holds the least hash of all its character shingles under each of a square of permutations. Rows,
columns and diagonals of the square are its bands. In every band, the smallest line meets the others, then each line
those of a block, then all pairs of the band that these links have not joined, block by block. Each candidate
pair is verified by the exact Jaccard similarity of all its character shingles, and of every component the line that
comes first, by document id and place, stays.

Defined results: blank lines always stay and are no part of the result; null and empty texts have no lines; a line
shorter than a shingle is one shingle; lines equal byte by byte are one line, so of equal lines the first stays;
a row repeated with its document id and text is judged like the first, and other texts of that id by themselves; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, free, quoted

SHINGLE, SIMILAR = 8, 0.8
#: Bands take SIDE minima each from a square of SIDE * SIDE permutations, in CLASSES directions: a pair at 0.8 shares
#: one of the 12 with a chance of 0.97 or more, short lines and long ones (simulated, and measured in the tests). AGREE of the 16 minima must be equal before texts are fetched.
SIDE, CLASSES, AGREE = 4, 3, 8
#: Places of a line worked out side by side.
STRIDE = 8
#: Lines of a block, alone and where all blocks of a band meet.
NEAR, BLOCK = 16, 1024
#: Draws (not 0) of blocks that meet alone before all blocks of a band meet.
SEEDS = (7,)
#: Longs of the two bitmaps of a line's shingles: the short one is compared first, the long one where that allows a pair.
BITMAP, WIDE = 24, 64


def exploded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text_id (a hash of the whole text), line_no (from 0) and line of each line that is not blank."""
    lines = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def shingle_set(line: Column, size: int = SHINGLE) -> Column:
    """Hashes of all shingles of a line, each once. Four bytes a character, so that a shingle is cut out by its place."""
    last = lambda b: F.greatest(F.octet_length(b) - 4 * size, F.lit(0)) + 1
    hashed = lambda b: F.transform(F.sequence(F.lit(1), last(b), F.lit(4)), lambda p: F.xxhash64(F.substring(b, p, F.lit(4 * size))))
    # Bound by a lambda, the line is encoded once and not for each of its shingles.
    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(line, "UTF-32")), hashed)))


def minima(lines: DataFrame, keys: list[str], size: int = SHINGLE) -> DataFrame:
    """keys, n (shingles with repeats, by UTF-16 units) and m0.. (the least 32 bits under each permutation over all shingles).

    A row stands for STRIDE places of a line, whose hashes are worked out side by side in generated code.
    Places past the end repeat the last one, which changes no minimum.
    """
    coded = lines.select(*keys, F.encode("line", "UTF-16BE").alias("_b"))
    coded = coded.select(*keys, "_b", F.greatest((F.octet_length("_b") / 2).cast("int") - size + 1, F.lit(1)).alias("_n"))
    places = coded.select(*keys, "_b", "_n", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(STRIDE))).alias("_i"))
    at = lambda j: F.shiftleft(F.least(F.col("_i") + j, F.col("_n") - 1), 1) + 1
    hashed = places.select(*keys, "_n", *(F.xxhash64(F.substring("_b", at(j), F.lit(2 * size))).alias(f"_h{j}") for j in range(STRIDE)))
    # The hash and the hash turned by half: a window of 32 bits of either, further on for each permutation, ranks shingles.
    turned = hashed.select(*keys, "_n", *(c for j in range(STRIDE) for c in (F.col(f"_h{j}"), F.shiftleft(f"_h{j}", 32).bitwiseOR(F.shiftrightunsigned(f"_h{j}", 32)).alias(f"_t{j}"))))
    half = SIDE * SIDE // 2
    window = lambda p, j: F.shiftleft(f"_h{j}" if p < half else f"_t{j}", 32 // half * (p % half))
    found = turned.groupBy(*keys).agg(F.max("_n").alias("n"), *(F.min(F.least(*(window(p, j) for j in range(STRIDE)))).alias(f"_m{p}") for p in range(SIDE * SIDE)))
    return found.select(*keys, "n", *(F.shiftright(f"_m{p}", 32).cast("int").alias(f"m{p}") for p in range(SIDE * SIDE)))


def bitmaps(texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """id, n (shingles, each once) and two bitmaps of their hashes, b0.. and wide (a list of longs), for texts(id, line).

    Where two bitmaps differ, a shingle is in one line and not in the other, so the bits that differ bound the
    common shingles from above. The short bitmap is the wide one folded, so both are functions of a hash.
    """
    sets = texts.repartition("id").select("id", F.inline(F.array(F.struct(shingle_set(F.col("line"), size).alias("_s")))))
    hashed = sets.select("id", F.size("_s").alias("n"), F.explode("_s").alias("_h"))
    # A long of the wide bitmap is one sum of its bits; only these longs, a few for many shingles, are laid side by side.
    bit = F.expr("shiftleft(1L, cast(_h & 63 as int))")
    longs = hashed.groupBy("id", "n", F.pmod(F.shiftright("_h", 8), F.lit(WIDE)).cast("int").alias("_w")).agg(F.bit_or(bit).alias("_1"))
    found = longs.groupBy("id").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_w") == i, F.col("_1"))).alias(f"w{i}") for i in range(WIDE)))
    wide = found.select("id", "n", *(F.coalesce(f"w{i}", F.lit(0).cast("long")).alias(f"w{i}") for i in range(WIDE)))
    short = lambda j: reduce(Column.bitwiseOR, (F.col(f"w{i}") for i in range(j, WIDE, BITMAP)))
    return wide.select("id", "n", *(short(j).alias(f"b{j}") for j in range(BITMAP)), F.array(*(f"w{i}" for i in range(WIDE))).alias("wide"))


def _side(marks: DataFrame, name: str) -> DataFrame:
    """marks with every column but keys named after one line of a pair."""
    return marks.select(*(F.col(c).alias(name if c == "id" else f"{name}_{c}" if c in ("n", "part", "wide") or c[1:].isdigit() else c) for c in marks.columns))


def _possible(similar: float) -> Column:
    """Whether bitmaps allow lines a and b the similarity: at Jaccard s, of n + m shingles (1 - s) / (1 + s) are in one line alone."""
    most = F.lit((1 - similar) / (1 + similar)) * (F.col("a_n") + F.col("b_n")) + 1e-9
    differ = sum((F.bit_count(F.col(f"a_b{i}").bitwiseXOR(F.col(f"b_b{i}"))) for i in range(BITMAP)), F.lit(0))
    wide = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (differ <= most) & (wide <= most)


def grid() -> list[list[int]]:
    """Permutations of each band: rows, columns and diagonals of a square of them, so two bands share one at most."""
    s = range(SIDE)
    slopes = [[(i * SIDE + (j + t * i) % SIDE) for i in s] for t in range(CLASSES - 1) for j in s]
    return [[i * SIDE + j for j in s] for i in s] + slopes


def bands(sketch: DataFrame, *keep: str) -> DataFrame:
    """keep and band, a row for each band of a line's minima."""
    made = F.array(*(F.xxhash64(F.lit(i), *(f"m{p}" for p in ps)) for i, ps in enumerate(grid())))
    return sketch.select(*keep, F.explode(made).alias("band"))


def _similar(pairs: DataFrame, texts: DataFrame, size: int, similar: float, scratch: Scratch, tag: str) -> DataFrame:
    """Pairs(a, b) whose lines reach the similarity. The set of a line is worked out once, for all of its pairs."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = scratch.save(texts.join(used, "id").select("id", shingle_set(F.col("line"), size).alias("s")), f"sets{tag}")
    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    # Behind inline, the intersection is worked out once: the filter can't be pushed below it.
    common = joined.select("a", "b", F.inline(F.array(F.struct((F.size("sa") + F.size("sb")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("i")))))
    links = scratch.save(common.where(F.col("i") >= F.lit(similar) * (F.col("n") - F.col("i")) - 1e-9).select("a", "b"), f"links{tag}")
    scratch.drop(f"sets{tag}")
    return links


def _open(shared: DataFrame, part: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Rows(band, id, members, part) of the bands whose lines are not yet of one part."""
    named = shared.join(part.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "members", F.coalesce("component", "id").alias("part"))
    named = scratch.save(named, f"named{tag}")
    mixed = named.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("band")
    out = scratch.save(named.join(scratch.save(mixed, f"mixed{tag}"), "band"), f"open{tag}")
    scratch.drop(f"named{tag}", f"mixed{tag}")
    return out


def _rest(rows: DataFrame, marks: DataFrame, similar: float, seed: int = 0) -> DataFrame:
    """Pairs(a, b), a < b, between rows(band, id, members, part) that share a band but no part, unless bitmaps rule them out.

    With a seed, lines meet those of their own small block alone, drawn by the seed; without, all of the band: every
    two blocks of it meet under a key of their own, so a hot band is spread over many tasks. Bitmaps are compared in
    the join's condition, and a pair they rule out becomes no row.
    """
    chunks = F.ceil(F.col("members") / F.lit(float(NEAR if seed else BLOCK))).cast("int")
    dealt = rows.join(marks, "id").withColumn("_all", chunks).withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("_all")).cast("int")).drop("members")
    later = F.array("_at") if seed else F.sequence(F.col("_at"), F.col("_all") - 1)
    sooner = F.array("_at") if seed else F.sequence(F.lit(0), F.col("_at"))
    one = _side(dealt.withColumn("i", F.col("_at")).withColumn("j", F.explode(later)).drop("_at", "_all"), "a")
    two = _side(dealt.withColumn("j", F.col("_at")).withColumn("i", F.explode(sooner)).drop("_at", "_all"), "b")
    met = one.join(two.withColumnsRenamed({"band": "_band", "i": "_i", "j": "_j"}), (F.col("band") == F.col("_band")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j"))
                   & (F.col("a_part") != F.col("b_part")) & ((F.col("i") < F.col("j")) | (F.col("a") < F.col("b"))) & _possible(similar))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likely(pairs: DataFrame, sketch: DataFrame, similar: float) -> DataFrame:
    """Pairs(a, b) whose numbers of shingles and minima don't rule the similarity out.

    Lines alike agree in AGREE minima but for one pair in thousands; only the exact check links.
    """
    every = [f"m{p}" for p in range(SIDE * SIDE)]
    one = sketch.select(F.col("id").alias("a"), F.array(*every).alias("ma"))
    two = sketch.select(F.col("id").alias("b"), F.array(*every).alias("mb"))
    joined = pairs.join(one, "a").join(two, "b")
    same = sum(((F.col("ma")[p] == F.col("mb")[p]).cast("int") for p in range(SIDE * SIDE)), F.lit(0))
    return joined.where(same >= AGREE).select("a", "b")


def dedup(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """doc_id, text_id, line_no, keep_doc, keep_line (the line of its component that stays) and kept, for each line not blank."""
    docs = docs.select(F.col(key), F.col(text))
    hashed = exploded(docs, key, text).withColumn("id", F.xxhash64("line"))
    sketch = scratch.save(minima(hashed.select("id", "line"), ["id"], size), "sketch")
    rows = bands(sketch, "id")
    heads = scratch.save(rows.groupBy("band").agg(F.min("id").alias("a"), F.count("*").alias("members")).where("members > 1"), "heads")
    # A hint spares the many rows of lines a sort; the side that is hashed has each key once and is a small part of them.
    shared = scratch.save(rows.join(heads.hint("shuffle_hash"), "band").select("band", "id", "a", "members"), "shared")
    scratch.drop("heads")
    stars = scratch.save(_likely(shared.where("id <> a").select("a", F.col("id").alias("b")).distinct(), sketch, similar), "stars")
    # Where each line stands first; rows without a document id come last.
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_id", "line_no")
    counted = hashed.select("id", F.xxhash64(F.lit(5), "line").alias("check"), place.alias("place")).groupBy("id").agg(F.min("place").alias("first"), F.min("check").alias("check"), F.count("*").alias("times"))
    lines = scratch.save(counted.join(shared.select("id").distinct().withColumn("shares", F.lit(True)).hint("shuffle_hash"), "id", "left").where("times > 1 or shares"), "lines")
    # The text of every line that shares a band comes from its first copy: no line is common there.
    wanted = lines.where("shares").select("id", F.col("first.doc_id").alias("first_doc"), F.col("first.text_id").alias("first_text"), F.col("first.line_no").alias("first_line"))
    here = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("text_id") == F.col("first_text")) & (F.col("line_no") == F.col("first_line"))
    texts = hashed.withColumnRenamed("id", "of").join(wanted.hint("shuffle_hash"), here & (F.col("of") == F.col("id"))).select("id", "line")
    texts = scratch.save(texts.dropDuplicates(["id"]), "texts")
    marks = scratch.save(bitmaps(texts, size), "marks")
    starred = stars.join(_side(marks, "a"), "a").join(_side(marks, "b"), "b").where(_possible(similar)).select("a", "b")
    links = _similar(scratch.save(starred, "starred"), texts, size, similar, scratch, "")
    scratch.drop("sketch", "stars", "starred")
    # Where many lines of a band are alike but for the smallest, meeting a few others joins most of them, in work that
    # is linear; then all pairs that are still of different parts meet. A band of one small block has had all its pairs
    # compared by then, and what a comparison has ruled out stays so.
    for seed in (*SEEDS, 0):
        part = scratch.save(connected_components(links, scratch, f"cc{seed}"), f"part{seed}")
        unmet = shared if seed or not SEEDS else shared.where(F.col("members") > NEAR)
        open_ = _open(unmet, part, scratch, str(seed))
        maybe = scratch.save(_rest(open_, marks, similar, seed), f"maybe{seed}")
        links = links.unionByName(_similar(maybe, texts, size, similar, scratch, str(seed)))
        scratch.drop(f"open{seed}", f"maybe{seed}")
    scratch.drop("shared", "texts", "marks")
    found = links
    part = scratch.save(connected_components(found, scratch, "last"), "part")
    member = part.select(F.col("node").alias("id"), "component").join(lines.select("id", "first", "check"), "id")
    member = scratch.save(member, "member")
    firsts = member.groupBy("component").agg(F.min("first").alias("keep"))
    fuzzy = member.join(firsts, "component").select("id", "check", "keep")
    alone = lines.where("times > 1").select("id", "check", F.col("first").alias("keep")).join(member, "id", "left_anti")
    keepers = scratch.save(fuzzy.unionByName(alone), "keepers")
    # Both sides are read anew, so adaptive execution may split the copies of one very common line.
    places = exploded(docs, key, text).select("doc_id", "text_id", "line_no", F.xxhash64("line").alias("id"), F.xxhash64(F.lit(5), "line").alias("check"))
    judged = places.join(keepers.withColumnRenamed("check", "right").hint("shuffle_hash"), "id", "left")
    right = F.col("keep").isNotNull() & (F.col("check") == F.col("right"))  # a line that only shares a hash stays
    return judged.select(
        "doc_id", "text_id", "line_no",
        F.when(right, F.col("keep.doc_id")).otherwise(F.col("doc_id")).alias("keep_doc"),
        F.when(right, F.col("keep.line_no")).otherwise(F.col("line_no")).alias("keep_line"),
        (~right | (F.col("keep.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keep.text_id") == F.col("text_id")) & (F.col("keep.line_no") == F.col("line_no")))).alias("kept"),
    )


def rewrite(docs: DataFrame, judged: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines that go. A document that had words and loses every line goes with them.

    Lines go by document id and text, so other texts of the same id keep theirs. Rows without a key and null texts stay
    as they are; an empty table stays empty; n_chars, if there, follows the text.
    """
    gone_, text_, of = free(docs, "gone"), free(docs, "text"), free(docs, "of")
    gone = judged.where("not kept").groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("line_no")).alias(gone_))
    gone = scratch.save(gone.withColumnsRenamed({"doc_id": key, "text_id": of}), "gone")
    joined = docs.withColumn(of, F.xxhash64(F.col(text))).join(gone, [key, of], "left")
    none = F.col(gone_).isNull()
    # The runs of lines between those that go, each copied once.
    every = F.split(F.col(text), "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(gone_, lambda i: i + 1))
    stops = F.concat(F.col(gone_), F.array(F.size(every)))
    rest = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(every, a + 1, b - a)))
    out = joined.withColumn(text_, F.when(none, F.col(text)).otherwise(F.array_join(rest, "\n")))
    out = out.where(none | F.col(text_).rlike(r"[^\x20\x09-\x0D]"))
    counted = lambda c: F.when(none, F.col(c)).otherwise(F.length(text_)).cast(dict(docs.dtypes)[c]).alias(c)
    return out.select(*(F.col(text_).alias(c) if c == text else counted(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, Scratch(spark))

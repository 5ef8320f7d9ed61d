"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import embedding, langid, linededup, mixing, ngramjoin, packing, quality, queries, secrets, tokencount, tokenfiles
from lodestar.llm.common import Scratch, connected_components, prefix_sums
from lodestar.llm.tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("al", "be", "co", "du", "er", "fi", "go", "hu") for b in ("ma", "ne", "ri", "so", "tu", "va", "xe", "zo")]


def prose(seed, n, per_line=12):
    r = random.Random(seed)
    w = [r.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(w[i : i + per_line]) for i in range(0, n, per_line))


def corpus():
    """Copies, near copies, shared lines, secrets, other scripts, and every awkward text."""
    texts = [prose(i, 60 + i) for i in range(40)]
    texts += [texts[0]] * 6 + [texts[1] + " tail", texts[1] + " tail end", texts[2].replace("alma", "ALMA", 1)]
    texts += [None, "", " \n\t", "x", "a b", "A B", "日本語のテキスト 🎉", "naïve café 12,5 % ü½²", "password=\"hunter22\" and token: short", "k AKIA" + "ABCD1234EFGH5678" + " deadbeef" * 4, "0" * 30 + "f" * 10]
    texts += [prose(99, 9000), "z" * 20000, "same line here and there\n" * 5 + prose(7, 40), "<s> <0x41> ▁x\n\n y", "a <|endoftext|> b <|startoftext|>c <|ENDOFTEXT|>"]
    return [(i, t, (None, "en", "fr")[i % 3], ("a", "a", "a", "b", None)[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5)


def query_on(name, spark, folder, rows=None):
    return queries.QUERIES[name](spark, folder("documents", corpus() if rows is None else rows, DOCS))


TEXT_QUERIES = sorted(q for q in queries.QUERIES if q != "op5_embedding_dedup")


@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_empty_table(name, spark, folder):
    assert query_on(name, spark, folder, []).count() == 0


@pytest.mark.parametrize("name", [q for q in TEXT_QUERIES if q not in ("op6_line_dedup", "op8_packing", "op4_mixing")])
def test_a_row_for_each_document(name, spark, folder):
    got = [r["doc_id"] for r in query_on(name, spark, folder).collect()]
    assert sorted(got) == [r[0] for r in corpus()]


def test_components_of_chains_stars_and_loops(spark):
    r = random.Random(3)
    edges = [(i + 1, i) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    up = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            i, j = find(a), find(b)
            up[max(i, j)] = min(i, j)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()
    assert {x["node"]: x["component"] for x in got} == {x: find(x) for x in up}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_prefix_sums_of_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), F.xxhash64("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = prefix_sums(df, "g", "o", "v", "before", Scratch(spark), "t", leaf=50).collect()
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: r["o"]):
        assert r["before"] == sums[r["g"]]
        sums[r["g"]] += r["v"]


# Secrets


def plain_secrets(text):
    out = []
    names = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    for rank, (kind, p, g, n) in enumerate((("assign", rf"{names}[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        out += [(m.start(), rank, kind, m.end()) for m in re.finditer(p, text) if len(m[g]) >= n]
    return sorted(out)


SECRET_TEXTS = ["🎉 secret = 'abcdef' token=token:abcdefgh API_KEY:\"a.b-c/d+e=\"", "AKIAAKIA" + "A1" * 8 + " x " + "ab12" * 6, None, "", "passwd:short", "secret: a\nsecret: abcdefg", "Kenſecret=ſabcdef ſecret=abcdefg", "f" * 23 + " " + "f" * 24]


def test_secret_spans(spark, folder):
    rows = [(i, t, None, None, None) for i, t in enumerate(SECRET_TEXTS + [SECRET_TEXTS[0]] * 3)]
    for r in query_on("op1_secret_scan", spark, folder, rows).collect():
        want = plain_secrets(rows[r["doc_id"]][1] or "")
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(w[1] == i for w in want) for i in range(3)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest()
        assert set(f"{k}:{a}:{b}" for a, _, k, b in want) <= set(r["spans"].split(",")) | {""}


def test_ledger_scans_only_unseen_pairs_and_reaches_all_paths(spark, tmp_path):
    at = str(tmp_path / "ledger")
    one = spark.createDataFrame([("p/a", "secret=abcdefg"), ("p/b", "secret=abcdefg"), ("p/c", "clean")], "path string, content string")
    first = secrets.scan(one, "path", "content", Scratch(spark), rules=secrets.BASE, ledger_path=at)
    assert {r["path"]: len(r["findings"]) for r in first.collect()} == {"p/a": 1, "p/b": 1, "p/c": 0}
    book = spark.read.parquet(at)
    assert book.count() == 2
    extra = secrets.Rule("clean", "clean", version=2)
    two = one.union(spark.createDataFrame([("q/d", "secret=abcdefg"), ("q/e", "new token=abcdefg")], one.schema))
    again = secrets.scan(two, "path", "content", Scratch(spark), ledger=book, rules=(*secrets.BASE, extra), ledger_path=at)
    assert {r["path"]: [x["kind"] for x in r["findings"]] for r in again.collect()} == {"p/a": ["assign"], "p/b": ["assign"], "p/c": ["clean"], "q/d": ["assign"], "q/e": ["assign"]}
    due = sorted(tuple(r["rules"]) for r in spark.read.parquet(at).collect())
    assert due == sorted([("assign@1", "access@1", "hex@1")] * 2 + [("clean@2",)] * 2 + [("assign@1", "access@1", "hex@1", "clean@2")])
    assert secrets.scan(two, "path", "content", Scratch(spark), ledger=spark.read.parquet(at), rules=(*secrets.BASE, extra), ledger_path=at).count() == 5
    assert spark.read.parquet(at).count() == 5


def test_a_new_rule_version_replaces_the_findings_of_the_old(spark):
    one = spark.createDataFrame([("p", "secret=abcdefg kk12"), ("q", "kk12")], "path string, content string")
    scratch, old, new = Scratch(spark), secrets.Rule("kk", r"kk\d+"), secrets.Rule("kk", r"kk[a-z]+", version=2)
    book = scratch.save(secrets.unseen(one, "content", (*secrets.BASE, old)), "book")
    assert sorted(x["kind"] for r in secrets.scan(one, "path", "content", Scratch(spark), ledger=book, rules=(*secrets.BASE, old)).collect() for x in r["findings"]) == ["assign", "kk", "kk"]
    due = secrets.unseen(one, "content", (*secrets.BASE, new), book)
    assert [r["rules"] for r in due.collect()] == [["kk@2"]] * 2
    twice = book.union(book)  # an append that was repeated
    assert sorted(x["kind"] for r in secrets.scan(one, "path", "content", Scratch(spark), ledger=twice, rules=(*secrets.BASE, new)).collect() for x in r["findings"]) == ["assign"]
    assert {r["path"]: len(r["findings"]) for r in secrets.scan(one, "path", "content", Scratch(spark), ledger=book, rules=(old,)).collect()} == {"p": 1, "q": 1}


CLASH = "_gone _text _id _id2 _source _n _all _b _n _i _h0 _m0 m0 band part rep sig key lang2 class text2 blob path rules id chunk line line_no component bucket head weight epoch block place score lang_pred n_tokens kept usual same v a b doc".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_extra_columns_with_clashing_names(name, spark, tmp_path):
    rows = [(i, prose(i % 7, 70) if i % 5 else None, "en", "s", 3) for i in range(24)]
    if name == "op5_embedding_dedup":
        df = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(20)], "vec_id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast("array<float>"))
    else:
        df = spark.createDataFrame(rows, DOCS)
    extra = df.select("*", *(F.lit(str(i)).alias(c) for i, c in enumerate(dict.fromkeys(CLASH))))
    table = "embeddings" if name == "op5_embedding_dedup" else "documents"
    got = []
    for folder, x in (("plain", df), ("clash", extra)):
        x.write.parquet(str(tmp_path / folder / f"{table}.parquet"))
        got.append(queries.QUERIES[name](spark, str(tmp_path / folder)))
    assert got[0].columns == got[1].columns
    if name not in ("op8_packing",):
        assert sorted(map(str, got[0].collect())) == sorted(map(str, got[1].collect()))
    else:
        assert got[0].count() == got[1].count()


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    df = spark.createDataFrame([(i, prose(i % 9, 70) + f"\nown line {i} here", "en", "s", 3) for i in range(40)], DOCS)
    names = [c for c in dict.fromkeys(CLASH) if c not in ("weight", "epoch", "block", "place", "n_tokens")]
    docs = df.select("*", *(F.lit(c).alias(c) for c in names), F.lit("dot").alias("a.b"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns and after.count(), name
        assert {x["_id"] for x in after.select("_id").collect()} == {"_id"}
        docs = after


# Token counts, fertility, files and packing


def unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(tokencount.read_vocabulary(), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_tokenizer(spark, folder):
    t = unigram()
    want = {r[0]: len(t.encode(r[1], add_special_tokens=False).ids) if r[1] else 0 for r in corpus()}
    assert {r["doc_id"]: r["n_tokens"] for r in query_on("op2_token_count", spark, folder).collect()} == want


def test_counter_ties_and_unknowns_on_random_texts():
    from tokenizers import Tokenizer, models, pre_tokenizers

    bytes_ = [(f"<0x{i:02X}>", -20.0) for i in range(256)]
    vocabulary = [("<unk>", 0.0), *bytes_, ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁a", -3.0), ("bb", -1.5), ("é", -4.0), ("cb", -1.0)]
    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c, r = tokencount.Counter(vocabulary, remember=50), random.Random(5)
    for _ in range(1500):
        s = "".join(r.choice("aabbc é日\n▁") for _ in range(r.randrange(1, 14)))
        assert c.text(s) == len(t.encode(s, add_special_tokens=False).ids), repr(s)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_tokenizer(file):
    e, plain = Encoder(file, remember=200), library(file)
    texts = [r[1] for r in corpus()] + ["it's 'S 12 a  b\n\n c ", " lead", "tail \n", "é́ ß İ \x1c\x85 ", "<|endoftext|>", "don’t “q”…—", "''s AB'RE"]
    for _ in range(2):
        for t, ids in zip(texts, e.encode(texts)):
            assert ids.tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t and t[:40])


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_on_random_texts(file):
    r, e, plain = random.Random(1), Encoder(file, remember=300), library(file)
    odd = ["—", "...", "€5", "a1b2", "x,y", "(z)", "“q”", "z" * 300, "don't", "\n", " ", "\t"]
    letters = lambda: "".join(r.choice("abcéÀß") for _ in range(r.randrange(1, 9)))
    texts = [r.choice([" ", "\n", " "]).join(letters() if r.random() < 0.7 else r.choice([*odd, str(r.randrange(10**6))]) for _ in range(r.randrange(60))) + r.choice(["", " ", "\n"]) for _ in range(300)]
    for t, ids in zip(texts, e.encode(texts)):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:40])


def plain_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark, folder):
    rows = corpus() + [(1000, "a b c " * 40, None, None, None), (1001, "# $ % <b> | " * 20, None, None, None), (1002, "a b a b a b", None, None, None)]
    for r in query_on("op3_quality_rules", spark, folder, rows).collect():
        text = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        want = plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality.script("日本語のテキスト") == "cjk" and quality.script("привет") == "cyrillic" and quality.script("123 !") == "other" and quality.script("हिन्दी") == "other"


def test_fertility_bands_reject_what_lies_outside(spark, folder):
    import sentencepiece
    import public_tokenizers

    r, at = random.Random(21), "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, prose(i, 60 + i % 90), ("en", None)[i % 2], None, None) for i in range(160)]
    odd = [" ".join("qzx" + r.choice("vwkj") * 2 + str(r.randrange(10**7)) for _ in range(80)), " ".join(chr(0x1F300 + i) + chr(0x1F400 + i) + chr(0x10900 + i % 20) for i in range(90)), " ".join(r.choice(["aa", "bb", "cc"]) + " " + r.choice(["dd", "ee"]) for _ in range(60)), " ".join(WORDS[i % 60] + "ing" for i in range(61))]
    rows += [(1000 + i, t, "en", None, None) for i, t in enumerate(odd)]
    got = {x["doc_id"]: x for x in quality.judge(spark.createDataFrame(rows, at), "doc_id", "text", Scratch(spark), "lang").collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(quality.VOCABULARY))
    plain = {}
    for d, text, lang, *_ in rows:
        ids = model.encode(text)
        h = -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids).values())
        plain[d] = (lang or "latin", len(text) / len(ids), sum(map(model.is_byte, ids)) / len(ids), h / min(math.log2(len(ids)), 8))
        assert (got[d]["chars_per_token"], got[d]["byte_share"], got[d]["entropy"]) == pytest.approx(plain[d][1:])
    bands = {}
    for kind in ("en", "latin"):
        for i, m in enumerate(("chars_per_token", "byte_share", "entropy"), 1):
            x = sorted(v[i] for d, v in plain.items() if v[0] == kind and not got[d]["base_failed"])
            lo, hi = (x[math.ceil(q * len(x)) - 1] for q in (0.25, 0.75))
            bands[kind, m] = lo, hi, max(hi - lo, quality.WIDTH[m])
    reasons = Counter()
    for d, (kind, per, share, entropy) in plain.items():
        (a, b, w), (_, e, u), (f, _, v) = (bands[kind, m] for m in ("chars_per_token", "byte_share", "entropy"))
        why = {"low": per < a - 5 * w, "high": per > b + 5 * w, "bytes": share > e + 8 * u, "entropy": entropy < f - 1.5 * v, "both": per < a - 2.5 * w and entropy < f - v}
        assert got[d]["kept"] == (not got[d]["base_failed"] and not any(why.values())), (d, why)
        reasons.update(k for k, v in why.items() if v and not got[d]["base_failed"])
    assert reasons["low"] and reasons["bytes"] and reasons["entropy"] and sum(x["kept"] for x in got.values()) > 130
    assert quality.script("aé" * 13 + "العربية" * 8) == "other"


def test_long_word_runs_repeat_alike():
    words = [b"%d" % (i % 3000) for i in range(9000)]
    assert quality.repeated_words(words) == 9000 and quality.repeated_words([b"%d" % i for i in range(9000)]) == 0


@pytest.mark.parametrize("bits", [1, 2])
def test_codec_round_trip(bits):
    top = 1 << (16 if bits == 1 else 32)
    r = np.random.default_rng(1)
    c = tokenfiles.Codec(bits)
    for n in (0, 1, 3, 7, 8, 9, 4097):
        ids = np.concatenate([r.integers(0, 300, n), r.integers(0, top, n), [0, 255, 256, 65535, top - 1]]).astype(np.uint32)
        assert (c.decode(*c.encode(ids), len(ids)) == ids).all()


def library(file):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(file))


def reference_ids(file):
    plain = library(file)
    return lambda t: [*plain.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("segment_ids, least", [(1 << 26, 2), (2_000, 6)])
def test_token_files_hold_every_document_in_order(spark, docs, segment_ids, least):
    ids = reference_ids("byte_bpe_50k.json")
    scratch = Scratch(spark)
    rows = corpus() + [(3, "again", None, None, None), (None, "no id", None, None, None)]
    out = scratch.path("tokens")
    tokenfiles.write_tokens(spark.createDataFrame(rows, DOCS).repartition(4), out, scratch, shard_chars=20_000, segment_ids=segment_ids)
    assert spark.read.parquet(f"{out}/manifest").count() >= least
    got = tokenfiles.read_tokens(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], tuple(r["ids"])) for r in got) == sorted((-1 if d is None else d, tuple(ids(t))) for d, t, *_ in rows)


def test_token_file_query(spark, folder):
    ids, at = reference_ids("byte_bpe_50k.json"), 0
    want = {}
    for d, t, *_ in corpus():
        x = ids(t)
        want[d] = (at, len(x), crc(x))
        at += len(x)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in query_on("op7_token_files", spark, folder).collect()} == want


def test_packing_holds_every_id_once_without_gaps(spark, folder):
    ids = reference_ids("word_bpe_49k.json")
    rows = corpus() + [corpus()[3]] * 2
    got = query_on("op8_packing", spark, folder, rows).collect()
    copies = Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    starts = defaultdict(list)
    for r in got:
        whole = ids(text[r["doc_id"]])
        assert r["doc_tokens"] == len(whole) and crc(whole[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
        starts[r["doc_id"]].append((r["start"], r["length"]))
    for d, parts in starts.items():
        assert len(parts) % copies[d] == 0
        at = 0
        for (a, n), times in sorted(Counter(parts).items()):
            assert a == at and times == copies[d]
            at += n
        assert at == len(ids(text[d]))
    assert set(starts) == set(text)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in windows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    total = sum(r["length"] for r in got)
    assert len(windows) <= math.ceil(total / 4096) + 1


def test_differencing_is_near_equal_and_the_count_rises():
    r = random.Random(2)
    sizes = np.array([r.randrange(1, 1500) for _ in range(400)])
    at = packing.difference(sizes, 20)
    sums = np.bincount(at, weights=sizes, minlength=20)
    assert sums.max() - sums.min() <= 60 and sums.sum() == sizes.sum()
    big = np.array([3000] * 5)
    assert np.bincount(packing.windows(big)).tolist() == [1] * 5
    assert packing.windows(np.array([1])).tolist() == [0]


# Mixing


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (i % 9 + 1), None, "big" if i % 10 else f"s{i % 3}", None) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, Scratch(spark), entropy=0.9, repeat=3.0, block=200).collect()
    seen = Counter(r["doc_id"] for r in got)
    assert set(seen) == {r[0] for r in rows} and max(seen.values()) <= 4
    tokens, weight, natural = Counter(), {}, Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
        weight[r["source"]] = r["weight"]
    for r in rows:
        natural[r[3]] += r[0] % 9 + 1
    total = sum(tokens.values())
    for s in tokens:
        assert tokens[s] / total == pytest.approx(weight[s], rel=0.06)
        assert tokens[s] / natural[s] <= 3.0 + 10 / natural[s]
    assert sum(weight.values()) == pytest.approx(1)
    by_block = defaultdict(Counter)
    for r in got:
        by_block[r["block"]][r["source"]] += r["n_tokens"]
    whole = [b for b in by_block if b < max(by_block)]
    assert all(by_block[b]["big"] / sum(by_block[b].values()) == pytest.approx(weight["big"], abs=0.12) for b in whole)


def test_exponent_against_a_plain_bisection(spark):
    tokens = [1000.0, 300.0, 50.0, 5.0]
    df = spark.createDataFrame([(t, sum(tokens)) for t in tokens], "tokens double, all_tokens double")

    def entropy(a):
        w = np.array(tokens) ** a
        w /= w.sum()
        return -(w * np.log(w)).sum()

    def repeats(a):
        return (max(tokens) / min(tokens)) ** (1 - a)

    for target, most in ((0.9, 1e9), (0.97, 4.0), (0.1, 2.0)):
        a = mixing.exponent(df, target, most)
        lo, hi = 0.0, 1.0
        for _ in range(60):
            m = (lo + hi) / 2
            lo, hi = (m, hi) if entropy(m) >= target * math.log(4) else (lo, m)
        want = 1.0 if entropy(1.0) >= target * math.log(4) else lo
        if repeats(want) > most:
            want = 1 - math.log(most) / math.log(max(tokens) / min(tokens))
        assert a == pytest.approx(want, abs=1e-6)


def test_a_small_budget_cuts_and_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(i, "w " * 5, "s", "x") for i in range(200)], "doc_id long, text string, source string, weight string")
    got = mixing.mix(df, Scratch(spark), budget=500.0, carry=True).collect()
    assert 95 <= len(got) <= 105 and got[0]["weight"] == 1.0
    same = spark.createDataFrame([(1, "a b", None, None, 3)] * 4 + [(None, None, None, None, None)], DOCS)
    assert mixing.mix(same, Scratch(spark)).count() == 5


# Embeddings


def plain_links(rows):
    v = {}
    for i, (key, x) in enumerate(rows):
        if x is not None and all(c is not None and math.isfinite(c) for c in x) and any(x):
            a = np.array(x, np.float64)
            v[i] = a / np.linalg.norm(a)
    n, up = Counter(), {key: key for key, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(v)
    for s, i in enumerate(ids):
        for j in ids[s + 1 :]:
            if len(v[i]) == len(v[j]) and v[i] @ v[j] >= 0.9:
                a, b = rows[i][0], rows[j][0]
                n[i] += 1
                n[j] += 1
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
    return {rows[i][0]: (n[i], find(rows[i][0])) for i in range(len(rows))}


def vectors(n=700, seed=4):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(16).astype(np.float32).tolist()) for i in range(n)]
    for i in range(0, 200):  # a large group of near copies, and of equal ones
        base = np.array(rows[600][1])
        rows[i] = (i, (base + 0.05 * r.standard_normal(16)).astype(np.float32).tolist() if i % 3 else rows[600][1])
    for i in range(200, 300, 2):
        rows[i] = (i, (np.array(rows[i + 1][1]) + 0.2 * r.standard_normal(16)).astype(np.float32).tolist())
    return rows + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [1.0, 2.0]), (2007, [])]


def test_embedding_links_and_components(spark, folder, monkeypatch):
    monkeypatch.setattr(embedding, "BUCKET", 64)
    rows = vectors()
    at = folder("embeddings", [(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding.links(spark.read.parquet(f"{at}/embeddings.parquet"), Scratch(spark), chunk=40).collect()}
    want = plain_links(rows)
    assert set(got) == set(want) and all(got[k][0] <= want[k][0] for k in want)
    found, all_ = sum(x for x, _ in got.values()), sum(x for x, _ in want.values())
    assert found >= 0.97 * all_
    assert {k: v[1] for k, v in got.items() if k < 200 or k >= 2000} == {k: v[1] for k, v in want.items() if k < 200 or k >= 2000}
    assert queries.QUERIES["op5_embedding_dedup"](spark, folder("embeddings", [], "vec_id long, embedding array<float>, label int")).count() == 0


def test_planned_recall_grows_tables_with_the_data():
    for n in (10, 10_000, 10_000_000):
        bits, tables = embedding.plan_tables(n)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.995
    assert embedding.plan_tables(10_000_000)[0] > embedding.plan_tables(10_000)[0]


# Lines


def plain_lines(rows, similar=0.8, size=8):
    first = {}
    for d, t, *_ in sorted((r for r in rows), key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                first.setdefault(line, (d, i))
    lines = list(first)
    sets = [frozenset(x[i : i + size] for i in range(max(1, len(x) - size + 1))) for x in lines]
    up = list(range(len(lines)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n >= similar * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    best = {}
    for i, line in enumerate(lines):
        best[find(i)] = min(best.get(find(i), first[line]), first[line])
    at = {line: i for i, line in enumerate(lines)}
    return {(d, i): best[find(at[line])] for d, t, *_ in rows for i, line in enumerate((t or "").split("\n")) if re.search(r"[^\x20\x09-\x0D]", line)}


def line_rows():
    rows, r = corpus(), random.Random(9)
    for i in range(20):  # long lines with small edits
        line = " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(40))
        rows += [(200 + 2 * i, line, None, None, None), (201 + 2 * i, line[:100] + "Q" + line[101:200] + "ZZ" + line[202:], None, None, None)]
    return rows


def test_line_dedup(spark, folder):
    rows = line_rows()
    got = {(r["doc_id"], r["line_no"]): ((r["keep_doc"], r["keep_line"]), r["kept"]) for r in query_on("op6_line_dedup", spark, folder, rows).collect()}
    want = plain_lines(rows)
    assert set(got) == set(want)
    assert sum(got[k][0] == want[k] for k in want) >= 0.99 * len(want)
    assert all(kept == (keep == k) for k, (keep, kept) in got.items())


def test_all_lines_of_a_band_meet(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK", 8, raising=False)
    monkeypatch.setattr(linededup, "bands", lambda sketch, *keep: sketch.select(*keep, F.lit(1).cast("long").alias("band")))
    r = random.Random(3)
    rows = []
    for i in range(30):  # pairs unlike the others
        line = "https://" + "".join(r.choice("abcdefghijklmnop") for _ in range(60))
        rows += [(2 * i, line + "0"), (2 * i + 1, line + "1")]
    got = {(r["doc_id"], r["line_no"]): (r["keep_doc"], r["keep_line"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert got == plain_lines(rows) and len(set(got.values())) == 30


def test_lines_of_a_small_band_meet_once(spark, monkeypatch):
    """What a small block has compared is not compared again with all blocks; larger bands are."""
    met, rest = {}, linededup._rest
    monkeypatch.setattr(linededup, "_rest", lambda rows, marks, similar, seed=0: met.setdefault(seed, rows) is None or rest(rows, marks, similar, seed))
    monkeypatch.setattr(Scratch, "drop", lambda self, *names: None)
    monkeypatch.setattr(linededup, "bands", lambda sketch, *keep: sketch.select(*keep, F.when(F.col("n") < 60, 1).otherwise(2).cast("long").alias("band")))
    r = random.Random(4)
    rows = []
    for i in range(5 + 20):
        line = "".join(r.choice("abcdefghijklmnop") for _ in range(50 if i < 5 else 90))
        rows += [(2 * i, line + "0"), (2 * i + 1, line + "1")]
    got = {(x["doc_id"], x["line_no"]): (x["keep_doc"], x["keep_line"]) for x in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()}
    assert got == plain_lines(rows) and len(set(got.values())) == 25
    assert {x["members"] for x in met[7].select("members").collect()} == {10, 40} and {x["members"] for x in met[0].select("members").collect()} == {40}


def edited(r, line, at_least=0.8):
    """line with as many changed, dropped or added characters as keep the shingles barely alike."""
    shingles = lambda x: {x[i : i + 8] for i in range(max(1, len(x) - 7))}
    one, now = shingles(line), line
    for _ in range(30):
        i = r.randrange(len(now))
        new = now[:i] + r.choice(["Q", "", "7z"]) + now[i + 1 :] if r.random() < 0.7 else now + r.choice("!?.0")
        two = shingles(new)
        if len(one & two) < at_least * len(one | two):
            break
        now = new
    return now


def test_banding_recall_of_each_class_of_lines(spark):
    r = random.Random(12)
    words = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    classes = {"short": lambda: letters(r.randrange(12, 32)), "5 words": lambda: words(5), "8 words": lambda: words(8), "unspaced": lambda: letters(120), "40 words": lambda: words(40), "long": lambda: words(400)}
    rows, kinds = [], []
    for kind, make in classes.items():
        while kinds.count(kind) < 150:
            line = make()
            other = edited(r, line)
            if other != line:
                rows += [(2 * len(kinds), line), (2 * len(kinds) + 1, other)]
                kinds.append(kind)
    sketch = linededup.minima(spark.createDataFrame(rows, "id long, line string").repartition(8), ["id"])
    met = linededup.bands(sketch, "id").withColumn("pair", F.floor(F.col("id") / 2)).groupBy("pair", "band").agg(F.countDistinct("id").alias("n")).where("n = 2")
    likely = linededup._likely(met.select((F.col("pair") * 2).alias("a"), (F.col("pair") * 2 + 1).alias("b")).distinct(), sketch, 0.8)
    found = Counter(kinds[x["a"] // 2] for x in likely.collect())
    assert sum(found.values()) >= 0.95 * len(kinds) and all(found[k] >= 0.93 * 150 for k in classes), found


def test_minima_are_those_of_a_plain_signature(spark):
    lines = ["short", "abcdefgh", "abcdefghi", "añb" * 30, "the same words, the same words"]
    sketch = {x["id"]: x for x in linededup.minima(spark.createDataFrame(list(enumerate(lines)), "id long, line string"), ["id"]).collect()}
    hashed = lambda x: spark.range(1).select(F.xxhash64(F.encode(F.lit(x), "UTF-16BE"))).first()[0] % (1 << 64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for i, line in enumerate(lines):
        every = [hashed(line[j : j + 8]) for j in range(max(1, len(line) - 7))]
        turned = [((h << 32) | (h >> 32)) % (1 << 64) for h in every]
        want = [min(signed((h << 4 * (p % 8)) % (1 << 64)) for h in (every if p < 8 else turned)) >> 32 for p in range(16)]
        assert [sketch[i][f"m{p}"] for p in range(16)] == want and sketch[i]["n"] == len(every)


def test_line_links_between_rows_without_an_id(spark):
    long = " ".join(WORDS[:30])
    rows = [(None, long), (7, long), (8, long.replace(WORDS[3], "quite")), (None, long.replace(WORDS[9], "other")), (9, "alone here in this place")]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)).collect()
    assert sorted(((r["doc_id"] or 0), r["keep_doc"]) for r in got if r["doc_id"] != 9) == [(0, 7), (0, 7), (7, 7), (8, 7)]


def test_rewrite_keeps_blank_lines_and_drops_emptied_documents(spark):
    rows = [(1, "one line of words here\n\nanother line of words", "en", "s", 1), (2, "one line of words here", "en", "s", 1), (3, "fresh text of its own\none line of words here\n", "en", "s", 1), (4, None, "en", "s", 1), (5, "", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    scratch = Scratch(spark)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in linededup.rewrite(df, linededup.dedup(df, scratch), scratch).collect()}
    assert got == {1: (rows[0][1], 1), 3: ("fresh text of its own\n", 22), 4: (None, 1), 5: ("", 1)}


# Shingle join


def test_bitmaps_bound_the_shingles_of_lines(spark):
    """Sets as characters have them, astral ones too; the short bitmap is the wide one folded, and both bound what differs."""
    r = random.Random(3)
    lines = ["a", "1234567", "12345678", "😀" * 9 + "é" * 9, "ab" * 40, "naïve 😀 text with words"] + ["".join(r.choice("abcde 😀é") for _ in range(n)) for n in (8, 9, 50, 700)]
    lines += [x[:-1] + "z" for x in lines]
    plain = [{x[i : i + 8] for i in range(max(1, len(x) - 7))} for x in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    hashes = {x["id"]: x["s"] for x in df.select("id", linededup.shingle_set(F.col("line")).alias("s")).collect()}
    marks = {x["id"]: x for x in linededup.bitmaps(df).collect()}
    bits = lambda longs: {(i, b) for i, x in enumerate(longs) for b in range(64) if x >> b & 1}
    wide = [bits(marks[i]["wide"]) for i in range(len(lines))]
    short = [bits([marks[i][f"b{j}"] for j in range(linededup.BITMAP)]) for i in range(len(lines))]
    for i, s in enumerate(plain):
        assert len(hashes[i]) == len(set(hashes[i])) == marks[i]["n"] == len(s)
        assert short[i] == {(w % linededup.BITMAP, b) for w, b in wide[i]}
        for j in range(i):
            assert len(set(hashes[i]) & set(hashes[j])) == len(s & plain[j])
            assert max(len(wide[i] ^ wide[j]), len(short[i] ^ short[j])) <= len(s ^ plain[j])


def plain_join(rows, percent=90, k=3):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for s, a in enumerate(ids):
        for b in ids[:s]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                i, j = find(a), find(b)
                up[max(i, j)] = min(i, j)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies():
    """Chains of small edits of short and long documents, whose ends are no longer alike, and a shared passage."""
    r, rows = random.Random(11), corpus()
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    for g, n in enumerate((45, 120, 295, 310, 700)):
        w = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
        for i in range(14):
            if i:
                for _ in range(1 + n // 150):
                    w[r.randrange(n)] = f"e{g}x{i}"
            rows.append((1000 * (g + 1) + i, " ".join(w), None, None, None))
    for i in range(150):
        rows.append((9000 + i, passage + " " + " ".join(r.choice(WORDS) + str(i % 75) for _ in range(5 + i % 30)), None, None, None))
    return rows


@pytest.mark.parametrize("frequent,pairs", [(64, 128), (2, 128), (3, 2)])
def test_shingle_join(frequent, pairs, spark, folder, monkeypatch):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "PAIRS", pairs)
    monkeypatch.setattr(ngramjoin, "BLOCK", 16)
    rows = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in query_on("op9_ngram_join", spark, folder, rows).collect()}
    assert got == plain_join(rows)


def test_members_of_many_entries_meet_once(spark):
    """Entries of nearly the same members are one group of these; entries in a chain stay groups of their own."""
    rows = [(e, 0, m, 9, 30, m) for e in range(20) for m in range(40) if m == 0 or (m + e) % 4]
    rows += [(100 + e, 1000 + 9 * e, 1000 + 9 * e + m, 9, 10, m) for e in range(30) for m in range(10)]
    many = spark.createDataFrame(rows, "sig long, a long, rep long, n long, members long, part long")
    got = ngramjoin._families(many, Scratch(spark)).collect()
    near = [(r["sig"], r["rep"]) for r in got if r["rep"] < 1000]
    assert len(rows) - 300 > 500 and sorted(near) == [(0, m) for m in range(40)]
    assert sorted((r["sig"], r["rep"]) for r in got if r["rep"] >= 1000) == sorted((s, rep) for s, _, rep, *_ in rows if rep >= 1000)


def test_signatures_meet_for_every_linked_pair():
    r = np.random.default_rng(8)
    for _ in range(300):
        n = int(r.integers(2, 420))
        universe = np.sort(r.integers(0, 1 << 62, 2 * n).astype(np.uint64))
        df = np.where(r.random(2 * n) < r.random(), 2, 500).astype(np.uint16)
        base = r.permutation(2 * n)
        most = n - -(-90 * n // 100)
        a, b = base[:n], np.concatenate([base[: n - int(r.integers(0, most + 1))], base[n : n + int(r.integers(0, most + 1))]])
        common = len(np.intersect1d(a, b))
        if 100 * common < 90 * (len(a) + len(b) - common):
            continue
        order = lambda x: x[np.lexsort((universe[x], df[x]))]
        a, b = order(a), order(b)
        sa, sb = (ngramjoin.signatures(universe[x], df[x], len(x), 0) for x in (a, b))
        assert np.intersect1d(sa, sb).size


def test_only_documents_with_a_partner_send_their_tokens(spark, folder, monkeypatch):
    """One of each set of copies is read a second time, and none whose tokens no other document has."""
    sent, profile = [], ngramjoin.profile
    monkeypatch.setattr(ngramjoin, "profile", lambda *a, **k: sent.append(profile(*a, **k)) or sent[-1])
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40 + i)), None, None, None) for i in range(300)]
    rows += [(1000 + i, rows[i % 4][1] + (" tail" if i % 8 > 3 else ""), None, None, None) for i in range(64)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in query_on("op9_ngram_join", spark, folder, rows).collect()}
    assert got == plain_join(rows)
    assert sorted(r["doc_id"] for r in sent[0].select("doc_id").collect()) == [0, 1, 2, 3, 1004, 1005, 1006, 1007]


# Language


def test_language_by_words_then_grams(spark, folder):
    r = random.Random(6)
    en, fr = [w + "ing" for w in WORDS], [w + "eau" for w in WORDS]
    text = lambda words: " ".join(r.choice(words) for _ in range(30))
    rows = [(i, text(en if i % 2 else fr), "en" if i % 2 else "fr", "s", 0) for i in range(200)]
    rows += [(500, None, "en", "s", 0), (501, "123 !?", "en", "s", 0), (502, "", None, "s", 0), (503, "zzozoing qqing", None, None, 0), (504, "日本", None, None, 0), (505, text(fr) * 3000, None, None, 0)]
    got = {r["doc_id"]: r for r in query_on("op10_language_id", spark, folder, rows).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(200)) and got[503]["lang_pred"] == "en" and got[505]["lang_pred"] == "fr"
    assert [got[i]["lang_pred"] for i in (500, 501, 502)] == ["und"] * 3 and got[504]["lang_pred"] in ("en", "fr") and 0 <= got[504]["score"] <= 1
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)


def test_predictions_ignore_the_labels_of_held_out_rows(spark):
    rows = [(i, ("alma bene " if i % 2 else "xori tuva ") * 9, "en" if i % 2 else "fr", None, 0) for i in range(60)]
    lied = [(d, t, "wrong" if zlib.crc32(str(d).encode()) % 3 == 1 else lang, s, n) for d, t, lang, s, n in rows]
    one, two = (langid.train(spark.createDataFrame(x, DOCS)) for x in (rows, lied))
    assert one.langs == two.langs == ["en", "fr"] and np.array_equal(np.sort(one.words.log, 0), np.sort(two.words.log, 0))
    assert langid.train(spark.createDataFrame([(1, "a", None, None, 0)], DOCS)).langs == []
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, DOCS), langid.Model([])).collect()} == {"und"}


# Pipeline


def test_stages(spark, folder, tmp_path):
    import corpus_pipeline

    rows = [(d, t, lang or "en", s, n) for d, t, lang, s, n in line_rows()]
    at = folder("documents", rows, DOCS)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    scratch, counts = Scratch(spark), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.save(stage(spark, docs, at), str(i))
        if i < 4:
            assert after.columns == docs.columns
        if name == "language":
            gone = docs.join(after, "doc_id", "left_anti").collect()
            assert all(not re.search(r"[^\W\d_]", r["text"] or "") or r["score"] < 0.5 for r in (x.asDict() | {"score": 0} for x in gone))
        if name == "near_duplicates":
            want = plain_join([(r["doc_id"], r["text"]) for r in docs.collect()], 80, 5)
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
        if name == "mixture":
            assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in docs.collect()}
        counts.append(after.count())
        docs = after
    assert all(counts) and corpus_pipeline.run(spark, at).count() == counts[-1]


# Texts that share an id, long documents, numerals, names in other case


def test_rewrite_judges_each_text_of_an_id_by_itself(spark):
    rows = [(0, "same line of words here"), (1, "alpha beta gamma delta\nsame line of words here"), (1, "completely other words\nunique second line of text"), (1, "alpha beta gamma delta\nsame line of words here"), (None, "same line of words here")]
    docs, scratch = spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark)
    got = sorted((tuple(r) for r in linededup.rewrite(docs, linededup.dedup(docs, scratch), scratch).collect()), key=str)
    assert got == sorted([(0, "same line of words here"), (1, "alpha beta gamma delta"), (1, "completely other words\nunique second line of text"), (1, "alpha beta gamma delta"), (None, "same line of words here")], key=str)


def test_rewrite_of_a_document_of_very_many_lines(spark):
    lines = [f"line {i // 2} of this long document {i // 2}" for i in range(60_000)]
    docs, scratch = spark.createDataFrame([(0, "\n".join(lines)), (1, "")], "doc_id long, text string"), Scratch(spark)
    judged = spark.createDataFrame([(0, i, i % 2 == 0) for i in range(60_000)], "doc_id long, line_no int, kept boolean").join(docs.select("doc_id", F.xxhash64("text").alias("text_id")), "doc_id")
    (text,) = [r["text"] for r in linededup.rewrite(docs, judged, scratch).collect() if r["doc_id"] == 0]
    assert text == "\n".join(lines[::2])


def test_numerals_are_no_letters(spark):
    model = langid.Model([("de", "der", 3), ("en", "the", 5)])
    assert [x for x, _ in model.predictor()(["12 ½ ²", "①②③", "Ⅷ", None, "", "_ 7"])] == [langid.UNKNOWN] * 6
    assert [x for x, _ in model.predictor()(["Ⅷ the", "der", "the", "dern"])] == ["en", "de", "en", "de"]


def test_words_forgotten_are_scored_alike():
    model = langid.Model([("de", w, 2) for w in ("der", "die", "das")] + [("en", w, 2) for w in ("the", "then", "dash")])
    texts = ["der then xyz", "dash das then", "qqq", "the die thedie"] * 3
    assert [p for t in texts for p in model.predictor(0)([t])] == model.predictor()(texts) == [p for t in [texts] for p in model.predictor(2)(t)]


def test_token_count_replaces_a_column_of_its_name_in_any_case(spark):
    got = tokencount.count_tokens(spark.createDataFrame([(1, "a b", 9)], "N_Tokens long, text string, `odd.name` int"))
    assert got.columns == ["text", "odd.name", "n_tokens"] and got.first()["n_tokens"] > 0

"""Operators 11 to 13 against plain versions: random and awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from lodestar.llm import chunks, negatives, trie
from lodestar.llm.common import Scratch

WHITE = " \t\n\x0b\x0c\r"


def words(text):
    return len("".join(" " if c in WHITE else c for c in text).split(" ")) - sum(1 for w in "".join(" " if c in WHITE else c for c in text).split(" ") if not w)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Conversation prefix trie


def plain_trie(rows, rebuild=True):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        made[c] = [*own.get(c - int(math.fmod(c, 20)), [])[:h], *turns[h:]]
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members) for p in below)
        saved = sum((len(members[p]) - 1) * (words(p[-1][1]) if p else 0) for p in below)
        ends = sorted(c for c in convs if len(made[c]) == len(path))
        children = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children, leaves, saved, sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, Depth int, k1 string"


def run_trie(spark, rows, **more):
    found = trie.trie(spark.createDataFrame([(*r, 7, "x") for r in rows], TURNS), Scratch(spark), **more)
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("height", [2, 8])
def test_trie_of_random_conversations(spark, monkeypatch, height):
    monkeypatch.setattr(trie, "HEIGHT", height)
    r = random.Random(height)
    rows = [(c, t, r.choice(["user", "bot", None]), r.choice(["a b", "c", " ", None, "d\ne f"])) for c in [*range(-3, 45), 2**40] for t in range(r.choice([1, 2, 3, 5, 9, 20]))]
    rows += [(4, None, "user", "null turn"), (None, 1, "user", "no id"), (5, 1, "user", "a b"), (5, 1, "user", "a b"), (6, 1, "z", "tie"), (6, 1, "a", "tie")]
    r.shuffle(rows)
    assert run_trie(spark, rows) == plain_trie(rows)


def test_trie_of_one_long_conversation_over_many_slices(spark):
    rows = [(20, t, "user", f"t{t % 3}") for t in range(300)] + [(21, t, "user", f"t{t % 3}") for t in range(290)]
    assert run_trie(spark, rows) == plain_trie(rows)


def test_trie_without_rebuilding_and_of_nothing(spark):
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "b c")]
    assert run_trie(spark, rows, rebuild=False) == plain_trie(rows, rebuild=False)
    assert run_trie(spark, []) == []
    assert run_trie(spark, [(None, 0, "u", "a")]) == []


def test_ends_of_many_conversations_run_over_several_texts(spark):
    rows = [(c, 0, "u", "same") for c in range(1, 20_000, 7)]
    (leaf,) = [x for x in run_trie(spark, rows, rebuild=False) if x[1] == 1]
    assert leaf[-1] == sha(",".join(str(c) for c in range(1, 20_000, 7)))


# Hard negatives


def plain_negatives(rows, every=100, k=5, least=80):
    def fit(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    rows = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and fit(v)]
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in rows if len(w) == len(v))
        for p, j, m in [s for s in scored if s[1] != i and s[2] == lab][:k]:
            hard = [s for s in scored if s[2] != lab and -least * p <= -100 * s[0] <= -100 * p][:k]
            out += [(i, j, n, b, -p, -s) for n, (s, b, _) in enumerate(hard, 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, score string, Goal int"


def run_negatives(spark, rows, **more):
    found = negatives.mine(spark.createDataFrame([(*r, "s", 1) for r in rows], VECTORS), Scratch(spark), **more)
    return sorted(tuple(r) for r in found.collect())


def vectors(r, n, width, spread):
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(4)]
    return [(i, [c + r.gauss(0, spread) for c in r.choice(centres)], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("width", "spread"), [(2, 0.3), (16, 0.4), (3, 0.0)])
def test_negatives_over_several_blocks(spark, width, spread):
    rows = vectors(random.Random(width), 400, width, spread)
    assert run_negatives(spark, rows, every=10, block=64, group=8) == plain_negatives(rows, every=10)


def test_negatives_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 1), (100, [1.0, 2.0], 2), (200, [0.0, 0.0], 1), (300, None, 1), (400, [1.0, None], 1), (500, [nan, 1.0], 1), (600, [inf, 1.0], 1), (700, [1.0, 1.0], None),
            (None, [1.0, 1.0], 1), (800, [], 1), (801, [], 1), (802, [], 2), (803, [], 2), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2), (3, [0.9, 2.0], 2), (4, [-1.0, -2.0], 2), (5, [1.0, 2.0, 3.0], 2), (900, [1.0, 2.0, 3.0], 1)]
    assert run_negatives(spark, rows) == plain_negatives(rows)
    assert run_negatives(spark, []) == []


def test_scores_are_exact_beyond_doubles(spark):
    rows = [(0, [2.0**21, 1.0], 1), (1, [2.0**21, 1.0], 1), (2, [2.0**21 - 2**-8, 3.0], 2), (3, [2.0**21, 0.5], 2), (4, [2.0**20, 0.0], 2)]
    assert run_negatives(spark, rows) == plain_negatives(rows)


def test_a_walk_stops_before_the_end_of_its_lists():
    r = np.random.default_rng(3)
    values = np.floor(256 * r.standard_normal((4000, 2)))
    block = negatives.Block(np.arange(4000), np.zeros(4000, np.int64), values)
    met = [len(new) for new, _, _ in block.walk(values[0])]
    steps = block.walk(values[0])
    got = sum(len(next(steps)[0]) for _ in range(3))
    assert got < 1000 and sum(met) == 4000
    ((rows, scores),) = block.best(values[0], np.ones(4000, bool), [(-math.inf, math.inf)], 5)
    assert scores.tolist() == sorted((values @ values[0]).astype(int).tolist(), reverse=True)[:5]


# Chunks


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(chunks.FILE))


PARTS = ["word ", "the ", "foo's ", "'re", "'", "ll", " ", "  ", "\n", "\n\n", "\t", "1234", "ö", "漢字", "😀", " ", "　", " don't", "a", "!?", "...", "<|endoftext|>", "<|EndOfText|>", "\x1c", "\x85", "é", "١٢"]


def some_text(r, n):
    return "".join(r.choice(PARTS) for _ in range(n))


def test_joins_are_repaired(monkeypatch, library):
    for name, value in (("LEAST", 4), ("MOST", 60), ("BITS", 3)):
        monkeypatch.setattr(chunks, name, value)
    joiner, r = chunks.Joiner(), random.Random(2)
    texts = [some_text(r, r.randint(0, 120)) for _ in range(600)] + ["x" * 500, "漢" * 300, "a b " * 200, " " * 300, "\n" * 200]
    cut = list(chunks._chunked(texts, joiner.encoder.special))
    assert ["".join(p) for p in cut] == texts and max(len(c) for p in cut for c in p) <= 60
    ids = iter(joiner.encoder.encode([c for p in cut for c in p]))
    for text, got in zip(texts, joiner.join([[next(ids) for _ in p] for p in cut])):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids
        assert joiner.decoder.decode(got) == text


def test_chunks_follow_the_content():
    r = random.Random(4)
    shared = some_text(r, 4000)
    texts = [some_text(r, 500) + shared + some_text(r, 300), some_text(r, 90) + shared]
    one, two = ({t[a:b] for a, b in zip([0, *e], e)} for t, e in zip(texts, chunks.cuts(texts)))
    assert sum(map(len, one & two)) > 0.7 * len(shared)
    assert chunks.cuts([texts[1]])[0] == chunks.cuts(texts)[1]  # whatever stands beside it


def run_chunks(spark, folder, texts):
    made = folder("documents", [(i, t, "N", 1) for i, t in texts], "doc_id long, text string, Key1 string, seq int")
    return sorted((tuple(r) for r in chunks.op11_bpe_chunks(spark, made).collect()), key=str)


def plain_chunks(library, texts):
    out = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


def test_chunk_query_equals_the_library(spark, folder, library, monkeypatch):
    r = random.Random(6)
    passage = some_text(r, 3000)
    texts = [(i, some_text(r, r.choice([1, 30, 900]))) for i in range(40)]
    texts += [(100 + i, some_text(r, 50) + passage + some_text(r, 50)) for i in range(6)] + [(200 + i, passage) for i in range(5)]
    texts += [(300, None), (301, ""), (302, " "), (303, "x" * 50_000), (304, "<|endoftext|>" * 3), (None, "no id"), (305, "twice"), (305, "twice"), (305, "other text of the id"), (306, (passage + " ") * 8)]
    assert run_chunks(spark, folder, texts) == plain_chunks(library, texts)
    monkeypatch.setattr(chunks, "REMEMBER", 0)
    assert run_chunks(spark, folder, texts) == plain_chunks(library, texts)


def test_chunk_query_of_an_empty_table(spark, folder):
    assert run_chunks(spark, folder, []) == []


def test_a_shared_chunk_is_encoded_once(spark, library):
    r = random.Random(8)
    passage = some_text(r, 5000)
    docs = spark.createDataFrame([(i, f"{i} {passage}") for i in range(20)], "doc_id long, text string").repartition(4)
    scratch = Scratch(spark)
    found = chunks.encode(docs, scratch, digest=False)
    assert found.count() == 20
    once = spark.read.parquet(scratch.path("ids"))
    assert once.count() == once.select("h1", "h2").distinct().count() > 3


def test_decode_of_ids(spark, library):
    r = random.Random(1)
    rows = [(i, [r.randrange(50_400) for _ in range(20)], "x") for i in range(50)] + [(50, [], "x"), (51, None, "x")]
    found = {x["doc_id"]: x["text"] for x in chunks.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, TEXT string")).collect()}
    assert found == {i: None if ids is None else library.decode(ids, skip_special_tokens=False) for i, ids, _ in rows}

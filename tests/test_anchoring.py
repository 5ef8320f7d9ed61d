"""Mentions of places against a plain scan of the tokens."""

import random
import re

import pytest

from lodestar.operators import anchoring


def plain(text, known, proper, apart):
    words = re.findall(r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*", text or "")
    out = []
    for i, w in enumerate(words):
        if proper and w[0] != w[0].upper():
            continue
        for n in range(5, 0, -1):
            run = " ".join(words[i : i + n]).lower()
            if i + n <= len(words) and (run in known or run in apart):
                if run not in apart:
                    out.append((i, n, known[run]))
                break
    return out


@pytest.mark.parametrize("proper", [False, True])
def test_longest_first(spark, proper):
    r = random.Random(6)
    vocabulary = ["New", "York", "city", "Kyiv", "Old", "old", "York-upon", "Rīga", "the", "Of"]
    places = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 1, 2, 3]))), r.randrange(3)) for i in range(25)] + [(90, None, 1), (None, "city", 9), (91, "...", 1)]
    texts = [(i, r.choice([" ", ", ", "\n"]).join(r.choice([*vocabulary, "word", "7"]) for _ in range(30))) for i in range(40)] + [(100, None), (101, ""), (102, "7 7")]
    best = {}
    for i, name, w in places:
        if name and i is not None and (t := re.findall(r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*", name.lower())):
            best[" ".join(t)] = min(best.get(" ".join(t), (-w, i)), (-w, i))
    known = {k: i for k, (_, i) in best.items()}
    apart = (next(iter(known)), "the old")
    df = spark.createDataFrame(texts, "id int, text string")
    made = anchoring.names(spark.createDataFrame(places, "place int, name string, people int"), weight=__import__("pyspark.sql.functions", fromlist=["col"]).col("people"))
    got = sorted((x["id"], x["at"], x["n"], x["place"]) for x in anchoring.mentions(df, made, proper=proper, apart=apart).collect())
    want = sorted((i, *m) for i, t in texts for m in plain(t, known, proper, apart))
    assert got == want and len(got) > 100
    first = {x["id"]: (x["at"], x["n"], x["place"]) for x in anchoring.first_place(df, made, proper=proper, apart=apart).collect()}
    assert first == {i: plain(t, known, proper, apart)[0] for i, t in texts if plain(t, known, proper, apart)}
    assert anchoring.mentions(df, made.limit(0), proper=proper).count() == 0

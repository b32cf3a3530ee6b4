import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from urlsieve.llm import order_minhash

LOW = (1 << order_minhash.PLACE) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chain(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h)
    return signed(h)


def brute(text, words=5, tuple_size=2, sketches=32):
    t = re.findall(order_minhash.TOKEN, text or "")
    k = [chain(*t[i : i + words]) for i in range(max(len(t) - words + 1, min(len(t), 1)))]
    seen, out = Counter(), []
    elements = []
    for h in k:
        elements.append(chain(h, seen[h]) if seen[h] else h)
        seen[h] += 1
    for mask in order_minhash.masks(sketches):
        order = sorted(range(len(k)), key=lambda i: signed(((elements[i] & ~LOW | i) ^ mask) & (1 << 64) - 1))
        out.append((chain(*(k[i] for i in sorted(order[:tuple_size]))) & (1 << 64) - 1) >> 32)
    return out


def texts():
    r = random.Random(5)
    word = lambda: r.choice(["a", "b", "cd", "é", "漢字か", "x" * 40])
    some = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(40)]
    return [*some, None, "", " \t\n", "one", "a b", "a a a a a a a a a", "same line here again\n" * 30, "한글 text x", "b a " * 500, "q" * 5000]


def test_sketches_against_brute_force(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "id long, text string")
    for options in ({}, {"words": 2, "tuple_size": 3, "sketches": 4}, {"words": 1, "tuple_size": 1, "sketches": 1}):
        got = {r["id"]: r["s"] for r in df.select("id", order_minhash.sketch(F.col("text"), **options).alias("s")).collect()}
        for i, text in docs:
            assert got[i] == brute(text, **options), (options, text)


def test_order_counts_and_empty_texts_are_alike(spark):
    r = random.Random(1)
    block = [" ".join(str(r.random())[2:9] for _ in range(200)) for _ in range(5)]
    rows = [("moved", " ".join(block), " ".join(block[::-1])), ("same", block[0], block[0]), ("edit", " ".join(block), " ".join(block[:4]) + " new"), ("empty", "", None), ("half", "", "a b")]
    df = spark.createDataFrame(rows, "k string, a string, b string")
    of = lambda c: order_minhash.sketch(F.col(c), sketches=256)
    got = {r["k"]: r["v"] for r in df.select("k", order_minhash.likeness(of("a"), of("b")).alias("v")).collect()}
    # a set of k-mers would find 0.96 in the first pair; four of five orders between two blocks are turned round
    assert got["same"] == got["empty"] == 1 and got["half"] == 0
    assert 0.1 < got["moved"] < 0.35 < 0.5 < got["edit"] < 0.85


@pytest.mark.parametrize("rows", [2, 7, 10_000])
def test_next_documents(spark, rows):
    r = random.Random(rows)
    ids = [None, None, 5, 5, 5, -3, 2**62, *r.sample(range(10**6), 60)]
    docs = [(i, r.choice(["", "text", "äöü"]) * r.randint(0, 30) + str(n)) for n, i in enumerate(ids)] + [(7 * 10**6, None)]
    got = order_minhash.digest(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, bucket int, next_text string"), sketches=2, rows=rows).collect()
    rank = lambda d: (d[0] is not None, d[0] or 0, chain(d[1] or ""))
    order = sorted(docs, key=rank, reverse=True)
    want = []
    for (i, text), (_, other) in zip(order, [*order[1:], order[0]]):
        text, other = text or "", other or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        one, two, three = (brute(t, sketches=2) for t in (text, edited, other))
        near = lambda a, b: sum(x == y for x, y in zip(a, b)) / 2
        say = lambda s: "".join(f"{x:08x}" for x in s)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), say(one), say(two), near(one, two), near(one, three)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_one_row_and_empty_table(spark):
    one = order_minhash.digest(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"abc dab").hexdigest()
    assert order_minhash.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_plan_is_native(spark):
    df = order_minhash.digest(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from urlsieve.llm import spelling
from urlsieve.llm import textbytes as tb


def brute_words(docs, every=97, min_length=5, min_count=3):
    count = Counter()
    for i, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            count[w] += len(w) >= min_length
    return {w: n for w, n in count.items() if n >= min_count}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=2):
    out, form = {}, {}
    for w, n in words.items():
        found = [(-m, v) for v, m in words.items() if v != w and is_near(v, w)]
        best = min(found, default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form[w], None, n, len(found), -best[0] if form[w] else None]
    for w, row in out.items():
        root = w
        while form[root]:
            root = form[root]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_documents_against_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abABÉé") for _ in range(r.randint(1, 8)))
    docs = [(i, " ".join(word() + r.choice(["", ",", "1", "Ж", "\n"]) for _ in range(400))) for i in range(20)]
    docs += [(None, "aaaaa " * 9 + "ababa"), (500, None), (501, ""), (502, "12 你"), (3, "ababa" * 2), (3, "ababa" * 2)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n long, word string")
    found = spelling.vocabulary(df, every=7)
    want = brute_words(docs, every=7)
    assert {x["word"]: x["n"] for x in found.collect()} == want and len(want) > 50
    assert rows(spelling.variants(found, part_words=64)) == brute_variants(want)


@pytest.mark.parametrize("part_words", [10, 1 << 16])
def test_words_of_all_lengths(spark, part_words):
    r = random.Random(part_words)
    words = {"".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(300)}
    words |= {"a" * n for n in range(1, 12)} | {"aab" * 3, "aba" * 3, "\U0001f600ab", "\U0001f600b", "\U0001f601b", "z"}
    counted = {w: r.choice([1, 2, 2, 5, 11, 40]) for w in words}
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    assert rows(spelling.variants(df, part_words=part_words)) == brute_variants(counted)


def test_machine_is_minimal_and_pairs_come_once():
    words = sorted({a + b for a in ("x", "y", "xy") for b in ("abc", "abd", "ab", "bc")})
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    machine = spelling.Acceptor(code, np.concatenate(([0], np.cumsum([len(w) for w in words]))), np.zeros(len(words), np.int64))
    rest = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(machine.ends) == len(rest)
    u, v = spelling.near_pairs(machine, np.zeros(len(words), np.int64))
    pairs = [frozenset((words[a], words[b])) for a, b in zip(u, v)]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset((a, b)) for a in words for b in words if a != b and is_near(a, b)}


def test_checksums_of_long_words():
    data = np.frombuffer(b"abc" * 100 + b"q" * 64 + b"z", np.uint8)
    start, end = np.array([0, 300, 364, 5]), np.array([300, 364, 365, 5])
    first = np.array([zlib.crc32(b"7:")] * 4, np.uint32)
    assert spelling.checksums(data, start, end, first).tolist() == [zlib.crc32(b"7:" + data[a:b].tobytes()) for a, b in zip(start, end)]


def test_runs_of_a_chunk():
    column = pa.array(["ÉtésÉ abcde", None, "", "ABCDE×x"])
    assert spelling.misspelt(*tb.text_bytes(column), ["1", "2", "3", "4"], every=1 << 40).to_pylist() == ["ÉtésÉ", "abcde", "abcde×x"]
    assert len(spelling.misspelt(np.zeros(0, np.uint8), np.zeros(2, np.int64), ["1"])) == 0


def test_long_words_hot_words_and_empty_tables(spark):
    long = "ab" * 20_000
    docs = [(1, f"{long} {long} {long} x{long} x{long} x{long}"), *[(i, "hello " * 2000) for i in range(20)], (30, "hellos hellos hellos")]
    got = rows(spelling.variants(spelling.vocabulary(spark.createDataFrame(docs, "doc_id long, text string"), every=1 << 40)))
    assert got == {long: (None, long, 3, 1, None), "x" + long: (None, "x" + long, 3, 1, None), "hello": (None, "hello", 40_000, 1, None), "hellos": ("hello", "hello", 3, 1, 40_000)}
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_roots_of_a_long_chain(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(45)]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w45" for w, _ in chain}

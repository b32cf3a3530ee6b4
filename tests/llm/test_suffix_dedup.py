import hashlib
import random
from collections import Counter

import pytest

from urlsieve.llm import suffix_dedup


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abé ") for _ in range(r.randint(1, 6)))
    make = lambda n: "".join(word() for _ in range(n))
    passages = [make(length // 2) for _ in range(4)]
    texts = [None, "", "a", "ab" * length, "ab" * length, "x" * (3 * length), make(40)]
    for _ in range(40):
        parts = [make(r.randint(0, 10))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts += [p[a : a + r.randint(0, len(p))], make(r.randint(0, 5))]
        texts.append("".join(parts))
    texts += texts[10:14]
    near = list(texts[20])
    if near:
        near[len(near) // 2] = "#"
    return [*texts, "".join(near)]


@pytest.mark.parametrize("length,seed", [(20, 1), (33, 2), (7, 3)])
def test_against_brute_force(spark, length, seed):
    texts = corpus(seed, length)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, tid string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(rows, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_null_and_repeated_ids_and_empty(spark):
    t = "abcdefghij" * 5
    rows = spark.createDataFrame([(None, t), (None, t), (1, "z" + t[:30]), (1, "q")], "doc_id long, text string")
    got = sorted((r["n_removed"], r["n_bytes"]) for r in suffix_dedup.suffix_dedup(rows, 20).collect())
    assert got == [(0, 1), (30, 31), (50, 50), (50, 50)]
    assert suffix_dedup.suffix_dedup(rows.limit(0), 20).count() == 0

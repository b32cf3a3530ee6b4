import random
import re

import numpy as np
import pytest

from urlsieve.llm import ngram_join
from urlsieve.llm import textbytes as tb
from urlsieve.llm.components import components


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(texts, percent=80):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta Gamma delta ÉTÉ x y z".split()) + str(r.randint(0, 30))
    texts = [None, "", " \n\t", "one", "One ", "one two", "a b c d", "A B C D", "a b c d e"]
    for _ in range(6):
        base = [word() for _ in range(r.randint(30, 120))]
        for _ in range(12):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += texts[20:30] + [" ".join(word() for _ in range(50)) for _ in range(10)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("hubs", [256, 2])
def test_against_all_pairs(spark, monkeypatch, hubs):
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    texts = corpus(hubs)
    rows = spark.createDataFrame([(i, t, "c", 9) for i, t in enumerate(texts)], "doc_id long, text string, n_shingles string, tid int")
    got = {r["doc_id"]: r for r in ngram_join.near_duplicates(rows).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == brute(texts)
    assert got[3]["tid"] == 9


def test_each_order_cuts_pairs_and_keeps_the_similar_ones():
    r = random.Random(9)
    base = [r.randrange(1 << 63) for _ in range(1500)]
    sets = []
    for _ in range(60):  # neighbours share three quarters, a few almost all
        at = r.randrange(1200)
        sets.append(np.array(sorted({*base[at : at + 200], *(r.randrange(1 << 63) for _ in range(r.randint(0, 40)))}), np.uint64))
    p = [ngram_join.prefix_length(len(x), 80) for x in sets]
    first = [set(x[np.argsort(tb.mix(x))[:k]].tolist()) for x, k in zip(sets, p)]
    marks = [ngram_join.signatures(x, k) for x, k in zip(sets, p)]
    pairs = [(i, j) for i in range(60) for j in range(i)]
    one = [(i, j) for i, j in pairs if first[i] & first[j]]
    two = [(i, j) for i, j in one if ngram_join.meet(marks[i][0], marks[j][0])]
    three = [(i, j) for i, j in two if ngram_join.meet(marks[i][1], marks[j][1])]
    true = [(i, j) for i, j in pairs if ngram_join.similar(sets[i], sets[j], 80)]
    assert true and set(true) <= set(three)
    assert len(pairs) > len(one) > len(two) > len(three)


def test_pairs_are_cut_before_texts_travel(spark):
    a, b = np.arange(1, 100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    rows = [(i, *ngram_join.signatures(x, 21)) for i, x in enumerate((a, a[:-1], b))]
    classes = spark.createDataFrame([(i, bytearray(x), bytearray(y)) for i, x, y in rows], "s long, second binary, third binary")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "a long, b long")
    assert [tuple(x) for x in ngram_join.met_everywhere(pairs, classes).collect()] == [(1, 0)]


def test_one_of_each_with_null_and_repeated_ids(spark):
    a, b = "one two three four five six", "seven eight nine"
    rows = spark.createDataFrame([(None, a), (4, a), (4, a), (5, a), (None, b), (None, b), (7, ""), (7, ""), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in ngram_join.one_of_each(rows).collect())
    assert got == [(-1, ""), (-1, b), (4, a), (7, ""), (7, "")]
    assert ngram_join.digest(rows.limit(0)).count() == 0
    assert ngram_join.one_of_each(rows.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for ab in links for x in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in ab and ab[0] != ab[1] for ab in links)}

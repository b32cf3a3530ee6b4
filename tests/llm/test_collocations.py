import random
import re
from collections import Counter, defaultdict

import pytest

from urlsieve.llm import collocations

SCHEMA = "doc_id long, lang string, text string, n long, phrase string, score int"


def brute(docs, max_words=3, support=10, cover=50, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, lang, text in docs:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            total[lang or "und" if lang is None else lang] += len(w)
            for m in range(1, max_words + 1):
                for i in range(len(w) - m + 1):
                    f["und" if lang is None else lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, count in f.items():
        cand, rows = {p: a for p, a in count.items() if len(p) > 1 and a >= support}, []
        covered = {p[i:j] for p, a in cand.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if (i, j) != (0, len(p)) and 100 * a >= cover * count[p[i:j]]}
        for p, a in cand.items():
            score, k, left, right = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            if p not in covered:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def run(spark, docs, max_words=3, support=10, cover=50, top=2000, **more):
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], SCHEMA)
    got = collocations.best(collocations.collocations(collocations.counts(df, max_words, support, **more), cover), top, salts=3)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["Ab", "ab", "c", "É", "ü", "x1", "\U0001f600"])
    gap = lambda: r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ;! "])
    docs = [(i, r.choice(["en", "de", None]), "".join(word() + gap() for _ in range(r.randint(0, 40)))) for i in range(n)]
    return [*docs, (None, "en", "ab c " * 30), (900, "fr", None), (901, "", ""), (902, None, ", ."), (1, "en", "ab ab"), *[(2, "en", "C x1 ab.")] * 7]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"shards": 1}), (3, {"support": 4, "shards": 2, "max_words": 4, "cover": 80}), (4, {"support": 1, "max_words": 2, "top": 5}), (5, {"support": 25, "shards": 9, "part_bytes": 100})])
def test_phrases_against_brute_force(spark, seed, options):
    docs = texts(seed)
    assert run(spark, docs, **options) == brute(docs, **{k: v for k, v in options.items() if k not in ("shards", "part_bytes")})


def test_full_filters_lose_and_add_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BITS_EACH", 0)
    monkeypatch.setattr(collocations, "KNOWN", 3)
    docs = texts(6)
    assert run(spark, docs, support=6) == brute(docs, support=6)


def test_empty_table_and_long_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "en", None), (2, "en", "")]) == []
    docs = [(1, "en", "word " * 300_000), (2, "en", "x" * 3_000_000), (3, "en", "a b " * 11 + "x" * 100_000)]
    assert run(spark, docs) == brute(docs)


def test_products_beyond_64_bits(spark):
    big = 3 * 10**15
    rows = [("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "", 0, 4 * big)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, phrase string, size int, n long")).first()
    assert (got["score"], got["l"], got["r"], got["n"]) == (10**6 * big * big // (big * (big + 1)), big, big + 1, 4 * big)

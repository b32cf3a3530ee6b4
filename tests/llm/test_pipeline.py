import random
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from urlsieve.llm import quality_rules
from urlsieve.llm import tokens as tk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def base_fails(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
    return len(w) < 20 or 100 * len(again) > 30 * len(w)


def without_common_lines(docs):
    key = lambda line: lower(line.strip(WHITE))
    seen = Counter(k for k, _ in {(key(line), i) for i, t in docs for line in t.split("\n")})
    return [(i, "\n".join(line for line in t.split("\n") if not key(line) or seen[key(line)] < 10)) for i, t in docs]


def one_of_each(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    kept = {}
    for at, (i, _) in enumerate(docs):
        r = find(at)
        if r not in kept or i is not None and (docs[kept[r]][0] is None or i < docs[kept[r]][0]):
            kept[r] = at
    return [docs[at] for at in sorted(kept.values())]


def clean(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    windows = [(min(10, len(w)), g) for w in map(words, items) if w for g in grams(w, min(10, len(w)))]
    return [(i, t) for i, t in docs if not any(g in grams(words(t), n) for n, g in windows)]


def pieces(docs):
    named, out = Tokenizer.from_file(tk.default_path()), []
    for i, t in docs:
        ids = np.array([*named.encode(t, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        sizes = [1024] * (len(ids) // 1024) + [1 << b for b in range(9, -1, -1) if len(ids) % 1024 >> b & 1]
        for n in sizes:
            out.append((i if i is not None else -1, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    return sorted(out)


def make(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(14), text(6), "", None]
    docs = []
    for i in range(60):
        body = text(r.randint(15, 90))
        if i % 9 == 4:
            body += " " + items[i % 2]
        docs.append((i, body + "\nthe same footer line" * (i % 2) + "\nRead  More!" * (i % 5 == 0)))
    for i in range(60, 90):  # near copies of the first ones
        w = docs[i - 60][1].split(" ")
        w[r.randrange(len(w))] = "changed"
        docs.append((i, " ".join(w)))
    docs += [docs[3], docs[3], (None, text(50)), (None, docs[5][1]), (500, None), (501, ""), (502, "BUY NOW !! " * 40), (503, text(1500) + " <|endoftext|> end")]
    r.shuffle(docs)
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    docs, items = make(3)
    d = str(tmp_path)
    rows = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in docs], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 50)] + [(502, 0, 1), (None, 1, 1), (7, None, 0)], "doc_id long, quality int, toxic int")
    rows.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    # the model's own probability decides beside the base rules, which are counted here
    p = {x["text"]: x["p_low"] for x in quality_rules.quality_rules(rows, labels).collect()}
    kept = [(i, t) for i, t in docs if not base_fails(t) and p[t] < 0.5]
    assert 60 < len(kept) < len(docs)
    want = pieces(clean(one_of_each(without_common_lines(kept)), items))
    got = corpus_pipeline.run(spark, d).collect()
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got) == want
    assert len({x["sequence_id"] for x in got}) == len(got) and {x["offset"] for x in got} == {0}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, d).columns == rows.columns, name


def test_empty_documents(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_join", "decontaminate", "packing"]
    assert corpus_pipeline.run(spark, d).count() == 0

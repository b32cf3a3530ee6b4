import hashlib
import pickle
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from urlsieve.llm import decontaminate, html_text, line_dedup, packing, quality_rules, token_counts, url_filter
from urlsieve.llm import textbytes as tb
from urlsieve.llm import tokens as tk


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


# --- decontamination


@pytest.mark.parametrize("shard", [10**6, 7])
def test_decontamination_against_brute_force(spark, shard):
    r = random.Random(shard)
    word = lambda: r.choice(["Ab", "c", "déjà", "x1", "y"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 1, 12, 14, 5, 2])] + [(9, None), (10, "!!"), (None, "zz zz")]
    docs = [(i, "-".join(word() for _ in range(r.randint(0, 60)))) for i in range(40)] + [(100, None), (101, ""), (102, "zz ZZ"), (103, "AB, c!")]
    docs += [(200 + i, f"{word()} {t}. {word()}") for i, t in items if i is not None and t]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    got = decontaminate.decontaminate(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hit int"), spark.createDataFrame(items, "item_id long, text string"), 4, shard)
    got = {x["doc_id"]: x for x in got.collect()}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            for a in range(max(1, len(v) - 3) if v else 0):
                p = v[a : a + 4]
                for k in range(len(w) - len(p) + 1):
                    if w[k : k + len(p)] == p:
                        hit |= {*range(k, k + len(p))}
                        found.add(item)
        ids = ",".join(sorted(str(x) for x in found if x is not None))
        x = got[i]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["items_sha256"], x["contaminated"]) == (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))


# --- line dedup


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64))
    prints = keys ^ np.uint64(99)
    shard = line_dedup.build(keys, prints, np.arange(len(keys)) + 1)
    assert sorted(shard.slot(keys).tolist()) == list(range(len(keys)))
    assert (shard.counts(keys, prints) == np.arange(len(keys)) + 1).all()
    assert not shard.counts(keys + np.uint64(1), prints).any()


def test_index_takes_about_thirteen_bytes_a_key():
    keys = np.random.default_rng(1).integers(0, 2**63, 1 << 16).astype(np.uint64)
    assert len(pickle.dumps(line_dedup.build(keys, keys, np.ones(len(keys), np.int64)))) < 13.2 * len(keys)


@pytest.mark.parametrize("group", [line_dedup.GROUP_BYTES, 1])
def test_line_dedup_against_brute_force(spark, monkeypatch, group):
    if group == 1:  # many shards, a pass for each
        monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    r = random.Random(2)
    lines = ["Common", " common\t", "é", "É", "", " ", "a b", "A B\r"] + [f"line {i}" for i in range(12)]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(1, 8)))) for i in range(30)] + [(50, None), (51, ""), (3, "Common\nnew")]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for k, _ in {(key(x), i) for i, t in docs for x in (t or "").split("\n")})
    got = line_dedup.line_dedup(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, k int"), 4, group_bytes=group).collect()
    want = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not key(x) or seen[key(x)] < 4]
        want.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), 5))
    assert sorted((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_sha256"], x["k"]) for x in got) == sorted(want)


# --- quality rules


def test_base_counts_against_brute_force():
    r = random.Random(3)
    texts = [None, "", "a", "x\n\nx\n x\nx", "# $ %% é|<>&*"] + ["".join(r.choice(["a ", "b ", "é\t", "\n", "#", "c d e f g h i j "]) for _ in range(r.randint(0, 60))) for _ in range(60)]
    data, offsets = tb.text_bytes(pa.array(texts, pa.string()))
    ranges = tb.RangeHash(data)
    words = quality_rules.words_of(data, offsets, ranges)
    got = quality_rules.base_counts(data, offsets, ranges, words)
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        rep = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert [int(got[c][i]) for c in quality_rules.COUNTS] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep)]


def test_quality_model_on_held_out_rows(spark):
    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "river", "runs", "past", "quiet", "houses", "and"]) for _ in range(40))
    bad = lambda: " ".join(r.choice(["BUY", "NOW!!", "$$$", "win", "free", "click"]) for _ in range(40))
    docs = [(i, bad() if i % 4 == 0 else good(), "x") for i in range(400)] + [(900, None, "x"), (901, "", "x"), (902, "short", "x")]
    labels = [(i, int(i % 4 != 0), 0) for i in range(300)] + [(None, 1, 0), (7, None, 0)]
    got = {x["doc_id"]: x for x in quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [got[i] for i in range(300, 400) if not got[i]["base_failed"]]
    assert len(held) > 50 and all(x["kept"] == (x["doc_id"] % 4 != 0) for x in held)
    assert not any(got[i]["kept"] for i in (900, 901, 902))
    other = spark.createDataFrame([(f"d{x[0]}", x[1]) for x in docs], "doc_id string, body string")
    named = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(other, spark.createDataFrame([(f"d{i}", q) for i, q, _ in labels if i is not None], "doc_id string, quality int"), text="body").collect()}
    assert all(named[f"d{i}"] == (i % 4 != 0) for i in range(300, 400) if not got[i]["base_failed"])
    none = quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, kept string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(x["kept"] != x["base_failed"] for x in none.collect())


# --- packing and token counts


def test_ids_equal_the_named_library():
    from tokenizers import Tokenizer

    class Held:
        value = open(tk.default_path(), "rb").read()

    named = Tokenizer.from_file(tk.default_path())
    named.encode_special_tokens = True
    for text in ["", "Hello  world", "été ñandú\n\n  x", "<|endoftext|> a", "it's 1,234.5 ###\t!", "\U0001f600 中文", "a" * 3000]:
        assert tk.encoder(Held)(text) == named.encode(text, add_special_tokens=False).ids


def test_added_tokens_equal_the_named_library_by_default(spark):
    from tokenizers import Tokenizer

    class Held:
        value = open(tk.default_path(), "rb").read()

    named = Tokenizer.from_file(tk.default_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>\n\n<|endoftext|><|endoftext|> y <|endoftext", "Hello  world \n"]
    want = [named.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    assert [tk.encoder(Held, added=True)(t) for t in texts] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["doc_tokens"] for x in packing.pack(rows).collect()}
    assert got == {i: len(ids) + 1 for i, ids in enumerate(want)}
    lengths = Counter({x["length"]: x["n_docs"] for x in token_counts.histogram(rows).collect()})
    assert lengths == Counter(map(len, want))


@pytest.mark.parametrize("run", [" ", "\n", "\t", "\r\n "])
def test_long_white_space_is_encoded_like_the_named_library(spark, run):
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(tk.default_path())
    texts = [run * (2_000_000 // len(run)), "some words" + run * (1_500_000 // len(run)) + "and more <|endoftext|> end"]
    want = [named.encode(t, add_special_tokens=False).ids for t in texts]
    share = tk.share(spark)
    assert [tk.encoder(share, added=True)(t) for t in texts] == want
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x["doc_id"]: x["doc_tokens"] for x in packing.pack(rows, with_ids=False).collect()} == {i: len(ids) + 1 for i, ids in enumerate(want)}
    assert {x["length"] for x in token_counts.histogram(rows).collect()} == {len(ids) for ids in want}


def test_one_long_labelled_text_moves_no_other_verdict(spark):
    r = random.Random(9)
    good = lambda n=40: " ".join(r.choice(["the", "river", "runs", "past", "quiet", "houses", "and"]) for _ in range(n))
    bad = lambda: " ".join(r.choice(["BUY", "NOW!!", "$$$", "win", "free", "click"]) for _ in range(40))
    docs, labels = [(i, bad() if i % 4 == 0 else good()) for i in range(300)], [(i, int(i % 4 != 0)) for i in range(300)]
    of = lambda more: {x["doc_id"]: x["p_low"] for x in quality_rules.quality_rules(spark.createDataFrame([*docs, *more], "doc_id long, text string"), spark.createDataFrame([*labels, *((i, 1) for i, _ in more)], "doc_id long, quality int")).collect()}
    plain = of([])
    assert max(plain.values()) - min(plain.values()) > 0.5
    # ids before and after the others in the sample's order, whatever that is
    long = of([(10_000 + i, good(100) * 15_000) for i in range(2)])
    assert len(long) == 302 and all(abs(long[i] - p) <= 0.05 for i, p in plain.items())


def test_packing_round_trip(spark):
    texts = [(1, "hello world " * 700), (2, None), (3, ""), (4, "one"), (4, "one"), (None, "two three")]
    rows = packing.pack(spark.createDataFrame([(*t, "s") for t in texts], "doc_id long, text string, start string")).collect()
    assert len({x["sequence_id"] for x in rows}) == len(rows)
    encode = packing.tk.encoder(packing.tk.share(spark))
    by = {}
    for x in rows:
        assert x["length"] & (x["length"] - 1) == 0 and x["length"] <= 1024 and x["offset"] == 0 and len(x["ids"]) == x["length"] == 1 << x["bucket"]
        by.setdefault(x["doc_id"], []).append(x)
    for i, text in texts[:4] + texts[5:]:
        pieces = sorted(by[i], key=lambda x: x["start"])
        ids = [t for x in pieces for t in x["ids"]]
        if i != 4:
            assert ids == [*encode(text or ""), 0] and all(x["doc_tokens"] == len(ids) for x in pieces)
            assert [x["start"] for x in pieces] == np.cumsum([0, *(x["length"] for x in pieces)])[:-1].tolist()
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_token_counts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    lengths = [0, 0, 1, 3, 3, 3, 7, 9, 30, 64]
    table = token_counts.limits(spark.createDataFrame(list(Counter(lengths).items()), "length long, n_docs long"))
    for x in table.collect():
        m = x["context_limit"]
        assert (x["docs_within"], x["docs_over"], x["truncated_tokens"]) == (sum(n <= m for n in lengths), sum(n > m for n in lengths), sum(min(n, m) for n in lengths))
        assert (x["total_docs"], x["total_tokens"], x["tokens_over"]) == (len(lengths), sum(lengths), sum(n for n in lengths if n > m))
    for x in token_counts.at_limits(table, [0, 2, 5, 8, 100]).collect():
        assert x["truncated_tokens"] == sum(min(n, x["context_limit"]) for n in lengths)
    assert {x["share"]: x["length"] for x in token_counts.quantiles(table, [0.5, 1.0]).collect()} == {0.5: 3, 1.0: 64}


# --- long texts, empty tables, nulls and clashes


def test_texts_longer_than_a_chunk(spark):
    """A text of over a chunk's bytes gives what its brute force gives, beside short ones."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    long = "\n".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(26_000)) + "\nfooter"
    assert len(long) > tb.CHUNK
    rows = spark.createDataFrame([(0, "short footer"), (1, long), (2, None), (3, "\nFOOTER"), (4, "footer ")], "doc_id long, text string")
    lines = {x["doc_id"]: (x["n_lines"], x["n_dropped"]) for x in line_dedup.line_dedup(rows, 3).collect()}
    assert lines == {0: (1, 0), 1: (26_001, 1), 2: (1, 0), 3: (2, 1), 4: (1, 1)}
    judged = {x["doc_id"]: x for x in quality_rules.quality_rules(rows, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert (judged[1]["n_words"], judged[1]["word_chars"]) == (26_000 * 12 + 1, len("".join(long.split())))
    item = " ".join(long.split()[200_000:200_010])
    clean = {x["doc_id"]: x["n_hit"] for x in decontaminate.decontaminate(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert clean == {0: 0, 1: 10, 2: 0, 3: 0, 4: 0}
    sizes = {x["doc_id"]: x["doc_tokens"] for x in packing.pack(rows, with_ids=False).collect()}
    assert sizes[1] == len(packing.tk.encoder(packing.tk.share(spark))(long)) + 1


def test_empty_tables_and_clashing_names(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_hit string, n_lines string, kept string, length string, n_chars string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c", "x"), (None, None, None), (1, "a b c", "x")], "doc_id long, text string, n_docs string")
    assert decontaminate.decontaminate(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    assert [x["n_hit"] for x in decontaminate.decontaminate(one, items).collect()] == [0, 0, 0]
    assert line_dedup.line_dedup(docs).count() == 0
    assert quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert packing.pack(docs).count() == 0
    assert token_counts.histogram(docs).count() == 0 and token_counts.limits(token_counts.histogram(docs)).count() == 0
    assert sum(x["n_docs"] for x in token_counts.histogram(one).collect()) == 3
    pages = spark.createDataFrame([], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([], "url string, label int")
    assert url_filter.judge(pages, labels).count() == 0
    again = url_filter.judge(spark.createDataFrame([("http://a.com/x", 1)] * 2, "url string, host int"), labels).collect()
    assert [(x["host"], x["verdict"]) for x in again] == [("a.com", "allow")] * 2


# --- html and urls


def test_words_inside_attribute_values_are_not_attributes():
    for head in ('title="a hidden gem"', "title='my class=menu list'", 'data-x="role=navigation" title="style=display:none"', 'alt="x" hiddenish class="body with-sidebar"', "title = 'id=ads' class = post"):
        assert html_text.main_text(f"<div><p {head}>A sentence that stays, as it should, in the text.</p></div>") == "A sentence that stays, as it should, in the text."
    for head in ("hidden", 'class="x menu"', "role = navigation", "class='side-bar'", 'title="ok" style="display: none"', "class=ads"):
        assert html_text.main_text(f"<div><p>Kept.</p><p {head}>Gone.</p></div>") == "Kept."


def test_extract_rows(spark):
    page = "<body><article><p>One, two.</p></article></body>"
    rows = [(1, "u", page, 7, "x"), (1, "u", page, 7, "x"), (2, None, None, None, None), (None, "v", "", 1, "y"), (3, "w", "<p>" + "long, text " * 150_000 + "</p>", 0, "z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()
    assert [(x["page_id"], x["url"], x["text"][:9], x["n_chars"]) for x in got] == [(1, "u", "One, two.", 9)] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "long, tex", len("long, text " * 150_000) - 1)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_main_text():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c -->'
        '<div class="ad">Buy, now, please.</div><article><h1>Head &amp; more</h1><p><b>First  para,\n with &eacute;<br><p>Second<i>ary</i> one.</p><ul><li>point</li></ul></article>'
        '<div id="comments"><p>Great, great, great post, thanks, really, I liked it very much indeed.</p></div><footer>&copy; x</footer></body></html>'
    )
    assert html_text.main_text(page) == "Head & more First para, with é Secondary one. point"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x</script>") == ""
    assert html_text.main_text("<p>a < b</p>") == "a < b"
    assert html_text.main_text("<body><article>bare text</article><nav>m") == "bare text"
    html_text.main_text("<a b='" * 300 + "<div>" * 3000)


def test_url_rules_and_model(spark):
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))
    cases = {
        "http://Example.COM/en/x": ("example.com", "/en/x", "example.com/en/", "block"), "https://a.www.example.com/en/": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "https://m.example.com/fr?x": ("m.example.com", "/fr", "com/", "allow"), "x://b.net/es/1#f": ("b.net", "/es/1", "net/es/", "block"), "nothing": ("", "", None, None),
        "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    }
    good = [(f"https://good{i}.org/news/{i}", 0) for i in range(60)]
    bad = [(f"https://spam{i}.org/casino/{i}", 1) for i in range(60)]
    pages = spark.createDataFrame([(u,) for u in cases] + [(None,), ("https://spam99.org/casino/7",), ("https://good99.org/news/7",)], "url string")
    got = {x["url"]: x for x in url_filter.judge(pages, spark.createDataFrame(good + bad, "url string, label int"), rules).collect()}
    for u, (host, path, rule, verdict) in cases.items():
        assert (got[u]["host"], got[u]["path"], got[u]["rule"]) == (host, path, rule)
        assert verdict is None or got[u]["verdict"] == verdict
    assert got["https://spam99.org/casino/7"]["verdict"] == "block" and got["https://good99.org/news/7"]["verdict"] == "allow"
    assert got[None]["host"] == ""

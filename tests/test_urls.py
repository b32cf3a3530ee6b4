import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.functions import url as u
from urlsieve.operators import urls
from urlsieve.sources import views


def test_normalize(spark):
    scheme, port, edge = ["", "http://", "HTTPS://"], ["", ":81", ":"], ["", "\t", " "]
    hosts = {"shop.Ulm.org": "shop.ulm.org", "[2001:DB8::5]": "[2001:db8::5]", "10.9.8.7": "10.9.8.7", "zoë.net": "zoë.net".encode("idna").decode(), "one-label": "one-label", "dot.end.": "dot.end."}
    tails = {"": "", "/Up/Low?K=V#F": "/Up/Low?K=V#F", "?": "", "#": "", "/ß?ü": "/ß?ü", "/a//b": "/a//b"}
    cases = {}
    for s in scheme:
        for p in port:
            for h, host in hosts.items():
                for t, tail in tails.items():
                    for user in ("", "Me:Pw@"):
                        raw = f"{edge[len(cases) % 3]}{s}{user}{h}{p}{t}{edge[len(cases) % 2]}"
                        cases[raw] = f"{s.lower() or 'https://'}{user}{host}{p if p != ':' else ''}{tail}"
    got = {r["url"]: (r["normalized_url"], r["url_error"]) for r in urls.normalize(spark.createDataFrame([(x,) for x in cases], "url string")).collect()}
    assert got == {raw: (want, None) for raw, want in cases.items()}
    again = {r["url"]: r["normalized_url"] for r in urls.normalize(spark.createDataFrame([(x,) for x in {*cases.values()}], "url string")).collect()}
    assert all(k == v for k, v in again.items())


def test_rejected_urls_and_why(spark):
    why = {
        None: "required", "": "required", "\t \n": "required", "w.org/" + "p" * 2042: "too_long", "https://w.org/" + "p" * 2040: "too_long", "w.org/a\tb": "characters", "w.o\x7frg": "characters",
        "mailto:me@w.org": "scheme", "tel:12": "scheme", "gopher://w.org": "scheme", "w.org:x": "malformed", "w.org:70000": "malformed", "http://[::1": "malformed", "http://": "host",
        "-w.org": "host", "w-.org": "host", "w..org": "host", "a_b.org": "host", "l" * 64 + ".org": "host", ".".join(["l" * 60] * 5): "host", "[12345::]": "host",
    }
    rows = spark.createDataFrame([(x,) for x in why], "url string")
    assert {r["url"]: r["url_error"] for r in urls.normalize(rows).collect()} == why
    assert {r["url"] for r in urls.normalize(spark.createDataFrame([("zoë.net",), ("w.org/ü",)], "url string"), idna=False).where("url_error = 'host'").collect()} == {"zoë.net"}


def test_registrable(spark):
    """Against a slow search through the rules."""
    rules = {(r, k): s for r, k, s in views.PSL_RULES}

    def suffix(labels, sections):
        best = 0
        for n in range(1, len(labels) + 1):
            rule = ".".join(labels[-n:])
            if rules.get((rule, "exception")) in sections:
                return n - 1
            if rules.get((rule, "normal")) in sections:
                best = max(best, n)
            if rules.get((rule, "wildcard")) in sections and n < len(labels):
                best = max(best, n + 1)
        return best

    r = random.Random(3)
    ends = [x for x, _, _ in views.PSL_RULES] + ["zz", "foo.ck", "ck"]
    hosts = {".".join([r.choice(["www", "m", "a-b", "x1", "ck"]) for _ in range(r.randint(0, 3))] + [r.choice(ends)]) for _ in range(300)} | {"7.7.7.7", "::1", "host"}
    got = {x["host"]: x for x in urls.registrable(spark.createDataFrame([(h,) for h in hosts], "host string"), views.psl(spark)).collect()}
    for h in hosts:
        labels = h.split(".")
        n = 0 if h in ("7.7.7.7", "::1") else suffix(labels, ("icann", "private"))
        whole = not n or n >= len(labels)
        assert (got[h]["registrable_domain"], got[h]["subdomain"]) == ((h, "") if whole else (".".join(labels[-n - 1 :]), ".".join(labels[: -n - 1]))), h
        assert got[h]["private_suffix"] == (not whole and suffix(labels, ("icann",)) != n), h


def test_internal_hosts(spark):
    """Against the standard library's table of addresses, in all the ways to write one."""
    r = random.Random(6)
    edges = [int(ipaddress.IPv4Address(x)) for low_high in urls.RESERVED for x in low_high]
    numbers = {n for e in edges for n in (e - 1, e, e + 1) if 0 <= n < 1 << 32} | {r.randrange(1 << 32) for _ in range(100)}
    outside = {int(ipaddress.IPv4Address(x)) for x in ("192.0.0.9", "192.0.0.10")}
    want = {}
    for n in numbers:
        a = ipaddress.IPv4Address(n)
        inside = n not in outside and (not a.is_global or a.is_multicast)
        q = [n >> 24, n >> 16 & 255, n >> 8 & 255, n & 255]
        for text in (str(a), str(n), hex(n), f"{q[0]}.{n & 0xFFFFFF}", f"0x{q[0]:x}.0{q[1]:o}.{n & 0xFFFF}", f"::ffff:{a}", f"[::FFFF:{a}]"):
            want[text] = inside
    want |= {"router": True, "localhost": True, "x.localhost": True, "tv.lan": True, "box.home.arpa": True, "wiki.internal": True, "cam.local.": True, "::1": True, "fe80::1": True, "fc00::2": True, "ff02::1": True}
    want |= {"lan.org": False, "local.example": False, "256.1.1.1.org": False, "2a00:1450::8": False, "1.2.3.4.5": False, "08.org": False, "1..2": False}
    rows = spark.createDataFrame([(h,) for h in want], "host string").select("host", urls.is_internal(F.col("host")).alias("x")).collect()
    assert {x["host"]: x["x"] for x in rows} == want


def test_the_policy_plan_stays_small(spark):
    rows = spark.createDataFrame([("w.org",)], "url string")
    assert len(urls.policy(rows)._jdf.queryExecution().executedPlan().toString()) < 100_000


def features_of(spark, url, prior=(("com", 0.5), ("dev", 0.0009613))):
    df = spark.createDataFrame([(url,)], "model_input string")
    return urls.with_features(df, spark.createDataFrame(list(prior), "tld string, p double")).first()


def test_feature_values(spark):
    # fixed values: a published row of feature values
    f = features_of(spark, "https://sh5sss.webwave.dev/")
    want = {"URLLength": 27, "DomainLength": 18, "TLDLength": 3, "NoOfSubDomain": 1, "NoOfLettersInURL": 15, "LetterRatioInURL": 0.556, "NoOfDegitsInURL": 1, "DegitRatioInURL": 0.037, "NoOfOtherSpecialCharsInURL": 3, "SpacialCharRatioInURL": 0.111, "TLDLegitimateProb": 0.0009613, "IsHTTPS": 1, "IsDomainIP": 0}
    assert {k: f[k] for k in want} == want
    assert f["CharContinuationRate"] == pytest.approx(0.642857143, abs=1e-6)
    assert tuple(c for c in f.asDict() if c != "model_input") == feat.NAMES


def test_features_of_odd_urls(spark):
    f = features_of(spark, "http://9.8.7.6.example.com/p%20q?x=1&y=%41")
    assert (f["IsDomainIP"], f["NoOfSubDomain"], f["NoOfAmpersandInURL"], f["NoOfEqualsInURL"], f["NoOfQMarkInURL"], f["IsHTTPS"], f["TLDLegitimateProb"]) == (1, 4, 2, 2, 1, 0, 0.5)
    f = features_of(spark, "https://nodots")
    assert (f["TLDLength"], f["NoOfSubDomain"], f["TLDLegitimateProb"]) == (0, 0, 0.0)
    assert features_of(spark, "https://w.COM/")["TLDLegitimateProb"] == 0.5


def test_views_ignore_what_they_drop(spark):
    same = ["https://shop.ulm.org/a?b", "http://www.ulm.org:81", "https://x:y@a.b.ulm.org#z"]
    rows = spark.createDataFrame([(x,) for x in same], "url string")
    assert {r["model_input"] for r in urls.model_input(urls.normalize(rows), "registrable", views.psl(spark)).collect()} == {"https://www.ulm.org"}
    host = urls.model_input(urls.normalize(spark.createDataFrame([("ftp@WWW.Ulm.org:90/x",)], "url string")), "host").first()
    assert host["model_input"] == "https://www.ulm.org:90"
    with pytest.raises(ValueError):
        urls.model_input(rows, "other")


def test_redaction(spark):
    cases = {
        "https://w.org/p?k=v&l=&m#f": "https://w.org/p?k=[redacted]&l=[redacted]&m=[redacted]",
        "http://me:secret@w.org:81/": "http://me@w.org:81/",
        "https://w.org/p/q": "https://w.org/p/q",
        "https://w.org/?&&": "https://w.org/?[redacted]",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", u.redact(F.col("url")).alias("x")).collect()
    assert {r["url"]: r["x"] for r in rows} == cases

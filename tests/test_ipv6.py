import ipaddress
import random

from pyspark.sql import functions as F

from urlsieve.functions import ipv6
from urlsieve.operators import urls


def spellings(r, value):
    """An address in some of the ways to write it."""
    a = ipaddress.IPv6Address(value)
    groups = [f"{value:032x}"[i : i + 4] for i in range(0, 32, 4)]
    yield a.compressed
    yield ":".join(groups).upper()
    yield ":".join(g.lstrip("0") or "0" for g in groups)
    four = str(ipaddress.IPv4Address(value & 0xFFFFFFFF))
    yield ":".join([*groups[:6], four])
    runs = [(i, j) for i in range(8) for j in range(i + 1, 9) if all(g == "0000" for g in groups[i:j])]
    for i, j in r.sample(runs, min(3, len(runs))):
        yield ":".join(groups[:i]) + "::" + ":".join(groups[j:])
    if value >> 32 == 0xFFFF:
        yield f"::ffff:{four}"
        yield f"::FFFF:{four}"


def literals(n=10_000):
    r, out = random.Random(11), set()
    nets = [ipaddress.ip_network(x) for x in ("::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "64:ff9b::/96", "100::/64", "2001::/23", "2001:1::/64", "2001:3::/32", "2001:4:112::/48", "2001:20::/27", "2001:30::/28", "2001:db8::/32", "2002::/16", "fc00::/7", "fe00::/9", "fe80::/10", "fec0::/10", "ff00::/8", "3fff::/20", "5f00::/16", "2000::/3", "::/0")]
    four = [int(ipaddress.IPv4Address(x)) for x in ("127.0.0.1", "10.1.2.3", "8.8.8.8", "100.64.0.1", "192.0.0.9", "192.0.0.8", "224.0.0.1", "255.255.255.255", "169.254.1.1")]
    while len(out) < n:
        net = r.choice(nets)
        size = 128 - net.prefixlen
        low = r.choice([0, 1, 2, (1 << size) - 1, r.getrandbits(128), r.getrandbits(16), *((x for x in four))]) & ((1 << size) - 1)
        value = int(net.network_address) + low
        for x in spellings(r, min(max(0, value + r.choice([0, 0, 0, -1, 1])), (1 << 128) - 1)):
            out.add(x)
    return sorted(out)


BAD = ["", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8:9", "::1:2:3:4:5:6:7:8", "12345::", "g::1", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "::256.1.1.1", "::1.2.3", "::01.2.3.4", "1.2.3.4::", "1:2:3:4:5:6:7:1.2.3.4", "::1%", "a.b", " ::1"]
GOOD = ["fe80::1%eth0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::", "1:2:3:4:5:6:1.2.3.4"]


def test_numbers_equal_the_standard_library(spark):
    rows = [*literals(), *GOOD]
    got = spark.createDataFrame([(x,) for x in [*rows, *BAD]], "x string").select("x", ipv6.number(F.col("x")).alias("n")).collect()
    for x, n in got:
        if x in BAD:
            assert n is None, x
        else:
            assert ((n["high"] & (1 << 64) - 1) << 64) + (n["low"] & (1 << 64) - 1) == int(ipaddress.ip_address(x.split("%")[0])), x


def test_internal_addresses_equal_the_standard_library(spark):
    def internal(x):
        ip = ipaddress.ip_address(x)
        ip = ip.ipv4_mapped or ip
        return not ip.is_global or ip.is_multicast

    rows = literals()
    df = spark.createDataFrame([(x, internal(x)) for x in rows], "x string, want boolean")
    wrong = df.where(urls.is_internal(F.col("x")) != F.col("want")).collect() + df.where(urls.is_internal(F.concat(F.lit("["), "x", F.lit("]"))) != F.col("want")).collect()
    assert len(rows) >= 10_000 and 2000 < df.where("want").count() < 9000 and wrong == []
    bad = spark.createDataFrame([("[::zz]", True), ("[1::2::3.x.com]", False)], "x string, want boolean")
    assert all(r["want"] == r["got"] for r in bad.select("want", urls.is_internal(F.col("x")).alias("got")).collect())

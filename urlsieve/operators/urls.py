"""Operators over tables of urls: normalisation with IDNA, registrable domains, model inputs, host policy, features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.functions import ipv6
from urlsieve.functions import url as u

#: A fitted lookup table of at most so many rows is sent along with the plan; beyond, the join is left to the optimizer.
LOCAL_ROWS = 200_000


def fitted(df: DataFrame) -> DataFrame:
    """A lookup table (a prior, suffix rules) as literal rows, if it is proven small: it is computed once, and the optimizer
    knows its size and broadcasts it. A larger one stays as it is."""
    rows = df.limit(LOCAL_ROWS + 1).toArrow()  # bounded
    return df.sparkSession.createDataFrame(rows) if rows.num_rows <= LOCAL_ROWS else df


def normalize(df: DataFrame, column: str = "url", max_length: int = u.MAX_LENGTH, idna: bool = True) -> DataFrame:
    """``df`` with ``normalized_url`` (null if invalid), ``url_error`` (null if valid) and ``scheme_assumed``.

    Everything is native; only rows whose host goes beyond ASCII take the way through Python's IDNA codec, and with
    ``idna=False`` these are invalid hosts."""
    raw = F.col(column)
    plain = F.coalesce(raw.rlike(r"^[\x00-\x7f]*$"), F.lit(True))

    def judged(rows: DataFrame, host=None) -> DataFrame:
        found = rows.withColumn("_n", u.normal(raw, max_length, host))
        return found.select(*df.columns, F.col("_n.url").alias("normalized_url"), F.col("_n.error").alias("url_error"), (~u.has_scheme(raw)).alias("scheme_assumed"))

    if not idna:
        return judged(df)
    rest = df.where(~plain).withColumn("_host", u.hostname(u.completed(raw)))
    rest = rest.mapInPandas(_to_idna, rest.schema)
    return judged(df.where(plain)).union(judged(rest, F.coalesce("_host", F.lit(""))))


def _to_idna(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def one(host: str) -> str:
        try:
            return host.encode("idna").decode("ascii")
        except UnicodeError:
            return ""

    for frame in frames:
        yield frame.assign(_host=frame["_host"].map(one))


def suffix_matches(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, n_labels, suffix_len, icann_len`` of distinct ``host`` rows: labels of the longest public suffix with all rules
    and with ICANN's alone. ``rules``: ``rule, kind`` (normal, wildcard, exception), ``section`` (icann, private)."""
    labels = hosts.select("host", F.split("host", r"\.").alias("l")).withColumn("n", F.size("l"))
    each = labels.select("host", "n", F.explode(F.sequence(F.lit(1), "n")).alias("k"), "l").withColumn("rule", F.array_join(F.slice("l", F.col("n") - F.col("k") + 1, F.col("k")), "."))
    met = each.select("host", "n", "k", "rule").join(fitted(rules), "rule")
    size = F.when(F.col("kind") == "normal", F.col("k")).when(F.col("kind") == "exception", F.col("k") - 1).when(F.col("k") < F.col("n"), F.col("k") + 1)
    # an exception beats all others; else the longest
    rank = F.when(size.isNotNull(), F.when(F.col("kind") == "exception", F.lit(1000)).otherwise(0) + size)
    best = lambda own: F.max(F.when(own, rank)) % 1000
    exception = F.max(F.when(F.col("kind") == "exception", F.col("k") - 1))
    return met.groupBy("host", F.col("n").alias("n_labels")).agg(
        F.coalesce(exception, best(F.lit(True))).alias("suffix_len"), F.coalesce(exception, best(F.col("section") == "icann")).alias("icann_len")
    )


def registrable(df: DataFrame, rules: DataFrame, column: str = "host") -> DataFrame:
    """``df`` with ``registrable_domain``, ``subdomain`` and ``private_suffix`` of a lower-case host.

    Hosts without one (addresses, single labels, unknown suffixes) are their own registrable domain with an empty subdomain.
    Distinct hosts are matched once and joined back."""
    bare = F.regexp_replace(F.regexp_replace(F.col(column), r"^\[|\]$", ""), r"\.+$", "")
    hosts = df.select(bare.alias("host")).where("host <> ''").where(~u.is_ip(F.col("host"))).distinct()
    found = suffix_matches(hosts, rules).where("n_labels > suffix_len")
    parts = F.split("host", r"\.")
    cut = F.col("n_labels") - F.col("suffix_len")
    found = found.select(
        F.col("host").alias("_host"),
        F.array_join(F.slice(parts, cut, F.col("suffix_len") + 1), ".").alias("_reg"),
        F.when(cut > 1, F.array_join(F.slice(parts, F.lit(1), cut - 1), ".")).otherwise("").alias("_sub"),
        (F.col("suffix_len") != F.coalesce("icann_len", F.lit(0))).alias("_private"),
    )
    return df.withColumn("_bare", bare).join(found, F.col("_bare") == F.col("_host"), "left").select(
        *df.columns, F.coalesce("_reg", "_bare").alias("registrable_domain"), F.coalesce("_sub", F.lit("")).alias("subdomain"),
        F.col("_reg").isNotNull().alias("has_suffix"), F.coalesce("_private", F.lit(False)).alias("private_suffix"),
    )


def model_input(df: DataFrame, view: str, rules: DataFrame | None = None, column: str = "normalized_url") -> DataFrame:
    """``df`` with ``model_input`` in the view ``full``, ``host`` or ``registrable``."""
    url = F.col(column)
    if view == "full":
        return df.withColumn("model_input", url)
    if view == "host":
        return df.withColumn("model_input", u.model_host(url))
    if view != "registrable":
        raise ValueError(f"unknown view: {view!r}")
    keyed = df.withColumn("_h", u.hostname(url))
    found = registrable(keyed, rules, "_h")
    return found.withColumn("model_input", F.concat(F.lit("https://www."), F.regexp_replace("registrable_domain", r"^www\.", ""))).select(*df.columns, "model_input")


def with_features(df: DataFrame, prior: DataFrame, column: str = "model_input") -> DataFrame:
    """``df`` with the features. ``prior``: ``tld, p`` with lower-case TLDs."""
    source = F.col(column)
    keyed = df.withColumn("_tld", F.lower(feat.tld(source)))
    joined = keyed.join(fitted(prior.select(F.col("tld").alias("_t"), F.col("p").alias("_p"))), F.col("_tld") == F.col("_t"), "left")
    # the parts are a column of their own, which keeps the optimizer from repeating them in each feature
    parted = joined.withColumn("_f", feat.parts(source))
    return parted.select(*df.columns, *(c.alias(n) for n, c in feat.vector(source, F.col("_f"), F.col("_p")).items()))


def extract(df: DataFrame, prior: DataFrame, view: str = "registrable", rules: DataFrame | None = None, column: str = "url", idna: bool = True) -> DataFrame:
    """The whole path: normalise, drop invalid urls, model input, features."""
    valid = normalize(df, column, idna=idna).where(F.col("url_error").isNull()).drop("url_error")
    return with_features(model_input(valid, view, rules), prior)


def violations(df: DataFrame) -> DataFrame:
    """``feature, rows, not_finite, below, above`` of a feature table; raises if a feature is missing or of the wrong kind."""
    kinds = dict(df.dtypes)
    for name, kind, *_ in feat.SCHEMA:
        if name not in kinds or (kinds[name] not in ("int", "bigint")) != (kind == "double"):
            raise ValueError(f"{name}: expected {kind}, got {kinds.get(name)}")
    checks = []
    for name, _, low, high, _ in feat.SCHEMA:
        c = F.col(name).cast("double")
        checks.append(F.struct(
            F.lit(name).alias("feature"), F.count("*").alias("n"),
            F.count_if(c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf"))).alias("not_finite"),
            F.count_if(c < low).alias("below"), (F.count_if(c > high) if high is not None else F.lit(0).cast("long")).alias("above"),
        ))
    return df.agg(F.array(*checks).alias("a")).select(F.inline("a"))


#: IPv4 ranges that are not global, as first and last address; 192.0.0.9 and 192.0.0.10 are global.
RESERVED = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.64.0.0", "100.127.255.255"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"), ("192.0.0.11", "192.0.0.255"),
    ("192.0.2.0", "192.0.2.255"), ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"), ("224.0.0.0", "239.255.255.255"), ("240.0.0.0", "255.255.255.255"),
)
INTERNAL_NAME = r"\.(localhost|local|internal|lan|home\.arpa)$"


def address(host):
    """The IPv4 address that a host denotes as a number: dotted quads and browsers' shorthands (one to four parts, decimal,
    octal or hexadecimal, the last filling the rest); else null."""
    number = lambda x: F.when(x.rlike(r"^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(x, 3, 8), 16, 10)).when(x.rlike(r"^0[0-7]{1,11}$"), F.conv(x, 8, 10)).when(x.rlike(r"^(0|[1-9][0-9]{0,9})$"), x).try_cast("bigint")
    def joined(values):
        n, last = F.size(values), F.element_at(values, -1)
        lead = F.aggregate(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.lit(0).cast("bigint"), lambda acc, x: F.when(x <= 255, acc * 256 + x))
        room = F.element_at(F.array(*(F.lit(1 << 8 * k) for k in (4, 3, 2, 1))), n)
        return F.when((n <= 4) & (last < room), lead * room + last)

    # other hosts are told apart before they are cut into parts
    return F.when(host.rlike(r"^[0-9a-fA-FxX]+(\.[0-9a-fA-FxX]+){0,3}$"), u.let(F.transform(F.split(host, r"\."), number), joined))


def is_internal(host):
    """Local, private, reserved or multicast addresses, single labels and internal names."""
    value = lambda a: sum(int(x) << 8 * (3 - i) for i, x in enumerate(a.split(".")))
    ranges = F.array(*(F.struct(F.lit(value(low)).cast("bigint").alias("low"), F.lit(value(high)).cast("bigint").alias("high")) for low, high in RESERVED))

    def judged(bare):
        name = (bare == "localhost") | ~bare.contains(".") | bare.rlike(INTERNAL_NAME)
        four = lambda number: F.exists(ranges, lambda r: number.between(r["low"], r["high"]))
        inside = lambda six: F.when(six.isNotNull(), F.coalesce(four(ipv6.mapped(six)), ipv6.is_special(six))).otherwise(name)
        return u.let(address(bare), lambda number: F.when(number.isNotNull(), four(number)).otherwise(u.let(ipv6.number(bare), inside)))

    # a name in brackets has a colon, so brackets make no difference to names
    return F.coalesce(u.let(F.regexp_replace(F.lower(host), r"\.+$|^\[|\]\.*$", ""), judged), F.lit(True))


def policy(df: DataFrame, column: str = "url", max_length: int = u.MAX_LENGTH, allow_internal: bool = False) -> DataFrame:
    """``df`` with ``normalized_url`` and ``error_code``: URL_TOO_LONG, UNSUPPORTED_SCHEME, INVALID_URL, UNSUPPORTED_HOST, or null."""
    judged = normalize(df, column, max_length)
    host = u.hostname(F.col("normalized_url"))
    code = (
        F.when(F.length(column) > max_length, "URL_TOO_LONG")
        .when(F.col("url_error") == "scheme", "UNSUPPORTED_SCHEME")
        .when(F.col("url_error").isNotNull(), "INVALID_URL")
        .when(F.lit(not allow_internal) & is_internal(host), "UNSUPPORTED_HOST")
    )
    return judged.withColumn("error_code", code).drop("url_error", "scheme_assumed")


def check_requests(df: DataFrame, column: str = "body") -> DataFrame:
    """Scan requests as JSON text: ``url, source, record`` and ``request_error`` (INVALID_JSON, UNEXPECTED_FIELD, MISSING_URL,
    INVALID_TYPE, INVALID_FIELD, or null). ``source`` defaults to api, ``record`` to true."""
    body = F.col(column)
    keys = F.json_object_keys(body)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), f"$.{k}", "variant"))
    text = lambda k: F.get_json_object(body, f"$.{k}")
    has = lambda k: F.array_contains(keys, k)
    null = lambda k: ~has(k) | (kind(k) == "VOID")
    error = (
        F.when(keys.isNull() | F.try_parse_json(body).isNull(), "INVALID_JSON")
        .when(F.size(F.array_except(keys, F.array(*map(F.lit, ("url", "source", "record"))))) > 0, "UNEXPECTED_FIELD")
        .when(null("url"), "MISSING_URL")
        .when(kind("url") != "STRING", "INVALID_TYPE")
        .when(u.trimmed(text("url")) == "", "MISSING_URL")
        .when(has("source") & ~F.coalesce(text("source").isin("web", "extension", "api"), F.lit(False)), "INVALID_FIELD")
        .when(has("record") & (kind("record") != "BOOLEAN"), "INVALID_TYPE")
    )
    good = error.isNull()
    return df.withColumns({
        "request_error": error, "scan_url": F.when(good, text("url")), "scan_source": F.when(good, F.coalesce(text("source"), F.lit("api"))),
        "record": F.when(good, F.coalesce(text("record") == "true", F.lit(True))),
    })


def structure_groups(df: DataFrame) -> DataFrame:
    """``df`` (with ``subdomain, private_suffix``) and the flags of structural subsets."""
    sub = ~F.col("subdomain").isin("", "www")
    return df.withColumns({"has_subdomain": sub, "shared_hosting": F.col("private_suffix"), "plain": ~sub & ~F.col("private_suffix")})


#: Words that phishing hosts often contain.
KEYWORDS = ("login", "secure", "account", "verify", "update", "bank", "pay", "support", "service", "signin", "wallet", "auth", "confirm", "billing", "help", "mail")


def host_lexical(host) -> dict:
    """Diagnostic columns of a host: hyphens, entropy, vowel ratio, longest consonant run, keyword hits."""
    core = F.when(host.contains("."), F.regexp_extract(host, r"^(.*)\.", 1)).otherwise(host)
    n = F.length(core)
    letters = F.regexp_replace(core, "[^a-z]", "")
    chars = F.split(core, "")
    # entropy over positions: each adds the log share of its own character
    share = lambda c: (n - F.length(F.replace(core, c, F.lit("")))) / n
    entropy = F.when(n > 0, -F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + F.log2(share(c)) / n)).otherwise(0.0)
    runs = F.transform(F.regexp_extract_all(core, F.lit("[b-df-hj-np-tv-z]+"), F.lit(0)), F.length)
    return {
        "hyphens": F.regexp_count(core, F.lit("-")),
        "entropy": entropy,
        "vowel_ratio": F.when(letters != "", F.regexp_count(letters, F.lit("[aeiou]")) / F.length(letters)).otherwise(0.0),
        "max_consonant_run": F.coalesce(F.array_max(runs), F.lit(0)),
        "keyword_hits": sum((core.contains(k).cast("int") for k in KEYWORDS), F.lit(0)),
    }


def platform_parents(hosts: DataFrame, least: int = 20) -> DataFrame:
    """``parent, hosts``: parent domains of at least ``least`` distinct hosts."""
    return hosts.select("host").distinct().groupBy(u.parent_domain(F.col("host")).alias("parent")).agg(F.count("*").alias("hosts")).where(F.col("hosts") >= least)

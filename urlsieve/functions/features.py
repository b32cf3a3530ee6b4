"""The seventeen lexical features of a model input string, in schema order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name, type, least and greatest value (None: no bound), what it is.
SCHEMA = (
    ("URLLength", "int", 1, None, "characters of the input"),
    ("DomainLength", "int", 1, None, "characters of the host, with the www. that a view adds"),
    ("IsDomainIP", "int", 0, 1, "a dotted quad in the host, or an IPv6 literal at its start"),
    ("CharContinuationRate", "double", 0, 1, "longest letter, digit and symbol runs of the core over its length"),
    ("TLDLegitimateProb", "double", 0, 1, "prior of the top-level domain; 0 if unknown"),
    ("TLDLength", "int", 0, None, "characters of the last label"),
    ("NoOfSubDomain", "int", 0, None, "dots of the host less one, at least 0"),
    ("NoOfLettersInURL", "int", 0, None, "ASCII letters of the body"),
    ("LetterRatioInURL", "double", 0, 1, "these over the input's length, to three decimals"),
    ("NoOfDegitsInURL", "int", 0, None, "digits of the body"),
    ("DegitRatioInURL", "double", 0, 1, "these over the input's length, to three decimals"),
    ("NoOfEqualsInURL", "int", 0, None, "= in the body"),
    ("NoOfQMarkInURL", "int", 0, None, "? in the body"),
    ("NoOfAmpersandInURL", "int", 0, None, "% in the body, whatever the name says"),
    ("NoOfOtherSpecialCharsInURL", "int", 0, None, "neither letters, digits nor = ? % in the body"),
    ("SpacialCharRatioInURL", "double", 0, 1, "all special characters over the input's length, to three decimals"),
    ("IsHTTPS", "int", 0, 1, "https anywhere"),
)
NAMES = tuple(s[0] for s in SCHEMA)
#: Features of the source table that are left out.
EXCLUDED = (
    ("URLSimilarityIndex", "leaks the label"),
    ("URLCharProb", "needs a table that is not published"),
    ("HasObfuscation", "its rule cannot be recovered"),
    ("NoOfObfuscatedChar", "its rule cannot be recovered"),
    ("ObfuscationRatio", "derived from an excluded feature"),
)


def host(url: Column) -> Column:
    """Text after the scheme up to ``/ ? #``, userinfo and port included."""
    return F.regexp_extract(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"^([^/?#]*)", 1)


def tld(url: Column) -> Column:
    """The last label of the host, as it is written; empty without a dot."""
    h = host(url)
    return F.when(h.contains("."), F.substring_index(h, ".", -1)).otherwise("")


def ratio(count: Column, n: Column) -> Column:
    """``count / n`` to three decimals, rounded as decimal text is; 0 for an empty input."""
    return F.when(n > 0, F.format_number(count / n, 3).cast("double")).otherwise(0.0)


def _longest(pattern: str, text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)), F.lit(0))


def parts(url: Column) -> Column:
    """``struct(host, tld, core, body)``: the pieces that the features are computed from."""
    h = host(url)
    bare = F.regexp_replace(h, r"^www\.", "")
    body = F.replace(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), F.lit("www."), F.lit(""))
    core = F.when(bare.contains("."), F.regexp_extract(bare, r"(?s)^(.*)\.", 1)).otherwise(bare)
    return F.struct(h.alias("host"), tld(url).alias("tld"), core.alias("core"), body.alias("body"))


def vector(url: Column, pieces: Column, prior: Column) -> dict[str, Column]:
    """Name to column. ``pieces``: :func:`parts` as a column; ``prior``: the TLD's prior, null if unknown."""
    n = F.length(url)
    h, last, core, body = (pieces[x] for x in ("host", "tld", "core", "body"))
    count = lambda p: F.regexp_count(body, F.lit(p)).cast("int")
    letters, digits, equals, marks, percents, other = (count(p) for p in ("[A-Za-z]", r"\p{Nd}", "=", r"\?", "%", r"[^\p{L}\p{N}=?%]"))
    runs = sum((_longest(p, core) for p in ("[A-Za-z]+", "[0-9]+", "[^A-Za-z0-9]+")), F.lit(0))
    return {
        "URLLength": n,
        "DomainLength": F.length(h),
        "IsDomainIP": (h.rlike(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}") | F.substring_index(h, "@", -1).rlike(r"^\[[0-9a-fA-F:.]+\]")).cast("int"),
        "CharContinuationRate": F.when(core != "", runs / F.length(core)).otherwise(0.0),
        "TLDLegitimateProb": F.coalesce(prior.cast("double"), F.lit(0.0)),
        "TLDLength": F.length(last),
        "NoOfSubDomain": F.greatest(F.regexp_count(h, F.lit(r"\.")) - 1, F.lit(0)).cast("int"),
        "NoOfLettersInURL": letters,
        "LetterRatioInURL": ratio(letters, n),
        "NoOfDegitsInURL": digits,
        "DegitRatioInURL": ratio(digits, n),
        "NoOfEqualsInURL": equals,
        "NoOfQMarkInURL": marks,
        "NoOfAmpersandInURL": percents,
        "NoOfOtherSpecialCharsInURL": other,
        "SpacialCharRatioInURL": ratio(other + equals + marks + percents, n),
        "IsHTTPS": F.lower(url).contains("https").cast("int"),
    }

"""URL parsing, validation and facts as native column expressions.

A URL is split by two regular expressions instead of Spark's URI functions, which reject hosts with ``_`` and keep the case
of hosts.  Every function takes and returns columns; none calls Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LENGTH = 2048
#: Schemes that are urls without ``://`` but not web urls.
NON_WEB = r"(?i)^(javascript|data|vbscript|file|ftp|mailto|about|chrome|chrome-extension|blob|tel):"
_LABEL = r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
LDH = rf"^{_LABEL}(\.{_LABEL})*\.?$"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_H = r"[0-9A-Fa-f]{1,4}"
#: Full and compressed IPv6 literals, without embedded IPv4 and with it.
IPV6 = (
    rf"^(({_H}:){{7}}{_H}|({_H}:){{1,7}}:|({_H}:){{1,6}}:{_H}|({_H}:){{1,5}}(:{_H}){{1,2}}|({_H}:){{1,4}}(:{_H}){{1,3}}|({_H}:){{1,3}}(:{_H}){{1,4}}"
    rf"|({_H}:){{1,2}}(:{_H}){{1,5}}|{_H}:(:{_H}){{1,6}}|:((:{_H}){{1,7}}|:)|::([Ff]{{4}}:)?{_OCTET}(\.{_OCTET}){{3}}|({_H}:){{6}}{_OCTET}(\.{_OCTET}){{3}})$"
)
SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def trimmed(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^[\x09-\x0d\x1c-\x20]+|[\x09-\x0d\x1c-\x20]+$", "")


def has_scheme(raw: Column) -> Column:
    return F.coalesce(raw.contains("://"), F.lit(False))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host_port(url: Column) -> Column:
    """The authority without userinfo."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)", 1)


def userinfo(url: Column) -> Column:
    """Userinfo with its ``@``; empty without one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?", 1)


def tail(url: Column) -> Column:
    """Path, query and fragment."""
    return F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1)


def hostname(url: Column) -> Column:
    """Lower-case host without port and brackets."""
    return _name(host_port(url))


def _name(hp: Column) -> Column:
    return F.lower(F.when(hp.startswith("["), F.regexp_extract(hp, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(hp, r"^([^:]*)", 1)))


def port(url: Column) -> Column:
    """The port as an int; null without one."""
    digits = F.regexp_extract(host_port(url), r":(\d+)$", 1)
    return F.when(digits != "", digits.cast("bigint").cast("int"))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^#]*#(.*)$", 1)


def is_ip(host: Column) -> Column:
    """An IPv4 address of four octets without leading zeros, or an IPv6 literal."""
    bare = F.regexp_replace(host, r"^[\[\]]+|[\[\]]+$", "")
    return bare.rlike(IPV4) | bare.rlike(IPV6)


def completed(raw: Column) -> Column:
    """Trimmed; ``https://`` before a url without a scheme."""
    return let(trimmed(raw), _completed)


def _completed(t: Column) -> Column:
    return F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), F.regexp_replace(t, r"^/+", "")))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it: a transform of a one-element array.

    Without it, each use would repeat the whole expression, and filters pushed below a projection repeat it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal(raw: Column, max_length: int = MAX_LENGTH, host: Column | None = None) -> Column:
    """``struct(error, url)``: the normalised url, or why ``raw`` is no web url: ``required, too_long, characters, scheme,
    malformed, host``, in that order of checks.

    Scheme and host are lower-cased and an empty port dropped; userinfo, path, query and fragment stay. ``host``: the host in
    ASCII form where it is not the url's own; hosts beyond ASCII are invalid otherwise."""

    def checked(t: Column, url: Column, p: Column) -> Column:
        name = p["host"]
        number = F.when(p["digits"] != "", p["digits"].try_cast("int"))
        return (
            F.when(t.isNull() | (t == ""), "required")
            .when(F.length(t) > max_length, "too_long")
            .when(t.rlike(r"[\x00-\x20\x7f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"), "characters")
            .when(~t.contains("://") & t.rlike(NON_WEB), "scheme")
            .when(~p["hp"].rlike(r"^(\[[^\[\]]*\]|[^:\[\]]*)(:\d*)?$") | (F.length(p["digits"]) > 9) | (number > 65535), "malformed")
            .when(~p["scheme"].isin("http", "https"), "scheme")
            .when(~(F.when(p["hp"].startswith("["), name.rlike(IPV6)).otherwise(name.rlike(LDH)) & (F.length(name) <= 253)), "host")
        )

    def rebuilt(url: Column, p: Column) -> Column:
        netloc = F.when(p["host"].contains(":"), F.concat(F.lit("["), p["host"], F.lit("]"))).otherwise(p["host"])
        number = F.when(p["digits"] != "", F.concat(F.lit(":"), p["digits"].try_cast("int").cast("string"))).otherwise("")
        # an empty query or fragment loses its mark
        rest = F.regexp_replace(F.regexp_replace(tail(url), r"#$", ""), r"\?(#|$)", "$1")
        return F.concat(p["scheme"], F.lit("://"), userinfo(url), netloc, number, rest)

    def parts(url: Column) -> Column:
        return let(host_port(url), lambda hp: F.struct(
            hp.alias("hp"),
            F.lower(F.regexp_extract(url, SCHEME, 1)).alias("scheme"),
            F.regexp_extract(hp, r":(\d+)$", 1).alias("digits"),
            (_name(hp) if host is None else host).alias("host"),
        ))

    def result(t: Column, url: Column, p: Column) -> Column:
        return let(F.struct(checked(t, url, p).alias("e"), rebuilt(url, p).alias("u")), lambda r: let(
            F.coalesce(r["e"], F.when(F.length(r["u"]) > max_length, "too_long")), lambda e: F.struct(e.alias("error"), F.when(e.isNull(), r["u"]).alias("url"))))

    return let(trimmed(raw), lambda t: let(_completed(t), lambda url: let(parts(url), lambda p: result(t, url, p))))


def normalized(raw: Column, max_length: int = MAX_LENGTH) -> Column:
    """The normalised url, null where it is invalid; hosts beyond ASCII are invalid here (see ``operators.urls.normalize``)."""
    return normal(raw, max_length)["url"]


def model_host(url: Column) -> Column:
    """Host view: ``https://www.`` and the host with its port, without userinfo and one leading ``www.``."""
    return F.concat(F.lit("https://www."), F.regexp_replace(F.regexp_extract(authority(url), r"([^@]*)$", 1), r"^www\.", ""))


def parent_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def redact(url: Column) -> Column:
    """Password and fragment dropped, query keys kept and re-quoted, values replaced; a query without pairs becomes ``[redacted]``."""
    user = F.regexp_extract(userinfo(url), r"^([^:@]*)", 1)
    host = F.regexp_extract(authority(url), r"([^@]*)$", 1)
    netloc = F.when(authority(url).contains("@"), F.concat(user, F.lit("@"), host)).otherwise(host)
    pairs = F.filter(F.split(query(url), "&"), lambda x: x != "")
    quoted = lambda k: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(k), k)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    keys = F.array_join(F.transform(pairs, lambda x: F.concat(F.replace(quoted(F.regexp_extract(x, r"^([^=]*)", 1)), F.lit("%7E"), F.lit("~")), F.lit("=[redacted]"))), "&")
    asked = F.when(query(url) == "", "").when(keys == "", "?[redacted]").otherwise(F.concat(F.lit("?"), keys))
    return F.concat(F.lower(F.regexp_extract(url, SCHEME, 1)), F.lit("://"), netloc, path(url), asked)


def defang(url: Column) -> Column:
    """``hxxp`` for the first ``http``, ``[.]`` for each dot."""
    return F.replace(F.regexp_replace(url, r"(?s)^(.*?)http", "$1hxxp"), F.lit("."), F.lit("[.]"))


def origin(url: Column) -> Column:
    """``scheme://host[:port]``; null for others than web urls."""
    return F.when(F.lower(F.regexp_extract(url, SCHEME, 1)).isin("http", "https"), F.lower(F.concat(F.regexp_extract(url, SCHEME, 1), F.lit("://"), host_port(url))))


#: Why a page of such a scheme cannot be scanned.
SCHEME_REASONS = {
    "about": "browser page", "chrome": "browser page", "chrome-search": "browser page", "chrome-untrusted": "browser page", "chrome-extension": "extension page",
    "devtools": "browser page", "edge": "browser page", "view-source": "browser page", "file": "local file", "blob": "in-memory page",
    "data": "in-memory page", "javascript": "script", "ftp": "not a web page",
}


def unsupported_reason(url: Column) -> Column:
    """Why the url's scheme cannot be scanned, null if it can."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    table = F.create_map(*[F.lit(x) for kv in SCHEME_REASONS.items() for x in kv])
    return F.when(scheme.isin("http", "https"), None).otherwise(F.coalesce(table[scheme], F.lit("not a web page")))


def shape(url: Column) -> dict[str, Column]:
    """Path or query, http, and PHP or WordPress paths."""
    return {
        "has_path_or_query": ~path(url).isin("", "/") | (query(url) != ""),
        "scheme_http": url.startswith("http://"),
        "php_or_wp_path": url.rlike(r"(?i)\.php|wp-|/wp/"),
    }


def homepage_rule(url: Column) -> Column:
    """The rule baseline's score: 0 for a bare ``https://www.`` homepage, else 1."""
    return F.when(url.rlike(r"^https://www\.[^/?#]+$"), 0).otherwise(1)


def facts(url: Column) -> dict[str, Column]:
    """Structural facts of a normalised url; registrable domain and subdomain come from ``operators.registrable``."""
    host, number = hostname(url), port(url)
    return {
        "scheme": F.regexp_extract(url, SCHEME, 1),
        "host": host,
        "port": number,
        "non_standard_port": F.coalesce(~number.isin(80, 443), F.lit(False)),
        "has_userinfo": authority(url).contains("@"),
        "is_ip_literal": is_ip(host),
        "is_punycode": host.rlike(r"(^|\.)xn--"),
        "hyphen_in_host": host.contains("-"),
        "has_www": host.startswith("www."),
        "has_path": ~path(url).isin("", "/"),
        "has_query": query(url) != "",
        "has_fragment": fragment(url) != "",
    }

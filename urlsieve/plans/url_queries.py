"""Queries over urls: normalisation, facts, views and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.functions import url as u
from urlsieve.operators import datasets, parity, urls
from urlsieve.plans import sql as S
from urlsieve.plans.registry import query
from urlsieve.sources import views as V
from urlsieve.sources.tables import load, union_splits

SHAPE = ("has_path_or_query", "scheme_http", "php_or_wp_path")


def prior(spark, d):
    """``tld, p``: the share of legitimate labels of each top-level domain."""
    stored = V.labelled(spark, d).groupBy("tld").agg(F.avg("label").alias("p"))
    return datasets.tld_prior(stored)


def inputs(spark, d, view):
    return urls.model_input(urls.normalize(load(spark, d, "pages").select("page_id", "url"), idna=False).where("url_error is null"), view, V.psl(spark))


def featured(spark, d, view="host"):
    return urls.with_features(inputs(spark, d, view), prior(spark, d))


def labelled_features(spark, d, view="host"):
    """``id, label, y`` and the features of the labelled urls."""
    rows = V.labelled(spark, d).withColumn("y", (F.col("label") == 0).cast("int"))
    valid = urls.normalize(rows, idna=False).where("url_error is null")
    return urls.with_features(urls.model_input(valid, view, V.psl(spark)), prior(spark, d))


@query("select page_id, url, strlen(html)::bigint html_bytes from pages")
def load_pages(spark, d):
    return load(spark, d, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("html_bytes"))


@query(S.with_("labelled") + "select id, url, label, case when label = 0 then 'bad' else 'good' end split from labelled")
def union_splits_all(spark, d):
    rows = V.labelled(spark, d).select("id", "url", "label")
    return union_splits({"bad": rows.where("label = 0"), "good": rows.where("label <> 0")})


@query(S.with_("messy", extra=S.NORMAL) + "select page_id, norm normalized_url, error url_error, contains(raw, '://') scheme_assumed from normal".replace("contains(raw, '://')", "not contains(raw, '://')"))
def url_normalize(spark, d):
    return urls.normalize(V.messy(spark, d), "raw").select("page_id", "normalized_url", "url_error", "scheme_assumed")


@query(S.with_("messy", extra=S.NORMAL) + rf"select page_id, hname host, regexp_matches(hname, '{u.IPV4}') is_ip from normal where error is null")
def url_is_ip(spark, d):
    host = u.hostname(F.col("normalized_url"))
    return urls.normalize(V.messy(spark, d), "raw").where("url_error is null").select("page_id", host.alias("host"), u.is_ip(host).alias("is_ip"))


_REG = S.with_("messy", "psl", extra=S.NORMAL + ",\nhosts as (select page_id, hname host from normal where error is null),\n" + S.REGISTRABLE)


@query(_REG + "select page_id, host, coalesce(reg, host) registrable_domain, coalesce(sub, '') subdomain, reg is not null has_suffix from hosts left join reg using (host)")
def url_registrable(spark, d):
    rows = urls.normalize(V.messy(spark, d), "raw").where("url_error is null").select("page_id", u.hostname(F.col("normalized_url")).alias("host"))
    return urls.registrable(rows, V.psl(spark)).select("page_id", "host", "registrable_domain", "subdomain", "has_suffix")


@query(_REG + "select coalesce(private, false) private_suffix, count(*)::bigint urls, count(distinct host)::bigint hosts from hosts left join reg using (host) group by 1")
def url_shared_hosting(spark, d):
    rows = urls.normalize(V.messy(spark, d), "raw").where("url_error is null").select(u.hostname(F.col("normalized_url")).alias("host"))
    return urls.registrable(rows, V.psl(spark)).groupBy("private_suffix").agg(F.count("*").alias("urls"), F.count_distinct("host").alias("hosts"))


_PATH = r"regexp_extract(norm, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(norm, '^[^?#]*\?([^#]*)', 1)"


@query(
    S.with_("messy", extra=S.NORMAL)
    + rf"""select page_id, split_part(norm, '://', 1) scheme, hname host, case when digits <> '' then digits::int else -1 end port,
  coalesce(case when digits <> '' then digits::int end not in (80, 443), false) non_standard_port, contains(regexp_extract(norm, '://([^/?#]*)', 1), '@') has_userinfo,
  regexp_matches(hname, '{u.IPV4}') is_ip_literal, regexp_matches(hname, '(^|\.)xn--') is_punycode, contains(hname, '-') hyphen_in_host, starts_with(hname, 'www.') has_www,
  {_PATH} not in ('', '/') has_path, {_QUERY} <> '' has_query, regexp_extract(norm, '#(.*)$', 1) <> '' has_fragment from normal where error is null"""
)
def url_facts(spark, d):
    rows = urls.normalize(V.messy(spark, d), "raw").where("url_error is null")
    cols = u.facts(F.col("normalized_url"))
    cols["port"] = F.coalesce(cols["port"], F.lit(-1))
    return rows.select("page_id", *(c.alias(n) for n, c in cols.items()))


@query(S.with_("messy", extra=S.NORMAL) + r"select page_id, hname host, starts_with(hname, '192.168.') internal from normal where error is null")
def url_internal(spark, d):
    host = u.hostname(F.col("normalized_url"))
    return urls.normalize(V.messy(spark, d), "raw").where("url_error is null").select("page_id", host.alias("host"), urls.is_internal(host).alias("internal"))


@query(
    S.with_("messy", extra=S.NORMAL)
    + "select page_id, case when error = 'scheme' then 'UNSUPPORTED_SCHEME' when error is not null then 'INVALID_URL' when starts_with(hname, '192.168.') then 'UNSUPPORTED_HOST' end error_code from normal"
)
def url_policy(spark, d):
    return urls.policy(V.messy(spark, d), "raw").select("page_id", "error_code")


@query(
    """select event_id, case event_type when 'click' then 'UNEXPECTED_FIELD' when 'error' then 'INVALID_FIELD' when 'signup' then 'MISSING_URL' when 'purchase' then 'INVALID_TYPE' end request_error,
  case when event_type = 'view' then 'api' end scan_source, case when event_type = 'view' then (user_id % 2 = 0)::varchar end record from events"""
)
def request_validate(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    body = (
        F.when(kind == "click", F.lit('{"url": "a.com", "other": 1}')).when(kind == "error", F.lit('{"url": "a.com", "source": "fax"}')).when(kind == "signup", F.lit('{"url": " ", "source": "web"}'))
        .when(kind == "purchase", F.lit('{"url": 42}')).otherwise(F.concat(F.lit('{"url": "a.com/'), user.cast("string"), F.lit('", "record": '), (user % 2 == 0).cast("string"), F.lit("}")))
    )
    return urls.check_requests(load(spark, d, "events").withColumn("body", body)).select("event_id", "request_error", "scan_source", F.col("record").cast("string").alias("record"))


_HOST_INPUT = S.HOST_INPUT.format("norm")


@query(S.with_("messy", extra=S.NORMAL) + f"select page_id, {_HOST_INPUT} model_input from normal where error is null")
def model_input_host(spark, d):
    return urls.model_input(urls.normalize(V.messy(spark, d), "raw").where("url_error is null"), "host").select("page_id", "model_input")


@query(_REG + r"select page_id, 'https://www.' || regexp_replace(coalesce(reg, host), '^www\.', '') model_input from hosts left join reg using (host)")
def model_input_registrable(spark, d):
    return urls.model_input(urls.normalize(V.messy(spark, d), "raw").where("url_error is null"), "registrable", V.psl(spark)).select("page_id", "model_input")


@query(
    S.with_("messy", extra=S.NORMAL)
    + r"""select page_id, lower(split_part(norm, '://', 1)) || '://' || case when contains(auth, '@') then regexp_extract(auth, '^([^:@]*)', 1) || '@' || regexp_extract(auth, '([^@]*)$', 1) else auth end
  || regexp_extract(norm, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)
  || case when q = '' then '' else '?' || array_to_string(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: split_part(x, '=', 1) || '=[redacted]'), '&') end stored
  from (select page_id, norm, regexp_extract(norm, '://([^/?#]*)', 1) auth, regexp_extract(norm, '^[^?#]*\?([^#]*)', 1) q from normal where error is null)"""
)
def url_redact(spark, d):
    rows = urls.normalize(V.messy(spark, d), "raw").where("url_error is null")
    return rows.select("page_id", u.redact(F.col("normalized_url")).alias("stored"))


@query("select page_id, replace(regexp_replace(url, 'http', 'hxxp'), '.', '[.]') defanged from pages")
def url_defang(spark, d):
    return load(spark, d, "pages").select("page_id", u.defang(F.col("url")).alias("defanged"))


@query(
    r"""select scheme_http, has_path_or_query, php_or_wp_path, count(*)::bigint urls from (select starts_with(url, 'http://') scheme_http,
  regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1) not in ('', '/') or regexp_extract(url, '^[^?#]*\?([^#]*)', 1) <> '' has_path_or_query, regexp_matches(url, '(?i)\.php|wp-|/wp/') php_or_wp_path from pages) group by all"""
)
def url_shape(spark, d):
    return load(spark, d, "pages").select(*(c.alias(n) for n, c in u.shape(F.col("url")).items())).groupBy(*SHAPE).agg(F.count("*").alias("urls"))


@query(r"select page_id, case when regexp_matches(url, '^https://www\.[^/?#]+$') then 0 else 1 end score from pages")
def rule_baseline(spark, d):
    return load(spark, d, "pages").select("page_id", u.homepage_rule(F.col("url")).alias("score"))


@query(S.with_("messy") + r"select page_id, case when regexp_matches(raw, '(?i)^https?://') then lower(regexp_extract(raw, '^([A-Za-z]+://)', 1) || regexp_extract(raw, '://(?:[^/?#]*@)?([^/?#@]*)', 1)) end origin, case when regexp_matches(raw, '(?i)^https?:') then null else 'not a web page' end reason from messy")
def url_origin(spark, d):
    return V.messy(spark, d).select("page_id", u.origin(F.col("raw")).alias("origin"), u.unsupported_reason(F.col("raw")).alias("reason"))


@query(
    _REG
    + "select coalesce(sub, '') not in ('', 'www') has_subdomain, coalesce(private, false) shared_hosting, coalesce(sub, '') in ('', 'www') and not coalesce(private, false) plain, count(*)::bigint urls from hosts left join reg using (host) group by all"
)
def url_structure_group(spark, d):
    rows = urls.normalize(V.messy(spark, d), "raw").where("url_error is null").select(u.hostname(F.col("normalized_url")).alias("host"))
    return urls.structure_groups(urls.registrable(rows, V.psl(spark))).groupBy("has_subdomain", "shared_hosting", "plain").agg(F.count("*").alias("urls"))


def _features_sql(source: str) -> str:
    return f"select page_id, mi model_input, {S.features('mi', 'p')} from (select *, {S.TLD.format('mi')} t from ({source})) left join prior on tld = t"


@query(S.with_("labelled", extra=S.PRIOR) + _features_sql(f"select page_id, {S.HOST_INPUT.format('url')} mi from pages"))
def features_host(spark, d):
    return featured(spark, d, "host").select("page_id", "model_input", *feat.NAMES)


@query(S.with_("labelled", extra=S.PRIOR) + _features_sql("select page_id, url mi from pages"))
def features_full(spark, d):
    return featured(spark, d, "full").select("page_id", "model_input", *feat.NAMES)


@query(
    S.with_("labelled", "psl", extra=S.PRIOR + f",\nhosts as (select page_id, {S.HOSTNAME.format('url')} host from pages),\n" + S.REGISTRABLE)
    + _features_sql(r"select page_id, 'https://www.' || regexp_replace(coalesce(reg, host), '^www\.', '') mi from hosts left join reg using (host)")
)
def features_registrable(spark, d):
    return featured(spark, d, "registrable").select("page_id", "model_input", *feat.NAMES)


@query("select unnest([" + ", ".join(f"'{n}'" for n in feat.NAMES) + "]) feature, (select count(*) from pages)::bigint n, 0::bigint not_finite, 0::bigint below, 0::bigint above")
def features_validate(spark, d):
    return urls.violations(featured(spark, d, "host"))


@query(S.with_("labelled", extra=S.PRIOR) + "select tld, p from prior")
def tld_prior(spark, d):
    return prior(spark, d)


@query(S.with_("sections") .replace("with ", "with " + V.SQL["labelled"] + ", ") + "select count(*)::bigint input_rows, count(distinct url)::bigint urls, 0::bigint rejected, count(distinct url)::bigint rows_used from sections")
def featurize_stats(spark, d):
    rows = V.sections(spark, d)
    one = datasets.dedup_first(rows)
    judged = urls.normalize(one, idna=False)
    used = urls.with_features(urls.model_input(judged.where("url_error is null"), "host"), prior(spark, d))
    a = rows.agg(F.count("*").alias("input_rows"))
    b = judged.agg(F.count("*").alias("urls"), F.count("url_error").alias("rejected"))
    c = used.agg(F.count("URLLength").alias("rows_used"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


_LEX = r"case when contains(host, '.') then regexp_extract(host, '^(.*)\.', 1) else host end"


@query(
    rf"""with h as (select page_id, {S.HOSTNAME.format('url')} host from pages), c as (select page_id, host, {_LEX} core from h),
l as (select *, regexp_replace(core, '[^a-z]', '', 'g') letters from c),
chars as (select page_id, ch, count(*) k, any_value(length(core)) n from (select page_id, core, unnest(string_split(core, '')) ch from c) group by page_id, ch),
e as (select page_id, round(-sum(k::double / n * log2(k::double / n)), 6) entropy from chars group by page_id)
select l.page_id, (length(core) - length(replace(core, '-', '')))::int hyphens, e.entropy, case when letters <> '' then round((length(letters) - length(regexp_replace(letters, '[aeiou]', '', 'g')))::double / length(letters), 6) else 0 end vowel_ratio,
  coalesce(list_max(list_transform(regexp_extract_all(core, '[b-df-hj-np-tv-z]+'), lambda x: length(x))), 0)::int max_consonant_run, ({' + '.join(f"contains(core, '{k}')::int" for k in urls.KEYWORDS)})::int keyword_hits from l join e using (page_id)"""
)
def host_lexical(spark, d):
    cols = urls.host_lexical(u.hostname(F.col("url")))
    cols |= {k: F.round(cols[k], 6) for k in ("entropy", "vowel_ratio")}
    return load(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in cols.items()))


@query(rf"select array_to_string(l[greatest(len(l) - 1, 1):], '.') parent, count(*)::bigint hosts from (select distinct string_split({S.HOSTNAME.format('url')}, '.') l from pages) group by 1 having count(*) >= 5")
def platform_parents(spark, d):
    return urls.platform_parents(load(spark, d, "pages").select(u.hostname(F.col("url")).alias("host")), 5)


@query(
    S.with_("labelled", extra=S.PRIOR)
    + ", full_ as ("
    + _features_sql("select page_id, url mi from pages")
    + "), host_ as ("
    + _features_sql(f"select page_id, {S.HOST_INPUT.format('url')} mi from pages")
    + ")\n"
    + " union all ".join(f"select '{n}' feature, round(avg((abs(a.{n} - b.{n}) <= {0.0015 if 'Ratio' in n else 1e-6} + 1e-5 * abs(b.{n}))::int), 6) parity from full_ a join host_ b using (page_id)" for n in feat.NAMES)
)
def feature_parity(spark, d):
    """Parity of one view's features with the other's as the stored ones: within 1e-6 (ratios: 0.0015), relative 1e-5 added."""
    a, b = featured(spark, d, "full"), featured(spark, d, "host").withColumnsRenamed({n: f"s_{n}" for n in feat.NAMES}).drop("url", "model_input", "normalized_url")
    close = lambda n: F.abs(F.col(n) - F.col(f"s_{n}")) <= F.lit(0.0015 if "Ratio" in n else 1e-6) + 1e-5 * F.abs(F.col(f"s_{n}"))
    cells = [F.struct(F.lit(n).alias("feature"), F.round(F.avg(close(n).cast("int")), 6).alias("parity")) for n in feat.NAMES]
    return a.join(b, "page_id").agg(F.array(*cells).alias("a")).select(F.inline("a"))


_CUT = "case page_id % 4 when 1 then substr(url, 1, length(url) - 1) when 2 then substr(url, 1, length(url) - 5) else url end"
_HOST_LEVEL = ", ".join(f"w.{n}" if n in parity.HOST_LEVEL else f"c.{n} + (c.page_id % 8 = 3)::int {n}" if n == "NoOfDegitsInURL" else f"case when c.page_id % 8 = 3 then c.{n} + 0.01 else c.{n} end {n}" if "Ratio" in n else f"c.{n}" for n in feat.NAMES)
_STORED = (
    S.with_("labelled", extra=S.PRIOR) + ", whole as (" + _features_sql("select page_id, url mi from pages") + "), cut_ as (" + _features_sql(f"select page_id, {_CUT} mi from pages")
    + f"), stored as (select c.page_id, {_HOST_LEVEL} from cut_ c join whole w using (page_id))\n"
)


def stored_features(spark, d):
    """``page_id, url`` and features as another program may have stored them: of some urls only a part was read (but for what depends on
    the host), and in some rows digits and ratios are off."""
    pages, known = load(spark, d, "pages").select("page_id", "url"), prior(spark, d)
    n = F.length("url")
    cut = F.when(F.col("page_id") % 4 == 1, F.substring("url", F.lit(1), n - 1)).when(F.col("page_id") % 4 == 2, F.substring("url", F.lit(1), n - 5)).otherwise(F.col("url"))
    whole = urls.with_features(pages, known, "url").select("page_id", *(F.col(c).alias(f"w_{c}") for c in parity.HOST_LEVEL))
    off = F.col("page_id") % 8 == 3
    rows = urls.with_features(pages.withColumn("cut", cut), known, "cut").join(whole, "page_id")
    moved = {c: F.col(f"w_{c}") for c in parity.HOST_LEVEL} | {"NoOfDegitsInURL": F.col("NoOfDegitsInURL") + off.cast("int")} | {c: F.when(off, F.col(c) + 0.01).otherwise(F.col(c)) for c in feat.NAMES if "Ratio" in c}
    return rows.withColumns(moved).select("page_id", "url", *feat.NAMES)


_AGREES = "round(avg(coalesce(abs(s.{0} - {1}.{0}) <= {2} + 1e-5 * abs({1}.{0}), false)::int), 6)"


@query(
    _STORED
    + " union all ".join(
        f" select '{n}' feature, {_AGREES.format(n, 'w' if n in parity.HOST_LEVEL else 'c', parity.tolerance(n))} prefix_share, {_AGREES.format(n, 'w', parity.tolerance(n))} whole_share from stored s join cut_ c using (page_id) join whole w using (page_id)"
        for n in feat.NAMES
    )
)
def parity_audit(spark, d):
    out = parity.audit(stored_features(spark, d), prior(spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("prefix_share", "whole_share")})


@query("select (length(" + _CUT + ") - length(url))::bigint as \"offset\", count(*)::bigint as \"rows\", 0::bigint rejected, count(*) filter (regexp_extract(url, '^([^:]*://[^/?#]*)', 1) <> lower(regexp_extract(url, '^([^:]*://[^/?#]*)', 1)))::bigint as \"changed\" from pages group by 1")
def parity_offsets(spark, d):
    return parity.offsets(stored_features(spark, d))


@query("select unnest(['" + "', '".join(feat.NAMES) + "']) name, count(*)::bigint as rows from pages group by 1")
def feature_catalog(spark, d):
    """The schema's features with the rows of the table that carry them."""
    rows = featured(spark, d, "host").agg(*(F.count(n).alias(n) for n in feat.NAMES))
    return rows.unpivot([], list(feat.NAMES), "name", "rows")

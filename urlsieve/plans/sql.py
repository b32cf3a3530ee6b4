"""DuckDB SQL for the registered queries: shared expressions and common table expressions."""

from __future__ import annotations

from urlsieve.functions import features as feat
from urlsieve.functions import url as u
from urlsieve.sources.views import SQL


def with_(*views: str, extra: str = "") -> str:
    return "with " + ", ".join([*(SQL[v] for v in views), *([extra] if extra else [])]) + "\n"


def features(source: str, prior: str) -> str:
    """The feature columns of a SQL expression for the model input and one for the prior."""
    host = rf"regexp_extract(regexp_replace({source}, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '^([^/?#]*)', 1)"
    tld = f"case when contains({host}, '.') then split_part({host}, '.', -1) else '' end"
    bare = rf"regexp_replace({host}, '^www\.', '')"
    core = rf"case when contains({bare}, '.') then regexp_extract({bare}, '^(.*)\.', 1) else {bare} end"
    body = f"replace(replace(replace({source}, 'https://', ''), 'http://', ''), 'www.', '')"
    count = lambda p: f"(length({body}) - length(regexp_replace({body}, '{p}', '', 'g')))"
    longest = lambda p: f"coalesce(list_max(list_transform(regexp_extract_all({core}, '{p}'), lambda x: length(x))), 0)"
    letters, digits, equals, marks, percents, other = (count(p) for p in ("[A-Za-z]", r"\p{Nd}", "=", r"\?", "%", r"[^\p{L}\p{N}=?%]"))
    ratio = lambda c: f"case when length({source}) > 0 then format('{{:.3f}}', ({c})::double / length({source}))::double else 0 end"
    columns = {
        "URLLength": f"length({source})::int",
        "DomainLength": f"length({host})::int",
        "IsDomainIP": rf"(regexp_matches({host}, '[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}') or regexp_matches(split_part({host}, '@', -1), '^\[[0-9a-fA-F:.]+\]'))::int",
        "CharContinuationRate": f"case when ({core}) <> '' then ({longest('[A-Za-z]+')} + {longest('[0-9]+')} + {longest('[^A-Za-z0-9]+')})::double / length({core}) else 0 end",
        "TLDLegitimateProb": f"coalesce({prior}, 0)::double",
        "TLDLength": f"length({tld})::int",
        "NoOfSubDomain": f"greatest(length({host}) - length(replace({host}, '.', '')) - 1, 0)::int",
        "NoOfLettersInURL": f"{letters}::int",
        "LetterRatioInURL": ratio(letters),
        "NoOfDegitsInURL": f"{digits}::int",
        "DegitRatioInURL": ratio(digits),
        "NoOfEqualsInURL": f"{equals}::int",
        "NoOfQMarkInURL": f"{marks}::int",
        "NoOfAmpersandInURL": f"{percents}::int",
        "NoOfOtherSpecialCharsInURL": f"{other}::int",
        "SpacialCharRatioInURL": ratio(f"{other} + {equals} + {marks} + {percents}"),
        "IsHTTPS": f"contains(lower({source}), 'https')::int",
    }
    assert tuple(columns) == feat.NAMES
    return ",\n  ".join(f"{v} as {k}" for k, v in columns.items())


PRIOR = "prior as (select lower(tld) tld, avg(label) p from labelled group by 1)"
TLD = r"lower(split_part(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '.', -1))"
HOST_INPUT = r"('https://www.' || regexp_replace(regexp_extract(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '([^@]*)$', 1), '^www\.', ''))"
HOSTNAME = r"lower(regexp_extract(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)', 1), '^([^:]*)', 1))"

#: Normalisation of ``messy.raw``: ``page_id, raw, t, url, hp, name, error, norm``.
NORMAL = rf"""parsed as (
  select page_id, raw, t, url, hp, lower(case when starts_with(hp, '[') then regexp_extract(hp, '^\[([^\]]*)\]', 1) else regexp_extract(hp, '^([^:]*)', 1) end) as hname, regexp_extract(hp, ':(\d+)$', 1) digits
  from (select *, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#@]*)', 1) hp
  from (select *, case when contains(t, '://') then t else 'https://' || regexp_replace(t, '^/+', '') end url
  from (select page_id, raw, regexp_replace(raw, '^[\x09-\x0d\x1c-\x20]+|[\x09-\x0d\x1c-\x20]+$', '', 'g') t from messy)))),
normal as (
  select *, case when error is null then
    lower(regexp_extract(url, '{u.SCHEME}', 1)) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*@)?', 1)
    || case when contains(hname, ':') then '[' || hname || ']' else hname end || case when digits <> '' then ':' || digits::int::varchar else '' end
    || regexp_replace(regexp_replace(regexp_extract(url, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$', 1), '#$', ''), '\?(#|$)', '\1') end norm
  from (select *, case when t is null or t = '' then 'required' when length(t) > 2048 then 'too_long' when regexp_matches(t, '[\x00-\x20\x7f]') then 'characters'
    when not contains(t, '://') and regexp_matches(t, '{u.NON_WEB}') then 'scheme'
    when not regexp_matches(hp, '^(\[[^\[\]]*\]|[^:\[\]]*)(:\d*)?$') or length(digits) > 9 or try_cast(digits as int) > 65535 then 'malformed'
    when lower(regexp_extract(url, '{u.SCHEME}', 1)) not in ('http', 'https') then 'scheme'
    when not regexp_matches(hname, '{u.LDH}') or length(hname) > 253 then 'host' end as error from parsed))"""

#: Registrable domains of ``hosts.host``: ``host, reg, sub, private``.
REGISTRABLE = rf"""labels as (select host, string_split(host, '.') l, len(string_split(host, '.')) n from (select distinct host from hosts where host <> '' and not regexp_matches(host, '{u.IPV4}'))),
cand as (select host, n, k, array_to_string(l[n - k + 1:n], '.') rule, l from (select *, unnest(range(1, n + 1)) k from labels)),
found as (select host, n, any_value(l) l, max(case when kind = 'exception' then k - 1 end) ex,
  max(case kind when 'normal' then k when 'wildcard' then case when k < n then k + 1 end end) longest,
  max(case when section = 'icann' then case kind when 'normal' then k when 'wildcard' then case when k < n then k + 1 end end end) icann
  from cand join psl using (rule) group by host, n),
reg as (select host, array_to_string(l[n - coalesce(ex, longest):n], '.') reg, case when n - coalesce(ex, longest) > 1 then array_to_string(l[1:n - coalesce(ex, longest) - 1], '.') else '' end sub,
  coalesce(ex, longest) <> coalesce(ex, icann, 0) private from found where n > coalesce(ex, longest))"""

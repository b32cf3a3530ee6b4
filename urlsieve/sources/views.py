"""Views over the given tables that the registered queries read; ``SQL`` has the same views for DuckDB.

None of them leaves rows out but for inner joins: each uses its whole tables.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlsieve.sources.tables import load

AS_OF = "2024-01-30"

#: A short extract of the Public Suffix List, as rule text, kind and section; full lists load the same way.
PSL_RULES = (
    ("com", "normal", "icann"), ("net", "normal", "icann"), ("org", "normal", "icann"), ("dev", "normal", "icann"), ("xyz", "normal", "icann"),
    ("io", "normal", "icann"), ("de", "normal", "icann"), ("fr", "normal", "icann"), ("uk", "normal", "icann"), ("co.uk", "normal", "icann"),
    ("org.uk", "normal", "icann"), ("br", "normal", "icann"), ("com.br", "normal", "icann"), ("jp", "normal", "icann"), ("co.jp", "normal", "icann"),
    ("ck", "wildcard", "icann"), ("www.ck", "exception", "icann"), ("app", "normal", "icann"), ("web.app", "normal", "private"),
    ("firebaseapp.com", "normal", "private"), ("github.io", "normal", "private"), ("webwave.dev", "normal", "private"), ("blogspot.com", "normal", "private"),
)


def psl(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pa.table(dict(zip(("rule", "kind", "section"), map(list, zip(*PSL_RULES))))))


def load_psl(spark: SparkSession, path: str) -> DataFrame:
    """A Public Suffix List file (``public_suffix_list.dat`` form) as rules; the section comes from the position in the file."""
    text = spark.read.text(path, wholetext=True)
    marked = text.select(F.posexplode(F.split("value", "\n")).alias("n", "line"), F.instr("value", "===BEGIN PRIVATE DOMAINS===").alias("at"), "value")
    private = F.size(F.split(F.substring(F.col("value"), F.lit(1), F.col("at")), "\n"))
    rule = F.regexp_extract("line", r"^([^\s/]+)", 1)
    rows = marked.select(rule.alias("r"), F.when((F.col("at") > 0) & (F.col("n") >= private - 1), "private").otherwise("icann").alias("section")).where("r <> ''")
    kind = F.when(F.col("r").startswith("*."), "wildcard").when(F.col("r").startswith("!"), "exception").otherwise("normal")
    return rows.select(F.regexp_replace("r", r"^(\*\.|!)", "").alias("rule"), kind.alias("kind"), "section")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """``id, url, label, tld``: pages with the label of the document of their id (1: legitimate). A deterministic label, no signal."""
    pages, labels = load(spark, d, "pages"), load(spark, d, "labels")
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return pages.join(labels, pages["page_id"] == labels["doc_id"]).select(F.col("page_id").alias("id"), "url", F.col("quality").alias("label"), F.substring_index(host, ".", -1).alias("tld"))


def sections(spark: SparkSession, d: str) -> DataFrame:
    """``labelled`` with urls cut after the first path segment: many rows share a url, some with other labels."""
    return labelled(spark, d).withColumn("url", F.regexp_extract("url", r"^([^:]*://[^/?#]*(?:/[^/?#]*)?)", 1))


def messy(spark: SparkSession, d: str) -> DataFrame:
    """``page_id, raw``: every url, edited by the last digit of its id."""
    k, url = F.col("page_id") % 10, F.col("url")
    rest = F.regexp_replace(url, r"^https?://", "")
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    raw = (
        F.when(k == 1, rest)
        .when(k == 2, F.replace(url, host, F.upper(host)))
        .when(k == 3, F.replace(url, host, F.concat(host, F.lit(":8443"))))
        .when(k == 4, F.concat(F.lit("http://user:pw@"), rest))
        .when(k == 5, F.concat(F.lit("  "), url, F.lit(" ")))
        .when(k == 6, F.concat(url, F.lit("/a b")))
        .when(k == 7, F.concat(F.lit("ftp:"), rest))
        .when(k == 8, F.concat(F.lit("http://192.168."), (F.col("page_id") % 256).cast("string"), F.lit(".7/"), rest))
        .when(k == 9, F.concat(url, F.lit("?q=1&token=s%20x&flag#frag")))
        .otherwise(url)
    )
    return load(spark, d, "pages").select("page_id", raw.alias("raw"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """``id, y, p, p2``: a label and two scores with many ties, from hashes of the ids."""
    unit = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("double") / 4294967295
    y = 1 - F.col("quality")
    p = lambda x: F.floor(100 * (0.6 * unit(x) + 0.4 * y)) / 100
    key = F.col("doc_id").cast("string")
    return load(spark, d, "labels").select(F.col("doc_id").alias("id"), y.alias("y"), p(key).alias("p"), p(F.concat(key, F.lit("b"))).alias("p2"))


def history(spark: SparkSession, d: str) -> DataFrame:
    """Events as scans of urls: one url for each (user, type), from the pages' hosts in no other relation."""
    kind = F.col("event_type")
    risky = F.when(kind == "error", "Phishing").when(kind.isin("signup", "purchase"), "Suspicious").otherwise("Safe")
    level = F.when(kind == "error", "High").when(kind.isin("signup", "purchase"), "Medium").otherwise("Low")
    p = F.least(F.greatest(F.col("value") / 1000, F.lit(0.0)), F.lit(1.0))
    host = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".example.com"))
    url = F.concat(F.lit("https://"), host, F.lit("/"), kind, F.lit("?id="), F.col("event_id").cast("string"))
    source = F.element_at(F.array(F.lit("web"), F.lit("extension"), F.lit("api")), (F.col("user_id") % 3 + 1).cast("int"))
    return load(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("scanned_at"), url.alias("url"), host.alias("host"), risky.alias("prediction"), level.alias("risk_level"),
        F.when(kind == "view", F.lit(None)).otherwise(p).alias("phishing_probability"), source.alias("source"), F.col("user_id").alias("client"), F.col("value").alias("processing_ms"), "props",
    )


SQL = {
    "psl": "psl as (select * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in PSL_RULES) + ") t(rule, kind, section))",
    "labelled": r"labelled as (select page_id id, url, quality as label, split_part(regexp_extract(url, '://([^/?#]*)', 1), '.', -1) tld from pages join labels on page_id = doc_id)",
    "sections": r"sections as (select id, regexp_extract(url, '^([^:]*://[^/?#]*(?:/[^/?#]*)?)', 1) url, label, tld from labelled)",
    "messy": r"""messy as (select page_id, case page_id % 10
  when 1 then rest when 2 then replace(url, host, upper(host)) when 3 then replace(url, host, host || ':8443') when 4 then 'http://user:pw@' || rest
  when 5 then '  ' || url || ' ' when 6 then url || '/a b' when 7 then 'ftp:' || rest when 8 then 'http://192.168.' || (page_id % 256)::varchar || '.7/' || rest
  when 9 then url || '?q=1&token=s%20x&flag#frag' else url end raw
  from (select page_id, url, regexp_replace(url, '^https?://', '') rest, regexp_extract(url, '://([^/?#]*)', 1) host from pages))""",
    "scored": r"""scored as (select doc_id id, 1 - quality y,
  floor(100 * (0.6::double * (('0x' || substr(md5(doc_id::varchar), 1, 8))::ubigint::double / 4294967295) + 0.4::double * (1 - quality))) / 100 p,
  floor(100 * (0.6::double * (('0x' || substr(md5(doc_id::varchar || 'b'), 1, 8))::ubigint::double / 4294967295) + 0.4::double * (1 - quality))) / 100 p2
  from labels)""",
    "history": r"""history as (select event_id id, ts scanned_at, 'https://u' || user_id::varchar || '.example.com/' || event_type || '?id=' || event_id::varchar url,
  'u' || user_id::varchar || '.example.com' host, case when event_type = 'error' then 'Phishing' when event_type in ('signup', 'purchase') then 'Suspicious' else 'Safe' end prediction,
  case when event_type = 'error' then 'High' when event_type in ('signup', 'purchase') then 'Medium' else 'Low' end risk_level,
  case when event_type <> 'view' then least(greatest(value / 1000, 0), 1) end phishing_probability,
  (['web', 'extension', 'api'])[user_id % 3 + 1] source, user_id client, value processing_ms, props from events)""",
}

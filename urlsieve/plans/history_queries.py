"""Queries over scan history, explanations, streams and models."""

from __future__ import annotations

import uuid

from pyspark.ml import classification as C
from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.functions import url as u
from urlsieve.operators import explain as X
from urlsieve.operators import history as H
from urlsieve.operators import metrics as M
from urlsieve.operators import datasets, models, urls
from urlsieve.plans import sql as S
from urlsieve.plans.data_queries import FEAT, rounded, split
from urlsieve.plans.registry import ORACLE, query
from urlsieve.plans.url_queries import labelled_features
from urlsieve.sources import views as V
from urlsieve.sources.tables import keep_table, shared_folder
from urlsieve.streaming import jobs as J
from urlsieve.streaming import stateful

HI, SC = S.with_("history"), S.with_("scored")
_DAY = "scanned_at::date"


@query(HI + "select id, url, host, prediction, risk_level, source, phishing_probability from history where true".replace("url, host", "split_part(url, '?', 1) || '?id=[redacted]' url, host"))
def history_record(spark, d):
    rows = V.history(spark, d).withColumn("normalized_url", F.col("url"))
    return H.record(rows).select("id", "url", "host", "prediction", "risk_level", "source", "phishing_probability")


@query(HI + f"select ({_DAY})::varchar as \"day\", count(*)::bigint n, sum(id)::bigint ids from history group by 1")
def history_append(spark, d):
    """Scans appended to a table partitioned by day, and read back."""
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    H.append(V.history(spark, d).select("id", "scanned_at", "url", "prediction"), path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(HI + "select id, prediction, case when id % 2 = 0 then host end host, case when id % 2 = 0 then phishing_probability end phishing_probability from history")
def history_upgrade(spark, d):
    rows = V.history(spark, d)
    old = rows.where("id % 2 <> 0").select("id", "prediction")
    return H.upgrade(old, rows.where("id % 2 = 0").select("id", "prediction", "host", "phishing_probability"))


@query(HI + "select id, case when id % 5 = 0 then 'prediction' when id % 7 = 0 then 'source' when id % 11 = 0 then 'not null' end violation from (select id from history)".replace("when id % 5 = 0 then 'prediction' when id % 7 = 0 then 'source' when id % 11 = 0 then 'not null'", "when id % 11 = 0 then 'not null' when id % 5 = 0 then 'prediction' when id % 7 = 0 then 'source'"))
def history_constraints(spark, d):
    rows = V.history(spark, d).withColumns({"prediction": F.when(F.col("id") % 5 == 0, "Maybe").otherwise(F.col("prediction")), "source": F.when(F.col("id") % 7 == 0, None).otherwise(F.col("source")), "url": F.when(F.col("id") % 11 != 0, F.col("url"))})
    return H.constraints(rows).select("id", "violation")


@query(HI + "select id, scanned_at, url, prediction, risk_level, source from history order by id desc limit 20 offset 20")
def history_page(spark, d):
    """The second page of twenty: paging is the operator's purpose."""
    return H.page(V.history(spark, d), 2, 20).withColumn("scanned_at", F.col("scanned_at").cast("timestamp_ntz"))


@query(HI + "select count(*)::bigint total, ceil(count(*) / 20)::bigint pages from history where prediction = 'Phishing' and (contains(lower(url), 'u1') or contains(lower(host), 'u1'))")
def history_search(spark, d):
    return H.page_totals(V.history(spark, d), 20, "Phishing", "U1")


@query(HI + "select id, prediction from history where prediction <> 'Phishing'")
def history_delete(spark, d):
    """What is left when the scans found to be phishing are deleted by their ids."""
    rows = V.history(spark, d)
    return H.delete(rows, rows.where("prediction = 'Phishing'").select("id")).select("id", "prediction")


@query(HI + f", gone as (select id from history where prediction = 'Phishing' and id % 3 = 0 or {_DAY} = date '2024-01-05') select count(*) filter (id in (select id from gone))::bigint deleted, count(*) filter (id not in (select id from gone))::bigint kept, count(distinct {_DAY}) filter (id in (select id from gone))::int as \"days\", sum(id) filter (id not in (select id from gone))::bigint ids from history")
def history_rewrite(spark, d):
    """A third of the phishing scans and one whole day deleted from the table partitioned by day, with the counts."""
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    rows = V.history(spark, d).select("id", "scanned_at", "url", "prediction")
    H.append(rows, path)
    done = H.rewrite_without(spark, path, rows.where("prediction = 'Phishing' and id % 3 = 0 or to_date(scanned_at) = date '2024-01-05'").select("id"))
    return done.join(F.broadcast(spark.read.parquet(path).agg(F.sum("id").alias("ids"))))


@query("select event_id id, user_id client, json_valid(props) ok, (json_extract_string(props, '$.k'))::bigint as k from events")
def history_get(spark, d):
    """Details of every scan with its JSON parsed: whether it is JSON, and the field it holds."""
    rows = V.history(spark, d).withColumn("v", F.try_parse_json("props"))
    return rows.select("id", "client", F.col("v").isNotNull().alias("ok"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query(
    HI + "select kind, \"value\", count(h.v)::bigint n from (values ('prediction', 'Safe'), ('prediction', 'Suspicious'), ('prediction', 'Phishing'), ('risk_level', 'Low'), ('risk_level', 'Medium'), ('risk_level', 'High'), ('source', 'web'), ('source', 'extension'), ('source', 'api')) t(kind, \"value\")"
    " left join (select 'prediction' k, prediction v from history union all select 'risk_level', risk_level from history union all select 'source', source from history) h on h.k = kind and h.v = \"value\" group by 1, 2"
)
def history_counts(spark, d):
    return H.counts(V.history(spark, d))


@query(HI + "select min(scanned_at) first_scan_at, max(scanned_at) last_scan_at, count(*)::bigint total from history")
def history_span(spark, d):
    out = H.span(V.history(spark, d))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_scan_at", "last_scan_at")})


_P3 = ", ".join(f"count(*) filter (prediction = '{p}')::bigint as \"{p}\"" for p in H.PREDICTIONS)


@query(HI + f"select ({_DAY})::varchar as \"day\", {_P3} from history where {_DAY} >= date '2024-01-30' - 13 group by 1")
def history_daily(spark, d):
    return H.daily(V.history(spark, d), V.AS_OF, 14).withColumn("day", F.col("day").cast("string"))


@query(
    HI + f"select (x.d::date)::varchar as \"day\", coalesce(n, 0)::bigint total, coalesce(n, 0) > 0 and x.d::date = (select {_DAY} from history where {_DAY} >= date '2024-01-30' - 59 group by 1 order by count(*) desc, 1 limit 1) busiest from (select unnest(generate_series(timestamp '2024-01-30' - interval 59 day, timestamp '2024-01-30', interval 1 day)) d) x left join (select {_DAY} dd, count(*) n from history group by 1) on dd = x.d::date"
)
def history_calendar(spark, d):
    return H.calendar(V.history(spark, d), V.AS_OF, 60).withColumn("day", F.col("day").cast("string"))


@query(HI + "select v as \"value\", n::bigint n, floor(100 * n / (select count(*) from history) + 0.5)::int as \"percent\" from (select 'Safe' v, count(*) filter (prediction = 'Safe')::double n from history union all select 'Suspicious', count(*) filter (prediction = 'Suspicious') from history union all select 'Phishing', count(*) filter (prediction = 'Phishing') from history union all select 'Risky', count(*) filter (prediction <> 'Safe') from history)")
def history_share(spark, d):
    return H.shares(V.history(spark, d))


@query(HI + "select count(*)::bigint n, round(avg(processing_ms), 6) mean, round(median(processing_ms), 6) median, min(processing_ms) as \"min\", max(processing_ms) as \"max\", (select processing_ms from history order by processing_ms limit 1 offset (select greatest(round_even(0.95::double * count(*), 0), 1)::bigint - 1 from history)) p95 from history")
def latency_summary(spark, d):
    return rounded(M.latency_summary(V.history(spark, d)), "mean", "median")


@query(SC + "select id, case when p < 0.3 then 'Safe' when p >= 0.7 then 'Phishing' else 'Suspicious' end prediction, case when p < 0.3 then 'Low' when p >= 0.7 then 'High' else 'Medium' end risk_level, round(case when p < 0.3 then 1 - p else p end, 6) confidence, case when p < 0.3 then 1 else 0 end label from scored")
def risk_classify(spark, d):
    return rounded(X.classify(V.scored(spark, d), 0.3, 0.7), "confidence").select("id", "prediction", "risk_level", "confidence", "label")


@query(SC + "select y, count(*) filter (p < 0.3)::bigint \"Low\", count(*) filter (p >= 0.3 and p < 0.7)::bigint \"Medium\", count(*) filter (p >= 0.7)::bigint \"High\" from scored group by y")
def risk_by_class(spark, d):
    return X.classify(V.scored(spark, d), 0.3, 0.7).groupBy("y").pivot("risk_level", list(H.RISKS)).count().fillna(0, list(H.RISKS))


@query(SC + "select id, case when p < 0.3 then 'low risk' when p >= 0.7 then 'high risk' else 'raised risk' end verdict, case when p < 0.3 then 'low risk: score ' || format('{:.2f}', p) || ' is below 0.30' when p >= 0.7 then 'high risk: score ' || format('{:.2f}', p) || ' is 0.70 or more' else 'raised risk: score ' || format('{:.2f}', p) || ' is from 0.30 to below 0.70' end summary from scored")
def verdict_text(spark, d):
    return X.verdict_text(X.classify(V.scored(spark, d), 0.3, 0.7), 0.3, 0.7).select("id", "verdict", "summary")


_REFERENCE = {"DomainLength": {"p5": 15, "p95": 24, "p99": 26}, "NoOfSubDomain": {"p5": 1, "p95": 2, "p99": 3}, "TLDLength": {"p5": 2, "p95": 3, "p99": 4}, "CharContinuationRate": {"p5": 0.7, "p95": 1, "p99": 1}}


def explained(spark, d):
    rows = urls.normalize(V.messy(spark, d), "raw").where("url_error is null")
    rows = urls.with_features(urls.model_input(rows, "host"), V.labelled(spark, d).groupBy("tld").agg(F.avg("label").alias("p")))
    rows = rows.withColumns(u.facts(F.col("normalized_url"))).withColumn("is_private_or_local", urls.is_internal(F.col("host")) & F.col("is_ip_literal"))
    rows = urls.registrable(rows, V.psl(spark))
    inner = urls.registrable(rows.select("page_id", F.col("subdomain").alias("sub")), V.psl(spark), "sub").select(F.col("page_id").alias("_i"), F.when(F.col("has_suffix"), F.col("registrable_domain")).otherwise("").alias("embedded_domain"))
    return X.explain(rows.join(inner, F.col("page_id") == F.col("_i")), _REFERENCE, "registrable")


_EXPLAIN = (
    S.with_("messy", "psl", "labelled", extra=S.PRIOR + ", " + S.NORMAL + ",\nhosts as (select page_id, hname host from normal where error is null),\n" + S.REGISTRABLE)
    + f", f as (select *, {S.features('mi', 'p')} from (select n.page_id, norm, hname, raw, case when digits <> '' then digits::int end port, {S.HOST_INPUT.format('norm')} mi from normal n where error is null) left join prior on tld = {S.TLD.format('mi')}),\n"
    + rf"""g as (select f.*, coalesce(sub, '') sub, coalesce(reg, hname) rd, IsDomainIP = 1 ip from f left join reg on host = hname)
select page_id, array_to_string(list_filter([case when ip then 'IsDomainIP:risk' end, case when not ip and TLDLegitimateProb = 0 then 'TLDLegitimateProb:caution' end,
  case when DomainLength > 26 then 'DomainLength:risk' when DomainLength > 24 then 'DomainLength:caution' end, case when not ip and NoOfSubDomain > 3 then 'NoOfSubDomain:risk' when not ip and NoOfSubDomain > 2 then 'NoOfSubDomain:caution' end,
  case when not ip and TLDLength > 4 then 'TLDLength:risk' when not ip and TLDLength > 3 then 'TLDLength:caution' end, case when not ip and CharContinuationRate < 0.7 then 'CharContinuationRate:caution' end,
  case when contains(regexp_extract(norm, '://([^/?#]*)', 1), '@') then 'userinfo:risk' end, case when regexp_matches(hname, '(^|\.)xn--') then 'punycode:caution' end, case when port not in (80, 443) then 'port:caution' end,
  case when starts_with(norm, 'http:') then 'https:caution' end, case when starts_with(hname, '192.168.') then 'local:info' end, case when contains(hname, '-') then 'hyphen:info' end,
  case when sub not in ('', 'www') then 'subdomain:info' end, case when (length(sub) - length(replace(sub, '.', ''))) >= 2 then 'deep_subdomain:caution' end, case when not contains(raw, '://') then 'scheme:info' end], lambda x: x is not null), ',') keys from g"""
)


@query(_EXPLAIN)
def explain_items(spark, d):
    """Keys and severities of the items; the item that stands for none is left out."""
    keys = F.transform(F.filter("explanations", lambda x: x["key"].isNotNull()), lambda x: F.concat(x["key"], F.lit(":"), x["severity"]))
    return explained(spark, d).select("page_id", F.array_join(keys, ",").alias("keys"))


@query(
    "with e as (" + _EXPLAIN + "), i as (select page_id, case when keys = '' then [':info'] else string_split(keys, ',')[1:8] end l from e)"
    " select page_id, len(l)::int n, array_to_string(list_transform(l, lambda x: split_part(x, ':', 2)), ',') severities, array_to_string(list_transform(l, lambda x: split_part(x, ':', 1)), ',') keys from i"
)
def indicator_severities(spark, d):
    """The first eight items of each url: their number, severities and keys."""
    rows = explained(spark, d).select("page_id", X.indicators().alias("i"))
    text = lambda c: F.array_join(F.transform("i", lambda x: F.coalesce(x[c], F.lit(""))), ",")
    return rows.select("page_id", F.size("i").alias("n"), text("severity").alias("severities"), text("key").alias("keys"))


@query()
def indicators(spark, d):
    """The first eight items of each url and their messages by severity, as text."""
    rows = explained(spark, d).select("page_id", X.indicators().alias("i"), "messages")
    return rows.select("page_id", F.size("i").alias("n"), F.array_join(F.transform("i", lambda x: x["severity"]), ",").alias("severities"), F.array_join("messages", "|").alias("messages"))


@query(S.with_("messy", "psl", extra=S.NORMAL + ",\nhosts as (select page_id, hname host from normal where error is null),\n" + S.REGISTRABLE) + "select page_id, coalesce(sub, '') not in ('', 'www') has_info, (length(coalesce(sub, '')) - length(replace(coalesce(sub, ''), '.', ''))) >= 2 deep from hosts left join reg using (host)")
def explain_subdomain(spark, d):
    has = lambda k: F.exists("explanations", lambda x: x["key"].eqNullSafe(F.lit(k)))
    return explained(spark, d).select("page_id", has("subdomain").alias("has_info"), has("deep_subdomain").alias("deep"))


@query(S.with_("labelled") + rf"select page_id, t.types is not null listed, coalesce(t.types, '') threat_types from pages left join (select host, array_to_string(list_sort(list(distinct tld)), ',') types from (select {S.HOSTNAME.format('url')} host, tld from labelled where label = 0) group by host) t on t.host = {S.HOSTNAME.format('pages.url')}")
def threat_enrich(spark, d):
    """Hosts with a phishing label as the threat table, its types being their top-level domains."""
    host = u.hostname(F.col("url"))
    threats = V.labelled(spark, d).where("label = 0").select(host.alias("host"), F.col("tld").alias("threat_type"))
    return X.threat_enrich(V.load(spark, d, "pages").select("page_id", host.alias("host")), threats).select("page_id", "listed", F.array_join("threat_types", ",").alias("threat_types"))


@query(HI + "select client, id, (select count(*) from history b where b.client = a.client and b.scanned_at <= a.scanned_at and b.scanned_at > a.scanned_at - interval 60 second)::bigint hits from history a")
def window_hits(spark, d):
    return J.window_hits(V.history(spark, d).withColumnRenamed("scanned_at", "ts"))


_HOUR = 3_600_000_000


@query(
    HI.replace("with ", "with recursive ", 1) + f""", r as (select client, id, scanned_at ts, row_number() over (partition by client order by scanned_at, id) n from history),
s as (
  select client, n, id, ts, [ts] recent, true allowed, 0 retry_after from r where n = 1
  union all
  select client, n, id, ts, case when ok then list_append(live, ts) else live end, ok, case when ok then 0 else greatest(1, trunc(3600 - (epoch_us(ts) - epoch_us(live[1])) / 1000000)::int + 1) end
  from (select *, len(live) < 3 ok from (select r.client, r.n, r.id, r.ts, list_filter(s.recent, lambda x: epoch_us(r.ts) - epoch_us(x) < {_HOUR}) live from s join r on r.client = s.client and r.n = s.n + 1)))
select client, id, ts, allowed, retry_after::int retry_after from s"""
)
def rate_limit(spark, d):
    return J.rate_limit(V.history(spark, d).withColumnRenamed("scanned_at", "ts"), 3, 3600.0).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    HI.replace("with ", "with recursive ", 1) + f""", r as (select 'https://' || host origin, id, scanned_at ts, prediction <> 'Phishing' ok, row_number() over (partition by host order by scanned_at, id) n from history),
s as (
  select origin, n, id, ts, true fresh, ts scored_at, case when ok then ts end held from r where n = 1
  union all
  select origin, n, id, ts, fresh, case when fresh then ts else held end, case when not fresh then held when ok then ts end
  from (select r.*, s.held, s.held is null or epoch_us(r.ts) - epoch_us(s.held) >= {_HOUR} fresh from s join r on r.origin = s.origin and r.n = s.n + 1))
select origin, id, ts, fresh, scored_at from s"""
)
def result_reuse(spark, d):
    rows = V.history(spark, d).select(F.concat(F.lit("https://"), F.col("host")).alias("origin"), "id", F.col("scanned_at").alias("ts"), (F.col("prediction") != "Phishing").alias("ok"))
    return J.result_reuse(rows, 3600.0).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "scored_at")})


def _phased(spark, rows, start, key: str, late=None, listener=None):
    """Runs a stream over ``rows`` (with ``ts``) in three parts by time, with a restart from its checkpoint before each, and then with
    a row far in the future, which only moves the watermark.  Rows come up to an hour out of order, those of ``late`` in the last part."""
    base = f"{shared_folder(spark)}/phases-{uuid.uuid4().hex}"
    at = F.col("ts").cast("double") + F.pmod(F.col("id"), F.lit(7)) * 600
    limits = rows.agg(F.min(at).alias("a"), F.max(at).alias("b"))
    part = F.least(F.floor(3 * (at - F.col("a")) / (F.col("b") - F.col("a") + 1)), F.lit(2)).cast("int")
    part = part if late is None else F.when(late, 2).otherwise(part)
    keep_at = f"{base}/arrivals"
    rows.join(F.broadcast(limits)).withColumn("_part", part).drop("a", "b").write.partitionBy("_part").parquet(keep_at)
    last = rows.limit(0).unionByName(spark.range(1).select(F.lit(-1).cast(rows.schema["id"].dataType).alias("id"), F.timestamp_seconds(F.lit(4_000_000_000)).alias("ts")), allowMissingColumns=True)
    for i in range(4):
        (last if i == 3 else spark.read.schema(rows.schema).parquet(f"{keep_at}/_part={i}")).write.mode("append").parquet(f"{base}/in")
        with stateful.rocksdb(spark):
            source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
            q = start(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            listener.wait(q) if listener else q.awaitTermination()
    return spark.read.parquet(f"{base}/out").where(F.col(key).isNotNull())


@query(ORACLE["rate_limit"])
def rate_limit_stream(spark, d):
    """The limit over a stream with restarts, in event time."""
    rows = V.history(spark, d).select("client", "id", F.col("scanned_at").alias("ts"))
    return _phased(spark, rows, lambda s: stateful.rate_limit(s, 3, 3600.0, "2 hours"), "client").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(ORACLE["result_reuse"])
def result_reuse_stream(spark, d):
    """Reuse of results over a stream with restarts, in event time."""
    rows = V.history(spark, d).select(F.concat(F.lit("https://"), F.col("host")).alias("origin"), "id", F.col("scanned_at").alias("ts"), (F.col("prediction") != "Phishing").alias("ok"))
    return _phased(spark, rows, lambda s: stateful.result_reuse(s, 3600.0, "2 hours"), "origin").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "scored_at")})


_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


_LATE = "event_id % 50 = 0 and ts < timestamp '2024-01-08'"


@query(f"select (ts::date)::varchar as \"day\", event_type prediction, count(*)::bigint n, count(*) filter (not ({_LATE}))::bigint closed, count(*) filter ({_LATE})::bigint missing, (select count(*) from events where {_LATE})::bigint late from events group by 1, 2")
def stream_closed_days(spark, d):
    """Daily counts in append mode over restarts, some rows weeks late: each day comes out once, and what the closed days lack is what
    the listener has counted."""
    rows = V.load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("prediction"))
    late, listener = (F.col("id") % 50 == 0) & (F.col("ts") < F.lit("2024-01-08").cast("timestamp")), J.LateRows()
    spark.streams.addListener(listener)
    try:
        closed = _phased(spark, rows, lambda s: J.closed_days(s, "2 hours"), "prediction", late, listener)
    finally:
        spark.streams.removeListener(listener)
    return J.reconciled(rows, closed).select(F.col("day").cast("string").alias("day"), "prediction", "n", "closed", "missing", F.lit(listener.total).cast("long").alias("late"))


@query(f"select event_type prediction, (ts::date)::varchar as \"day\", count(*)::bigint n from events group by 1, 2")
def stream_daily(spark, d):
    """Daily counts by a stream over the events, in complete mode."""
    source = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = source.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("prediction"))
    name = "stream_daily_" + uuid.uuid4().hex
    running = J.daily_stream(rows).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.table(name).withColumn("day", F.col("day").cast("string"))


@query("select event_id id, case when least(greatest(value / 1000, 0), 1) < 0.3 then 'Safe' when least(greatest(value / 1000, 0), 1) >= 0.7 then 'Phishing' else 'Suspicious' end prediction from events where event_type <> 'view'")
def stream_score(spark, d):
    """A stream of requests, scored and appended batch by batch; views are not recorded."""
    source = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = source.select(F.col("event_id").alias("id"), F.least(F.greatest(F.col("value") / 1000, F.lit(0.0)), F.lit(1.0)).alias("p"), (F.col("event_type") != "view").alias("record"))
    base = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    J.score_stream(rows, lambda b: X.classify(b, 0.3, 0.7).select("id", "prediction", "record"), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "prediction")


def parts(spark, d):
    """Train and test rows with features, grouped by host."""
    rows = keep_table(labelled_features(spark, d).join(split(spark, d).select("id", "split"), "id"), "parts")
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


@query()
def model_grid(spark, d):
    train, test = parts(spark, d)
    return models.compare(train, test, feat.NAMES, models.grid())


@query()
def research_models(spark, d):
    train, test = parts(spark, d)
    return models.compare(train, test, feat.NAMES, models.research(len(feat.NAMES)), (False,))


@query()
def predict_urls(spark, d):
    """Every page scored by a model of the labelled urls, with its risk level."""
    train, _ = parts(spark, d)
    model = models.fit(train, feat.NAMES, C.LogisticRegression(labelCol="y", weightCol="w"))
    rows = urls.with_features(urls.model_input(urls.normalize(V.load(spark, d, "pages").select("page_id", "url"), idna=False).where("url_error is null"), "host"), V.labelled(spark, d).groupBy("tld").agg(F.avg("label").alias("p")))
    return X.classify(models.scored(model, rows, ("page_id",)), 0.5, 0.9).select("page_id", "p", "prediction", "risk_level")


@query()
def text_classify(spark, d):
    """Both probabilities and the label of urls that the text model has not seen."""
    rows = V.labelled(spark, d).withColumn("y", (F.col("label") == 0).cast("int")).join(split(spark, d).select("id", "split"), "id")
    scores = models.scored(models.text_classifier().fit(rows.where("split = 'train'")), rows.where("split <> 'train'"), ("id", "y"))
    return scores.select("id", "y", "p", (1 - F.col("p")).alias("p_legitimate"), F.when(F.col("p") >= 0.5, "phishing").otherwise("legitimate").alias("prediction_text"))


@query()
def ablation(spark, d):
    """Leave-outs in the order of a forest's importances."""
    train, test = parts(spark, d)
    forest = models.importances(models.fit(train, feat.NAMES, models.grid()["random_forest"]), feat.NAMES, train)
    ranked = [x["feature"] for x in forest.orderBy(F.desc("importance"), "feature").collect()]
    return models.ablation(train, test, models.leave_out(feat.NAMES, ranked), C.LogisticRegression(labelCol="y", weightCol="w"))


_GAPS = ", ".join(f"case when id % 9 <> 0 then {c}::double end {c}" for c in feat.NAMES)
_FILLED = ", ".join(f"coalesce({c}, (select quantile_disc({c}, 0.5) from gaps)) {c}" for c in feat.NAMES)
_SCALED = ", ".join(f"round(case when stddev_samp({c}) over () > 1e-12 then ({c} - avg({c}) over ()) / stddev_samp({c}) over () else 0 end, 6) {c}" for c in feat.NAMES)


@query(FEAT.rstrip() + f", gaps as (select id, {_GAPS} from feats), filled as (select id, {_FILLED} from gaps) select id, {_SCALED} from filled")
def impute_scale(spark, d):
    """All features, those of each ninth row missing, filled by the median and standardised."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    rows = labelled_features(spark, d).withColumns({c: F.when(F.col("id") % 9 != 0, F.col(c).cast("double")) for c in feat.NAMES})
    out = Pipeline(stages=models.assembled(feat.NAMES, scale=True, impute=True)).fit(rows).transform(rows)
    # a column without spread is 0; its rounding errors are not scaled up
    flat = rows.agg(*(F.when(F.coalesce(F.stddev_samp(c), F.lit(0.0)) > 1e-12, 1.0).otherwise(0.0).alias(f"_{c}") for c in feat.NAMES))
    return out.join(F.broadcast(flat)).select("id", *(F.round(vector_to_array("features")[i] * F.col(f"_{c}"), 6).alias(c) for i, c in enumerate(feat.NAMES)))


@query()
def feature_importance(spark, d):
    train, _ = parts(spark, d)
    return models.importances(models.fit(train, feat.NAMES, models.grid()["random_forest"]), feat.NAMES, train)


@query()
def permutation_importance(spark, d):
    train, test = parts(spark, d)
    model = models.fit(train, feat.NAMES, C.LogisticRegression(labelCol="y", weightCol="w"))
    return models.permutation_importance(model, test.select("id", "y", *feat.NAMES), feat.NAMES, 10)


#: A linear score of whole numbers, the same in any engine.
FIXED = {"DomainLength": 3, "NoOfSubDomain": 11, "TLDLength": -7, "NoOfLettersInURL": 1, "NoOfDegitsInURL": 5, "NoOfOtherSpecialCharsInURL": 4}


def fixed_score(rows, keep):
    """``keep`` and ``p``: the fixed score."""
    return rows.select(*keep, sum((F.col(c) * k for c, k in FIXED.items()), F.lit(0)).cast("double").alias("p"))


def fixed_sql(name=str) -> str:
    return " + ".join(f"{k} * {name(c)}" for c, k in FIXED.items())


_KEYS = "[" + ", ".join("[" + ", ".join(map(str, datasets.permutation_keys(42_000 + r))) + "]" for r in range(10)) + "]"
_SWAP = "case when (((((greatest(x, (k % n + n - x) % n) % 2147483647) * 48271 + k % 2147483647) % 2147483647) * 69621 % 2147483647) // 65536) % 2 = 1 then (k % n + n - x) % n else x end"


@query(
    FEAT.rstrip()
    + f""", numbered as (select *, (row_number() over (order by md5('42|' || id::varchar), id) - 1)::bigint at_, count(*) over () n from feats),
moved as (select *, list_reduce(list_concat([at_], ks), lambda x, k: {_SWAP}) other from (select numbered.*, unnest({_KEYS}) ks, unnest(range(10)) r from numbered)),
scores as (
  select '' feature, 0 r, y, ({fixed_sql()})::double p from numbered union all """
    + " union all ".join(f"select '{f}', a.r, a.y, ({fixed_sql(lambda c, f=f: ('b.' if c == f else 'a.') + c)})::double from moved a join numbered b on a.other = b.at_" for f in feat.NAMES)
    + """),
h as (select feature, r, p, sum(y)::double k, sum(1 - y)::double m from scores group by all),
auc as (select feature, r, sum(m * (cp - k / 2)) / (sum(k) * sum(m)) auc from (select *, sum(k) over (partition by feature, r order by p desc) cp from h) group by all)
select a.feature, round(avg(b.auc - a.auc), 6) mean, round(stddev_pop(b.auc - a.auc), 6) std from auc a join auc b on b.feature = '' where a.feature <> '' group by a.feature"""
)
def permutation_fixed(spark, d):
    """Permutation importance of the features in a fixed score, over ten seeded bijections."""
    return rounded(models.permutation_importance(fixed_score, labelled_features(spark, d), feat.NAMES, 10), "mean", "std")


@query()
def view_experiment(spark, d):
    """The model grid on the features of two views, both weightings."""
    from functools import reduce

    from pyspark.sql import DataFrame

    out = []
    for view in ("host", "registrable"):
        rows = keep_table(labelled_features(spark, d, view).join(split(spark, d).select("id", "split"), "id"), "view")
        compared = models.compare(rows.where("split = 'train'"), rows.where("split <> 'train'"), feat.NAMES, models.grid())
        out.append(compared.select(F.lit(view).alias("view"), "*"))
    return reduce(DataFrame.union, out)


@query()
def model_rescore(spark, d):
    """Three models of all features, each with a threshold of its own from the validation part, saved and loaded: all recorded metrics
    come out again."""
    from functools import reduce

    from pyspark.sql import DataFrame

    from urlsieve.operators.boosting import BoostedTrees, Boosting
    from urlsieve.sources import tables

    rows = keep_table(labelled_features(spark, d).join(split(spark, d).select("id", "split"), "id"), "parts")
    train, held, test = (rows.where(F.col("split") == name) for name in ("train", "validation", "test"))
    kinds = {"logistic_regression": C.LogisticRegression(labelCol="y", weightCol="w"), "decision_tree": models.grid()["decision_tree"], "hist_gradient_boosting": Boosting(rounds=50, min_rows=5)}
    stored, recorded = {}, []
    for name, estimator in kinds.items():
        model, path = models.fit(train, feat.NAMES, estimator), f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
        # the highest score of a legitimate url that the false-positive cap leaves out; 0.5 where there is none
        boundary = M.threshold_max_fpr(models.scored(model, held, ("y",)), 0.05).first()
        at = 0.5 if boundary is None or boundary["boundary"] is None else float(boundary["boundary"])
        if isinstance(model, BoostedTrees):
            spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.text(path)
            again = BoostedTrees.from_json(spark.read.text(path).first()["value"])
        else:
            tables.save_model(model, path)
            again = tables.load_model(path)
        stored[name] = again, at
        flags = models.scored(model, test, ("y",)).select("y", (F.col("p") >= at).cast("double").alias("p"))
        recorded.append(M.binary_metrics(flags).select(F.lit(name).alias("model"), *_RESCORED).unpivot("model", list(_RESCORED), "metric", "recorded"))
    return models.rescore(stored, test, reduce(DataFrame.union, recorded))


_RESCORED = ("accuracy", "precision", "recall", "f1")


@query(FEAT.replace("\n", " ") + "select case when label = 0 then 'phishing' else 'legitimate' end as \"group\", count(*)::bigint total, count(*) filter (NoOfSubDomain > 1)::bigint flagged from feats group by label")
def probe_summary(spark, d):
    rows = labelled_features(spark, d)
    return rows.groupBy(F.when(F.col("label") == 0, "phishing").otherwise("legitimate").alias("group")).agg(F.count("*").alias("total"), F.count_if(F.col("NoOfSubDomain") > 1).alias("flagged"))

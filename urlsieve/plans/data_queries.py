"""Queries over labelled tables: dedup, splits, audits, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.functions import url as u
from urlsieve.operators import datasets as D
from urlsieve.operators import bootstrap as B
from urlsieve.operators import metrics as M
from urlsieve.operators import models, urls
from urlsieve.plans import sql as S
from urlsieve.plans.registry import query
from urlsieve.plans.url_queries import labelled_features
from urlsieve.sources import views as V

R = lambda c: f"round({c}, 6)"
SEC = S.with_("labelled", "sections")
SC = S.with_("scored")
FEAT = S.with_("labelled", extra=S.PRIOR) + f", feats as (select id, label, (label = 0)::int y, {S.features('mi', 'p')} from (select *, {S.TLD.format('mi')} t from (select *, {S.HOST_INPUT.format('url')} mi from labelled)) left join prior on tld_ = t)\n"
FEAT = FEAT.replace("prior as (select lower(tld) tld,", "prior as (select lower(tld) tld_,").replace("(select *, " + S.HOST_INPUT.format("url") + " mi from labelled)", "(select id, label, " + S.HOST_INPUT.format("url") + " mi from labelled)")


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(SEC + "select distinct url, label from sections")
def dedup_exact(spark, d):
    return D.dedup_rows(V.sections(spark, d).select("url", "label"))


@query(SEC + "select id, url, label from (select *, row_number() over (partition by url order by id) r from sections) where r = 1")
def dedup_url(spark, d):
    return D.dedup_first(V.sections(spark, d).select("id", "url", "label"))


@query(SEC + "select url, count(*)::bigint as rows from sections group by url having count(distinct label) > 1")
def label_conflicts(spark, d):
    return D.label_conflicts(V.sections(spark, d))


@query(SEC + "select count(*)::bigint input_rows, (count(*) - count(distinct url))::bigint duplicate_url_rows_removed, 0::bigint rejected_by_url_validation, count(distinct url)::bigint rows_used, count(distinct split_part(url, '/', 3))::bigint as groups from sections")
def prepare_stats(spark, d):
    rows = V.sections(spark, d)
    prepared = urls.normalize(D.dedup_first(rows), idna=False).withColumn("group", F.when(F.col("url_error").isNull(), u.model_host(F.col("normalized_url"))))
    return D.prepare_stats(rows, prepared)


_GROUPS = "grouped as (select *, split_part(url, '/', 3) \"group\" from labelled), gl as (select \"group\", (avg((label = 0)::int) >= 0.5)::int y, count(*) n from grouped group by 1)"
_SPLIT = (
    _GROUPS
    + ", ranked as (select *, row_number() over (partition by y order by md5('42|' || \"group\"), \"group\") r, count(*) over (partition by y) t from gl),\n"
    + "assigned as (select \"group\", y, case when r <= floor(0.8::double * t) then 'train' when r <= floor(0.9::double * t) then 'validation' else 'test' end split from ranked), splits as (select grouped.*, split from grouped join assigned using (\"group\"))"
)
SPLIT = S.with_("labelled", extra=_SPLIT) + "\n"


def grouped(spark, d):
    return V.labelled(spark, d).withColumn("group", F.split("url", "/")[2])


def split(spark, d):
    return D.grouped_split(grouped(spark, d))


@query(S.with_("labelled", extra=_GROUPS) + 'select "group", y, n from gl')
def group_label(spark, d):
    return D.group_labels(grouped(spark, d))


@query(SPLIT + 'select id, "group", split from splits')
def split_grouped(spark, d):
    return split(spark, d).select("id", "group", "split")


@query(
    S.with_("labelled", extra="ranked as (select *, row_number() over (partition by label order by md5('7|' || url), url) r, count(*) over (partition by label) t from labelled)")
    + "select id, case when r <= floor(0.8::double * t) then 'train' when r <= floor(0.9::double * t) then 'validation' else 'test' end split from ranked"
)
def split_url(spark, d):
    return D.split_groups(V.labelled(spark, d), 7, "url", "label").select("id", "split")


@query(
    SPLIT
    + """, keyed as (select 'group' as "key", "group" v, split from splits union all select 'tld', tld, split from splits), c as (select "key", v, count(*) filter (split = 'train') train, count(*) filter (split = 'validation') validation, count(*) filter (split = 'test') test from keyed group by 1, 2)
select "key", a, b, count(*) filter (x > 0 and y > 0)::bigint shared_keys, coalesce(sum(y) filter (x > 0 and y > 0), 0)::bigint rows_with_shared_key from (
  select "key", 'train' a, 'validation' b, train x, validation y from c union all select "key", 'train', 'test', train, test from c union all select "key", 'validation', 'test', validation, test from c) group by 1, 2, 3"""
)
def split_overlap(spark, d):
    return D.split_overlap(D.require_disjoint(split(spark, d)), ("group", "tld"))


@query(SPLIT + "select split, count(*)::bigint as rows, count(distinct url)::bigint unique_urls, (count(*) - count(distinct url))::bigint duplicate_rows, count(*) filter (label = 0)::bigint phishing, count(*) filter (label <> 0)::bigint legitimate from splits group by split")
def split_describe(spark, d):
    return D.describe_splits(split(spark, d))


@query(" union all ".join(f"select '{c}' as \"column\", count(*)::bigint as rows, count(*) filter ({c} is null)::bigint nulls, count(distinct {c})::bigint distinct_values from pages" for c in ("page_id", "url", "html")))
def dataset_profile(spark, d):
    return D.profile(V.load(spark, d, "pages"))


_PART = "('0x' || substr(sha256(url), {0}, 15))::ubigint::hugeint"


@query(
    SPLIT
    + f""", b as (select split, substr(sha256(url), 1, 2) b, count(*) n, sum({_PART.format(3)}) x, sum({_PART.format(20)}) y from splits group by 1, 2)
select split, sum(n)::bigint n, sha256(string_agg(b || ':' || n::varchar || ':' || x::varchar || ':' || y::varchar, ',' order by b)) sha256 from b group by split"""
)
def split_fingerprint(spark, d):
    return D.fingerprint(split(spark, d))


_LEVEL = "(select split, sum(n) n, substr(at_, 1, {0}) at_, sha256(string_agg(at_ || ':' || d, ',' order by at_ || ':' || d)) d from {1} group by split, substr(at_, 1, {0}))"


@query(SPLIT + " select split, n::bigint n, d sha256 from " + _LEVEL.format(0, _LEVEL.format(3, _LEVEL.format(6, "(select split, 1 n, sha256(url) at_, sha256(url) d from splits)"))))
def split_digest(spark, d):
    return D.digest_tree(split(spark, d))


@query(S.with_("labelled") + "select id, label from (select *, row_number() over (partition by label order by md5('42|' || id::varchar), id) r from labelled) where r <= 5")
def sample_per_group(spark, d):
    """Five examples of each class: the number is the operator's purpose."""
    return D.sample_per_group(V.labelled(spark, d), "label", 5).select("id", "label")


@query(SPLIT + f"select split, count(*) filter (label = 0)::bigint phishing, count(*) filter (label = 1)::bigint legitimate, {R('avg((label = 0)::int)')} phishing_share from splits group by split")
def class_balance(spark, d):
    return rounded(D.class_balance(split(spark, d)), "phishing_share")


@query(S.with_("labelled") + f"select label, count(*)::bigint n, {R('(select count(*) from labelled)::double / (2 * count(*))')} weight from labelled group by label")
def class_weights(spark, d):
    return rounded(D.class_weights(V.labelled(spark, d)), "weight")


@query(S.with_("labelled") + "select id, trim(url) url, label from labelled where label in (0, 1) and trim(url) <> ''")
def text_prepare(spark, d):
    return D.prepare_texts(V.labelled(spark, d))


@query("select o_totalprice from orders")
def numeric_columns(spark, d):
    return D.numeric_columns(V.load(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority"))


def _metrics_sql(where: str, positive: int = 1, by: str = "") -> str:
    y, flag = ("y", f"({where})") if positive == 1 else ("(1 - y)", f"not ({where})")
    return (
        f"m as (select {by}{',' if by else ''} count(*) filter ({flag} and {y} = 1)::bigint tp, count(*) filter ({flag} and {y} = 0)::bigint fp, count(*) filter (not ({flag}) and {y} = 1)::bigint fn, count(*) filter (not ({flag}) and {y} = 0)::bigint tn from src{' group by ' + by if by else ''})"
    )


_RATES = "round(case when tp + fp + fn + tn > 0 then (tp + tn)::double / (tp + fp + fn + tn) else 0 end, 6) accuracy, round(case when tp + fp > 0 then tp::double / (tp + fp) else 0 end, 6) as \"precision\", round(case when tp + fn > 0 then tp::double / (tp + fn) else 0 end, 6) recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp::double / (2 * tp + fp + fn) else 0 end, 6) f1, round(case when fp + tn > 0 then fp::double / (fp + tn) end, 6) false_positive_rate, tp + fp + fn + tn n"
RATES = ("accuracy", "precision", "recall", "f1", "false_positive_rate")


@query(SC.rstrip() + ", src as (select * from scored), " + _metrics_sql("p >= 0.5") + f" select tp, fp, fn, tn, {_RATES} from m")
def binary_metrics(spark, d):
    return rounded(M.binary_metrics(V.scored(spark, d)), *RATES)


@query(SC.rstrip() + ", src as (select * from scored), " + _metrics_sql("p >= 0.5", 0) + f" select tp, fp, fn, tn, {_RATES} from m")
def binary_metrics_legit(spark, d):
    return rounded(M.binary_metrics(V.scored(spark, d), positive=0), *RATES)


_HIST = ", h as (select p, sum(y) pos, sum(1 - y) neg from scored group by p), c as (select *, sum(pos) over (order by p desc) cp, sum(neg) over (order by p desc) cn from h)"


@query(SC.rstrip() + _HIST + " select round(sum(neg * (cp - pos + pos / 2))::double / (sum(pos) * sum(neg)), 6) roc_auc, sum(pos)::bigint positives, sum(neg)::bigint negatives from c")
def roc_auc(spark, d):
    return rounded(M.roc_auc(V.scored(spark, d)), "roc_auc")


@query(SC.rstrip() + _HIST + " select round(sum(pos * cp::double / (cp + cn)) / sum(pos), 6) average_precision from c")
def average_precision(spark, d):
    return rounded(M.average_precision(V.scored(spark, d)), "average_precision")


@query(SC.rstrip() + _HIST + ", a as (select floor(0.05::double * sum(1 - y))::bigint allowed from scored) select 0.05::double cap, allowed, max(p) filter (cn > allowed and neg > 0) boundary from c, a group by allowed")
def threshold_fpr(spark, d):
    return M.threshold_max_fpr(V.scored(spark, d), 0.05)


_FBETA = "(select {b}::double beta, p threshold, f fbeta from (select p, round((1 + {b} * {b}) * cp::double / ({b} * {b} * (select sum(y) from scored) + cp + cn), 12) f from c) order by f desc, p desc limit 1)"


@query(SC.rstrip() + _HIST + " select beta, threshold, round(fbeta, 6) fbeta from (" + _FBETA.format(b=1) + " union all " + _FBETA.format(b=2) + ")")
def threshold_fbeta(spark, d):
    s = V.scored(spark, d)
    return rounded(M.threshold_fbeta(s, 1.0).union(M.threshold_fbeta(s, 2.0)), "fbeta")


@query(SC.rstrip() + _HIST + " select min(p) filter (p >= 0.5 and cp >= 0.95::double * (cp + cn)) threshold from c")
def threshold_precision(spark, d):
    return M.threshold_precision(V.scored(spark, d), 0.5)


@query(
    SC.rstrip() + ", g as (select unnest([" + ", ".join(f"{x}::double" for x in M.GRID) + "]) threshold), src as (select s.*, threshold from scored s, g), " + _metrics_sql("p >= threshold", by="threshold")
    + f" select threshold, tp, fp, fn, tn, {_RATES}, round(case when tp > 0 then 5 * tp::double / (4 * (tp + fn) + tp + fp) else 0 end, 6) f2 from m"
)
def threshold_table(spark, d):
    return rounded(M.threshold_table(V.scored(spark, d)), *RATES, "f2")


def _cap_sql(cap: float) -> str:
    return f"select 'fpr_le_{cap:g}', max(p) filter (cn > floor({cap}::double * (select sum(1 - y) from scored)) and neg > 0), true from c"


@query(
    SC.rstrip() + _HIST + ", lim as (select 'fixed_0.5' criterion, 0.5::double boundary, false strict union all " + " union all ".join(_cap_sql(x) for x in (0.01, 0.02, 0.05, 0.1))
    + " union all select 'max_f1', threshold, false from " + _FBETA.format(b=1) + " union all select 'max_f2', threshold, false from " + _FBETA.format(b=2)
    + "), src as (select criterion, boundary, strict, y, boundary is null or case when strict then p > boundary else p >= boundary end flag from scored, lim), " + _metrics_sql("flag", by="criterion, boundary, strict")
    + f" select criterion, boundary, strict, tp, fp, fn, tn, {_RATES} from m"
)
def threshold_criteria(spark, d):
    return rounded(M.threshold_criteria(V.scored(spark, d)), *RATES)


_DRAWN = f"select id, y, p, p2, r, ((id % {B.MODULUS} * {B.MIX[0]}) % {B.MODULUS} + r * {B.MIX[1]}) % {B.MODULUS} h from (select id::bigint id, y, p, p2, unnest(range(1, 1001)) r from scored)"
for _shift, _by in zip(B.SHIFTS, B.MIX):
    _DRAWN = f"select id, y, p, p2, r, (xor(h, h >> {_shift}) * {_by}) % {B.MODULUS} h from ({_DRAWN})"


def _recall_sql(score: str) -> str:
    return f"""(select r, coalesce(sum(k) filter (cn <= floor(0.05 * n)), 0) / nullif(any_value(t), 0)::double recall from (
    select r, {score}, sum(w * y) k, sum(sum(w * (1 - y))) over (partition by r order by {score} desc) cn, sum(sum(w * (1 - y))) over (partition by r) n, sum(sum(w * y)) over (partition by r) t
    from drawn group by r, {score}) group by r)"""


@query(
    SC.rstrip() + f""", drawn as (
  select r, y, p, p2, len(list_filter([{", ".join(map(str, B.CUTS))}], lambda c: c <= h)) w
  from ({_DRAWN})),
gains as (select b.recall - a.recall g from {_recall_sql("p")} a join {_recall_sql("p2")} b using (r))
select round(avg(g), 6) mean, round(quantile_cont(g, 0.025), 6) ci_lo, round(quantile_cont(g, 0.975), 6) ci_hi from gains"""
)
def bootstrap_gain(spark, d):
    return rounded(B.bootstrap_gain(V.scored(spark, d), reps=1000), "mean", "ci_lo", "ci_hi")


@query(SC + "select id % 3 = 0 subset, count(*)::bigint n, round(avg((p >= 0.5)::int) filter (y = 1), 6) recall, round(avg((p >= 0.5)::int) filter (y = 0), 6) false_positive_rate from scored group by 1")
def subset_rates(spark, d):
    s = V.scored(spark, d).withColumn("subset", F.col("id") % 3 == 0)
    return rounded(M.subset_rates(s, F.col("p") >= 0.5, "subset"), "recall", "false_positive_rate")


@query(SC + "select round(o, 6) overall, round(s, 6) subset, round(s / o, 6) ratio, coalesce(s <= 2 * o, true) passes from (select avg((p >= 0.3)::int) filter (y = 0) o, avg((p >= 0.3)::int) filter (y = 0 and id % 2 = 0) s from scored)")
def subset_fpr_guard(spark, d):
    return rounded(M.fpr_guard(V.scored(spark, d), F.col("p") >= 0.3, F.col("id") % 2 == 0), "overall", "subset", "ratio")


_LIVE = ("DomainLength", "NoOfSubDomain", "NoOfDegitsInURL", "NoOfOtherSpecialCharsInURL", "TLDLength", "CharContinuationRate", "LetterRatioInURL", "TLDLegitimateProb")


@query(FEAT + " union all ".join(f"select '{c}' feature, " + ", ".join(f"round(quantile_cont({c}::double, {q}), 6) p{round(100 * q)}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + " from feats where label = 1" for c in _LIVE))
def legit_reference(spark, d):
    return rounded(M.percentiles(labelled_features(spark, d).where("label = 1"), _LIVE), "p1", "p5", "p50", "p95", "p99")


@query(
    SC + "select bin, count(*)::bigint n, round(avg(p), 6) mean_predicted, round(avg(y), 6) observed_rate, round(count(*) * abs(avg(p) - avg(y)) / (select count(*) from scored), 6) ece_part, round(sum((p - y) * (p - y)) / (select count(*) from scored), 6) brier_part from (select *, "
    + " + ".join(f"(p >= {e!r}::double)::int" for e in M.EDGES) + " bin from scored) group by bin"
)
def calibration(spark, d):
    return rounded(M.calibration(V.scored(spark, d)), "mean_predicted", "observed_rate", "ece_part", "brier_part")


@query(
    SC.rstrip() + ", x as (select 'phishing' name, count(*) filter (p >= 0.5 and y = 1) tp, count(*) filter (p >= 0.5 and y = 0) fp, count(*) filter (p < 0.5 and y = 1) fn from scored union all select 'legitimate', count(*) filter (p < 0.5 and y = 0), count(*) filter (p < 0.5 and y = 1), count(*) filter (p >= 0.5 and y = 0) from scored),"
    ' e as (select name, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end pr, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end re, case when 2 * tp + fp + fn > 0 then 2 * tp::double / (2 * tp + fp + fn) else 0 end f1, tp + fn support from x)'
    ' select name, round(pr, 6) as "precision", round(re, 6) recall, round(f1, 6) f1, support::bigint support from e union all select \'macro\', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(support)::bigint from e union all select \'weighted\', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint from e'
)
def class_report(spark, d):
    return rounded(M.class_report(V.scored(spark, d)), "precision", "recall", "f1")


_SPLIT_S = S.with_("scored")


@query(_SPLIT_S.rstrip() + ", src as (select *, id % 2 = 0 seen from scored), " + _metrics_sql("p >= 0.5", by="seen") + f" select seen, tp, fp, fn, tn, {_RATES} from m")
def overlap_breakdown(spark, d):
    """Metrics by whether a row's key is among those of a training part (here: the even ids)."""
    s = V.scored(spark, d)
    known = s.select("id").where("id % 2 = 0").distinct().withColumn("hit", F.lit(True))
    return rounded(M.binary_metrics(s.join(known, "id", "left").withColumn("seen", F.coalesce("hit", F.lit(False))), by=("seen",)), *RATES)


_OUT = "case when y = 1 and p >= 0.5 then 'TP' when y = 1 then 'FN' when p >= 0.5 then 'FP' else 'TN' end"
_JOINED = FEAT.rstrip() + ", scored as " + V.SQL["scored"].split(" as ", 1)[1] + f", o as (select feats.*, scored.p, {_OUT.replace('y = 1', 'feats.y = 1')} outcome from feats join scored using (id))\n"


def outcomes(spark, d):
    rows = labelled_features(spark, d).drop("y").join(V.scored(spark, d), "id")
    return rows.withColumn("outcome", M.outcome(F.col("p") >= 0.5))


@query(_JOINED + "select outcome, count(*)::bigint n, round(median(p), 6) median_p, round(avg(TLDLegitimateProb), 6) mean_prior, round(median(DomainLength), 6) median_domain_length, round(avg((NoOfSubDomain > 1)::int), 6) share_with_subdomain from o group by outcome")
def outcome_patterns(spark, d):
    out = outcomes(spark, d).groupBy("outcome").agg(
        F.count("*").alias("n"), F.percentile("p", F.lit(0.5)).alias("median_p"), F.avg("TLDLegitimateProb").alias("mean_prior"), F.percentile("DomainLength", F.lit(0.5)).alias("median_domain_length"),
        F.avg((F.col("NoOfSubDomain") > 1).cast("int")).alias("share_with_subdomain"),
    )
    return rounded(out, "median_p", "mean_prior", "median_domain_length", "share_with_subdomain")


@query(
    S.with_("labelled", "scored", extra=f"o as (select {_OUT} outcome, array_to_string(l[greatest(len(l) - 1, 1):], '.') parent from (select y, p, string_split({S.HOSTNAME.format('url')}, '.') l from labelled join scored using (id)))")
    + 'select outcome, parent, "rows", "rank" from (select outcome, parent, count(*)::bigint "rows", (row_number() over (partition by outcome order by count(*) desc, parent))::int "rank" from o group by 1, 2) where "rank" <= 15'
)
def top_parents(spark, d):
    """The fifteen most frequent parents of each outcome: a top-k report."""
    rows = V.labelled(spark, d).join(V.scored(spark, d), "id")
    return M.top_parents(rows.select(M.outcome(F.col("p") >= 0.5).alias("outcome"), u.parent_domain(u.hostname(F.col("url"))).alias("parent")))


@query(
    FEAT + " union all ".join(f"select '{c}' feature, 'constant' reason, min({c})::double as \"value\" from feats having min({c}) = max({c})" for c in feat.NAMES)
    + " union all select 'URLLength', 'DomainLength plus a constant', min(URLLength - DomainLength)::double from feats having min(URLLength - DomainLength) = max(URLLength - DomainLength)"
)
def degenerate_features(spark, d):
    return M.degenerate_features(labelled_features(spark, d), feat.NAMES)


_CORR = ("URLLength", "DomainLength", "NoOfLettersInURL", "LetterRatioInURL", "NoOfSubDomain", "NoOfOtherSpecialCharsInURL", "SpacialCharRatioInURL")


@query(FEAT + "select * from (" + " union all ".join(f"select '{a}' a, '{b}' b, round(corr({a}::double, {b}::double), 6) r from feats" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]) + ") where abs(r) >= 0.9")
def correlated_pairs(spark, d):
    return rounded(M.correlated_pairs(labelled_features(spark, d), _CORR), "r")


@query(
    FEAT.rstrip() + f", g as (select sum(y) pos, count(*) n from feats group by {', '.join(feat.NAMES)}) select sum(n)::bigint as rows, coalesce(sum(n) filter (pos > 0 and pos < n), 0)::bigint rows_in_mixed_vectors, count(*)::bigint distinct_vectors,"
    " round(sum(least(pos, n - pos))::double / sum(n), 6) minimum_error, round(1 - coalesce(sum(pos) filter (2 * pos <= n), 0)::double / sum(pos), 6) maximum_recall from g"
)
def label_ambiguity(spark, d):
    return rounded(M.label_ambiguity(labelled_features(spark, d), feat.NAMES), "minimum_error", "maximum_recall")


@query(FEAT + " union all ".join(f"select label, '{c}' feature, round(avg({c}), 6) mean from feats group by label" for c in _LIVE))
def class_means(spark, d):
    return rounded(models.class_means(labelled_features(spark, d), _LIVE), "mean")


@query(FEAT + " union all ".join(f"select '{c}' feature, round(case when min({c}) = max({c}) then 0.5 else greatest(a, 1 - a) end, 6) auc from (select {c}, (select sum(n * (cp - k / 2)) / (sum(k) * sum(n)) from (select sum(y)::double k, sum(1 - y)::double n, sum(sum(y)) over (order by {c}::double desc) cp from feats group by {c}::double)) a from feats) group by a" for c in _LIVE))
def single_feature_auc(spark, d):
    return rounded(models.single_feature_auc(labelled_features(spark, d), _LIVE), "auc")


@query(SC + "select id, v phishing_votes, case when v > 1 then 0 else 1 end prediction, round(greatest(v, 3 - v)::double / 3, 6) confidence, case when v > 1 then 'phishing' else 'legitimate' end prediction_text from (select id, (p >= 0.5)::int + (p2 >= 0.5)::int + (p + p2 >= 0.9)::int v from scored)")
def ensemble_vote(spark, d):
    s = V.scored(spark, d)
    votes = {"m1": F.col("p") >= 0.5, "m2": F.col("p2") >= 0.5, "m3": F.col("p") + F.col("p2") >= 0.9}
    out = M.majority_vote(s.withColumns({k: 1 - v.cast("int") for k, v in votes.items()}), tuple(votes))
    return rounded(out.select("id", "phishing_votes", "prediction", "confidence", "prediction_text"), "confidence")


@query(SC + "select coalesce(max_by(model, gain) filter (lo > 0), 'p') model, count(*) filter (lo > 0) > 0 replaced from (select 'p2' model, avg(p2 - p) gain, avg(p2 - p) - 0.05 lo from scored union all select 'mean', avg((p + p2) / 2 - p + 0.1), avg((p + p2) / 2 - p) + 0.05 from scored)")
def model_select(spark, d):
    s = V.scored(spark, d)
    gain = lambda name, g, lo: s.agg(F.lit(name).alias("model"), F.avg(g).alias("mean"), (F.avg(g) + lo).alias("ci_lo"))
    half = (F.col("p") + F.col("p2")) / 2 - F.col("p")
    a, b = gain("p2", F.col("p2") - F.col("p"), -0.05), s.agg(F.lit("mean").alias("model"), F.avg(half + 0.1).alias("mean"), (F.avg(half) + 0.05).alias("ci_lo"))
    return M.select_model(a.union(b), "p")

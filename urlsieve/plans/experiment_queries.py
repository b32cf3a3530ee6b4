"""Queries over files, and the experiments on methods, features and probes."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlsieve.functions import features as feat
from urlsieve.functions import url as u
from urlsieve.operators import datasets as D
from urlsieve.operators import explain as X
from urlsieve.operators import metrics as M
from urlsieve.operators import models, urls
from urlsieve.plans import sql as S
from urlsieve.plans.data_queries import _RATES, FEAT, RATES, SC, _metrics_sql, rounded, split
from urlsieve.plans.history_queries import FIXED, fixed_score, fixed_sql
from urlsieve.plans.registry import query
from urlsieve.plans.url_queries import _features_sql, featured, labelled_features, prior
from urlsieve.sources import tables
from urlsieve.sources import views as V


def fresh(spark, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def regression():
    return C.LogisticRegression(labelCol="y", weightCol="w")


# --- files


@query("select page_id, url from pages")
def csv_load(spark, d):
    """Every url through a CSV file with a given schema."""
    path = fresh(spark, "urls")
    tables.write_csv(V.load(spark, d, "pages").select("page_id", "url"), path)
    return tables.load_csv(spark, path, "page_id long, url string")


def _scored_file(spark, d, fitted):
    """The features of all labelled urls as a CSV file, scored into another one by the model that ``fitted`` makes of them."""
    rows = labelled_features(spark, d)
    source, target = fresh(spark, "features"), fresh(spark, "scores")
    tables.write_csv(rows, source)
    tables.score_file(spark, source, fitted(rows), target, rows.schema)
    out = rows.schema.add("prediction", "integer").add("prediction_text", "string")
    return tables.load_csv(spark, target, out).select("id", "y", "prediction", "prediction_text")


@query()
def batch_score(spark, d):
    """A fitted model over files, after a check of the columns that it expects."""

    def fitted(rows):
        model = models.fit(rows, feat.NAMES, regression())
        tables.require_columns(tables.model_columns(model), feat.NAMES)
        return model

    return _scored_file(spark, d, fitted)


@query(FEAT.rstrip() + f" select id, y, ({fixed_sql()} > 120)::int prediction, case when {fixed_sql()} > 120 then 'phishing' else 'legitimate' end prediction_text from feats")
def batch_score_fixed(spark, d):
    """The same with a fixed linear model, saved and loaded before it scores."""

    def fitted(rows):
        score = " + ".join(f"{k} * {c}" for c, k in FIXED.items())
        path = fresh(spark, "model")
        tables.save_model(Pipeline(stages=[SQLTransformer(statement=f"select *, cast({score} > 120 as int) as prediction from __THIS__")]).fit(rows), path)
        return tables.load_model(path)

    return _scored_file(spark, d, fitted)


@query(SC.rstrip() + ", src as (select * from scored), " + _metrics_sql("p >= 0.5") + f" select tp, fp, fn, tn, {_RATES} from m")
def report_json(spark, d):
    """A report of metrics written as JSON and read back."""
    path, report = fresh(spark, "report"), rounded(M.binary_metrics(V.scored(spark, d)), *RATES)
    tables.write_json(report, path)
    return spark.read.schema(report.schema).json(path)


@query(S.with_("labelled", extra=S.PRIOR) + "select tld, p from prior")
def prior_file(spark, d):
    """The prior written and loaded."""
    path = fresh(spark, "prior")
    tables.write_prior(prior(spark, d), path)
    return tables.load_prior(spark, path)


# --- data


@query(S.with_("labelled") + "select id, (row_number() over (order by md5('42|' || id::varchar), id))::bigint \"position\" from labelled")
def seeded_shuffle(spark, d):
    return D.shuffle_rank(V.labelled(spark, d)).select("id", F.col("position").cast("long").alias("position"))


@query(
    S.with_("labelled", extra=S.PRIOR)
    + f"select length(url) - length({S.HOST_INPUT.format('url')}) as \"offset\", count(*)::bigint as rows from pages group by 1"
)
def feature_offsets(spark, d):
    """How far one view's lengths are from the other's as the stored ones: a row for each difference."""
    a, b = featured(spark, d, "full").select("page_id", "URLLength"), featured(spark, d, "host").select("page_id", F.col("URLLength").alias("stored"))
    return a.join(b, "page_id").groupBy((F.col("URLLength") - F.col("stored")).cast("long").alias("offset")).agg(F.count("*").alias("rows"))


@query(
    SC.rstrip() + ", src as (select * from scored), " + _metrics_sql("p >= 0.5")
    + ", r as (select tp::double / (tp + fn) r, fp::double / (fp + tn) f from m) select id, 'A signal from the name alone; in tests it found ' || format('{:.1f}', 100 * r) || '% of phishing urls and flagged ' || format('{:.1f}', 100 * f) || '% of others.' disclaimer from scored, r"
)
def disclaimer(spark, d):
    rows = V.scored(spark, d)
    return X.disclaimer(rows, M.binary_metrics(rows)).select("id", "disclaimer")


@query(
    S.with_("labelled", extra=S.PRIOR) + ", f as (" + _features_sql(f"select page_id, {S.HOST_INPUT.format('url')} mi from pages")
    + f"), s as (select page_id, least(greatest({fixed_sql()}, 0), 200) / 200.0::double p from f) select page_id, round(p, 6) p, case when p < 0.5 then 'Safe' when p >= 0.9 then 'Phishing' else 'Suspicious' end prediction,"
    " case when p < 0.5 then 'Low' when p >= 0.9 then 'High' else 'Medium' end risk_level from s"
)
def predict_fixed(spark, d):
    """Every page scored by the fixed score, with its risk level: the path of ``predict_urls`` without a fit."""
    scores = fixed_score(featured(spark, d, "host"), ("page_id",)).withColumn("p", F.least(F.greatest("p", F.lit(0.0)), F.lit(200.0)) / 200)
    return rounded(X.classify(scores, 0.5, 0.9), "p").select("page_id", "p", "prediction", "risk_level")


# --- experiments


def _tested(rows: DataFrame, assigned: DataFrame, columns, name: str) -> DataFrame:
    """Scores on the test part of a model of the train part."""
    # a fit makes many passes; each reads the table, and none makes features or splits again
    parts = tables.keep_table(rows.join(assigned.select("id", "split"), "id").select("y", "split", *columns), "parts")
    model = models.fit(parts.where("split = 'train'"), columns, regression())
    return models.scored(model, parts.where("split <> 'train'"), ("y",)).select(F.lit(name).alias("experiment"), F.lit(len(columns)).alias("n_features"), "y", "p")


@query()
def methodology(spark, d):
    """The same model under five methods: rows split at random with the label's own host statistic among the columns (a leak) or
    without it, urls kept apart in two views, and hosts kept apart."""
    full, host = (tables.keep_table(labelled_features(spark, d, v).select("id", "y", *feat.NAMES), v) for v in ("full", "host"))
    leak = V.labelled(spark, d).withColumn("h", u.hostname(F.col("url")))
    leak = leak.join(leak.groupBy("h").agg(F.avg("label").alias("host_label")), "h").select("id", "host_label")
    at_random = tables.keep_table(D.split_groups(V.labelled(spark, d).select("id", "label"), 42, "id", "label").select("id", "split"), "at-random")
    by_url = tables.keep_table(D.split_groups(V.labelled(spark, d), 42, "url", "label").select("id", "split"), "by-url")
    runs = [
        _tested(full.join(leak, "id"), at_random, (*feat.NAMES, "host_label"), "A: leaked column, rows at random"),
        _tested(full, at_random, feat.NAMES, "A2: features, rows at random"),
        _tested(full, by_url, feat.NAMES, "B1: full view, urls apart"),
        _tested(host, by_url, feat.NAMES, "B2: host view, urls apart"),
        _tested(host, split(spark, d), feat.NAMES, "C: host view, hosts apart"),
    ]
    return M.binary_metrics(reduce(DataFrame.union, runs), by=("experiment", "n_features"))


_LEXICAL = ("hyphens", "entropy", "vowel_ratio", "max_consonant_run", "keyword_hits", "on_platform")


@query()
def feature_sufficiency(spark, d):
    """The seventeen features against these and the six diagnostic columns of the host."""
    host = V.labelled(spark, d).select("id", u.hostname(F.col("url")).alias("host"))
    parents = urls.platform_parents(host).select("parent", F.lit(1).alias("on_platform"))
    extra = host.withColumn("parent", u.parent_domain(F.col("host"))).join(parents, "parent", "left").fillna(0, ["on_platform"])
    extra = extra.select("id", "on_platform", *(c.alias(n) for n, c in urls.host_lexical(F.col("host")).items()))
    rows = tables.keep_table(labelled_features(spark, d).select("id", "y", *feat.NAMES), "features")
    assigned = tables.keep_table(split(spark, d).select("id", "split"), "split")
    runs = [_tested(rows, assigned, feat.NAMES, "features"), _tested(rows.join(extra, "id"), assigned, (*feat.NAMES, *_LEXICAL), "features and host columns")]
    return M.binary_metrics(reduce(DataFrame.union, runs), by=("experiment", "n_features"))


@query()
def lr_coefficients(spark, d):
    rows = labelled_features(spark, d)
    return models.coefficients(models.fit(rows, feat.NAMES, regression()), feat.NAMES, rows)


@query()
def view_subset_rates(spark, d):
    """Recall and false-positive rate of a model of each view, on hosts with a subdomain and on others."""
    rows = urls.registrable(V.labelled(spark, d).withColumn("host", u.hostname(F.col("url"))), V.psl(spark))
    subset = urls.structure_groups(rows).select("id", "has_subdomain")
    assigned, out = tables.keep_table(split(spark, d).select("id", "split").join(subset, "id"), "split"), []
    for view in ("host", "registrable"):
        parts = tables.keep_table(labelled_features(spark, d, view).join(assigned, "id").select("y", "split", "has_subdomain", *feat.NAMES), "parts")
        model = models.fit(parts.where("split = 'train'"), feat.NAMES, regression())
        scores = models.scored(model, parts.where("split <> 'train'"), ("y", "has_subdomain"))
        out.append(M.subset_rates(scores, F.col("p") >= 0.5, "has_subdomain").select(F.lit(view).alias("view"), "*"))
    return reduce(DataFrame.union, out)


@query()
def probe_scores(spark, d):
    """Probe groups made of every page's url (its host alone, its first path segment, the whole), scored by models of two views: how
    many of each group each model flags."""
    pages, out = V.load(spark, d, "pages").select("url"), None
    cut = {"host": r"^([^:]*://[^/?#]*)", "section": r"^([^:]*://[^/?#]*(?:/[^/?#]*)?)", "whole": r"(?s)^(.*)$"}
    probes = reduce(DataFrame.union, (pages.select(F.lit(g).alias("group"), F.regexp_extract("url", p, 1).alias("url")).distinct() for g, p in cut.items()))
    valid = urls.normalize(probes, idna=False).where("url_error is null")
    for view in ("host", "registrable"):
        rows = labelled_features(spark, d, view)
        model = models.fit(rows, feat.NAMES, regression())
        scores = models.scored(model, urls.with_features(urls.model_input(valid, view, V.psl(spark)), prior(spark, d)), ("group", "url"))
        found = scores.groupBy("group").agg(F.count("*").alias("total"), F.count_if(F.col("p") >= 0.5).alias(f"flagged_{view}"))
        out = found if out is None else out.join(found.drop("total"), "group")
    return out


@query()
def model_card(spark, d):
    """One row on a model: version, view, features, thresholds, test metrics and the classes of each split."""
    assigned = split(spark, d)
    parts = labelled_features(spark, d).join(assigned.select("id", "split"), "id")
    model = models.fit(parts.where("split = 'train'"), feat.NAMES, regression())
    scores = models.scored(model, parts.where("split = 'test'"), ("y",))
    held = models.scored(model, parts.where("split = 'validation'"), ("y",))
    flag = M.threshold_max_fpr(held, 0.05).select(F.col("boundary").alias("flag_above"))
    high = M.threshold_precision(held, 0.5).toDF("high_from")
    tested = M.binary_metrics(scores).select(F.struct("*").alias("test_metrics"))
    classes = D.class_balance(assigned).agg(F.sort_array(F.collect_list(F.struct("split", "phishing", "legitimate", "phishing_share"))).alias("classes"))  # three rows
    one = reduce(lambda a, b: a.join(F.broadcast(b)), (tested, flag, high, classes))
    return one.select(F.lit("lr-1").alias("version"), F.lit("host").alias("view"), F.array(*map(F.lit, feat.NAMES)).alias("features"), "flag_above", "high_from", "test_metrics", "classes")


_KINDS = ", ".join(f"('{n}', '{k}', {low}::double, {'null' if high is None else high}::double, '{text.replace(chr(39), chr(39) * 2)}')" for n, k, low, high, text in feat.SCHEMA)


@query(
    FEAT.rstrip() + f", kinds(name, kind, low, high, description) as (values {_KINDS}), seen as (" + " union all ".join(f"select '{n}' name, min({n})::double least, max({n})::double greatest from feats" for n in feat.NAMES)
    + ") select name, kind, low, high, description, round(least, 6) least, round(greatest, 6) greatest from kinds join seen using (name)"
)
def feature_ranges(spark, d):
    """Name, type, range and description of each feature, and the range seen in the labelled urls."""
    rows = labelled_features(spark, d)
    schema = spark.createDataFrame([(n, k, float(low), None if high is None else float(high), t) for n, k, low, high, t in feat.SCHEMA], "name string, kind string, low double, high double, description string")
    long = rows.unpivot([], [F.col(n).cast("double").alias(n) for n in feat.NAMES], "name", "v")
    return rounded(schema.join(long.groupBy("name").agg(F.min("v").alias("least"), F.max("v").alias("greatest")), "name"), "least", "greatest")

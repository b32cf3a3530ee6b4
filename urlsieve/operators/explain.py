"""Risk levels, explanation items and texts, from computed values only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Features of which a high value is noteworthy, and the words for it.
HIGH = (
    ("DomainLength", "characters in the assessed domain"),
    ("NoOfSubDomain", "levels after www in the assessed domain"),
    ("NoOfDegitsInURL", "digits in the assessed domain"),
    ("NoOfOtherSpecialCharsInURL", "separators in the assessed domain"),
    ("TLDLength", "characters in the top-level domain"),
)
DOMAIN_ONLY = ("TLDLength", "NoOfSubDomain", "TLDLegitimateProb", "CharContinuationRate")
LEVELS = {"Safe": "Low", "Suspicious": "Medium", "Phishing": "High"}
VERDICTS = {"Safe": "low risk", "Suspicious": "raised risk", "Phishing": "high risk"}


def classify(df: DataFrame, flag: float, high: float | None, p: str = "p") -> DataFrame:
    """``df`` with ``prediction, risk_level, confidence, label``: below ``flag`` Safe, from ``high`` on Phishing (never, if null),
    else Suspicious; without a probability all is null."""
    score = F.col(p)
    upper = F.lit(False) if high is None else score >= high
    prediction = F.when(score < flag, "Safe").when(upper, "Phishing").when(score.isNotNull(), "Suspicious")
    level = F.when(score < flag, "Low").when(upper, "High").when(score.isNotNull(), "Medium")
    return df.withColumns({"prediction": prediction, "risk_level": level, "confidence": F.when(score < flag, 1 - score).otherwise(score), "label": F.when(score < flag, 1).when(score.isNotNull(), 0)})


def item(source: str, severity: str | Column, key: str | None, message: Column) -> Column:
    s = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(source).alias("source"), s.alias("severity"), F.lit(key).cast("string").alias("key"), message.alias("message"))


def explain(df: DataFrame, reference: dict[str, dict[str, float]], view: str = "host") -> DataFrame:
    """``df`` (features, facts, ``subdomain``, ``registrable_domain``, ``embedded_domain``, ``scheme_assumed``) with ``explanations``, an
    array of items in source order, and ``messages``, their texts by severity.

    ``reference``: percentiles of legitimate rows by feature; a short table, so it goes into the plan as literals."""
    ip = F.col("IsDomainIP") == 1
    when = lambda cond, *a: F.when(cond, item(*a))
    text = F.lit
    out = [when(ip, "model_feature", "risk", "IsDomainIP", text("the host is or contains an IP address"))]
    out.append(when(~ip & (F.col("TLDLegitimateProb") == 0), "model_feature", "caution", "TLDLegitimateProb", text("the top-level domain has no legitimate use on record")))
    for name, words in HIGH:
        ref = reference.get(name)
        if not ref:
            continue
        fits = F.col(name) > ref["p95"]
        if name in DOMAIN_ONLY:
            fits = fits & ~ip
        severity = F.when(F.col(name) > ref["p99"], "risk").otherwise("caution")
        out.append(when(fits, "model_feature", severity, name, F.concat(F.col(name).cast("string"), F.lit(f" {words}; 95% of legitimate ones have at most {ref['p95']:g}"))))
    ref = reference.get("CharContinuationRate")
    if ref:
        out.append(when(~ip & (F.col("CharContinuationRate") < ref["p5"]), "model_feature", "caution", "CharContinuationRate", F.concat(F.lit("letters, digits and symbols are mixed: rate "), F.format_number("CharContinuationRate", 2))))
    out += [
        when(F.col("has_userinfo"), "observation", "risk", "userinfo", text("text before @ hides the real host")),
        when(F.col("is_punycode"), "observation", "caution", "punycode", text("an internationalised name can look like another")),
        when(F.col("non_standard_port"), "observation", "caution", "port", F.concat(F.lit("port "), F.col("port").cast("string"))),
        when(F.col("scheme") == "http", "observation", "caution", "https", text("the connection is not encrypted")),
        when(F.col("is_private_or_local"), "observation", "info", "local", text("the host is local or private, so the score means little")),
        when(F.col("hyphen_in_host"), "observation", "info", "hyphen", text("the host has a hyphen")),
    ]
    below = ~F.col("subdomain").isin("", "www") & (F.col("registrable_domain") != "")
    if view == "registrable":
        out.append(when(below, "observation", "info", "subdomain", F.concat(F.lit("the model assessed "), F.col("registrable_domain"), F.lit(", not the subdomain "), F.col("subdomain"))))
    embedded = below & (F.col("embedded_domain") != "")
    dots = F.regexp_count("subdomain", F.lit(r"\."))
    out.append(when(embedded, "observation", "caution", "embedded_domain", F.concat(F.lit("the subdomain contains "), F.col("embedded_domain"))))
    out.append(when(below & ~embedded & (dots >= 2), "observation", "caution", "deep_subdomain", F.concat((dots + 1).cast("string"), F.lit(" subdomain levels"))))
    out.append(when(F.col("scheme_assumed"), "observation", "info", "scheme", text("no scheme was given; https was assumed")))
    found = F.array_compact(F.array(*out))
    calm = ~F.exists(found, lambda x: x["severity"].isin("risk", "caution"))
    typical = item("model_feature", "info", None, text("no feature is outside the range of legitimate urls"))
    all_ = F.when(calm, F.array_append(found, typical)).otherwise(found)
    return df.withColumn("explanations", all_).withColumn("messages", F.flatten(F.array(*(_texts(s) for s in ("risk", "caution", "info")))))


def _texts(severity: str) -> Column:
    return F.transform(F.filter("explanations", lambda x: x["severity"] == severity), lambda x: x["message"])


def indicators(column: str = "explanations", most: int = 8) -> Column:
    """The first items as ``severity, source, key, message``."""
    return F.slice(F.transform(column, lambda x: F.struct(x["severity"].alias("severity"), x["source"].alias("source"), x["key"].alias("key"), x["message"].alias("message"))), 1, most)


def verdict_text(df: DataFrame, flag: float, high: float) -> DataFrame:
    """``df`` (with ``prediction, p``) and ``verdict, summary``."""
    table = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    score = F.format_string("%.2f", "p")
    place = F.when(F.col("prediction") == "Safe", F.concat(F.lit(f" is below {flag:.2f}"))).when(F.col("prediction") == "Suspicious", F.lit(f" is from {flag:.2f} to below {high:.2f}")).otherwise(F.lit(f" is {high:.2f} or more"))
    return df.withColumn("verdict", table[F.col("prediction")]).withColumn("summary", F.concat(F.col("verdict"), F.lit(": score "), score, place))


def disclaimer(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """``df`` with a sentence from the one row ``recall, false_positive_rate`` of ``metrics``."""
    percent = lambda c: F.format_string("%.1f%%", 100 * F.col(c))
    one = metrics.limit(1).select(F.concat(F.lit("A signal from the name alone; in tests it found "), percent("recall"), F.lit(" of phishing urls and flagged "), percent("false_positive_rate"), F.lit(" of others.")).alias("disclaimer"))
    return df.join(F.broadcast(one))


def threat_enrich(df: DataFrame, threats: DataFrame, key: str = "host") -> DataFrame:
    """``df`` with ``listed`` and the sorted distinct ``threat_types`` of its key; scores stay as they are."""
    types = threats.groupBy(key).agg(F.sort_array(F.collect_set("threat_type")).alias("threat_types"))
    return df.join(types, key, "left").withColumns({"listed": F.col("threat_types").isNotNull(), "threat_types": F.coalesce("threat_types", F.array().cast("array<string>"))})

"""URL filters: rules first, gradient-boosted trees on lexical features for every other URL.

A rule fits its host and all subdomains if the URL's path starts with the rule's path; the longest rule wins. URLs that
a rule decides are the labelled ones: the trees learn from a bounded sample of them (``max_labelled``, 40,000, in hash
order) and judge the rest. Features: lengths, depth, digit ratio, entropy of the characters, parameter counts, and the
share of blocked training URLs by suffix and by file extension (smoothed by ten URLs of the overall share; a training
URL's own label is left out of its shares). Rules' own
host names and paths are no features.

Defined cases: a null URL or one without ``://`` has empty host and path; without rules that fit (or of one verdict
only) every other URL gets that verdict, or allow; repeated rows get equal rows; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_LABELLED = 40_000
TREES, DEPTH = 12, 4
SUFFIX_WEIGHT = 10.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and the path of a URL; both empty without ``://``."""
    parts = F.coalesce(url, F.lit(""))
    at = F.instr(parts, "://")
    rest = F.when(at > 0, parts.substr(at + 3, F.length(parts)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null where none fits. Rules are a short fixed list.

    rules are ``(verdict, "host/path")``; of two that are equally long the first wins.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        at, _, under = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + under)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical_features(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Numeric features of a URL, from built-in functions."""
    text = F.coalesce(url, F.lit(""))
    length = F.length(text)
    digits = F.length(F.regexp_replace(text, r"[^0-9]", ""))
    query = F.coalesce(F.regexp_extract(text, r"\?([^#]*)", 1), F.lit(""))
    params = F.when(query == "", 0).otherwise(F.size(F.split(query, "&")))
    letters = F.array_distinct(F.split(text, ""))
    share = lambda c: (length - F.length(F.replace(text, c, F.lit("")))) / F.greatest(length, F.lit(1))
    used = F.filter(letters, lambda c: c != "")
    entropy = F.aggregate(used, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(F.greatest(share(c), F.lit(1e-12))))
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return {
        "url_length": length, "host_length": F.length(host), "path_length": F.length(path),
        "host_labels": F.size(F.split(host, r"\.")), "depth": depth, "digit_ratio": digits / F.greatest(length, F.lit(1)),
        "entropy": entropy, "n_params": params, "query_length": F.length(query),
        "has_fragment": F.instr(text, "#") > 0, "secure": text.startswith("https"),
        "hyphens": F.length(F.regexp_replace(text, "[^-]", "")),
    }


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, block_score)`` for each row of pages; block_score is null under a rule."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("*", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"))
    features = lexical_features(F.col("url"), F.col("host"), F.col("path"))
    rows = rows.select("*", *(c.cast("double").alias(k) for k, c in features.items()))
    rows = rows.withColumn("suffix", F.coalesce(F.regexp_extract("host", r"([^.]*)$", 1), F.lit("")))
    rows = rows.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)))
    known = rows.where("ruled is not null").withColumn("label", (F.col("ruled") == "block").cast("double"))
    known = known.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(max_labelled)
    known = scratch.save(known.coalesce(4), "known")
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.avg("label"), F.lit(0.0)).alias("rate")).first()
    out = ("page_id", "host", "path", "rule")
    if total.n == 0 or total.rate in (0.0, 1.0):
        method = F.lit("block" if total.n and total.rate == 1.0 else "allow")
        return rows.select(*out, F.coalesce("ruled", method).alias("verdict"), F.when(F.col("ruled").isNull(), total.rate).alias("block_score"))

    def rates(key: str) -> DataFrame:
        # at most max_labelled rows, so the broadcast is bounded
        smooth = (F.sum("label") + SUFFIX_WEIGHT * total.rate) / (F.count("*") + SUFFIX_WEIGHT)
        return scratch.save(known.groupBy(key).agg(smooth.alias(f"{key}_rate"), F.count("*").alias(f"{key}_n")).coalesce(1), key)

    tables = {key: rates(key) for key in ("suffix", "extension")}
    fill = lambda df: reduce(
        lambda d, key: d.join(F.broadcast(tables[key].drop(f"{key}_n")), key, "left").fillna({f"{key}_rate": total.rate}), tables, df
    )

    def apart(df: DataFrame) -> DataFrame:
        """Training rows with the rates of all other training rows, so that no tree sees a row's own label."""
        for key in tables:
            sums = F.col(f"{key}_rate") * (F.col(f"{key}_n") + SUFFIX_WEIGHT) - F.col("label")
            df = df.join(F.broadcast(tables[key]), key).withColumn(f"{key}_rate", sums / (F.col(f"{key}_n") - 1 + SUFFIX_WEIGHT))
        return df

    names = [*features, *(f"{key}_rate" for key in tables)]
    gather = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    trees = GBTClassifier(
        labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, maxBins=32, seed=7, cacheNodeIds=False
    )
    model = Pipeline(stages=[gather, trees]).fit(apart(known).select("label", *names).coalesce(4))
    scored = model.transform(fill(rows))
    score = F.when(F.col("ruled").isNull(), vector_to_array("probability")[1])
    method = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return scored.select(*out, F.coalesce("ruled", method).alias("verdict"), score.alias("block_score"))

"""URL filters by association rules, in DataFrame functions and Spark's FP-growth only.

A URL is a set of tokens: host labels, path segments with digits folded, query keys. FP-growth mines the token
sets that are frequent among labelled URLs together with their label; sets whose confidence for a label is high
enough become rules. Each rule is filed in an inverted index under its rarest token; a URL looks up its own
tokens, and a rule found there fits if all its tokens are in the URL. Of fitting rules the one of the highest
confidence decides, then the higher support, then the longer; without one a URL is allowed.

Hand-written (host, path) rules come first: a rule fits its host and all subdomains if the path starts with the
rule's path, and the longest fitting rule wins.

Results for the unusual cases: a null url, or one without ``://``, has empty host and path and no tokens; rows that
repeat are judged each; URLs that appear under several labels count once for each; labels of one class only, or
none, give no rules; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.7
#: Rule: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BAD, GOOD = "=block", "=allow"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return common.lower_ascii(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    labels = F.transform(F.array_remove(F.split(host, r"\."), ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "#")))
    keys = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(labels, parts, keys))


def hand_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting hand-written rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from labelled URLs (bad: boolean, nulls are left out): tokens, n_tokens, key, label, support, confidence."""
    rows = labelled.where(F.col(bad_col).isNotNull()).select(tokens_of(F.col(url_col)).alias("t"), F.when(F.col(bad_col), BAD).otherwise(GOOD).alias("label"))
    rows = common.cut(rows.where(F.size("t") > 0).select(F.concat("t", F.array("label")).alias("items")))
    schema = "tokens array<string>, n_tokens int, key string, label string, support long, confidence double"
    if rows.isEmpty():
        return labelled.sparkSession.createDataFrame([], schema)
    sets = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(rows).freqItemsets
    sets = common.cut(sets.select(F.array_sort(F.expr(f"filter(items, x -> x not in ('{BAD}', '{GOOD}'))")).alias("tokens"), F.expr(f"case when array_contains(items, '{BAD}') then '{BAD}' when array_contains(items, '{GOOD}') then '{GOOD}' end").alias("label"), "freq"))
    whole = sets.where("label is null").select(F.col("tokens").alias("whole"), F.col("freq").alias("n"))
    single = sets.where("label is null and size(tokens) = 1").select(F.expr("tokens[0]").alias("key"), F.col("freq").alias("key_freq"))
    found = sets.where("label is not null and size(tokens) > 0").join(whole, F.col("tokens") == F.col("whole"))
    found = found.select("tokens", F.expr("substr(label, 2)").alias("label"), F.col("freq").alias("support"), F.expr("freq / n").alias("confidence")).where(f"confidence >= {min_confidence}")
    # the rarest token of a rule is the one it is filed under
    filed = found.select("*", F.explode("tokens").alias("token")).join(single, F.col("token") == F.col("key"))
    filed = filed.groupBy("tokens", "label", "support", "confidence").agg(F.min(F.struct("key_freq", "key")).alias("k"))
    return common.cut(filed.select("tokens", F.size("tokens").alias("n_tokens"), F.col("k.key").alias("key"), "label", "support", "confidence"))


def classify(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, url, verdict, confidence, mined) for the URLs that some mined rule fits; one row per distinct id and url."""
    rows = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).distinct().withColumn("t", tokens_of(F.col("url")))
    looked = rows.select("id", "url", "t", F.explode("t").alias("token")).join(rules, F.col("token") == F.col("key"))
    fits = looked.where(F.size(F.array_except("tokens", "t")) == 0)
    best = fits.groupBy("id", "url").agg(F.max(F.struct("confidence", "support", "n_tokens", "label", F.array_join("tokens", " ").alias("mined"))).alias("b"))
    return best.select("id", "url", F.col("b.label").alias("verdict"), F.col("b.confidence").alias("confidence"), F.col("b.mined").alias("mined"))


def judge(urls: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES, **options) -> DataFrame:
    """One row per row of urls: id, host, path, rule, verdict, mined (tokens of the mined rule that decided), confidence."""
    url = F.col(url_col)
    base = urls.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = hand_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("hand", verdict)
    found = classify(base.where("rule is null").select(F.col("id").alias(id_col), F.col("url").alias(url_col)), mine(labelled, **options), id_col, url_col)
    found = found.select(F.col("id").alias("fid"), F.col("url").alias("furl"), "verdict", "confidence", "mined")
    out = base.join(found, base["id"].eqNullSafe(found["fid"]) & base["url"].eqNullSafe(found["furl"]), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("hand", "verdict", F.lit("allow")).alias("verdict"), "mined", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose url names a labelled document by the number in its path."""
    named = pages.select("url", F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("named")).where("named is not null")
    bad = labels.groupBy("doc_id").agg(F.max(F.expr("quality = 0 or toxic = 1")).alias("bad"))
    return named.join(bad, named["named"] == bad["doc_id"]).select("url", "bad")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_pages(pages, common.read(spark, sf_dir, "labels")))

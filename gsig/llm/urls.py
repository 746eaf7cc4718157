"""URL filters: suffix rules, and gradient-boosted trees on lexical features for the urls that no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

#: (verdict, rule): a rule is a host, which stands for its subdomains too, and the start of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path; null urls and urls without :// have an empty host and path."""
    rest = F.expr("substring(url, instr(url, '://') + 3)")
    rest = F.when(F.instr("url", "://") > 0, rest).otherwise(F.lit(""))
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url")).withColumn("rest", rest)
    host = ascii_lower(F.regexp_extract("rest", r"^([^/?#]*)", 1))
    return out.select("page_id", "url", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(rules: tuple) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits per character over the characters that urls are made of."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = [(F.length(text) - F.length(F.translate(text, c, ""))) / n for c in "abcdefghijklmnopqrstuvwxyz0123456789-._/?=&"]
    return sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in share), F.lit(0.0))


def lexical(rows: DataFrame) -> DataFrame:
    """rows with f_ columns: lengths, depth, digit ratio, entropy, parameters, marks, the head of the path; and suffix, the host's last label."""
    count = lambda text, chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")
    query = F.regexp_extract("url", r"\?([^#]*)", 1)
    n = F.greatest(F.length("url"), F.lit(1)).cast("double")
    head = F.regexp_extract("path", "^/([^/]*)", 1)
    return (
        rows.withColumn("f_length", F.length("url").cast("double"))
        .withColumn("f_host", F.length("host").cast("double"))
        .withColumn("f_depth", count("path", "/"))
        .withColumn("f_labels", count("host", "."))
        .withColumn("f_digits", count("url", "0123456789") / n)
        .withColumn("f_entropy", entropy(ascii_lower(F.col("url"))))
        .withColumn("f_params", F.when(F.length(query) > 0, count(query, "&") + 1).otherwise(0.0))
        .withColumn("f_hyphens", count("host", "-"))
        .withColumn("f_marks", count("url", "%@_~;:") / n)
        .withColumn("f_secure", F.col("url").startswith("https").cast("double"))
        .withColumn("f_head", F.length(head).cast("double"))
        .withColumn("f_head_first", F.ascii(head).cast("double"))
        .withColumn("f_head_last", F.ascii(F.right(head, F.lit(1))).cast("double"))
        .withColumn("suffix", F.substring_index("host", ".", -1))
    )


FEATURES = ("f_length", "f_host", "f_depth", "f_labels", "f_digits", "f_entropy", "f_params", "f_hyphens", "f_marks", "f_secure", "f_head", "f_head_first", "f_head_last", "f_suffix_length", "f_suffix_log", "f_suffix_hosts", "f_suffix_depth")


def featured(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule, known (the verdict of the rule that fits) and the features.

    Suffix statistics are counted over all urls and know nothing of rules: how many urls and hosts a suffix has, and how deep its paths are.
    """
    rows = parts(pages).withColumn("by", ruled(rules))
    rows = lexical(rows.select("page_id", "url", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("known")))
    stats = rows.groupBy("suffix").agg(F.log1p(F.count("*")).alias("f_suffix_log"), F.log1p(F.approx_count_distinct("host")).alias("f_suffix_hosts"), F.avg("f_depth").alias("f_suffix_depth"))
    return rows.join(stats, "suffix").withColumn("f_suffix_length", F.length("suffix").cast("double"))


def fitted(rows: DataFrame, train_rows: int, trees: int, depth: int, seed: int):
    """Boosted trees that part the `known` rows, at most `train_rows` of them, those of lowest hash; or the only verdict there is, or allow."""
    train = rows.filter("known is not null").orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(train_rows).select((F.col("known") == "block").cast("double").alias("label"), *FEATURES)
    train = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(train).select("label", "features").cache()
    seen = {r["label"] for r in train.groupBy("label").count().collect()}
    if len(seen) < 2:
        train.unpersist()
        return "block" if seen == {1.0} else "allow"
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.2, cacheNodeIds=True).fit(train)
    train.unpersist()
    return model


def judge(pages: DataFrame, rules: tuple = RULES, train_rows: int = 20_000, trees: int = 15, depth: int = 4, seed: int = 3) -> DataFrame:
    """page_id, host, path, rule, verdict, block_score (null where a rule decides) for every page.

    Urls that a rule fits are the labelled ones. Boosted trees are fitted on at most `train_rows` of them, those of
    lowest hash, and judge all urls without a rule: block from 0.5. No feature holds a label. With labels of one kind only, that kind
    is the verdict, and without any it is allow. Null urls have an empty host and path, fit no rule and are judged
    like any other. Repeated rows are judged alike; an empty table gives no rows; extra columns are not read.
    """
    rows = featured(pages, rules)
    model = fitted(rows, train_rows, trees, depth, seed)
    if isinstance(model, str):
        return rows.select(F.col("page_id").cast("long"), "host", "path", "rule", F.coalesce("known", F.lit(model)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows))
    score = vector_to_array("probability")[1]
    verdict = F.coalesce("known", F.when(score >= 0.5, "block").otherwise("allow"))
    return scored.select(F.col("page_id").cast("long"), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("known").isNull(), score).alias("block_score"))


def quality(pages: DataFrame, rules: tuple = RULES, train_rows: int = 20_000, trees: int = 15, depth: int = 4, seed: int = 3, folds: int = 4) -> DataFrame:
    """known, n, right: of the urls that rules decide on a fold of hosts that the trees weren't fitted on, how many they judge as the rules do."""
    rows = featured(pages, rules)
    held_out = F.pmod(F.xxhash64("host"), F.lit(folds)) == 0
    model = fitted(rows.filter(~held_out), train_rows, trees, depth, seed)
    test = rows.filter(held_out & F.col("known").isNotNull())
    if isinstance(model, str):
        said = test.withColumn("said", F.lit(model))
    else:
        said = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(test)).withColumn("said", F.when(vector_to_array("probability")[1] >= 0.5, "block").otherwise("allow"))
    return said.groupBy("known").agg(F.count("*").alias("n"), F.count_if(F.col("said") == F.col("known")).alias("right"))

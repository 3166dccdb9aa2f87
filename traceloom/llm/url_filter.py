"""URL filtering: rules on host and path, and for the rest a logistic regression on hashed character n-grams.

Host and path are cut by string functions. A rule fits its host and all subdomains if the path starts with the rule's; the longest
(host and path together) wins. URLs that no rule fits get the verdict of a logistic regression over hashed 3- to 5-grams of host and
path, learned from a small table of labelled URLs, which was written by hand and shares no host with other data. Scoring stays in the
JVM: n-grams are hashed and looked up in the weights, in time proportional to the URL's length.

Cases: a null URL, or one without ``://``, has an empty host and path and gets the regression's verdict on them; rules that are equally
long are tried by name; repeated rows and null ids are judged one by one; an empty table gives an empty result; extra columns are
ignored, whatever their names; very long URLs count as a whole.
"""

from __future__ import annotations

from importlib import resources

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): fixed values.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BUCKETS, SIZES = 4096, (3, 4, 5)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, own, start = rule
    return ((host == own) | host.endswith("." + own)) & path.startswith(start)


def labelled_urls() -> list[tuple[str, str, int]]:
    """The table to learn from (host, path, 1 = block), which labelled_urls.tsv holds; its first lines say where it comes from."""
    text = resources.files("traceloom.llm").joinpath("labelled_urls.tsv").read_text(encoding="utf-8")
    rows = [line.split("\t") for line in text.splitlines() if line and not line.startswith("#")]
    return [(host, path, int(label == "block")) for label, host, path in rows]


def gram_buckets(host: Column, path: Column) -> Column:
    """Buckets of the 3- to 5-grams of ``^host|path$``, one after another; every character is looked at a fixed number of times."""
    chars = F.split(F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$")), "")

    def of(chars: Column, k: int) -> Column:
        last = F.size(chars) - (k - 1)
        hashed = lambda i: F.pmod(F.xxhash64(*(F.get(chars, i + j) for j in range(k))), F.lit(BUCKETS)).cast("int")
        return F.when(last > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(1)) - 1), hashed)).otherwise(F.array().cast("array<int>"))

    # An array in an array of one: so the characters are split once and not for each gram.
    once = F.transform(F.array(F.struct(chars.alias("c"))), lambda s: F.concat(*(of(s["c"], k) for k in SIZES)))
    return F.get(once, 0)


#: What may stand around a name and means nothing: each row is learned from with several of them.
PREFIXES, ENDS = ("", "www.", "m.", "shop.", "blog."), ("com", "net", "org", "info", "co.uk")


def variants(table: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
    """The rows under other prefixes and endings, every other one with the bare path, so that these carry no weight."""
    return [
        (PREFIXES[j] + host.removesuffix(".test") + "." + ENDS[(i + j) % len(ENDS)], path if j % 2 == 0 else "/", y) for i, (host, path, y) in enumerate(table) for j in range(len(PREFIXES))
    ]


def train(spark: SparkSession, table: list[tuple[str, str, int]] | None = None) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the bias: gradient descent with an L2 penalty on a small labelled table."""
    table = variants(labelled_urls() if table is None else table)
    rows = spark.createDataFrame([(i, h, p) for i, (h, p, _) in enumerate(table)], "i int, host string, path string")
    x, y = np.zeros((len(table), BUCKETS)), np.array([r[2] for r in table], float)
    for i, buckets in rows.select("i", gram_buckets(F.col("host"), F.col("path"))).collect():
        np.add.at(x[i], buckets, 1 / np.sqrt(len(buckets)))
    # The weights stay sums of rows, so the steps are taken on the rows' shares.
    products, share, b, rate = x @ x.T, np.zeros(len(y)), 0.0, 4.0
    for _ in range(600):
        error = 1 / (1 + np.exp(-(products @ share + b))) - y
        share -= rate * (error / len(y) + 1e-4 * share)
        b -= 0.5 * error.mean()
    return x.T @ share, b


def probability(host: Column, path: Column, weights: np.ndarray, bias: float) -> Column:
    """Of label 1; the weights are one literal array of fixed size."""
    table = F.from_json(F.lit("[" + ",".join(f"{v:.9g}" for v in weights) + "]"), "array<double>")
    total = F.aggregate(
        gram_buckets(host, path), F.struct(F.lit(0.0).alias("z"), F.lit(0).alias("n")), lambda s, b: F.struct((s["z"] + F.get(table, b)).alias("z"), (s["n"] + 1).alias("n"))
    )
    z = F.get(F.transform(F.array(total), lambda t: t["z"] / F.sqrt(t["n"])), 0) + bias
    return 1 / (1 + F.exp(-z))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (the regression's probability of block)."""
    weights, bias = model or train(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2])):
        fit, name = fits(F.col("host"), F.col("path"), r), F.lit(r[1] + r[2])
        rule = F.when(fit, name) if rule is None else rule.when(fit, name)
        verdict = F.when(fit, F.lit(r[0])) if verdict is None else verdict.when(fit, F.lit(r[0]))
    p = probability(F.col("host"), F.col("path"), weights, bias)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return rows.withColumn("score", p).select("page_id", "host", "path", rule.alias("rule") if rule is not None else F.lit(None).cast("string").alias("rule"), F.coalesce(verdict, own).alias("verdict") if verdict is not None else own.alias("verdict"), "score")

"""URL filters: fixed rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path prefix; it fits its host and all subdomains if the path starts with its path, and the longest
rule wins. Everything else is judged by boosted trees fitted to labelled URLs: lengths, depths, digit and symbol ratios,
character entropy, parameter counts and how often URLs of the same host suffix were labelled as blocked.

The fit takes at most ``sample`` labelled rows, chosen by hash of the url; the suffix statistics count all labelled rows.
They are kept by the suffix itself and joined to distinct hosts, then by host to the urls. Urls are summed by host before
hosts are summed by suffix; a host or suffix with very many rows is split where a join is shuffled (skew handling of
adaptive execution).

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the model like any
other. Repeated urls get equal verdicts. With no labelled rows of both classes the model's verdict is the class there is,
or allow. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayside.llm.text import ascii_lower
from wayside.session import cut

SAMPLE = 20_000  # labelled urls the trees are fitted to, at most
Rule = tuple[str, str, str]  # host, path prefix, verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # later ones, the longer, win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def entropy(text: Column) -> Column:
    """Bits per character of a string, by the counts of its distinct characters."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c)))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of a url's text; all are 0 for an empty one."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    labels = F.split(host, r"\.")
    found = {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "depth": count(path, r"/[^/]"), "labels": F.when(host == "", 0).otherwise(F.size(labels)),
        "digit_ratio": count(u, r"\d") / n, "host_digits": count(host, r"\d"), "hyphens": count(host, "-"),
        "symbol_ratio": count(u, r"[^A-Za-z0-9]") / n, "params": count(u, r"[?&][^=&#]*="),
        "tracking": count(u, r"[?&](?:utm_[a-z]+|ref|gclid|fbclid)="), "fragment": F.contains(u, F.lit("#")).cast("int"),
        "secure": u.startswith("https://").cast("int"), "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        "entropy": entropy(host),
    }
    return {name: value.cast("double") for name, value in found.items()}


def suffixes() -> Column:
    """The host's last one, two and three labels, one row for each."""
    return F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.substring_index("host", ".", -k).alias("suffix")) for k in (1, 2, 3)]))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """Labelled and blocked urls by suffix (k, suffix, bad, n), over all labelled rows."""
    by_host = labelled.groupBy("host").agg(F.sum(F.col("blocked").cast("long")).alias("bad"), F.count("*").alias("n"))
    each = by_host.select("bad", "n", suffixes().alias("s")).select("bad", "n", "s.*")
    return each.groupBy("k", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def with_rates(rows: DataFrame, counts: DataFrame, own: Column | None = None, times: Column | None = None) -> DataFrame:
    """``rows`` with the smoothed share of blocked urls under each of their suffixes; unseen ones count as a half.

    ``own``: a row's own label, if the row is among those counted, ``times`` over; it is then left out of its own rates.
    """
    times = F.lit(1) if times is None else times
    each = rows.select("host").distinct().select("host", suffixes().alias("s")).select("host", "s.*")
    by_host = cut(each.join(counts, ["k", "suffix"], "left").groupBy("host").agg(*[
        F.coalesce(F.max(F.when(F.col("k") == k, F.col(name))), F.lit(0).cast("long")).alias(f"{name}{k}")
        for k in (1, 2, 3) for name in ("bad", "n")
    ]))  # written, so that its size is known when the join is planned
    out = rows.join(by_host, "host", "left")
    for k in (1, 2, 3):
        bad, n = F.col(f"bad{k}"), F.col(f"n{k}")
        if own is not None:
            bad, n = bad - own.cast("long") * times, n - times
        out = out.withColumn(f"rate{k}", (bad + 1) / (n + 2)).drop(f"bad{k}", f"n{k}")
    return out


def featured(urls: DataFrame) -> tuple[DataFrame, list[str]]:
    """Rows (url, host, path, …) with lexical features, and the names of the model's inputs."""
    found = lexical(F.col("url"), F.col("host"), F.col("path"))
    return urls.withColumns(found), [*found, "rate1", "rate2", "rate3"]


def fit(labelled: DataFrame, trees: int = 12, depth: int = 4, sample: int = SAMPLE):
    """(model, suffix counts, share blocked) from rows (url, host, path, blocked); no model if one class is missing.

    The trees see at most ``sample`` distinct urls, half of them of each class (smallest hashes), each weighing as many rows
    as it has; classes are weighed back to their shares, so that neither a repeated url nor the rarer class gets lost.
    """
    counts = cut(suffix_counts(labelled))
    distinct = cut(labelled.groupBy("url", "host", "path", "blocked").agg(F.count(F.lit(1)).alias("times")))
    of_class = lambda bad: distinct.where(F.col("blocked") == bad)
    drawn = [of_class(bad).orderBy(F.xxhash64("url"), "url").limit(sample // 2) for bad in (True, False)]
    known, seen = (
        {r["blocked"]: r["n"] for r in rows.groupBy("blocked").agg(F.sum("times").alias("n")).collect()}  # two rows
        for rows in (distinct, drawn[0].unionByName(drawn[1])))
    share = known.get(True, 0) / max(sum(known.values()), 1)
    if not 0.0 < share < 1.0:
        return None, counts, share
    weight = F.when(F.col("blocked"), known[True] / seen[True]).otherwise(known[False] / seen[False])
    rows, names = featured(with_rates(drawn[0].unionByName(drawn[1]), counts, F.col("blocked"), F.col("times")))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.withColumn("weight", F.col("times") * weight))
    rows = cut(rows.select("features", "weight", F.col("blocked").cast("double").alias("label")))
    trees_of = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=7, weightCol="weight")
    return trees_of.fit(rows), counts, share


def judge(urls: DataFrame, rules: list[Rule], labelled: DataFrame | None = None, key: str = "page_id", url: str = "url",
          trees: int = 12, depth: int = 4, sample: int = SAMPLE) -> DataFrame:
    """One row per url: key, url, host, path, rule, verdict (allow or block) and the model's score for blocking.

    ``labelled`` has columns url and blocked (boolean). Without it, the urls that a rule decides are the labelled ones.
    """
    host, path = host_and_path(F.col("url"))
    rows = urls.select(key, F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    if labelled is None:
        known = rows.where(F.col("ruled").isNotNull()).withColumn("blocked", F.col("ruled") == "block")
    else:
        known = labelled.where(F.col("blocked").isNotNull()).withColumns({"host": host, "path": path})
    model, counts, share = fit(known.select("url", "host", "path", "blocked"), trees, depth, sample)
    if model is None:
        scored = rows.withColumn("score", F.lit(share))
    else:
        with_features, names = featured(with_rates(rows, counts))
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(with_features)
        scored = model.transform(vectors).withColumn("score", vector_to_array("probability")[1])
    judged = F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select(key, "url", "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), "score")

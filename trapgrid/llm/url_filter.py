"""URL filter by two character language models, of accepted and of rejected URLs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapgrid.llm.frames import free_name, stored

#: Characters that the models tell apart; digits count as one, anything else as another one.
_KNOWN = "abcdefghijklmnopqrstuvwxyz./:-_?=&#%"
_ALPHABET = len(_KNOWN) + 4  # digit, other, start, end


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """The longest rule "host/path" (as text; of equal length the first given) that fits, or null.

    A rule fits its host and all subdomains, if the path starts with the rule's path.
    """
    out = None
    for domain, prefix, _ in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        out = F.when(fits, domain + prefix) if out is None else out.when(fits, domain + prefix)
    return F.lit(None).cast("string") if out is None else out


def model_text(url: Column) -> Column:
    """The URL as the models see it: start, lower case, digits as 0, unknown characters as one, end."""
    low = F.lower(F.coalesce(url, F.lit("")))
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(low, "[0-9]", "0"), f"[^0{_KNOWN.replace('-', '')}-]", "~"), F.lit("$"))


def _grams(text: Column, order: int) -> Column:
    """(gram) of each character with each context of 0 to `order` characters before it."""
    lengths = F.transform(F.sequence(F.lit(0), F.lit(order)), lambda k: k + 1)
    at = lambda k: F.transform(F.sequence(F.lit(2), F.length(text)), lambda i: F.when(i >= k, F.substring(text, i - k + 1, k)))
    return F.filter(F.flatten(F.transform(lengths, at)), lambda g: g.isNotNull())


def gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """(gram, g, b): how often each gram occurs in accepted and in rejected URLs; partial sums first.

    A row of `labelled` (text, good) stands for n URLs, where n is a column, else for one.
    """
    urls = F.col("n") if "n" in labelled.columns else F.lit(1)
    one = lambda side: F.sum(F.when(F.col("good") == side, F.col("n")).otherwise(0))
    grams = labelled.select("good", urls.alias("n"), F.explode(_grams(F.col("text"), order)).alias("gram"))
    return grams.groupBy("gram").agg(one(True).alias("g"), one(False).alias("b"))


def likelihood_table(labelled: DataFrame, order: int, least_share: float) -> DataFrame:
    """(gram, gain): what a gram adds to the log-likelihood ratio beyond its shorter suffixes.

    Both models are variable-order Markov models with Witten-Bell smoothing: a context's
    distribution falls back on that of the context without its first character, in proportion to the
    number of different characters seen after it. Contexts with less than `least_share` of all
    characters of both classes are left out (none at 0); the alphabet bounds the contexts of each length.
    The gains of all grams that end at a character sum up to the ratio by its longest known context.
    """
    counts = gram_counts(labelled, order).withColumn("ctx", F.expr("left(gram, length(gram) - 1)"))
    contexts = counts.groupBy("ctx").agg(
        F.sum("g").alias("ng"), F.sum("b").alias("nb"), F.sum(F.signum("g")).alias("tg"), F.sum(F.signum("b")).alias("tb")
    )
    if least_share:
        total = counts.where(F.length("gram") == 1).agg(F.sum(F.col("g") + F.col("b")).alias("all"))
        # One row, so this is no product of tables.
        contexts = contexts.join(F.broadcast(total), (F.col("ng") + F.col("nb")) >= F.col("all") * least_share).drop("all")
    known = stored(counts.join(contexts, "ctx"), "url-grams")
    uniform = F.lit(1.0 / _ALPHABET)
    smoothed = lambda n, total, kinds, lower: (F.col(n) + F.col(kinds) * lower) / (F.col(total) + F.col(kinds))
    table = None
    for k in range(1, order + 2):
        level = known.where(F.length("gram") == k)
        if table is None:
            level = level.withColumns({"lg": uniform, "lb": uniform})
        else:
            lower = table.where(F.length("gram") == k - 1).select(F.col("gram").alias("suffix"), F.col("pg").alias("lg"), F.col("pb").alias("lb"))
            level = level.withColumn("suffix", F.expr("right(gram, length(gram) - 1)")).join(lower, "suffix", "left").drop("suffix")
            level = level.fillna(1.0 / _ALPHABET, ["lg", "lb"])
        pick = lambda n, total, kinds, lower: F.when(F.col(total) > 0, smoothed(n, total, kinds, F.col(lower))).otherwise(F.col(lower))
        level = level.withColumns({"pg": pick("g", "ng", "tg", "lg"), "pb": pick("b", "nb", "tb", "lb")})
        level = level.select("gram", "pg", "pb", (F.log(F.col("pg") / F.col("lg")) - F.log(F.col("pb") / F.col("lb"))).alias("gain"))
        table = level if table is None else table.unionByName(level)
    return table.select("gram", "gain")


def ratios(texts: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """(key, ratio): log-likelihood ratio of each text per character. The alphabet bounds `table`; Spark broadcasts it where it is small."""
    grams = texts.select("key", F.length("text").alias("n"), F.explode(_grams(F.col("text"), order)).alias("gram"))
    hits = grams.join(table, "gram")
    return hits.groupBy("key", "n").agg(F.sum("gain").alias("sum")).select("key", (F.col("sum") / F.col("n")).alias("ratio"))


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, bool]],
    name: str = "judged",
    order: int = 3,
    least_share: float = 0.0,
    url: str = "url",
) -> DataFrame:
    """`pages` with a struct column `name`: host, path, rule, score, verdict ("allow" or "block").

    `rules` are (host, path, allow). A URL that a rule fits is judged by it, and is a labelled
    example; the models are counted over all different labelled URLs, each with its own label and each once, but one
    fifth (by a hash of what the models see of it, so that alike URLs stay together), on which the limit for
    the length-normalised log-likelihood ratio is set, with the highest mean of the shares of allowed and of blocked
    URLs judged right; the midpoint of two neighbouring hundredths. score is the ratio less that limit; URLs with a score of
    0 or more are allowed. If one class has no example, all others are allowed with score 0. Null URLs: empty host and path,
    no rule, judged as an empty text. Only distinct model texts are scored, rows with the same one share the score. An empty table gives an empty one.
    """
    if name in pages.columns:
        raise ValueError(f"{name} is a column of the pages")
    own = {k: free_name(pages, f"_{k}") for k in ("text", "rule")}
    host, path = host_of(F.col(url)), path_of(F.col(url))
    ruled = pages.withColumns({own["text"]: model_text(F.col(url)), own["rule"]: rule_of(host, path, rules)})
    allowed = [d + p for d, p, allow in rules if allow]
    urls = pages.select(F.col(url).alias("url")).distinct()
    one = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    sides = urls.select(model_text(F.col("url")).alias("text"), F.when(one.isNotNull(), one.isin(allowed)).alias("good"))
    counted = stored(sides.groupBy("text", "good").agg(F.count("*").alias("n")), "url-texts")
    labelled = counted.where(F.col("good").isNotNull())
    fifth = F.pmod(F.xxhash64("text"), F.lit(5))
    table = stored(likelihood_table(labelled.where(fifth != 0), order, least_share), "url-model")
    scores = stored(ratios(counted.select(F.col("text").alias("key"), "text").distinct(), table, order), "url-ratios")
    limit = _limit(scores.join(labelled.where(fifth == 0).withColumnRenamed("text", "key"), "key"))
    score = F.when(F.lit(limit is None), F.lit(0.0)).otherwise(F.coalesce(F.col("ratio"), F.lit(0.0)) - F.lit(limit or 0.0))
    shared = scores.select(F.col("key").alias(own["text"]), score.alias(free_name(pages, "_score")))
    points = F.coalesce(F.col(free_name(pages, "_score")), F.lit(0.0 if limit is None else -limit))
    rule = F.col(own["rule"])
    by_rule = F.when(rule.isin(allowed), "allow").when(rule.isNotNull(), "block")
    verdict = F.coalesce(by_rule, F.when(points >= 0, "allow").otherwise("block"))
    joined = ruled.join(shared, own["text"], "left")
    judged = F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), points.alias("score"), verdict.alias("verdict"))
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], judged.alias(name))


def _limit(rated: DataFrame) -> float | None:
    """The ratio that parts the classes best; from a histogram in hundredths, whose size their range bounds."""
    bins = rated.groupBy(F.floor(F.col("ratio") * 100).alias("bin")).agg(
        F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("n"))).alias("bad")
    )
    rows = sorted((r.bin, r.good, r.bad) for r in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    best, right = None, good / good  # everything allowed: all good ones right, no bad one
    score = right + 0.0
    below_good = below_bad = 0
    best_score, best = score, (rows[0][0], rows[0][0])
    for i, (at, g, b) in enumerate(rows):
        below_good, below_bad = below_good + g, below_bad + b
        now = (good - below_good) / good + below_bad / bad
        if now > best_score:
            after = rows[i + 1][0] if i + 1 < len(rows) else at + 1
            best_score, best = now, (at + 1, after)
    return (best[0] + best[1]) / 200

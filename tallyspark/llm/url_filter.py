"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest.

The trees learn from all URLs that a rule decides. A third of the hosts is held out: neither the
trees nor the statistics of suffixes see their labels. The threshold is the least one that reaches the precision on them, by enough URLs to tell;
where there is none, nothing is blocked but by rule. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.boosted import calibrated, train
from tallyspark.llm.common import written

#: Rules as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
PRECISION = 0.9
#: Held-out URLs above a threshold without which its precision says nothing.
LEAST_HELD_OUT = 20
#: Rows by which a suffix is drawn to the share of all URLs.
SMOOTHING = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "host_labels", "hyphens", "longest_label", "depth", "path_length", "host_digits", "path_digits", "entropy", "params", "query_length", "fragment", "secure", "suffix_share", "suffix_count"]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    """What follows the first "://"; empty for nulls and without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule whose host is the URL's or a domain above it and whose path starts the URL's; else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def share_of(chars: Column, text: Column) -> Column:
    return F.when(F.length(text) == 0, 0.0).otherwise(F.length(chars) / F.length(text))


def entropy(text: Column) -> Column:
    """Bits per character."""
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.aggregate(counts, F.lit(0.0), lambda s, p: s - p * F.log2(F.when(p > 0, p).otherwise(1.0))))


def features(rows: DataFrame) -> DataFrame:
    """Lexical features of the columns url, host and path; those of suffixes are joined later."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda c: share_of(F.regexp_replace(c, "[^0-9]", ""), c)
    labels = F.split("host", r"\.")
    made = {
        "length": F.length(url),
        "host_length": F.length("host"),
        "host_labels": F.size(labels),
        "hyphens": F.length(F.regexp_replace("host", "[^-]", "")),
        "longest_label": F.array_max(F.transform(labels, F.length)),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")),
        "path_length": F.length("path"),
        "host_digits": digits(F.col("host")),
        "path_digits": digits(F.col("path")),
        "entropy": entropy(F.col("host")),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "secure": F.startswith(F.lower(url), F.lit("https://")).cast("int"),
    }
    return rows.select("*", *(c.cast("double").alias(n) for n, c in made.items()))


def judged(pages: DataFrame, id_column: str = "page_id", url: str = "url", *, rules: tuple[tuple[str, str], ...] = RULES, precision: float = PRECISION) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and score (the probability of block, null where a rule decides).

    Null URLs and those without "://" have an empty host and path and no rule. Where too few URLs
    are labelled to train on, or no threshold is precise enough, what no rule decides is allowed. Every row is answered, equal URLs alike.
    """
    verdicts = {r: v for v, r in rules}
    if len(verdicts) < len(rules) or set(verdicts.values()) - {"allow", "block"}:
        raise ValueError("each rule needs one verdict, allow or block")
    source = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"))
    rows = source.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    block = F.col("rule").isin([r for r, v in verdicts.items() if v == "block"])
    rows = features(rows).withColumn("label", F.when(F.col("rule").isNotNull(), block.cast("int"))).withColumn("suffix", F.substring_index("host", ".", -1))
    rows = written(rows, "urls")
    labelled = rows.where("label is not null")
    held_out = F.pmod(F.xxhash64("host"), F.lit(3)) == 0  # whole hosts
    seen = labelled.where(~held_out)
    total = seen.agg(F.avg("label").alias("all")).first()["all"]
    counts = written(seen.groupBy("suffix").agg(F.sum("label").alias("hit"), F.count("*").alias("n")), "suffixes")
    share = (F.coalesce("hit", F.lit(0)) + SMOOTHING * F.lit(total or 0.0)) / (F.coalesce("n", F.lit(0)) + SMOOTHING)
    with_suffix = lambda df: df.join(counts, "suffix", "left").withColumns({"suffix_share": share, "suffix_count": F.coalesce("n", F.lit(0)).cast("double")})
    trees = train(with_suffix(seen), FEATURES)
    limit, score = None, F.lit(None).cast("double")
    if trees:
        score = trees.probability(F.col)
        held = with_suffix(labelled.where(held_out))
        limit = calibrated(held, F.lit("all"), score, F.col("label"), precision).get("all")
        if limit is not None and held.where(F.floor(score * 100) / 100 >= limit).count() < LEAST_HELD_OUT:
            limit = None
    out = with_suffix(rows).withColumn("score", F.when(F.col("rule").isNull(), score))
    by_rule = F.element_at(F.create_map(*(F.lit(x) for pair in verdicts.items() for x in pair)), F.col("rule"))
    other = F.when(F.floor(F.col("score") * 100) / 100 >= limit, "block").otherwise("allow") if limit is not None else F.lit("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), other).otherwise(by_rule).alias("verdict"), "score")

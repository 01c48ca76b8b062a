"""URL verdicts: rules by host and path, boosted trees on lexical features for the rest.

Labelled URLs are those a rule decides and those whose host has a word of a short list; URLs with
neither sign count as allowed with less weight. The trees are fitted on a bounded sample of them.
Everything else reads all rows: the suffix statistics (how often hosts under a suffix are labelled,
and how often as blocked) are aggregates of the whole table, joined back by suffix, a row taking
those of the folds it is not in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from clientele.llm.common import ascii_lower, fresh, stage

FIT_ROWS = 20_000  # the trees are fitted on about so many labelled rows, fewer than twice as many
UNSIGNED_WEIGHT = 0.25
PRIOR = 20.0  # labelled rows a suffix is taken to have had, half of them blocked
FOLDS = 8  # parts of the urls whose labels are counted apart
TREES, DEPTH = 12, 3
SEED = 5
#: Host words that mark a URL as blocked for the training labels.
BAD_WORDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "free", "loan", "loans", "pills", "poker", "porn",
             "spam", "track", "viagra", "win", "xxx")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
         Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

FEATURES = ("n_chars", "host_chars", "path_chars", "depth", "labels", "digit_share", "host_digit_share",
            "host_entropy", "hyphens", "params", "query_chars", "fragment", "longest_label", "secure",
            "suffix_block", "suffix_seen", "domain_block", "domain_seen")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(name, verdict) of the longest rule that fits, null if none does."""
    none = F.lit(None).cast("struct<name:string,verdict:string>")
    out = none
    # The longest is asked first; of equally long ones the first in order of their names.
    for r in sorted(rules, key=lambda r: (len(r.name), r.name), reverse=True)[::-1]:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _share(count: Column, of: Column) -> Column:
    return F.when(of > 0, count / of).otherwise(F.lit(0.0))


def entropy(text: Column) -> Column:
    """Bits per character of a short text."""
    n = F.char_length(text)
    marks = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    bits = F.transform(marks, lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(bits, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    query = F.coalesce(F.regexp_extract(url, "(?s)\\?([^#]*)", 1), F.lit(""))
    digits = lambda c: F.regexp_count(c, F.lit("[0-9]"))
    labels = F.split(host, "\\.")
    return {
        "n_chars": F.char_length(url), "host_chars": F.char_length(host), "path_chars": F.char_length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")), "labels": F.size(labels),
        "digit_share": _share(digits(url), F.char_length(url)),
        "host_digit_share": _share(digits(host), F.char_length(host)),
        "host_entropy": entropy(host), "hyphens": F.regexp_count(host, F.lit("-")),
        "params": F.regexp_count(query, F.lit("[^&=]+=?[^&]*")), "query_chars": F.char_length(query),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
        "longest_label": F.coalesce(F.array_max(F.transform(labels, lambda x: F.char_length(x))), F.lit(0)),
        "secure": F.startswith(url, F.lit("https")).cast("int"),
    }


def suffix_of(host: Column, n: int) -> Column:
    return F.substring_index(host, ".", -n)


def _signs(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (with ``url``) and host, path, rule, label, suffix and domain.

    ``label`` is 1 for blocked, 0 for allowed and null without a sign.
    """
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    bad = F.size(F.array_intersect(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in BAD_WORDS]))) > 0
    label = (F.when(F.col("rule.verdict") == "block", 1.0).when(F.col("rule.verdict") == "allow", 0.0)
             .when(bad, 1.0))
    return rows.withColumns({"label": label, "suffix": suffix_of(F.col("host"), 1),
                             "domain": suffix_of(F.col("host"), 2)})


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), url), F.lit(FOLDS)).cast("int")


def suffix_statistics(urls: DataFrame) -> dict[str, DataFrame]:
    """Of the labelled ones among all different urls, per suffix and per domain: how many, how many blocked, by fold."""
    known = urls.where("label is not null").withColumn("fold", _fold(F.col("url")))
    by_fold = lambda what: F.array(*[F.sum(F.when(F.col("fold") == i, what).otherwise(0.0)) for i in range(FOLDS)])
    return {key: stage(known.groupBy(key).agg(by_fold(F.lit(1.0)).alias("n"), by_fold(F.col("label")).alias("bad")).select(
        F.col(key).alias(f"{key}_of"), F.col("n").alias(f"{key}_n"), F.col("bad").alias(f"{key}_bad")), f"{key}-statistics")
        for key in ("suffix", "domain")}


def featured(rows: DataFrame, statistics: dict[str, DataFrame]) -> DataFrame:
    """``rows`` as ``_signs`` gives them with the columns FEATURES.

    A url takes the counts of its suffixes from the folds it is not in, so that no row sees its own
    label. (Taking out only its own would tell labelled rows by a count that is one less.)
    """
    def others(counts: Column) -> Column:
        every = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
        return F.coalesce(every - F.element_at(counts, _fold(F.col("url")) + 1), F.lit(0.0))

    for key, stats in statistics.items():
        rows = rows.join(stats, rows[key] == stats[f"{key}_of"], "left")
        n, bad = others(F.col(f"{key}_n")), others(F.col(f"{key}_bad"))
        rows = rows.withColumns({f"{key}_block": (bad + PRIOR / 2) / (n + PRIOR), f"{key}_seen": F.log1p(n)}).drop(
            f"{key}_of", f"{key}_n", f"{key}_bad")
    rows = rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")))
    return rows.withColumns({f: F.col(f).cast("double") for f in FEATURES})


def fit(urls: DataFrame, statistics: dict[str, DataFrame], fit_rows: int = FIT_ROWS, seed: int = SEED):
    """Boosted trees on about ``fit_rows`` different urls, chosen by their hash; None with one class only."""
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col("url")), F.lit(max(1, urls.count() // fit_rows))) == 0
    marked = featured(urls.where(chosen), statistics).withColumns({
        "weight": F.when(F.col("label").isNull(), UNSIGNED_WEIGHT).otherwise(1.0),
        "label": F.coalesce("label", F.lit(0.0))})
    sample = stage(marked.select("label", "weight", *FEATURES), "fit")
    if sample.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(sample).select("label", "weight", "x")
    trees = GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=0.3, seed=seed, maxBins=32)
    return trees.fit(ready.coalesce(4))


def judge_urls(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """``pages`` with a struct (host, path, rule, verdict, by_model); also the new column's name.

    A null url or one without ``://`` has empty host and path and is judged by the trees like any
    other; without two classes among the labels they allow. Rows are judged where they are: only the
    counts of the labelled urls' suffixes are joined to them.
    """
    urls = pages.select(F.col(url_col).alias("url")).distinct()
    urls = stage(_signs(urls, rules).select("url", "host", "path", "label", "suffix", "domain"), "urls")
    statistics = suffix_statistics(urls)
    model = fit(urls, statistics)
    name, row = fresh("url_judged", pages.columns), fresh("_row", ["url", *pages.columns])
    packed = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias(row), F.col(url_col).alias("url"))
    rows = _signs(packed, rules)
    if model is None:
        judged = rows.withColumn("prediction", F.lit(0.0))
    else:
        judged = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(
            featured(rows, statistics)))
    return judged.select(f"{row}.*", F.struct(
        "host", "path", F.col("rule.name").alias("rule"),
        F.coalesce("rule.verdict", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")).alias("verdict"),
        F.col("rule").isNull().alias("by_model")).alias(name)), name

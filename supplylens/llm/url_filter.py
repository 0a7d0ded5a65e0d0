"""URL filter: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

The trees learn from URLs that a rule labels (a bounded sample of them) and see only the URL's form: lengths, depth, ratio of
digits, entropy of characters, numbers of parameters and labels, and how the host's suffix fares among
the labelled URLs. Everything is DataFrame code and Spark's own GBT estimator.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.llm.common import cut, join_groups

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The production rules: (host, path, action).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

FEATURES = [
    "n_url", "n_host", "n_path", "depth", "labels", "longest_label", "hyphens", "digit_ratio", "host_digit_ratio",
    "entropy", "host_entropy", "params", "has_fragment", "suffix_rate", "suffix_rows",
]


def split_url(url):
    """(host, path) of a URL column; both empty for null and where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def match_rule(host, path, rules: Sequence[tuple[str, str, str]]):
    """The longest fitting rule as struct<size, rule, action>, or null.

    Rules are looked up by each suffix of the host, so their number adds nothing to the cost of a URL.
    Of rules equally long the last by code point wins; two actions for one rule make it a block.
    """
    by_host: dict[str, dict[str, str]] = {}
    for h, p, action in rules:
        known = by_host.setdefault(h, {})
        known[p] = "block" if "block" in (action, known.get(p)) else action
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,action:string>")
    entries = []
    for h, paths in sorted(by_host.items()):
        structs = [F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(p).alias("path"), F.lit(a).alias("action")) for p, a in sorted(paths.items())]
        entries += [F.lit(h), F.array(*structs)]
    lookup = F.create_map(*entries)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.flatten(F.transform(suffixes, lambda s: F.coalesce(lookup[s], F.array().cast("array<struct<size:int,rule:string,path:string,action:string>>"))))
    fitting = F.filter(fitting, lambda r: F.startswith(path, r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return F.when(host != "", best)


def entropy(s):
    """Shannon entropy in bits of the characters of ``s``; 0 when empty."""
    n = F.char_length(s)
    counts = F.transform(F.array_distinct(F.split(s, "")), lambda c: (n - F.char_length(F.replace(s, c, F.lit("")))).cast("double"))
    total = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda acc, c: acc - c / n * F.log2(c / n))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def lexical(pages: DataFrame) -> DataFrame:
    """Add the lexical features to rows with url, host and path."""
    url = F.coalesce("url", F.lit(""))
    digits = lambda s: F.char_length(F.regexp_replace(s, "[^0-9]", ""))
    occurs = lambda s, c: F.char_length(s) - F.char_length(F.replace(s, F.lit(c), F.lit("")))
    ratio = lambda s: F.when(F.char_length(s) > 0, digits(s) / F.char_length(s)).otherwise(F.lit(0.0))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns(
        {
            "n_url": F.char_length(url),
            "n_host": F.char_length("host"),
            "n_path": F.char_length("path"),
            "depth": occurs(F.col("path"), "/"),
            "labels": F.size(labels),
            "longest_label": F.array_max(F.transform(labels, F.char_length)),
            "hyphens": occurs(F.col("host"), "-"),
            "digit_ratio": ratio(url),
            "host_digit_ratio": ratio(F.col("host")),
            "entropy": entropy(url),
            "host_entropy": entropy(F.col("host")),
            "params": F.when(query == "", 0).otherwise(occurs(query, "&") + 1),
            "has_fragment": F.instr(url, "#").cast("boolean").cast("int"),
            "suffix": F.element_at(labels, -1),
        }
    )


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_rows: int = 10_000, trees: int = 12, depth: int = 4, seed: int = 3) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    ``max_rows`` bounds the labelled URLs that the trees learn from (the first by a seeded hash of the distinct URL). ``score`` is
    the trees' probability of a block. Null and malformed URLs have an empty host, fit no rule and are judged by the trees like any
    other. When the rules label no URL, or only one way, there is nothing to learn: what no rule decides is allowed with
    score 0. Repeated rows get equal verdicts; an empty table gives no rows; only ``page_id`` and ``url`` are read.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("match", match_rule(F.col("host"), F.col("path"), rules))
    rows = cut(lexical(rows))
    n = rows.count()
    label = F.when(F.col("match.action") == "block", 1.0).when(F.col("match.action") == "allow", 0.0)
    rows = rows.withColumn("label", label)
    # Smoothed block rate of each suffix among labelled rows, and how common the suffix is.
    suffixes = cut(rows.groupBy("suffix").agg(F.count("*").alias("rows"), F.sum("label").alias("blocked"), F.count("label").alias("labelled")))
    total = suffixes.agg(F.sum("blocked"), F.sum("labelled")).first()
    blocked, labelled = (total[0] or 0.0), (total[1] or 0)
    out = rows.select("page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.action").alias("action"))
    if labelled in (0, blocked) or blocked == 0:
        return out.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    base = blocked / labelled
    suffixes = suffixes.select(
        "suffix",
        "rows",
        ((F.coalesce("blocked", F.lit(0.0)) + 10 * base) / (F.col("labelled") + 10)).alias("suffix_rate"),
        F.log1p(F.col("rows") * 1e6 / n).alias("suffix_rows"),
    )
    ready = join_groups(rows, suffixes, ["suffix"], "rows", n)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    learn = ready.filter("label is not null").dropDuplicates(["url"]).orderBy(F.xxhash64("url", F.lit(seed)), "url").limit(max_rows)
    learn = assembler.transform(cut(learn.select("label", *FEATURES).coalesce(1)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, seed=seed, featureSubsetStrategy="all").fit(learn)
    scored = model.transform(assembler.transform(ready)).withColumn("score", vector_to_array("probability")[1])
    verdict = F.coalesce("match.action", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), "score")

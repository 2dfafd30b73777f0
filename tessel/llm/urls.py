"""URL filters: a list of fixed rules, and association rules mined from the URLs it labels.

The list gives the verdicts of the URLs that its rules fit, and so labels them.  Spark's
FP-growth mines combinations of URL tokens and verdicts from the labelled rows; rules that
conclude a verdict stay if their support and confidence suffice and no more general rule
with the same verdict is as confident.  Each is filed in an inverted index under its least
frequent token; a URL meets only the rules filed under one of its tokens, and a rule fits
if the URL has all of its tokens.  The most confident rule decides, then the larger
support, the longer rule, and block before allow.  URLs without any rule are allowed.

The tokens of a URL are all suffixes of its host, whether it has more than two labels, all
segments of the path with their places (numbers stand as #), the names of all query keys,
and the scheme.  Tokens count if they are frequent among all labelled rows; of those that
the same labelled rows hold, one stands for all, so that parts which always come together
don't multiply the combinations.  The frequent tokens are fewer than the tokens of a URL on
average divided by the support, however many rows there are.

Defined results: null URLs, and URLs without ://, have an empty host and path, fit no
rule of the list, and are judged by their tokens alone; an empty table gives an empty one;
repeated rows give a row each.  Without labelled rows all verdicts are allow.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
#: Rules sent to all tasks at most; more are joined by a shuffle.
SENT_RULES = 20_000

#: The list, as (verdict, host, path).
LIST = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _lower(c: F.Column) -> F.Column:
    """A-Z alone in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def listed(host: F.Column, path: F.Column, rules: Sequence[tuple[str, str, str]]) -> F.Column:
    """The longest rule (host and path together) that fits, as a struct of rule and verdict."""
    each = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    return F.coalesce(*each)


def tokens(url: F.Column, host: F.Column, path: F.Column) -> F.Column:
    """The distinct tokens of a URL, never null."""
    none = F.array().cast("array<string>")
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("suffix:"), F.array_join(F.slice(labels, -i, i), ".")))).otherwise(none)
    steps = F.filter(F.split(path, "/"), lambda x: x != "")
    steps = F.transform(steps, lambda x, i: F.concat(F.lit("step"), (i + 1).cast("string"), F.lit(":"), F.regexp_replace(x, r"[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.substring_index(x, "=", 1)))
    scheme = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A([^:/?#]+)://", 1)
    few = F.array(F.when(n >= 3, F.lit("deeper")), F.when(scheme != "", F.concat(F.lit("scheme:"), _lower(scheme))))
    return F.array_distinct(F.array_compact(F.concat(few, suffixes, steps, keys)))


def frequent(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> dict[str, str]:
    """Each frequent token with the one that stands for all tokens of the same labelled rows."""
    sets = labelled.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    each = sets.select(F.explode("tokens").alias("token"), "n", F.xxhash64("tokens").cast("decimal(38,0)").alias("h"), F.xxhash64("tokens", F.lit(1)).cast("decimal(38,0)").alias("g"))
    counted = each.groupBy("token").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("g").alias("g")).where(F.col("n") >= F.lit(min_support * labelled.count()))
    stands: dict[tuple, str] = {}
    rows = sorted(counted.collect(), key=lambda r: r.token)
    return {r.token: stands.setdefault((r.n, r.h, r.g), r.token) for r in rows}


def reduced(found: F.Column, names: dict[str, str]) -> F.Column:
    """The tokens of a URL that count, by the names that stand for them."""
    if not names:
        return F.array().cast("array<string>")
    known = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    return F.array_distinct(F.array_compact(F.transform(found, lambda t: F.try_element_at(known, t))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (antecedent, verdict, confidence, support) from rows with tokens and verdict.

    Combinations grow with the tokens that one URL holds, not with the number of rows.
    """
    mark = "verdict:"
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    last = F.col("consequent")[0]
    found = model.associationRules.where(last.startswith(mark) & ~F.exists("antecedent", lambda x: x.startswith(mark)))
    return found.select(F.array_sort("antecedent").alias("antecedent"), F.substr(last, F.lit(len(mark) + 1)).alias("verdict"), "confidence", "support")


def prune(rules: DataFrame) -> DataFrame:
    """Rules to which no rule with fewer of their tokens and the same verdict is equal in confidence."""
    numbered = rules.withColumn("name", F.array_join("antecedent", "\x00"))
    parts = numbered.select("name", "verdict", "confidence", "antecedent", F.explode("antecedent").alias("token"))
    general = numbered.select(F.col("antecedent").alias("less"), F.col("verdict"), F.col("confidence").alias("c"), F.get("antecedent", F.lit(0)).alias("token"))
    worse = parts.join(general, ["verdict", "token"]).where((F.size("less") < F.size("antecedent")) & (F.size(F.array_except("less", "antecedent")) == 0) & (F.col("c") >= F.col("confidence")))
    return numbered.join(worse.select("name", "verdict").distinct(), ["name", "verdict"], "left_anti").drop("name")


def index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rules, each filed under its least frequent token (key)."""
    counts = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.withColumn("name", F.array_join("antecedent", "\x00")).select("*", F.explode("antecedent").alias("token")).join(counts, "token")
    return each.groupBy("name", "verdict").agg(F.min(F.struct("n", "token"))["token"].alias("key"), F.first("antecedent").alias("antecedent"), F.first("confidence").alias("confidence"), F.first("support").alias("support")).drop("name")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = LIST, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = "allow") -> DataFrame:
    """id_col, host, path, rule (of the list), verdict, mined (tokens of the rule that decided)."""
    store = Store(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", "url", host.alias("host"), path.alias("path"))
    read = read.withColumn("listed", listed(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    read = store.table("read", read.select("id", "host", "path", F.col("listed.rule").alias("rule"), F.col("listed.verdict").alias("verdict"), "tokens"))
    labelled = read.where(F.col("verdict").isNotNull() & (F.size("tokens") > 0))
    names = frequent(labelled, min_support)
    read = read.withColumn("tokens", reduced(F.col("tokens"), names))
    labelled = read.where(F.col("verdict").isNotNull())
    open_sets = store.table("sets", read.where(F.col("verdict").isNull()).groupBy("tokens").agg(F.count(F.lit(1)).alias("n")))
    if not names:
        decided = open_sets.select("tokens", F.lit(None).cast("struct<rank:double,support:double,size:int,block:boolean,verdict:string,antecedent:array<string>>").alias("best"))
    else:
        mined = store.table("mined", mine(labelled, min_support, min_confidence))
        filed = store.table("filed", index(prune(mined), labelled))
        if filed.count() <= SENT_RULES:
            filed = F.broadcast(filed)
        meets = open_sets.select("tokens", F.explode("tokens").alias("key")).join(filed, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
        rank = F.struct(F.col("confidence").alias("rank"), "support", F.size("antecedent").alias("size"), (F.col("verdict") == "block").alias("block"), "verdict", "antecedent")
        decided = meets.groupBy("tokens").agg(F.max(rank).alias("best"))
    decided = store.table("decided", decided)
    out = read.join(decided, "tokens", "left")
    out = out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("rule").isNull(), F.col("best.verdict")), F.lit(default)).alias("verdict"), F.when(F.col("rule").isNull(), F.col("best.antecedent")).alias("mined"))
    out = store.table("out", out)
    store.drop_but("out")
    return out


def report(pages: DataFrame) -> DataFrame:
    return judge(pages)

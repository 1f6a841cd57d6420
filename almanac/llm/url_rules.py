"""URL filters by association rules (operator 13).

Labelled URLs are cut into tokens (scheme, host labels and their words, path segments,
file type, query keys; runs of digits alike). Spark's FP-growth mines the token
combinations of the URLs labelled bad; how often each combination stands in all
labelled URLs gives its confidence. Rules are pruned by support, by confidence, and
where a part of their tokens alone is as sure. A URL is blocked if a rule's tokens all
stand in it.

Matching is by inverted index: a rule is listed under its rarest token only, the
tokens of the distinct token sets are joined with that list, and what is found is
verified against the whole set. A frequent token is the rarest of few rules, so it makes
few candidates, and a set that a third of all pages share is matched once.

An explicit list (host, path, verdict) goes before the mined rules: a listed rule fits
its host and all subdomains where the path starts with its path, and the longest
fitting one decides. The list is policy, a parameter that stands in the plan.

Only DataFrame functions and ``pyspark.ml``'s FP-growth. No rule list is collected or
hinted to be broadcast; Spark picks the joins by measured size.

Edge cases: a null URL, and one without ``://``, has no host, no path and no tokens,
so no rule fits and it is allowed; an empty path fits no listed rule; labels without a
page and pages without a label don't count; a null label is not bad; several labels
of one page count as one, bad if any is; repeated pages each get the verdict; without
labels nothing is blocked but by the list; other columns stay, and those named like a
result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read, written

# The listed rules (verdict, host, path).
LISTED = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
          ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT = 0.002      # of the bad URLs, and
MIN_COUNT = 5            # as many of them at least
MIN_CONFIDENCE = 0.6
SALTS = 32
RESULT = ("host", "path", "rule", "verdict", "mined")
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = LISTED) -> Column:
    """(rule, verdict) of the longest listed rule that fits; null if none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    table = F.array(*[F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"),
                               F.lit(p).alias("path")) for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))])
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"])))
                    & path.startswith(r["path"]))
    first = F.get(fits, 0)
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def tokens_of(url: Column) -> Column:
    """Sorted distinct tokens of a URL; empty without ``://``."""
    def named(kind, values):
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind), v))

    def alike(text):
        return F.regexp_replace(text, r"[0-9]+", "#")

    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda v: v.contains("-")), lambda v: F.split(v, "-")))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = F.concat(
        F.array(F.concat(F.lit("scheme:"), ascii_lower(F.substring_index(url, "://", 1)))),
        named("host:", labels), named("word:", words), named("path:", F.split(alike(path), "/")),
        named("type:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        named("key:", F.transform(F.split(query, "&"), lambda v: F.substring_index(v, "=", 1))))
    return F.when(F.instr(url, "://") > 0, F.array_sort(F.array_distinct(parts))).otherwise(F.array().cast("array<string>"))


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(columns of ``sets``, columns of ``rules``) where all of a rule's ``items`` are in the ``tokens``.

    ``rules`` has ``anchor``, one of its items, by which the pair is found.
    """
    return (sets.withColumn("anchor", F.explode("tokens")).join(rules, "anchor").drop("anchor")
            .where(F.size(F.array_intersect("items", "tokens")) == F.size("items")))


def mine(urls: DataFrame, *, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (id, items, anchor, support, confidence) of labelled ``urls`` (url, bad boolean).

    ``support`` counts the bad URLs that hold all items, ``confidence`` their share of all that do.
    """
    rows = written(urls.select(tokens_of(F.col("url")).alias("tokens"), F.coalesce("bad", F.lit(False)).alias("bad"))
                   .where(F.size("tokens") > 0), "url-labelled")
    sets = written(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad")), "url-sets")
    n_bad = sets.agg(F.sum("n_bad")).first()[0] or 0
    least = min(1.0, max(min_support, min_count / max(n_bad, 1)))
    bad = rows.where("bad").select(F.col("tokens").alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=least).fit(bad).freqItemsets.where(F.col("freq") >= min_count)
    common = sets.select(F.explode("tokens").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("of"))
    ids = F.xxhash64(F.array_join(F.array_sort("items"), "\n"))
    itemsets = written(found.select(ids.alias("id"), F.array_sort("items").alias("items"), F.col("freq").alias("support")),
                       "url-itemsets")
    anchors = (itemsets.select("id", F.explode("items").alias("item")).join(common, "item")
               .groupBy("id").agg(F.min_by("item", F.struct("of", "item")).alias("anchor")))
    index = written(itemsets.join(anchors, "id"), "url-index")
    counted = matches(sets, index.select("id", "items", "anchor")).groupBy("id").agg(F.sum("n").alias("n"))
    sure = written(index.join(counted, "id").withColumn("confidence", F.col("support") / F.col("n"))
                   .where(F.col("confidence") >= min_confidence).drop("n"), "url-sure")
    # A rule goes if fewer of its items are at least as sure: found by the same index.
    whole = sure.select(F.col("id").alias("whole"), F.col("items").alias("tokens"), F.col("confidence").alias("c"))
    needless = matches(whole, sure).where((F.size("items") < F.size("tokens")) & (F.col("confidence") >= F.col("c")))
    return written(sure.join(needless.select(F.col("whole").alias("id")), "id", "left_anti"), "url-rules")


def judge(pages: DataFrame, rules: DataFrame, listed: Sequence[tuple[str, str, str]] = LISTED) -> DataFrame:
    """``pages`` (with url) and host, path, rule, verdict, and the surest mined rule as ``mined`` (or null)."""
    url = F.col("url")
    rows = pages.drop(*RESULT).select(F.struct("*").alias("page"), tokens_of(url).alias("of"), host_of(url).alias("host"),
                                      path_of(url).alias("path"))
    rows = rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    sets = rows.select(F.col("of").alias("tokens")).distinct()
    best = matches(sets, rules).groupBy("tokens").agg(F.max_by(
        F.struct(F.array_join("items", " ").alias("items"), "support", "confidence"),
        F.struct("confidence", "support", "id")).alias("mined"))
    by_rule = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    # Pages of one set are dealt over salts; a set has one row of rules, repeated for each.
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page.url"), F.lit(SALTS)).cast("int"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(best, (F.col("of") == F.col("tokens")) & (F.col("part") == F.col("salt")), "left").select(
        "page.*", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), by_rule).alias("verdict"), "mined")


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of pages whose document has labels: bad where one is toxic or of low quality.

    The last number of a page's path is the id of the document that it shows.
    """
    bad = F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False)))
    per_id = labels.groupBy("doc_id").agg(bad.alias("bad"))
    shown = F.regexp_extract(path_of(F.col("url")), r"([0-9]{1,18})[^0-9/]*/?$", 1)
    return (pages.select("url", F.when(shown != "", shown).cast("long").alias("doc_id"))
            .join(per_id, "doc_id").select("url", "bad"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by the listed and the mined rules."""
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    rules = mine(labelled(pages, read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", F.col("mined.items").alias("mined"),
                                      F.col("mined.confidence").alias("confidence"))

"""URL filtering by association rules between URL tokens and labels.

Tokens of a URL are its scheme, the host's first label and its trailing parts (``org``,
``example.org``), the path segments with their place and the query's keys; digits
become ``0`` so that numbers do not make every URL unique.  Spark's FP-growth mines the token
sets (with the label as one more item) that reach ``min_support`` of the labelled
URLs; a rule "tokens -> label" stands if its confidence reaches ``min_confidence``,
and goes if a rule over some of its tokens is as confident (it says nothing more), or
if it is no surer than its label's share.  Tokens that stand in exactly the same
labelled URLs are mined as one item, and any of them fits it (each would have its own rule,
as confident), so a long URL that is repeated does not multiply the sets.

Matching uses an inverted index: each rule is listed under its rarest token, so a
URL meets only the rules of its own tokens and keeps those it holds completely.
Equal URLs are judged once.  The rule that gains most on its label's share decides
((confidence - share) / (1 - share)), then the most confident, the best supported, the longest, then ``block``.

Fixed rules (host, path) come before: a rule fits its host and all subdomains if the
path starts with the rule's; the longest wins.

Cases: null urls and urls without ``://`` have empty host and path, no token, and the
default verdict.  No labelled urls: no mined rules, so the default for all.  Repeated
rows and repeated or null page ids are all judged.  Labels that are null do not count.
Empty tables: no rows.  Only page_id and url are read; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import lower_ascii, staged

#: Fixed rules: rule string (host and path) and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BLOCK, ALLOW = "label=block", "label=allow"


@dataclass(frozen=True)
class Mining:
    min_support: float = 0.005
    min_count: int = 10             # labelled URLs behind a rule at least, however few there are
    min_confidence: float = 0.6
    max_tokens: int | None = None   # of a mined set, label included; None: all
    default: str = "allow"
    broadcast_rules: int = 200_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):        # later, longer rules win
        domain, at, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(at + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL (empty array for null or no ``://``)."""
    shape = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    host = shape(host_of(url))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
                        lambda n: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -n, n), ".")))
    tails = F.when(F.size(labels) > 0, tails).otherwise(F.array().cast("array<string>"))
    names = F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("sub:"), x))
    segments = F.filter(F.split(shape(path_of(url)), "/"), lambda x: x != "")
    places = F.transform(segments, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), x))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^((?s:.*?))://", 1)))
    query = F.regexp_extract_all(url, F.lit(r"[?&]([^=&#?]+)"), F.lit(1))
    keys = F.transform(query, lambda x: F.concat(F.lit("query:"), x))
    out = F.array_distinct(F.concat(scheme, tails, names, places, keys))
    return F.when(url.contains("://"), out).otherwise(F.array().cast("array<string>"))


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support, gain) from rows (url, label: block or allow).

    Each labelled URL holds C(t, k) token sets of k of its t tokens, and a frequent set needs
    ``min_support`` of the URLs, so their number is bounded by the mean of C(t, k) / min_support."""
    spark = labelled.sparkSession
    rows = (labelled.filter(F.col("url").isNotNull() & F.col("label").isin("block", "allow"))
            .groupBy("url", "label").agg(F.count("*").alias("times")))
    rows = staged(rows.withColumn("tokens", url_tokens(F.col("url"))), "labelled-urls")
    n, n_block = rows.agg(F.sum("times"), F.coalesce(F.sum(F.when(F.col("label") == "block", F.col("times"))), F.lit(0))).first()
    schema = "rule_id long, tokens array<string>, same array<array<string>>, verdict string, confidence double, support double, gain double"
    if not n:
        return spark.createDataFrame([], schema)
    support = min(1.0, max(mining.min_support, mining.min_count / n))
    each = rows.select("url", "label", "times", F.explode("tokens").alias("token"))
    hashes = [F.sum(F.col("times") * F.xxhash64("url", "label", F.lit(salt)).cast("decimal(20,0)")).alias(f"h{salt}") for salt in (0, 1)]
    often = each.groupBy("token").agg(F.sum("times").alias("n"), *hashes).filter(F.col("n") >= support * n * (1 - 1e-9))
    items = staged(often.groupBy("n", "h0", "h1").agg(F.array_sort(F.collect_list("token")).alias("same"))
                   .select(F.col("same")[0].alias("item"), "same"), "url-items")
    known = each.join(items.select("item", F.explode("same").alias("token")), "token").groupBy("url", "label").agg(F.collect_set("item").alias("held"))
    baskets = rows.join(known, ["url", "label"], "left").select(
        F.concat(F.coalesce("held", F.array().cast("array<string>")), F.array(F.concat(F.lit("label="), "label"))).alias("items"),
        F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("items")
    sets = FPGrowth(itemsCol="items", minSupport=support).fit(baskets).freqItemsets
    if mining.max_tokens:
        sets = sets.filter(F.size("items") <= mining.max_tokens)
    sets = staged(sets, "frequent-sets")
    labels = F.array(F.lit(BLOCK), F.lit(ALLOW))
    plain = F.array_sort(F.array_except("items", labels))
    of_label = sets.filter(F.arrays_overlap("items", labels) & (F.size("items") > 1)).select(
        plain.alias("tokens"), F.when(F.array_contains("items", BLOCK), "block").otherwise("allow").alias("verdict"),
        F.col("freq").alias("both"))
    alone = sets.filter(~F.arrays_overlap("items", labels)).select(plain.alias("tokens"), F.col("freq"))
    rules = (of_label.join(alone, "tokens")
             .select("tokens", "verdict", (F.col("both") / F.col("freq")).alias("confidence"),
                     (F.col("both") / n).alias("support"))
             .filter(F.col("confidence") >= mining.min_confidence))
    # a rule goes if the rule without one of its tokens is at least as confident
    shorter = rules.filter(F.size("tokens") > 1).select(
        "tokens", "verdict", "confidence",
        F.explode("tokens").alias("token")).withColumn("less", F.array_remove("tokens", F.col("token")))
    known = rules.select(F.col("tokens").alias("less"), "verdict", F.col("confidence").alias("as_good"))
    useless = (shorter.join(known, ["less", "verdict"]).filter(F.col("as_good") >= F.col("confidence"))
               .select("tokens", "verdict").distinct())
    rules = rules.join(useless, ["tokens", "verdict"], "left_anti")
    share = F.when(F.col("verdict") == "block", F.lit(n_block / n)).otherwise(F.lit(1 - n_block / n))
    gain = F.when(share < 1, (F.col("confidence") - share) / (1 - share)).otherwise(F.lit(0.0))
    rules = rules.withColumn("gain", gain).filter(F.col("gain") > 0)
    named = (rules.select("tokens", "verdict", F.posexplode("tokens").alias("place", "item")).join(items, "item")
             .groupBy("tokens", "verdict").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "same"))), lambda x: x["same"]).alias("same")))
    return staged(rules.join(named, ["tokens", "verdict"]).select(
        F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "same", "verdict", "confidence", "support", "gain"), "url-rules")


def match_rules(urls: DataFrame, rules: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(url, tokens_matched, mined, confidence) of every distinct non-null url that some rule fits."""
    if "same" not in rules.columns:
        rules = rules.withColumn("same", F.transform("tokens", lambda t: F.array(t)))
    n_rules = rules.count()
    counts = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = (rules.select("rule_id", F.posexplode("tokens").alias("place", "token")).join(counts, "token")
              .groupBy("rule_id").agg(F.min_by("place", F.struct("n", "token")).alias("place")))
    index = rules.join(rarest, "rule_id").withColumn("token", F.explode(F.get("same", F.col("place")))).drop("place")
    index = F.broadcast(index) if n_rules <= mining.broadcast_rules else index
    distinct = urls.filter(F.col("url").isNotNull()).select("url").distinct().withColumn("have", url_tokens(F.col("url")))
    met = (distinct.select("url", "have", F.explode("have").alias("token")).join(index, "token")
           .filter(F.forall("same", lambda some: F.arrays_overlap(some, F.col("have")))))
    gain = F.col("gain" if "gain" in rules.columns else "confidence").alias("gain")
    best = F.struct(gain, "confidence", "support", F.size("tokens").alias("n"), "verdict", "tokens")
    return (met.groupBy("url").agg(F.max(best).alias("best"))
            .select("url", F.col("best.verdict").alias("mined"), F.col("best.tokens").alias("matched"),
                    F.col("best.confidence").alias("confidence")))


def judge(pages: DataFrame, rules: DataFrame, fixed=RULES, mining: Mining = Mining()) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, matched, confidence) of every row of ``pages``."""
    rows = pages.select("page_id", "url")
    found = match_rules(rows, rules, mining)
    out = rows.join(found, "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, says = fixed_rule(F.col("host"), F.col("path"), fixed)
    return (out.withColumn("host", host).withColumn("path", path).withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(says, F.col("mined"), F.lit(mining.default)))
            .select("page_id", "url", "host", "path", "rule", "verdict", "matched", "confidence"))

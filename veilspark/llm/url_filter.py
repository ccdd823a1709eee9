"""URL filters (operator 1): association rules mined from labels, and stated rules before them. DataFrame functions only.

A labelled page's URL becomes a set of tokens (scheme, host, domains, path segments without digits, extension, query
keys, fragment); Spark's FP-growth mines the sets together with the class of the page. A rule `tokens -> class` is
kept when its confidence and lift are high enough, when it has been seen LEAST_PAGES times and the lower confidence bound
of its confidence is above its class's share (so of thousands of rules without meaning hardly one is kept), and when no
part of it, of any size, has that confidence (pruning). Kept
rules stand in an inverted index under their first token: a URL looks up its own tokens only, and a rule matches when
all its tokens are there. The surest matching rule decides; without one the page is allowed.

A stated rule `host/path` fits its host and all subdomains where the URL's path starts with the rule's path; the
longest one wins, and goes before mined rules.

A page's label is that of the document whose number ends its path: such a page shows that document (of 2,500 pages
looked at, 2,459 hold the beginning of the first line of that document's text). Null or odd URLs: empty host and path, the only
token "none". Rows are judged one by one, equal rows equally. An empty table of labels gives no mined rules.

Bound: a token of a kept rule stands in a share of MIN_SUPPORT of all pages or more, and a URL has few tokens, so the
index is a literal of bounded size, whatever the number of pages."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path), as `host` + `path` in results.
STATED = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.6, 1.2
#: A rule has been seen on so many pages, and its confidence is so many standard errors above its class's share of all pages.
LEAST_PAGES, ERRORS = 20, 4.0
BAD, GOOD = "@bad", "@good"


def host_of(url: Column) -> Column:
    """From after the first :// up to / ? # or the end, A-Z lowered; empty without one."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: tuple = STATED) -> Column:
    """The longest rule that fits, as a struct of verdict and rule; null if none does."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the last one asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL."""
    u = F.coalesce(url, F.lit(""))
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    query = F.regexp_extract(u, r"(?s)\A[^?#]*\?([^#]*)", 1)
    kinds = (
        ("scheme", F.array(F.regexp_extract(u, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
        ("host", F.array(host)),
        ("domain", F.when(n > 1, F.array(F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), "."))).otherwise(F.array().cast("array<string>"))),
        ("top", F.array(F.element_at(labels, -1))),
        ("path", F.filter(F.split(path, "/"), lambda x: ~x.rlike(r"\d"))),
        ("ext", F.array(F.regexp_extract(path, r"\.([A-Za-z]+)\z", 1))),
        ("query", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, r"\A([^=]*)", 1))),
        ("part", F.array(F.when(u.contains("#"), "fragment").otherwise(""))),
    )
    # a lambda of two parameters would get the place as its second one
    under = lambda kind: lambda x: F.concat(F.lit(f"{kind}:"), x)
    named = F.concat(*[F.transform(F.filter(c, lambda x: x != ""), under(kind)) for kind, c in kinds])
    return F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(F.array(F.lit("none")))


def document_of(url: Column) -> Column:
    """The number that ends the path, before an extension or a slash; null without one."""
    return F.regexp_extract(path_of(url), r"/(\d{1,18})(?:\.[A-Za-z]+)?/?\z", 1).try_cast("bigint")


def lower_bound(share: Column, n: Column, errors: float = ERRORS) -> Column:
    """Wilson's lower bound of a share seen in n cases."""
    z = errors * errors
    return (share + z / (2 * n) - errors * F.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """verdict, tokens (sorted), confidence, lift and support of each kept rule."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0), F.lit(False)) | F.coalesce(F.col("toxic") > 0, F.lit(False))).alias("bad"))
    seen = pages.select("url").withColumn("doc_id", document_of(F.col("url"))).join(known, "doc_id")
    sets = seen.select(F.concat(tokens(F.col("url")), F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
    rules = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sets).associationRules
    total = sets.count()
    seen_on, share = F.col("support") * total / F.col("confidence"), F.col("confidence") / F.col("lift")
    sure = (seen_on > LEAST_PAGES - 0.5) & (lower_bound(F.col("confidence"), seen_on) > share)
    about = rules.where(sure & F.col("consequent")[0].isin(BAD, GOOD) & (F.col("lift") >= min_lift) & ~F.array_contains("antecedent", BAD) & ~F.array_contains("antecedent", GOOD))
    kept = about.select(F.when(F.col("consequent")[0] == BAD, "block").otherwise("allow").alias("verdict"), F.array_sort("antecedent").alias("tokens"), "confidence", "lift", "support")
    # a longer rule is dropped when a part of it, of any size, is as sure; a part's first token is one of the longer rule's
    part = kept.select(F.col("verdict").alias("v"), F.col("tokens").alias("ts"), F.col("confidence").alias("c"), F.col("tokens")[0].alias("t"))
    longer = kept.select("verdict", "tokens", "confidence", F.explode("tokens").alias("at"))
    inside = (F.col("at") == F.col("t")) & (F.col("verdict") == F.col("v")) & (F.size("ts") < F.size("tokens")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("ts", "tokens")) == 0)
    covered = longer.join(part, inside, "left_semi").select("verdict", "tokens").distinct()
    return kept.join(covered, ["verdict", "tokens"], "left_anti")


def matched(found: Column, rules: list) -> Column:
    """The surest of the rules that match the tokens, by an inverted index: a struct of confidence, verdict and tokens, or null."""
    if not rules:
        return F.lit(None).cast("struct<confidence:double,verdict:string,tokens:array<string>>")
    index: dict[str, list] = {}
    for r in rules:
        index.setdefault(r["tokens"][0], []).append(r)
    entry = lambda r: F.struct(F.lit(float(r["confidence"])).alias("confidence"), F.lit(r["verdict"]).alias("verdict"), F.array(*map(F.lit, r["tokens"])).alias("tokens"))
    held = F.create_map(*[x for token, some in sorted(index.items()) for x in (F.lit(token), F.array(*map(entry, some)))])
    looked = F.flatten(F.filter(F.transform(found, lambda t: F.try_element_at(held, t)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(looked, lambda r: F.size(F.array_except(r["tokens"], found)) == 0))


def judge(pages: DataFrame, labels: DataFrame, stated: tuple = STATED, key: str = "page_id") -> DataFrame:
    """key, host, path, rule (the stated one, or null), verdict, method_verdict, confidence and evidence of the mined rule."""
    rules = mine(pages, labels).collect()  # bounded: see above
    url = F.col("url")
    rows = pages.select(F.col(key), url, host_of(url).alias("host"), path_of(url).alias("path"), matched(tokens(url), rules).alias("mined"))
    rows = rows.withColumn("stated", stated_rule(F.col("host"), F.col("path"), stated))
    method = F.coalesce("mined.verdict", F.lit("allow"))
    return rows.select(key, "host", "path", F.col("stated.rule").alias("rule"), F.coalesce("stated.verdict", method).alias("verdict"), method.alias("method_verdict"), F.col("mined.confidence").alias("confidence"), F.array_join("mined.tokens", " ").alias("evidence"))

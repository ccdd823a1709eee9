"""Quality rules (operator 9): weak supervision instead of all-must-pass. DataFrame functions only.

Each rule votes for a text, against it, or abstains. A text's votes are one of few patterns; expectation-maximisation
over the patterns and their counts (all texts) estimates the share of good texts and each rule's rates of voting for
and against among good and bad ones. The posterior probability of being good then decides, instead of every rule
having to pass. The start says what a rule is: its vote against is rare among good texts and common among bad ones,
its vote for tells little. So the two classes keep their meaning. Texts of one kind of fault are found when more than
one rule sees it; two of the rules look at symbols in different ways for that.

Null texts: no words; each count is 0 and the base fails. Whole texts count, of any length; equal rows give equal
results. An empty table gives no rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

# White space of the contract, as the inside of a class of Java's patterns.
_BLANK = r" \t-\r"
SYMBOLS = "#*$%&|<>"
WINDOW, KEEP, ROUNDS, PRIOR = 5, 0.5, 100, 3
#: {vote: (rate among good, rate among bad)} at the start; it also counts as PRIOR texts of each class.
START = {1: (0.9, 0.6), 0: (0.09, 0.1), -1: (0.01, 0.3)}
START_SHARE = 0.8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{_BLANK}]+"), lambda w: w != "")


def counted(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs (with the prefix `in_`), COUNTS, and how many letters are upper case and how many words end oddly."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"in_{c}") for c in keep], t.alias("_t"))
    rows = rows.withColumn("_w", words_of(F.col("_t")))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(f"[^{_BLANK}]"))
    rows = rows.select(
        *[F.col(f"in_{c}") for c in keep],
        F.size("_w").cast("bigint").alias("n_words"),
        F.char_length(F.regexp_replace("_t", f"[{_BLANK}]+", "")).cast("bigint").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.struct(F.size(lines).alias("n"), F.size(F.array_distinct(lines)).alias("d")).alias("_lines"),
        F.char_length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        F.regexp_count("_t", F.lit(rf"[^\p{{L}}\p{{N}}.,;:!?'\"\u2019\u201d\u00bb)\]{_BLANK}](?=[{_BLANK}]|\z)")).cast("bigint").alias("n_odd_ends"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    window = lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(WINDOW)])
    windows = F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_h") - WINDOW), lambda i: F.struct(window(i).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("_s", F.sort_array(windows))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter("_s", lambda x, j: same(x, F.get(F.col("_s"), j - 1)) | same(x, F.get(F.col("_s"), j + 1)))
    rows = rows.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_p"), j + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(*[F.col(f"in_{c}") for c in keep], "n_words", "word_chars", "n_symbols", (F.col("_lines.n") - F.col("_lines.d")).cast("bigint").alias("n_dup_lines"), covered.alias("n_repeat_words"), "n_upper", "n_odd_ends")


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 for, -1 against, 0 if it abstains."""
    n, chars = F.col("n_words"), F.col("word_chars")
    vote = lambda against, doubtful: F.when(against, -1).when(doubtful, 0).otherwise(1)
    return {
        "length": vote(n < 10, n < 20),
        "mean_word": F.when(n == 0, -1).otherwise(vote((chars < 2.5 * n) | (chars > 15 * n), (chars < 3 * n) | (chars > 11 * n))),
        "symbols": vote(F.col("n_symbols") > 0.1 * n, F.col("n_symbols") > 0.03 * n),
        "endings": vote(F.col("n_odd_ends") > 0.1 * n, F.col("n_odd_ends") > 0.03 * n),
        "lines": F.when(n == 0, 0).otherwise(vote(F.col("n_dup_lines") >= 5, F.col("n_dup_lines") > 0)),
        "repeats": F.when(n < WINDOW, 0).otherwise(vote(F.col("n_repeat_words") * 100 > 20 * n, F.col("n_repeat_words") * 100 > 5 * n)),
        "shouting": F.when(chars == 0, 0).otherwise(vote(F.col("n_upper") > 0.5 * chars, F.col("n_upper") > 0.25 * chars)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """The share of good texts, and for each rule {vote: (rate among good, rate among bad)}, from patterns of votes and
    their counts."""
    share, rates = START_SHARE, [START] * rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [n * posterior(p, share, rates) for p, n in patterns]
        share = (sum(good) + START_SHARE * PRIOR) / (total + PRIOR)
        new = []
        for r in range(rules):
            sums = {v: [PRIOR * a, PRIOR * b] for v, (a, b) in START.items()}
            for x, (p, n) in zip(good, patterns, strict=True):
                sums[p[r]][0] += x
                sums[p[r]][1] += n - x
            all_good, all_bad = (sum(s[i] for s in sums.values()) for i in (0, 1))
            new.append({v: (a / all_good, b / all_bad) for v, (a, b) in sums.items()})
        rates = new
    return share, rates


def posterior(pattern: tuple[int, ...], share: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(share / (1 - share)) + sum(math.log(r[v][0] / r[v][1]) for v, r in zip(pattern, rates, strict=True) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judged(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """in_ columns, COUNTS, base_failed, quality (posterior probability) and kept of each row."""
    rows = stored(counted(docs, keep, text), "quality")
    named = votes()
    # at most 3 ** rules patterns, whatever the number of texts
    patterns = [(tuple(r[:-1]), r[-1]) for r in rows.groupBy(*[v.alias(k) for k, v in named.items()]).count().orderBy(*named).collect()]
    share, rates = estimate(patterns, len(named))
    odds = F.lit(math.log(share / (1 - share)))
    for (_, vote), rate in zip(named.items(), rates, strict=True):
        weight = {v: math.log(rate[v][0] / rate[v][1]) for v in (1, -1)}
        odds = odds + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(0.0)
    rows = rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, COUNTS, base_failed, kept and quality of each row."""
    return judged(docs, [key], text).select(F.col(f"in_{key}").alias(key), *COUNTS, "base_failed", "kept", "quality")


def kept_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that are kept."""
    return judged(docs, docs.columns, text).where("kept").select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])

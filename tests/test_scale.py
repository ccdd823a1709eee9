"""Hot groups, many terms, and plans that do the work once."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from veilspark.operators import redact, rules
from veilspark.operators.resolve import detect, exploded
from veilspark.plans import ledger, policy
from veilspark.plans.order import numbered_within
from veilspark.schema import UserTerms


def test_places_in_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(None).cast("string")).when(F.col("id") % 3 == 1, "a").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), F.xxhash64("id").alias("o"))
    want = {}
    for r in sorted(rows.collect(), key=lambda r: r["o"]):
        want.setdefault(r["g"], []).append(r["id"])
    got = numbered_within(rows, ["g"], ["o"], "n").collect()
    assert len(got) == 3000 and all(want[r["g"]][r["n"] - 1] == r["id"] for r in got)


def test_placeholders_of_one_conversation_of_all_rows(spark):
    found = spark.range(2000).select(F.lit("c").alias("conversation_id"), F.lit("PERSON").alias("type"), F.concat(F.lit("k"), (F.col("id") % 700).cast("string")).alias("key"), F.lit("K").alias("value"), (F.lit(5000) - F.col("id")).alias("seq"), F.lit(0).alias("start"), F.lit(False).alias("allowlisted"))
    first = {}
    for r in sorted(found.collect(), key=lambda r: r["seq"]):
        first.setdefault(r["key"], len(first) + 1)
    placed = redact.allocate(found)
    assert {r["key"]: r["n"] for r in placed.collect()} == first
    ranges = numbered_within(found.groupBy("conversation_id", "type", "key").agg(F.min("seq").alias("seq")).withColumn("p", F.lit(0)), ["conversation_id", "type"], ["seq"], "n")
    assert "rangepartitioning" in ranges._jdf.queryExecution().toString()


def brute_terms(terms, text):
    touches = lambda c: c == "_" or (c != "" and unicodedata.category(c)[0] in "LN")
    out = []
    for type_, pattern in rules.term_patterns(terms):
        for m in re.finditer(pattern, text, re.IGNORECASE):
            start, end = m.span()
            start -= type_ == "PHONE" and start > 0 and text[start - 1] in "+("
            if not touches(text[start - 1 : start]) and not touches(text[end : end + 1]):
                out.append((type_, start, end))
    return out


def test_many_terms_equal_a_pattern_for_each(spark):
    rng = random.Random(3)
    words = ["Ana", "O'Neil", "ſam", "KİM", "ıda", "straße", "ẞ", "ĸ", "é", "x_1", "@bob", "#!", "12", "漢字", "ﬁx"]
    for _ in range(150):
        pick = lambda k: tuple(" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(k))
        terms = UserTerms(names=pick(2), emails=("a.b@c.de",), phones=("(212) 555-0100", "12"), addresses=pick(1), custom=pick(3))
        text = rng.choice([" ", "-", "", "_"]).join(rng.choices([*words, *map(str.upper, words), *map(str.lower, words), "+1 (212) 555.0100", "A.B@c.de", "K", "s"], k=12))
        assert [(f[0], f[1], f[2]) for f in rules.user_terms(terms)(rules.Text(text))] == brute_terms(terms, text)


def test_a_hundred_thousand_terms_cost_about_as_much_as_a_hundred():
    text = rules.Text("we met name77 surname77 at the long table and talked about nothing much " * 20)
    find = {n: rules.user_terms(UserTerms(custom=tuple(f"name{i} surname{i}" for i in range(n)))) for n in (100, 100_000)}
    took = {}
    for n, rule in find.items():
        assert len(list(rule(text))) == 20
        start = time.perf_counter()
        for _ in range(20):
            list(rule(text))
        took[n] = time.perf_counter() - start
    assert took[100_000] < 5 * took[100] + 0.05


def test_terms_of_each_user(spark):
    terms = spark.createDataFrame([(1, "names", "Ana Kim"), (2, "custom", "Blue Door"), (2, "other", "zzz"), (None, "names", "Nobody")], "user_id long, field string, term string")
    said = spark.createDataFrame([(1, "ana kim saw a blue door"), (2, "ana kim saw a blue door"), (3, "blue door"), (1, None)], "user_id long, text string")
    got = {(r["user_id"], r["text"]): [f["value"] for f in r["found"]] for r in rules.terms_by_user(said, terms).collect()}
    assert got == {(1, said.first()["text"]): ["ana kim", "ana", "kim"], (2, said.first()["text"]): ["blue door"], (3, "blue door"): [], (1, None): []}


def test_texts_are_scanned_once(spark, tmp_path):
    spark.createDataFrame([(i, f"mail a{i}@b.example or 10.0.0.{i}") for i in range(50)], "seq long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    for df in (exploded(detect(docs), "seq"), exploded(detect(docs.repartition(8)), "seq"), policy.chunks(docs.withColumn("page", F.col("seq")))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.count("RoundRobinPartitioning") <= 1


def test_long_texts_take_time_in_proportion():
    start = time.perf_counter()
    t = rules.Text(",".join(f"u{i}@mail.example" for i in range(40_000)) + " http://x.example/a@b.example")
    assert len(list(rules.email(t))) == 40_000
    keys = rules.Text("-----BEGIN RSA PRIVATE KEY-----\nabc\n" * 5000 + "-----END RSA PRIVATE KEY-----" + " -----BEGIN PRIVATE KEY----- sk-" + "a" * 30)
    assert [f[1:3] for f in rules.api_key(keys)] == [(0, keys.text.index("END RSA") + 24), (keys.text.index("sk-"), len(keys.text))]
    assert sum(map(len, policy._windows("line of text\n\n" * 80_000, 1200, 200))) > 1_000_000
    assert time.perf_counter() - start < 4


def test_scores_of_a_stream_at_any_day(spark):
    changes = spark.createDataFrame([(1, 19700, 40, 1, 19690, 5, 1), (1, 19702, 30, 1, 19690, 7, 2)], "user_id long, day long, score long, leaked long, first long, at long, place long")
    got = {r["date"]: r["score"] for r in ledger.scores_on(changes, "2023-12-15 00:00:00").collect()}  # day 19706
    assert [got[f"2023-12-{d:02d}"] for d in (9, 10, 11, 12, 13, 14, 15)] == [40, 42, 30, 32, 34, 36, 36]


def test_keys_of_a_stream_share_groups(spark, tmp_path, monkeypatch):
    """Many keys, one of them null, over batches: states go on by key, and there are as many groups as buckets at most."""
    from veilspark.streaming import live

    monkeypatch.setattr(live, "BUCKETS", 3)
    schema = "editor string, kind string, version long, findings string, ts timestamp"
    at = lambda rows: rows.withColumn("ts", F.timestamp_seconds("version"))
    editor = F.when(F.col("id") > 0, F.col("id").cast("string")).alias("editor")
    for i, (kind, version) in enumerate([("edit", 2), ("result", 1), ("result", 2), ("edit", 3), ("result", 2)]):  # a batch each
        at(spark.range(40).coalesce(1).select(editor, F.lit(kind).alias("kind"), F.lit(version).cast("long").alias("version"), F.lit("x").alias("findings"))).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    found = live.fresh_results(stream)
    assert "_bucket" in found._jdf.queryExecution().analyzed().toString()
    got = sorted((r["editor"] or "", r["version"]) for r in live.collected(found).collect())
    assert got == sorted((str(i) if i else "", 2) for i in range(40))

"""Empty tables, clashing columns, ties, and what the numbered operators do at their limits."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import bpe_codec, language_id, license_scan, media, near_copies, packing, quality_rules, simhash, token_counts, toxicity, url_filter
from veilspark.llm.common import joined_once
from veilspark.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = [c + " string" for c in ("k", "t", "row", "n", "fp", "first", "root", "_copies", "_kept", "_near_row", "_simhash_row", "c0", "score", "label", "kept", "quality")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_all_operators_on_empty_tables(spark, labels):
    docs = spark.createDataFrame([], DOCS)
    everyone = F.lit(True)
    results = [
        url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), labels),
        packing.pack(docs, vocabulary("word_bpe_49k.json")),
        media.media_columns(docs),
        simhash.near_duplicates(docs),
        bpe_codec.round_trips(docs, vocabulary("byte_bpe_50k.tiktoken")),
        toxicity.score(docs, toxicity.fit(docs, labels)),
        token_counts.count_tokens(docs, vocabulary("word_bpe_49k.json")),
        license_scan.digest(license_scan.scan(docs)),
        quality_rules.judge(docs),
        language_id.predict(docs, language_id.fit(docs, everyone)),
        simhash.one_of_each(docs),
        near_copies.one_of_each(docs),
        quality_rules.kept_rows(docs),
        toxicity.clean_rows(docs, toxicity.fit(docs, labels)),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_stages_keep_rows_with_nulls_repeats_and_clashing_columns(spark):
    good = "The weather was fine and we walked along the river until the evening came and then home again to read."
    values = [(1, good), (1, good), (None, good + " Other words follow here, which say more."), (2, None), (3, ""), (4, "you stupid idiot, you moron")]
    schema = DOCS + ", " + ", ".join(CLASHING)
    docs = spark.createDataFrame([(i, t, None, None, None, *(["x"] * len(CLASHING))) for i, t in values], schema)
    some = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    clean = toxicity.clean_rows(docs, toxicity.fit(docs, some))
    assert clean.columns == docs.columns and sorted(r["doc_id"] or 0 for r in clean.collect()) == [0, 1, 1, 2, 3]
    assert quality_rules.kept_rows(clean).columns == docs.columns
    for once in (simhash.one_of_each, near_copies.one_of_each):
        rows = once(docs).collect()
        assert rows[0].asDict().keys() == set(docs.columns) and sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i or 0, t or "") for i, t in {(1, good), values[2], (2, None), values[5]})
    for name, of in (("near_duplicates", simhash.near_duplicates(docs)), ("media", media.media_columns(docs)), ("tokens", token_counts.count_tokens(docs, vocabulary("word_bpe_49k.json"))), ("language", language_id.predict(docs, language_id.fit(docs, F.lit(True))))):
        assert of.count() == len(values), name
    assert packing.pack(docs, vocabulary("word_bpe_49k.json")).where("start = 0").count() == len(values)
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near-duplicates"


def test_join_with_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 2000).alias("k"), "id")
    each = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("m"))
    got = joined_once(rows, each, "k", "n")
    assert got.columns == ["k", "id", "m"] and got.count() == 5000 and got.where("k = 0").select("m").distinct().count() == 1


def made_text(rng, letters):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(40))


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(3)
    rows = [(i, made_text(rng, letters), lang) for i, (lang, letters) in enumerate([("aa", "abcde"), ("bb", "fghij"), ("cc", "klmnö")] * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_without_letters_in_blocks_and_held_out(spark, languages, monkeypatch):
    trained = F.col("doc_id") % 5 > 0
    odd = spark.createDataFrame([(-1, "\u00b2 \u00bd \u2460 12, \u2167", None), (-2, "", None), (-3, None, None), (-4, "\u0301!", None)], "doc_id long, text string, lang string")
    docs = languages.unionByName(odd)
    whole = {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in language_id.predict(docs, language_id.fit(docs, trained)).collect()}
    want = {r["doc_id"]: r["lang"] for r in languages.collect()}
    assert all(whole[i][0] == lang for i, lang in want.items() if i % 5 == 0)
    assert all(whole[i] == ("und", 0.0) for i in (-1, -2, -3, -4))
    monkeypatch.setattr(language_id, "BLOCK", 1)
    model = language_id.fit(docs, trained)
    assert model["blocks"] == 3
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in language_id.predict(docs, model).collect()} == whole


def test_license_places_in_a_long_text(rows_of):
    n = 20_000
    r = license_scan.digest(license_scan.scan(rows_of(["a " + "cc by nc " * n]))).first()
    assert (r["n_base"], r["first_word"], r["last_word"], r["n_words"]) == (n, 1, 3 * (n - 1) + 1, 3 * n + 1)


def planted_pages(spark, n, share):
    """Pages of a domain whose documents are bad with the given share, and others that are bad one time in ten."""
    rng = random.Random(n)
    rows = [(i, f"http://{'junk.example.dev' if i % 4 == 0 else f'h{i % 7}.example.edu'}/p/{i}", rng.random() < (share if i % 4 == 0 else 0.1)) for i in range(n)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    return pages, spark.createDataFrame([(i, 0 if bad else 1, 0) for i, _, bad in rows], "doc_id long, quality int, toxic int")


def test_mined_rules_beat_the_base_rate_on_held_out_pages(spark):
    pages, labels = planted_pages(spark, 1600, 0.9)
    judged = url_filter.judge(pages, labels.where("doc_id % 2 = 0")).join(labels.withColumnRenamed("doc_id", "page_id"), "page_id").where("page_id % 2 = 1 or page_id % 8 = 4")
    right = judged.agg(F.avg(((F.col("verdict") == "block") == (F.col("quality") == 0)).cast("int")).alias("r"), F.avg((F.col("quality") == 1).cast("int")).alias("base")).first()
    assert right["r"] > right["base"] + 0.1


def test_labels_that_say_nothing_give_no_rules(spark):
    pages, labels = planted_pages(spark, 1600, 0.1)
    assert url_filter.mine(pages, labels).count() == 0


def literal_score(text, words, kinds, base, rates):
    """The grammar by a walk over each clause's words, without a table."""
    import re

    strong, weak, n = set(), 0, 0
    for clause in re.split(r"[.!?;:,\n]", text.lower()):
        said = re.findall(r"[a-z0-9äöüßéèêçñáíóú]+(?:'[a-z0-9]+)*", clause)
        n += len(said)
        light_words = 0
        insult = threat = aimed = lightly = denied = told = False
        best, reported, reach = 0.0, False, 0
        for w in said:
            p = max([words.get(w, 0.0), *(v for k, v in words.items() if k.endswith("*") and not k.endswith("**") and w.startswith(k[:-1]))])
            light = not p and any(k.endswith("**") and w.startswith(k[:-2]) for k in words)
            best = max(best, p)
            light_words += light
            bad = p > 0 or light or w in toxicity.THREATS and w not in toxicity.NEGATIONS
            if not bad and w in toxicity.REPORTS:
                reported = True
            elif not bad and w in toxicity.NEGATIONS:
                reach = toxicity.REACH
                continue
            elif not bad and w in toxicity.TARGETS:
                aimed = True
            elif bad:
                negated = reach > 0
                if negated:
                    denied |= p > 0
                elif reported:
                    told |= p > 0
                else:
                    insult, lightly, threat = insult or p > 0, lightly or light, threat or not (p > 0 or light)
            reach = max(0, reach - 1)
        kind = "targeted threat" if threat and aimed else "targeted insult" if insult and aimed else "insult" if insult else "weak" if lightly else "reported" if told else "negated" if denied else None
        if kind == "weak":
            weak += light_words
        elif kind:
            strong.add((kind, best or 1.0))
    if not strong and not weak:
        return base
    clean = 1.0
    if weak:
        a, b, odds = rates
        like = lambda p: p**weak * (1 - p) ** (n - weak) / (1 - (1 - p) ** n)
        clean = 1 / (1 + odds * like(a) / like(b))
    for kind, p in strong:
        clean *= 1 - kinds[kind] * p
    return 1 - clean


def test_toxicity_scores_by_a_literal_walk():
    rng = random.Random(9)
    kinds = {k: 0.3 + 0.1 * i for i, k in enumerate(toxicity.PRIORS)}
    words = {"scum": 0.9, "idiot": 0.7, "vermin*": 0.8, "blurb**": 0.5}
    rates = (0.2, 0.03, 0.5)
    g = toxicity.Grammar(words, kinds, 0.02, rates)
    pool = ["scum", "Idiot", "verminous", "blurbing", "blurbs", "kill", "you", "they", "not", "never", "said", "wrote", "the", "a", "house", "river", "isn't"]
    for _ in range(3000):
        text = "".join(rng.choice(pool) + rng.choice((" ", " ", " ", ", ", ". ", "!\n")) for _ in range(rng.randrange(0, 40)))
        assert abs(g.score(text) - literal_score(text, words, kinds, 0.02, rates)) < 1e-9, text

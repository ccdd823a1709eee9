"""Operators that look at one text at a time: codec, counts, licenses, toxicity, languages."""

import base64
import hashlib
import os
import random

import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import bpe_codec, language_id, license_scan, token_counts, toxicity
from veilspark.llm.packing import WordIds
from veilspark.llm.queries import vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"
ALPHABET = "abcXYZ éÉßüñ'sS’ \t\n\r\x0b\x1c\x1f\x85\xa0​ 0123²½٣①!!..#|-_<>ΣςσİIﬁ é漢字😀\u0000ͅ"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def some_texts(n=400):
    rng = random.Random(2)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 20))) + rng.choice(["", "<|endoftext|>", "thereof"]) for _ in range(n)]


def test_codec_equals_the_library(spark, rows_of, odd, reference):
    texts = odd + some_texts()
    got = {r["doc_id"]: r for r in bpe_codec.round_trips(rows_of(texts), vocabulary("byte_bpe_50k.tiktoken")).collect()}
    ids = {r["doc_id"]: r["ids"] for r in bpe_codec.encode_texts(rows_of(texts), vocabulary("byte_bpe_50k.tiktoken")).collect()}
    for i, t in enumerate(texts):
        want = reference.encode_ordinary(t or "")
        assert ids[i] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_ranks_with_a_gap_are_refused():
    with pytest.raises(ValueError):
        bpe_codec.model_of({b"a": 0, b"b": 2})


def test_counts_equal_the_library(rows_of, odd, library):
    texts = odd + some_texts()
    got = {r["doc_id"]: r for r in token_counts.count_tokens(rows_of(texts), vocabulary("word_bpe_49k.json")).collect()}
    ids = WordIds(vocabulary("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(want) and got[i]["n_bytes"] == len((t or "").encode()) and got[i]["over_limit"] == (len(want) > 2048)
        assert len(ids.packed(t or "")) == 2 * len(want)


def test_empty_tables(spark, rows_of):
    none = rows_of(["x"]).where("doc_id < 0")
    assert token_counts.count_tokens(none, vocabulary("word_bpe_49k.json")).count() == 0
    assert license_scan.digest(license_scan.scan(none)).count() == 0
    assert toxicity.score(none, toxicity.prior_grammar()).count() == 0
    model = language_id.fit(none, F.lit(True))
    assert language_id.predict(rows_of(["abc"]), model).first()["lang_pred"] == "und"


def base_places(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        out += [(label, i) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_licenses(rows_of, odd):
    texts = [*odd, "Released under the MIT License. under THE mit  license", "Relesed under the MIT Licence, x", "cc by nc cc by-nc", "This work is licensed under the GNU General Public Licence, version 3", "licensed under the apache license, version 22", "nothing licensed"]
    got = {r["doc_id"]: r for r in license_scan.digest(license_scan.scan(rows_of(texts))).collect()}
    for i, t in enumerate(texts):
        n, places = base_places(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert (r["first_word"], r["last_word"]) == ((min(p for _, p in places), max(p for _, p in places)) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({a for a, _ in places})) and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}
    k = len(odd)
    assert got[k]["labels"] == "mit" and got[k]["score"] == 1.0
    assert got[k + 1]["labels"] == "mit" and got[k + 1]["base_labels"] == "" and 0.9 < got[k + 1]["score"] < 1 and got[k + 1]["spans"] == ["mit:0:4:2"]
    assert got[k + 2]["labels"] == "cc-by-nc" and got[k + 2]["n_base"] == 2
    assert got[k + 3]["labels"] == "gpl-3" and got[k + 5]["labels"] == "" and got[k + 5]["score"] == 0.0


def test_grammar_transducers():
    g = toxicity.prior_grammar()
    kinds = lambda t: [k for k, _ in g.clauses(t)]
    assert kinds("You are an idiot. He is fine.") == ["targeted insult"]
    assert kinds("an idiot, there") == ["insult"]
    assert kinds("this is not an idiot") == ["negated"]
    assert kinds("not so long ago some very old idiot") == ["insult"]
    assert kinds("Ann said idiot") == ["reported"]
    assert kinds("I will kill you") == ["targeted threat"] and kinds("kill the lights") == []
    assert kinds("idiotic") == [] and kinds("") == []
    assert g.score(None) == g.score("") == g.base and g.score("not an idiot") < toxicity.THRESHOLD < g.score("you idiot")


def test_toxicity_learns_new_insults(spark, rows_of):
    rng = random.Random(4)
    clean = lambda: " ".join(rng.choice("der die das und mit von zu ein auf fur".split()) + rng.choice("abcdefgh") for _ in range(30))
    texts, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        texts.append(clean() + (f" zorbk{rng.choice(['ung', 'heit', 'en', 'lich'])} " + clean() if bad else ""))
        labels.append((i, int(bad)))
    labels = spark.createDataFrame([*labels, (0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    docs = rows_of(texts)
    grammar = toxicity.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, grammar).collect()}
    assert all(got[i] == int(i % 3 == 0) for i in range(300))
    kept = toxicity.clean_rows(docs, grammar)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(300) if i % 3}


def test_cover_stops_when_all_is_explained():
    toxic = [{"a*", "x"}, {"a*", "y"}, {"a*", "z"}, {"a*", "w", "v"}]
    assert toxicity.cover(toxic, {f: (3, 0) for fs in toxic for f in fs}, set()) == ["a*"]


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.fit(docs, ~held)
    rows = docs.select("doc_id", F.col("lang").alias("lang")).join(language_id.predict(docs, model), "doc_id").where(held)
    right = rows.where("lang = lang_pred").count() / rows.count()
    assert right > 0.95 and rows.where("score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "漢字漢字漢字")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in {r["lang"] for r in model["centroids"].collect()} and got[4]["rejected"]


def test_packing_with_a_small_memory():
    """Ids don't depend on how many words are remembered, and no more are."""
    from veilspark.llm import packing
    from veilspark.llm.queries import vocabulary

    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "word's", f"w{rng.randrange(10**6)}", "é,a", "x" * rng.randrange(1, 30)]) for _ in range(40)) for _ in range(60)]
    small, usual = (packing.WordIds(vocabulary("word_bpe_49k.json"), m) for m in ((300, 200), packing.REMEMBERED))
    for t in texts:
        assert small.packed(t) == usual.packed(t)
        assert len(small.known.words) <= 200 and len(small.known.pieces) <= 300
    assert len(usual.known.words) > 200

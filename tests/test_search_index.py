"""The stored search index against the search that builds its postings anew."""

import random

import pytest

from veilspark.plans import policy
from veilspark.plans.search_index import SearchIndex

KEY = ["page_id", "chunk"]
SCHEMA = "page_id long, chunk int, tool_id string, chunk_text string"


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(["the"] * rng.randint(1, 4) + rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(3, 60)))
    return [(i, 0, rng.choice(["a", "b"]), text()) for i in range(n)]


def results(rows):
    return {(r["question_id"], r["tool_id"], r["rank"]): (r["page_id"], r["chunk"], r["score"]) for r in rows.collect()}


@pytest.fixture(scope="module")
def questions(spark):
    asked = ["the w1 w40", "w0", "the", "w55 w56 w57 nothing", "unknown words", "w2 w3 w4 w5 w6 the"]
    return spark.createDataFrame([(f"q{i}", t, q) for i, q in enumerate(asked) for t in ("a", "b")], "question_id string, tool_id string, question string")


def test_search_and_refresh(spark, tmp_path, questions):
    pieces = {r[:2]: r for r in corpus(700, 1)}
    index = SearchIndex(spark, str(tmp_path / "index"), KEY)
    table = lambda rows: spark.createDataFrame(list(rows), SCHEMA)
    index.refresh(table(pieces.values()))
    plain = lambda: results(policy.search(questions, policy.index(table(pieces.values()), KEY), KEY))
    assert results(index.search(questions)) == plain()
    # a frequent term brings no candidates beside rarer ones: most of its blocks aren't read
    only = questions.where("question_id = 'q0' and tool_id = 'a'")
    need = {r["term"] for r in index.needed(only)[1].select("term").distinct().collect()}
    assert "w40" in need and "the" not in need
    changed = [(k[0], k[1], "b", t[3]) for k, t in zip([(3, 0), (5, 0), (900, 0), (901, 0)], corpus(4, 9))] + [(7, 0, "a", "")]
    index.refresh(table(changed), table([pieces[(11, 0)], pieces[(12, 0)]]).select(*KEY))
    pieces |= {r[:2]: r for r in changed}
    del pieces[(11, 0)], pieces[(12, 0)]
    assert results(index.search(questions)) == plain()
    index.refresh(table([(11, 0, "a", "w55 w56 again")]))
    pieces[(11, 0)] = (11, 0, "a", "w55 w56 again")
    assert results(index.search(questions)) == plain()

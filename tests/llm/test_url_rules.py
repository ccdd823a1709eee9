"""Mined URL rules of any length."""

from itertools import combinations, product

from pyspark.sql import functions as F

from veilspark.llm import url_filter


def test_rules_of_three_tokens(spark):
    """Only three tokens together are bad: any two of them have confidence 1/2, under the least one."""
    urls = [f"http://{host}/{path}/{i * 8 + j}?{query}=1" for i in range(40) for j, (host, path, query) in enumerate(product(("a.x.dev", "b.y.dev"), ("p", "q"), ("m", "n")))]
    bad = {i: "a.x.dev/p/" in u and "?m=" in u for i, u in enumerate(urls)}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, int(b)) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["method_verdict"] for r in url_filter.judge(pages, labels, ()).collect()}
    assert got == {i: "block" if b else "allow" for i, b in bad.items()}
    # each kept rule is surer than all its parts, and no rule above the limits is missing without a part as sure
    sets = [(set(r["t"]), bad[r["page_id"]]) for r in pages.select("page_id", url_filter.tokens(F.col("url")).alias("t")).collect()]
    brute = {}
    t = sorted({x for s, _ in sets for x in s})
    for size in range(1, len(t) + 1):
        for some in combinations(t, size):
            hit = [b for s, b in sets if s.issuperset(some)]
            for verdict, n, share in (("block", sum(hit), sum(bad.values())), ("allow", len(hit) - sum(hit), len(bad) - sum(bad.values()))):
                if n >= url_filter.MIN_SUPPORT * len(sets) and n / len(hit) >= url_filter.MIN_CONFIDENCE and n / len(hit) >= url_filter.MIN_LIFT * share / len(sets):
                    brute[verdict, some] = n / len(hit)
    want = {(v, t) for (v, t), c in brute.items() if not any(brute.get((v, p), 0) >= c for k in range(1, len(t)) for p in combinations(t, k))}
    mined = {(r["verdict"], tuple(r["tokens"])) for r in url_filter.mine(pages, labels).collect()}
    assert mined == want and max(len(t) for _, t in want) == 3

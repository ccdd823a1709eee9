"""Operators over a whole corpus: packing, media, near-duplicates, quality rules, URL filters, the pipeline."""

import hashlib
import io
import random
import re
import tarfile
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from veilspark.llm import media, packing, quality_rules, simhash, url_filter
from veilspark.llm.components import components
from veilspark.llm.queries import vocabulary

SIZE = 64


def checked_pieces(texts, rows, size):
    """Every id of every text lies in one piece, windows are gapless, and all but the last are full."""
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    at, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r["doc_id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i in ids:
        end = 0
        for a, n in sorted(at[i]):
            assert a == end
            end += n
        assert end == len(ids[i])
    full = []
    for w in sorted(windows):
        end = 0
        for a, n in sorted(windows[w]):
            assert a == end and n > 0
            end += n
        full.append(end)
    assert sorted(windows) == list(range(len(full))) and all(n == size for n in full[:-1]) and 0 < full[-1] <= size
    return windows


@pytest.mark.parametrize("targets", [None, {"s0": 0.6, "s1": 0.3}, {"nowhere": 1.0}])
def test_packing(rows_of, odd, targets):
    rng = random.Random(7)
    texts = [*odd[:6], *odd[7:11], *(" ".join(rng.choice("one two three fourty".split()) for _ in range(rng.randint(0, 90))) for _ in range(60))]
    rows = packing.pack(rows_of(texts), vocabulary("word_bpe_49k.json"), SIZE, targets=targets).collect()
    checked_pieces(texts, rows, SIZE)
    if targets is None:  # each window has each source's share, but for the tokens carried
        total = Counter()
        by = defaultdict(Counter)
        for r in rows:
            total[r["source"]] += r["length"]
            by[r["sequence_id"]][r["source"]] += r["length"]
        for w in list(by)[:-1]:
            for s, n in total.items():
                assert abs(by[w][s] - SIZE * n / sum(total.values())) < 2.5


def test_packing_of_nothing(rows_of):
    assert packing.pack(rows_of(["x"]).where("doc_id < 0"), vocabulary("word_bpe_49k.json")).count() == 0


def literal_deficit_round_robin(totals, windows):
    """What each queue gives in each window: it is owed its quantum and what the queue before it left, and the last
    queue's rest goes to the first one of the next window as nothing, windows being whole."""
    quantum = [Fraction(t, windows) for t in totals]
    owed, given_all, out = [Fraction(0)] * len(totals), [0] * len(totals), []
    for _ in range(windows):
        row, upto_owed, upto_given = [], Fraction(0), 0
        for j, q in enumerate(quantum):
            owed[j] += q  # the deficit counter, never reset
            upto_owed += owed[j]
            upto_given += given_all[j]
            take = int(upto_owed) - upto_given - sum(row)
            row.append(take)
        given_all = [a + b for a, b in zip(given_all, row)]
        out.append(row)
    return out


def test_schedule_carries_less_than_a_token():
    rng = random.Random(1)
    for _ in range(50):
        windows, size = rng.randint(1, 30), 32
        cuts = sorted(rng.sample(range(1, windows * size), 3)) if windows * size > 4 else [1, 2, 3]
        totals = [b - a for a, b in zip([0, *cuts], [*cuts, windows * size])]
        s = packing.Schedule([(0, windows, totals)])
        for j, t in enumerate(totals):
            for w in range(windows + 1):
                given = int(s.given(0, j + 1, w) - s.given(0, j, w))
                assert abs(given - Fraction(t * w, windows)) < 1
        for w in range(windows + 1):
            assert s.given(0, len(totals), w) == w * size
        taken = [[int(s.given(0, j + 1, w + 1) - s.given(0, j, w + 1) - s.given(0, j + 1, w) + s.given(0, j, w)) for j in range(len(totals))] for w in range(windows)]
        assert taken == literal_deficit_round_robin(totals, windows)


def test_tiny_sources_share_a_queue():
    queues, shares = packing.queues_of([("a", 900), ("b", 99), ("c", 1)], None, 64)
    assert queues == [["a"], ["b", "c"]] and sum(shares) == 1
    queues, _ = packing.queues_of([(f"s{i:03}", 1) for i in range(200)], None, 64)
    assert len(queues) == 1 and len(queues[0]) == 200


def test_many_sources(spark):
    texts = [f"text {i} of many" for i in range(300)]
    docs = spark.createDataFrame([(i, t, f"host{i % 150:03}" if i % 3 else "big") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    checked_pieces(texts, packing.pack(docs, vocabulary("word_bpe_49k.json"), SIZE).collect(), SIZE)


def test_media(spark, rows_of, odd):
    docs = rows_of(odd)
    got = {r["doc_id"]: r for r in media.media_columns(docs).collect()}
    for i, t in enumerate(odd):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        picture = media.picture(payload)
        assert (r["media_bytes"], r["media_sha256"], r["width"], r["height"], r["bits"]) == (len(picture), hashlib.sha256(picture).hexdigest(), 576, len(payload) // 576, 8)
    assert [got[7][c] for c in ("shard", "offset", "feature")] == [got[8][c] for c in ("shard", "offset", "feature")]
    rows, folder = media.store(docs)
    for h in media.headers(media.places(rows), folder).collect():
        with tarfile.open(f"{folder.removeprefix('file://')}/{h['shard']}") as tar:
            entry = tar.getmember(f"{h['digest'].hex()}.png")
            assert (entry.offset_data, entry.size) == (h["offset"], h["length"])
            assert hashlib.sha256(media.samples(io.BytesIO(tar.extractfile(entry).read()).getvalue())).digest() == h["digest"]


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(s))


def classes(items, linked):
    up = {i: i for i in items}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in items:
        for b in items:
            if b < a and linked(a, b) and top(a) != top(b):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in items}


def test_simhash(rows_of, odd):
    rng = random.Random(5)
    base = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(300)]
    texts = list(odd)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    docs = rows_of(texts)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fp = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = classes(list(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert all(got[i]["fingerprint"] == f"{fp[i]:016x}" and got[i]["component_id"] == want[i] for i in fp)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    twice = simhash.one_of_each(docs.unionByName(docs))
    assert twice.count() == kept.count()


def test_anchors_lose_no_link(spark):
    rng = random.Random(9)
    fps = set()
    for _ in range(150):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(3):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 3)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert got == want and len(want) > 100


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = sorted({x for e in edges for x in e})
    joined = set(edges) | {(b, a) for a, b in edges}
    want = classes(nodes, lambda a, b: (a, b) in joined)
    assert {n: got.get(n, n) for n in nodes} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_counts(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), dup, len(covered)


def test_quality_rules(rows_of, odd):
    rng = random.Random(8)
    good = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)) for _ in range(60)]
    bad = ["BUY!! NOW!! " * 60, "# * $ % " * 50, "menu | home | login |\n" * 30]
    texts = [*odd, "a b c d e f a b c d e g h", "l\nl\n\nl \n m\nm", *bad, *good]
    got = {r["doc_id"]: r for r in quality_rules.judge(rows_of(texts)).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_counts(t)
        assert tuple(r[c] for c in quality_rules.COUNTS) == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"]) and r["kept"] == (not failed and r["quality"] >= quality_rules.KEEP)
    k = len(odd) + 2
    assert not any(got[i]["kept"] for i in range(k, k + 3)) and all(got[i]["kept"] for i in range(k + 3, len(texts)))
    docs = rows_of(texts)
    kept = quality_rules.kept_rows(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in got if got[i]["kept"]}
    assert quality_rules.judge(docs.where("doc_id < 0")).count() == 0


def test_estimate_finds_accuracies():
    """Rules that vote against rarely among good texts: their rates and the share of good texts come out."""
    rng = random.Random(6)
    against = ((0.01, 0.7), (0.03, 0.6), (0.08, 0.5), (0.02, 0.4))
    rows = Counter()
    for _ in range(6000):
        good = rng.random() < 0.85
        rows[tuple(-1 if rng.random() < (a if good else b) else 0 if rng.random() < 0.1 else 1 for a, b in against)] += 1
    share, rates = quality_rules.estimate(sorted(rows.items()), 4)
    assert abs(share - 0.85) < 0.08
    assert all(abs(r[-1][0] - a) < 0.03 and r[-1][1] > 4 * r[-1][0] for r, (a, b) in zip(rates, against))


def brute_url(url, rules=url_filter.STATED):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.split(r"[/?#]", rest, maxsplit=1)[0] if rest is not None else ""
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0] if rest is not None else ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=lambda x: len(x[1]), default=None)


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x?q#f", "https://example.net/en", "http://x.example.com/de/1", "ftp://org/fr/", "http://a.org/fr/x", "http://net", "http://net/", "http://É.net/", "http://a?b/c", "http://a.b#/net/", "x\n://q.net/\n/z", "http://" + "a" * 50_000 + ".net/" + "b/" * 9000]
    urls += [f"http://{'spam' if i % 2 else 'fine'}.example.dev/p/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1, 0) for i in range(200)] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, labels).collect()}
    for i, u in enumerate(urls):
        host, path, rule = brute_url(u)
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[1] if rule else None)
        if rule:
            assert r["verdict"] == rule[0]
        elif u and "spam" in u:
            assert r["verdict"] == "block" and "spam" in r["evidence"]
        else:
            assert r["verdict"] == "allow"
    assert {r["verdict"] for r in url_filter.judge(pages, labels.where("doc_id < 0")).where("rule is null").collect()} == {"allow"}


def brute_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near-duplicates", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).persist()
        assert after.columns == docs.columns
        gone = {r["doc_id"] for r in before.select("doc_id").collect()} - {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "toxicity":
            assert gone and all(labels[i]["toxic"] == 1 for i in gone if i in labels)
        if name == "quality rules":
            assert gone and sum(labels[i]["quality"] == 0 for i in gone if i in labels) >= 0.5 * sum(i in labels for i in gone)
        if name == "near-duplicates":
            sets = {r["doc_id"]: brute_shingles(r["text"]) for r in before.collect()}
            want = classes(sorted(sets), lambda a, b: sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
            assert {r["doc_id"] for r in after.collect()} == set(want.values())
        before = after
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)

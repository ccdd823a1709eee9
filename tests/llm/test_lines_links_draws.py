"""Operators 11 to 13 against brute force: line dedup, cross-tokenizer alignment, importance resampling."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilspark.llm import alignment, importance, line_dedup
from veilspark.llm.queries import vocabulary

LOWER = {i: i + 32 for i in range(65, 91)}


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute_lines(texts, min_docs=10, min_chars=1, keep_first=False):
    count = collections.Counter(k for t in texts for k in {line_key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    seen, out = set(), []
    for t in texts:
        kept, lines = [], (t or "").split("\n")
        for x in lines:
            k = line_key(x)
            if count.get(k, 0) < min_docs or (keep_first and k not in seen):
                kept.append(x)
            seen.add(k)
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_texts():
    rng = random.Random(4)
    common = ["Home | About", "  all rights reserved\t", "é漢 Ünï", "x"]
    texts = ["\n".join(rng.choice([rng.choice(common).upper() if rng.random() < 0.3 else rng.choice(common), f"own {rng.randrange(40)}", "", f"line {rng.random()}"]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    return texts + ["hot line"] * 60 + ["Hot Line \r\nand more\n\nhot line"] * 5


@pytest.mark.parametrize("keep_first,min_docs,min_chars", [(False, 10, 1), (True, 10, 1), (True, 1, 1), (False, 3, 5)])
def test_lines_equal_brute_force(rows_of, odd, keep_first, min_docs, min_chars):
    texts = [*odd, *odd, *line_texts()]
    docs = rows_of(texts).coalesce(1).sortWithinPartitions("doc_id")
    got = {r["doc_id"]: r for r in line_dedup.digest(docs, min_docs, min_chars, keep_first).collect()}
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs, min_docs, min_chars, keep_first).collect()}
    for i, (n, gone, text) in enumerate(brute_lines(texts, min_docs, min_chars, keep_first)):
        assert (got[i]["n_lines"], got[i]["n_dropped"], kept[i]) == (n, gone, text)
        assert got[i]["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_a_line_of_all_documents_lies_over_many_ranges(spark):
    """Runs that are cut over ranges settle as whole ones do, whatever the number of ranges."""
    texts = [f"the same\nown {i}\nsome {i // 9}\nten {i // 10}" for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for keep_first in (False, True):
                got = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(docs, keep_first=keep_first).collect()}
                assert [got[i] for i in range(400)] == [t for _, _, t in brute_lines(texts, keep_first=keep_first)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_draw(ids, texts, target):
    runs = lambda t: [zlib.crc32(x.encode()) % 10000 for w in [words_of(t)] for x in [*w, *map(" ".join, zip(w, w[1:]))]]
    own = [runs(t) for t in texts]
    s, t = collections.Counter(x for f in own for x in f), collections.Counter(x for b in target for x in runs(b))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    rows = []
    for i, f, x in zip(ids, own, texts):
        weight = math.floor(sum(map(gain, f)) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(x)) >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for n, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = n + 1
    return [tuple(r[:5]) for r in rows]


def draw_texts():
    rng = random.Random(8)
    vocabulary = [rng.choice(["Wörter", "words", "漢", "X1"]) + str(i) for i in range(300)]
    target = [" ".join(rng.choices(vocabulary[:60], k=25)) for _ in range(8)] + [None, ""]
    texts = [" ".join(rng.choices(vocabulary[: rng.choice([60, 300])], k=rng.choice([5, 19, 20, 21, 80]))) for _ in range(300)]
    return texts, target


def by_row(rows):
    return sorted(map(repr, rows))


def test_draw_equals_brute_force(spark, odd):
    texts, target = draw_texts()
    texts = [*odd, *texts]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    docs = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    got = [tuple(r) for r in importance.resample(docs, bench).collect()]
    want = brute_draw([i * 3 for i in range(len(texts))], texts, target)
    assert by_row(got) == by_row(want) and max(r[4] or 0 for r in got) > 30
    none = importance.resample(docs, bench.where("item_id < 0")).collect()
    assert by_row(map(tuple, none)) == by_row(brute_draw([i * 3 for i in range(len(texts))], texts, []))
    assert importance.resample(docs.where("doc_id < 0"), bench).count() == 0


def test_draw_of_ties_null_and_repeated_ids(spark):
    texts, target = draw_texts()
    long = [t for t in texts if len(t.split()) >= 20][:40]
    ids = [None] * 60 + [5] * 40 + list(range(10, 110))
    texts = [long[0]] * 60 + [long[1]] * 20 + [long[2]] * 20 + [long[i % 40] for i in range(100)]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4), bench).collect()
    assert by_row(map(tuple, got)) == by_row(brute_draw(ids, texts, target))
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51))


def spelled():
    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def brute_links(texts):
    a, b = spelled()
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {chr(x): x for x in seen} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in seen)}
    ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    rows = []
    for t in texts:
        row = None
        if t:
            e = a.encode(" " + t, add_special_tokens=False)
            one = [bytes(letter[c] for c in x) for x in e.tokens]
            ids = b.encode(t)
            two = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids)]
            if b"".join(one) == b"".join(two) == (" " + t).encode():
                ea, eb = ends(one), ends(two)
                overlap = lambda i, j: max(ea[i] - len(one[i]), eb[j] - len(two[j])) < min(ea[i], eb[j])
                links = [(e.ids[i], ids[j]) for i in range(len(one)) for j in range(len(two)) if overlap(i, j)]
                common, text, before = sorted(set(ea) & set(eb)), [], 0
                for c in common:
                    text.append("|".join(",".join(str(x) for x, end in zip(xs, es) if before < end <= c) for xs, es in ((e.ids, ea), (ids, eb))))
                    before = c
                row = (len(one), len(two), len(common), links, hashlib.sha256(";".join(text).encode()).hexdigest())
        rows.append(row)
    count = collections.Counter(p for r in rows if r for p in set(r[3]))
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(count[p] == best[p[0]] for p in r[3]), sum(count[p] for p in r[3]), r[4]) for r in rows]


def link_texts(odd):
    rng = random.Random(6)
    alphabet = ["the", " ", "  ", "\n", "é", "漢字", "😀", "'s", "1234", "<s>", "<|endoftext|>", "▁", "<0x41>", "\t", "Wort", "ing", "\x85", "　", "\r\n", "\x00", "ﬁ", "é"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return [*(t[:300] if t else t for t in odd), " ", "  a", "a  ", "the", *made]


@pytest.mark.parametrize("broadcast", [alignment.BROADCAST, 10])
def test_links_equal_brute_force(rows_of, odd, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST", broadcast)
    texts = link_texts(odd)
    found = alignment.digest(rows_of(texts), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.collect()}
    want = brute_links(texts)
    assert sum(w[0] > 0 for w in want) > 60 and any(w[0] == 0 and t for w, t in zip(want, texts))
    assert [got[i] for i in range(len(texts))] == want


def test_ids_are_those_of_the_libraries(rows_of, odd):
    texts = [*link_texts(odd), "a" + " " * 200_000 + "b", "\n" * 200_000, "x" * 200_000, "漢字" * 50_000]
    a, b = spelled()
    got = {r["doc_id"]: r for r in alignment.tokenised(rows_of(texts), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        if t and got[i]["a"]:
            assert got[i]["a"] == a.encode(" " + t, add_special_tokens=False).ids and got[i]["b"] == b.encode(t)


def test_links_need_no_function_of_elements(rows_of):
    """Functions of elements are evaluated one element at a time: alignment is whole arrays in the pass that makes the tokens."""
    found = alignment.aligned(rows_of(["the tokens, of both", None, ""]), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    assert "lambda" not in found._jdf.queryExecution().toString()
    a, b = spelled()
    rows = {r["doc_id"]: r for r in found.collect()}
    sides = [g.split("|") for g in rows[0]["groups"].split(";")]
    assert [int(x) for s in sides for x in s[0].split(",")] == a.encode(" the tokens, of both", add_special_tokens=False).ids
    assert [int(x) for s in sides for x in s[1].split(",")] == b.encode("the tokens, of both")
    assert rows[0]["n_groups"] == len(sides) and rows[0]["n_single"] == sum("," not in x + y for x, y in sides)
    assert [(rows[i]["n_a"], rows[i]["groups"], rows[i]["links"]) for i in (1, 2)] == [(0, "", [])] * 2


def test_empty_tables_have_no_rows(spark, rows_of):
    none = rows_of(["x"]).where("doc_id < 0")
    assert line_dedup.digest(none).count() == 0
    assert alignment.digest(none, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).count() == 0


def test_extra_columns_with_clashing_names(rows_of):
    docs = rows_of(["a\nb", None, "the words"]).withColumn("key", F.lit(1)).withColumn("keep", F.lit(2)).withColumn("links", F.lit(3)).withColumn("row", F.lit(4)).withColumn("a", F.lit(5)).withColumn("rank", F.lit(6)).withColumn("_line_row", F.lit(7))
    assert line_dedup.digest(docs).count() == 3 and importance.resample(docs, docs).count() == 3
    assert alignment.digest(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")).count() == 3

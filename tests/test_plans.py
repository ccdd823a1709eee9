"""Report, ledger, exports, policy pages and streams."""

import datetime as dt
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.operators import redact
from veilspark.operators.resolve import detect, exploded
from veilspark.plans import ledger, policy, report
from veilspark.schema import COST, Options
from veilspark.sources import exports, files
from veilspark.sources.versions import Versions
from veilspark.streaming import live


@pytest.fixture
def export_folder(tmp_path):
    tree = [{"conversation_id": "c1", "title": "Secret title", "create_time": 1_700_000_000, "mapping": {
        "z": {"id": "z", "message": None},
        "b": {"id": "b", "message": {"id": "m1", "author": {"role": "user"}, "create_time": 1_700_000_001.5, "content": {"content_type": "text", "parts": ["mail a@b.example.org", {"asset": 1}, "bye"]}}},
        "a": {"id": "a", "message": {"id": "m2", "author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["ok"]}}},
        "s": {"id": "s", "message": {"id": "m3", "author": {"role": "system"}, "content": {"content_type": "text", "parts": ["no"]}}}}}]
    turns = {"conversations": [{"uuid": "u1", "created_at": "2024-03-01T00:00:00Z", "chat_messages": [{"sender": "human", "text": " ", "content": [{"type": "text", "text": "my lawyer"}]}, {"uuid": "x", "sender": "assistant", "text": "hm"}]}]}
    activity = [{"products": ["Gemini Apps"], "title": "Prompted  hello there", "time": "2024-05-01T10:00:00Z", "titleUrl": "https://gemini.google.com/app/abc?x=1"}, {"products": ["Maps"], "title": "Prompted x", "time": "2024-05-01T10:00:00Z"}, {"products": ["Bard"], "title": "Visited y", "time": "2024-05-01T10:00:00Z"}]
    (tmp_path / "conversations.json").write_text(json.dumps(tree))
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.writestr("a/turns.json", json.dumps(turns))
        z.writestr("activity.json", json.dumps(activity))
        z.writestr("other.json", json.dumps({"x": 1}))
        z.writestr("conversations.json", json.dumps(tree))
    return str(tmp_path)


def test_exports(spark, export_folder):
    m = exports.parse_exports(exports.read_exports(spark, export_folder))
    got = {(r["provider"], r["conversation_id"], r["role"], r["text"]) for r in m.collect()}
    assert got == {("chatgpt", "c1", "user", "mail a@b.example.org\nbye"), ("chatgpt", "c1", "assistant", "ok"), ("claude", "claude:u1", "user", "my lawyer"), ("claude", "claude:u1", "assistant", "hm"), ("gemini", "gemini:https://gemini.google.com/app/abc", "user", "hello there")}
    times = {r["text"]: r["created_at"] for r in m.collect()}
    assert times["my lawyer"] == dt.datetime(2024, 3, 1) and times["ok"].year == 2023
    own = exports.ledger_messages(m).collect()
    assert {r["conversation_id"] for r in own} == {"c1", "u1", "abc"}
    assert {json.loads(r["content"])["uuid"] for r in exports.to_list_export(m).collect()} == {"c1", "claude:u1", "gemini:https://gemini.google.com/app/abc"}
    d = detect(report.users(m))
    hit = report.hits(d)
    assert {(r["category"], r["conversations"]) for r in report.counts_by_type(hit).collect()} == {("EMAIL", 1), ("LEGAL", 1)}
    s = report.summary(m, hit).first()
    assert s["conversations"] == 3 and s["messages"] == 3 and s["findings"] == 1 and s["risk"] == 8 and s["activity_based"] and s["privacy_score"] == 43
    top = report.riskiest(hit, d).collect()
    assert [r["risk_score"] for r in top] == [5, 3]
    assert "Secret title" not in str(top) and "a@b.example.org" not in str(top)
    months = [(r["month"], r["conversations"]) for r in report.timeline(m, hit).orderBy("month").collect()]
    assert months[0] == ("2023-11", 1) and ("2024-03", 1) in months and months[-1] == ("2024-05", 0) and len(months) == 7


def test_manifest(spark):
    rows = [("f", json.dumps({"data_files": [{"category": "conversations", "filename": "a", "export_url": u} for u in ("https://claude.ai/x", "http://claude.ai/x", "https://evil.example/claude.ai", "https://u@claude.ai/x")]}))]
    assert [r["url"] for r in exports.manifest_links(spark.createDataFrame(rows, "file string, content string")).collect()] == ["https://claude.ai/x"]


def test_redaction_is_undone_by_its_placeholders(spark):
    rows = [(1, "c", "a@b.example.org and c@d.example.org"), (2, "c", "again a@b.example.org"), (3, "d", "nothing"), (4, "d", "")]
    d = detect(spark.createDataFrame(rows, "seq long, conversation_id string, text string"))
    p = redact.allocate(exploded(d, "seq", "conversation_id"))
    got = {r["seq"]: r["text"] for r in redact.redact(d, p).collect()}
    assert got == {1: "person_1@b.example.org and person_2@d.example.org", 2: "again person_1@b.example.org", 3: "nothing", 4: ""}
    more = detect(spark.createDataFrame([(9, "c", "e@f.example.org")], "seq long, conversation_id string, text string"))
    again = redact.allocate(exploded(more, "seq", "conversation_id"), p)
    assert {r["placeholder"] for r in again.collect()} == {"person_1@b.example.org", "person_2@d.example.org", "person_3@f.example.org"}
    bad = spark.createDataFrame([("c", "EMAIL", "x", 1, "person_1@b.example.org")], "conversation_id string, type string, key string, n int, placeholder string")
    with pytest.raises(Exception, match="a placeholder would change"):
        redact.merged_placeholders(p, bad).collect()


def replay(events, now):
    """The score by walking every day."""
    day = lambda t: (t - dt.datetime(1970, 1, 1)).days
    events = sorted(e for e in events if e[0] <= now)
    today = day(now)
    first, score, out = (day(events[0][0]) if events else today), 100, {}
    for d in range(min(first, today - 29), today + 1):
        leaked = False
        for _, _, type_, action in (e for e in events if day(e[0]) == d):
            if action == "as_is":
                score, leaked = max(0, score - COST[type_]), True
        if first < d < today and not leaked:
            score = min(100, score + 2)
        out[d] = score
    return [out[d] for d in range(today - 29, today + 1)]


def test_score_replay(spark):
    rng = random.Random(3)
    now = dt.datetime(2024, 3, 1, 12)
    rows = [(i, rng.randrange(6), now - dt.timedelta(minutes=rng.randrange(60 * 24 * 90)), rng.choice(list(COST)), rng.choice(["as_is", "renamed", "allowlisted"])) for i in range(160)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, type string, action string")
    got: dict = {}
    for r in ledger.score_replay(df, "2024-03-01 12:00:00").orderBy("user_id", "date").collect():
        got.setdefault(r["user_id"], []).append(r["score"])
    for u in range(6):
        assert got[u] == replay([(r[2], r[0], r[3], r[4]) for r in rows if r[1] == u], now)


def limited(times, limit, seconds):
    start, n, out = None, 0, []
    for t in times:
        if start is None or t >= start + seconds:
            start, n = t, 0
        n += 1
        out.append(n > limit)
    return out


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(5)
    base = dt.datetime(2024, 1, 1)
    rows = [(f"k{i % 3}", i, base + dt.timedelta(seconds=s)) for i, s in enumerate(sorted(rng.sample(range(600), 90)))]
    df = spark.createDataFrame(rows, "key string, event_id long, ts timestamp")
    want = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        want |= dict(zip([r[1] for r in mine], limited([(r[2] - base).seconds for r in mine], 4, 60)))
    assert {r["event_id"]: r["denied"] for r in ledger.rate_limited(df, 4).collect()} == want
    df.withColumnRenamed("event_id", "request_id").orderBy("ts").repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, request_id long, ts timestamp").parquet(str(tmp_path / "in"))
    out = live.run_available(live.rate_limits(stream, 4), "limits", str(tmp_path / "cp"))
    assert {r["request_id"]: r["denied"] for r in out.collect()} == want


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    rows = [("d1", "draft", "c", "hi  there", 0, at(0)), ("d1", "bubble", "c", "hi there", 1, at(2)), ("d2", "draft", "c", "x", 0, at(0)), ("d2", "bubble", "c", "x", 1, at(20)), ("d3", "draft", "c", "y", 0, at(0)), ("d3", "edit", "c", "z", 0, at(1)), ("d3", "bubble", "c", "y", 1, at(2)), ("d4", "draft", "new", "w", 1, at(0)), ("d4", "bubble", "c9", "w", 2, at(3))]
    schema = "draft_id string, kind string, conversation string, text string, bubbles long, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sends"))
    sent = live.run_available(live.confirmed_sends(spark.readStream.schema(schema).parquet(str(tmp_path / "sends"))), "sends", str(tmp_path / "cp1"))
    assert {(r["draft_id"], r["conversation"], r["prompt"]) for r in sent.collect()} == {("d1", "c", "hi there"), ("d4", "c9", "w")}
    for name in ("a", "b"):
        spark.range(5).selectExpr("cast(id as string) id", "timestamp'2024-01-01' ts", "1L user_id", "'EMAIL' type", "'claude' site", "'typed' source", "'as_is' action").coalesce(1).write.parquet(str(tmp_path / f"events/{name}"))
    schema = "id string, ts timestamp, user_id long, type string, site string, source string, action string"
    stream = live.event_stream(spark, str(tmp_path / "events/*"), schema)
    ledger_rows = live.run_available(live.ledger_stream(stream), "ledger", str(tmp_path / "cp2"))
    assert ledger_rows.count() == 5
    totals = live.run_available(live.live_totals(live.ledger_stream(stream)), "totals", str(tmp_path / "cp3"), "complete")
    assert [tuple(r) for r in totals.collect()] == [(1, 5, 5, 0, 15)]
    target = str(tmp_path / "table")
    write = live.upsert(target, ["id"])
    batch = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    write(batch, 0)
    write(batch, 0)
    write(spark.createDataFrame([("b",), ("c",)], "id string"), 1)
    assert sorted(r["id"] for r in Versions(spark, target).read().collect()) == ["a", "b", "c"]


def test_cache_and_reviews(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("k", i, t + dt.timedelta(seconds=s)) for i, s in enumerate([0, 10, 86_500])]
    spark.createDataFrame(rows, "key string, request_id long, ts timestamp").write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema("key string, request_id long, ts timestamp").parquet(str(tmp_path / "r"))
    out = live.run_available(live.cached_answers(s, lambda k: k + "!"), "cache", str(tmp_path / "cp"))
    assert [tuple(r) for r in out.orderBy("request_id").collect()] == [("k", 0, "k!", True), ("k", 1, "k!", False), ("k", 2, "k!", True)]
    rows = [("t", 1, "open", t), ("t", 2, "open", t + dt.timedelta(seconds=5)), ("t", 2, "decide", t + dt.timedelta(seconds=700))]
    spark.createDataFrame(rows, "tab string, review_id long, kind string, ts timestamp").write.parquet(str(tmp_path / "v"))
    s = spark.readStream.schema("tab string, review_id long, kind string, ts timestamp").parquet(str(tmp_path / "v"))
    out = live.run_available(live.pending_reviews(s), "reviews", str(tmp_path / "cp2"))
    assert {(r["review_id"], r["outcome"]) for r in out.collect()} == {(1, "replaced"), (2, "expired")}


def test_ledger(spark):
    m = spark.createDataFrame([(i, "claude", "c1", "a  b " if i != 2 else "other", dt.datetime(2024, 1, 1 + i)) for i in range(3)] + [(9, "claude", "c1", "mail x@y.example.org", dt.datetime(2024, 1, 9))], "seq long, site string, conversation_id string, text string, ts timestamp")
    records = ledger.history_records(detect(m)).withColumn("epoch", F.lit("e"))
    assert records.select("id").distinct().count() == 4 and records.select("conversation").distinct().count() == 1
    assert ledger.merged(records, records, "e").count() == 4
    with pytest.raises(Exception, match="activity was reset"):
        ledger.merged(records, records.withColumn("epoch", F.lit("old")), "e").collect()
    s = ledger.activity_stats(records).first()
    assert (s["messages"], s["shared"], s["cost"], s["score"], s["counts"]) == (4, 1, 3, 97, {"EMAIL": 1})
    bad = records.withColumn("counts", F.expr("map('EMAIL', -1)"))
    assert ledger.validated(bad, strict=False).count() == 0
    for counts in ("map('EMAIL', -1)", "map('EMAIL', 10001)", "map('NO_TYPE', 1)"):
        wrong = records.withColumn("counts", F.expr(counts))
        assert ledger.validated(wrong, strict=False).count() == 0
        with pytest.raises(Exception, match="invalid activity record"):
            ledger.validated(wrong).collect()
    kept = ledger.validated(records.withColumn("counts", F.expr("map('EMAIL', 0, 'SSN', 10000)"))).collect()
    assert len(kept) == 4 and all(r["counts"] == {"SSN": 10000} for r in kept)
    assert ledger.merged(records, records, "e", most=4).count() == 4
    with pytest.raises(Exception, match="more than 3 records"):
        ledger.merged(records, records, "e", most=3).collect()


def test_pieces_by_brute_force(spark):
    def literal(text, size, overlap):
        """Every end is looked for from the right."""
        text, start, out = text.strip(), 0, []
        while text[start:]:
            end = next((e for e in range(start + size - 2, start + size // 2 - 1, -1) if text[e : e + 2] == "\n\n" and e > start), start + size) if start + size < len(text) else len(text)
            out.append(text[start:end].strip())
            start = len(text) if end >= len(text) else max(start + 1, end - overlap)
        return [p for p in out if p]

    rng = random.Random(11)
    texts = ["", None, " \n\n ", "\x85a\ufeff", *("".join(rng.choice(("\n\n", "\n", " ", "ä", "x" * 5)) for _ in range(n)) for n in (5, 40, 200, 900))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for size, overlap in ((50, 10), (30, 29), (7, 0)):
        got: dict = {}
        for r in policy.chunks(df, size, overlap).orderBy("i", "chunk").collect():
            got.setdefault(r["i"], []).append(r["chunk_text"])
        assert got == {i: want for i, t in enumerate(texts) if (want := literal(t or "", size, overlap))}


def test_policy(spark):
    text = "\n\n".join("abcdefghi " * 30 for _ in range(12))
    cut = lambda t: spark.createDataFrame([(t,)], "text string").select(policy.windows(F.col("text")).alias("p")).first()["p"]
    parts = cut(text)
    assert all(len(p) <= 1200 for p in parts) and parts[0] == text[: len(parts[0])]
    assert cut("x" * 3500)[1][:200] == cut("x" * 3500)[0][-200:] and [len(p) for p in cut("x" * 3500)] == [1200, 1200, 1200, 500]
    body = "<p>We keep chats for 30 days</p>, <a>really</a>" + "<p>More words here.</p>" * 30
    html = f"<html><head><title>T</title><script>var a='<p>no</p>'</script></head><nav>menu</nav><article>{body}</article></html>"
    title, clean = policy.readable(html)
    assert title == "T" and "menu" not in clean and "no" not in clean.split("More")[0].split() and clean.startswith("We keep chats for 30 days, really")
    assert policy.readable("<article>short</article>") is None and policy.readable("<p>no body</p>") is None
    pieces = spark.createDataFrame([("claude", "https://www.anthropic.com/a", "A", 0, "Chats are kept for thirty days."), ("claude", "https://www.anthropic.com/b", "B", 0, "Training by default can be turned off."), ("gemini", "https://g.google.com/", "C", 0, "Chats are kept.")], "tool_id string, source_url string, source_title string, chunk int, chunk_text string")
    postings = policy.index(pieces, ["source_url", "chunk"])
    asked = policy.tool_questions(spark.createDataFrame([("claude",)], "tool_id string"))
    found = policy.search(asked, postings, ["source_url", "chunk"])
    best = {r["question_id"]: r["source_url"] for r in found.where("rank = 1").collect()}
    assert best["retention"] == "https://www.anthropic.com/a" and best["training"] == "https://www.anthropic.com/b"
    full = policy.with_excerpts(found, pieces, ["source_url", "chunk"]).join(asked, ["question_id", "tool_id"])
    a = {r["question_id"]: r for r in policy.answered(full).collect()}
    assert a["retention"]["answer"] == "Chats are kept for thirty days." and a["retention"]["citations"][0]["url"] == "https://www.anthropic.com/a"


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.md").write_text("  ")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    (tmp_path / "d.pdf").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    got = {r["path"].rpartition("/")[2]: (r["status"], r["text"]) for r in files.extract(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.txt": ("ok", "hello"), "b.md": ("empty", None), "c.docx": ("error", None), "d.pdf": ("unsupported", None), "e.docx": ("ok", "one\ntwo")}


def test_scores_and_totals(spark):
    r = spark.createDataFrame([(10, 4, 60, ["EMAIL"])], "messages long, findings long, privacy_score long, categories array<string>")
    v = spark.createDataFrame([(2, 3, 15, ["EMAIL", "SSN"])], "prompts long, shared long, cost long, categories array<string>")
    assert tuple(report.dashboard_totals(r, v).first()) == (12, 7, 2, 45)
    i = spark.createDataFrame([(["a", "b"], 1, 5), (["b", "a"], 2, 6)], "providers array<string>, imported_at long, n long")
    assert [(x["id"], x["n"]) for x in report.import_summaries(i).collect()] == [("a+b", 6)]


def test_search_by_blocks_is_that_of_all_pairs(spark, monkeypatch):
    """Small blocks, null questions, equal pieces and equal scores: as from all pairs at once."""
    monkeypatch.setattr(policy, "PIECES", 7)
    monkeypatch.setattr(policy, "ASKED", 3)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    said = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pieces = [(i, rng.choice("xy"), said(4) if i % 3 else "w1 w2 w3") for i in range(60)] + [(None, "x", said(4))]
    asked = [(i, rng.choice("xyz"), said(3)) for i in range(20)] + [(21, "x", None), (22, "x", "")]
    rows = spark.createDataFrame(pieces, "id int, tool_id string, chunk_text string")
    postings = policy.index(rows, ["id"])
    questions = spark.createDataFrame(asked, "question_id int, tool_id string, question string")
    result = lambda df: sorted((r["question_id"], r["tool_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    got = result(policy.search(questions, postings, ["id"]))
    assert result(policy.search_pieces(questions, rows, ["id"])) == got
    weight = {(r["tool_id"], r["term"], r["id"]): r["weight"] for r in postings.collect()}
    want, pairs = [], {}
    for q, tool, text in asked:
        for term in set((text or "").split()):
            for (t, w, i), x in weight.items():
                if (t, w) == (tool, term):
                    pairs.setdefault((q, tool), {}).setdefault(i, 0)
                    pairs[q, tool][i] += x
    for (q, tool), of in pairs.items():
        best = sorted(of, key=lambda i: (-round(of[i], 6), i is not None, i))[: policy.TOP]
        want += [(q, tool, n + 1, i, round(of[i], 6)) for n, i in enumerate(best)]
    assert got == sorted(want) and len(got) > 40


def test_pages_are_cleaned_a_few_at_a_time():
    import pyarrow as pa

    class Pages:
        columns, schema = ["html"], {}
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    html = pa.RecordBatch.from_pydict({"html": [f"<main>{i} {'word ' * 100}</main>" if i % 7 else None for i in range(1000)]})
    made = list(policy.clean_pages(Pages())(iter([html])))
    assert max(b.num_rows for b in made) <= 256
    assert [t.split()[0] for b in made for t in b.column("text").to_pylist()] == [str(i) for i in range(1000) if i % 7]


def test_equal_texts_of_a_batch_are_scanned_once(monkeypatch):
    import pyarrow as pa

    from veilspark.operators import resolve as r

    scanned, made, held = [], r.Text, []
    monkeypatch.setattr(r, "Text", lambda x: scanned.append(x) or made(x))
    monkeypatch.setattr(r, "arrow_udf", lambda schema: lambda f: held.append(f) or type("U", (), {"asNondeterministic": lambda self: lambda c: c})())
    texts = ["write to a@b.example.org", None, "see my lawyer", "write to a@b.example.org", "", "see my lawyer", "write to c@b.example.org"]
    for settled in (True, False):
        scanned.clear()
        r.scanned(None, Options(), settled)
        got = held[-1](pa.array(texts)).to_pylist()
        assert sorted(scanned) == sorted({x for x in texts if x})
        assert [[f["value"] for f in x["found"]] for x in got] == [["a@b.example.org"], [], [], ["a@b.example.org"], [], [], ["c@b.example.org"]]
        assert [len(x["topics"]) for x in got] == [0, 0, 1, 0, 0, 1, 0]


def test_masks_are_not_made_where_nobody_reads_them(spark):
    """The chart of categories reads no mask; a conversation's messages are grouped once for the riskiest ones."""
    m = spark.createDataFrame([(i, f"c{i % 3}", None, "", f"write to u{i % 2}@b.example.org") for i in range(12)], "seq long, conversation_id string, created_at timestamp, conversation_url string, text string")
    hit = report.hits(detect(m))
    assert "••••••@" not in report.category_chart(hit)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["masked"], r["weight"]) for r in hit.collect()} == {("u••••••@b.example.org", 5)}
    plan = report.riskiest(hit, m)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") >= 2

"""Model entities, errors of exports, sinks, checks, SQL functions, the guard of questions, and timers of streams."""

import datetime as dt
import json
import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspark.functions import scalars as S
from veilspark.functions import sql
from veilspark.operators.ner import Mention, entities_of, mentions, widened, with_entities
from veilspark.operators.resolve import detect, exploded, full_over_fast
from veilspark.plans import checks, policy, report
from veilspark.schema import ENTITY_TYPES, Options, UserTerms, word_list
from veilspark.sources import exports, samples, sinks
from veilspark.streaming import live


def token(entity, word, score=0.9, index=None):
    return {"entity": entity, "word": word, "score": score, "index": index}


def test_tokens_become_entities():
    spans = lambda text, *tokens: [(m.kind, text[m.start : m.end], round(sum(m.scores) / len(m.scores), 3)) for m in mentions(text, list(tokens))]
    assert spans("Bindhu came", token("B-PER", "Bin", 0.9), token("I-PER", "##dh", 0.7), token("O", "##u", 0.1)) == [("PERSON", "Bindhu", 0.8)]
    assert spans("Ann and Bo", token("B-PER", "Ann"), token("O", "and"), token("I-PER", "Bo", 0.5)) == [("PERSON", "Ann", 0.9), ("PERSON", "Bo", 0.5)]
    assert spans("Ann Bo", token("B-PER", "Ann"), token("O", "missing"), token("I-PER", "Bo")) == [("PERSON", "Ann", 0.9), ("PERSON", "Bo", 0.9)]
    assert spans("Ann-Bo", token("B-PER", "Ann", 1.0, 1), token("I-PER", "Bo", 0.5, 2)) == [("PERSON", "Ann-Bo", 0.75)]
    assert spans("Ann Bo", token("B-PER", "Ann", 1.0, 1), token("I-PER", "Bo", 0.5, 4)) == [("PERSON", "Ann", 1.0), ("PERSON", "Bo", 0.5)]
    assert spans("the the Ann", token("O", "the"), token("O", "the"), token("B-PER", "Ann")) == [("PERSON", "Ann", 0.9)]


def test_entities_are_widened_joined_and_trimmed():
    wide = lambda text, *es, stop=frozenset(): [(text[e["start"] : e["end"]], round(e["score"], 3)) for e in widened(text, list(es), stop)]
    e = lambda a, b, score=0.9, kind="PERSON": Mention(kind, a, b, (score,))
    assert wide("Rohith's cat", e(0, 3)) == [("Rohith", 0.9)]
    assert wide("Ann2 x", e(0, 2)) == [("Ann", 0.9)]  # digits are no part of a word
    assert wide("Ann Bo", e(0, 3, 0.9), e(4, 6, 0.5)) == [("Ann Bo", 0.7)]
    assert wide("Ann  Bo", e(0, 3), e(5, 7)) == [("Ann", 0.9), ("Bo", 0.9)]
    assert wide("New York", e(0, 3, 0.9, "LOCATION"), e(4, 8, 0.5, "LOCATION")) == [("New", 0.9), ("York", 0.5)]
    assert wide("Hi, Ravi Iyer , dear", e(0, 20), stop=frozenset({"hi", "dear"})) == [("Ravi Iyer", 0.9)]
    assert wide("Hi", e(0, 2), stop=frozenset({"hi"})) == []
    assert wide("Hi. Ravi", e(0, 8), stop=frozenset({"hi"})) == [("Hi. Ravi", 0.9)]  # a full stop keeps it
    assert wide("dear hi dear", e(0, 12), stop=frozenset({"hi", "dear"})) == []
    assert wide("O’Neil-Smith’s", e(2, 6)) == [("O’Neil-Smith", 0.9)]


def test_pieces_of_words_are_glued():
    found = lambda text, *tokens: [(e["type"], text[e["start"] : e["end"]], round(e["score"], 3)) for e in entities_of(text, list(tokens))]
    assert found("Bindhu's Lima", token("O", "Bin"), token("B-PER", "##dh", 0.8), token("B-LOC", "##u", 0.1), token("B-LOC", "Lima", 0.6)) == [("PERSON", "Bindhu", 0.8), ("LOCATION", "Lima", 0.6)]
    assert found("Jean-Luc", token("B-PER", "Jean", 0.9), token("O", "-"), token("I-PER", "Luc", 0.7)) == [("PERSON", "Jean-Luc", 0.8)]
    assert found("a b", token("B-LOC", "##", 0.9), token("B-LOC", "zz", 0.9)) == []


def test_model_runs_over_chunks(spark):
    text = ("Nothing to see here. " * 90) + "Then Ravi Iyer came."
    df = spark.createDataFrame([(1, text), (2, None)], "seq long, text string")
    known = [token("B-PER", "Ravi", 0.99), token("I-PER", "Iyer", 0.99)]
    model = lambda parts: [known if "Ravi" in p else [] for p in parts]
    found = detect(with_entities(df, model), entities="entities")
    assert [(f["value"], text[f["start"] : f["end"]], f["source"]) for f in exploded(found, "seq").collect()] == [("Ravi Iyer", "Ravi Iyer", "ner")]


def test_exports_that_are_wrong(spark):
    made = lambda *contents: spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], "file string, content string")
    for content, message in (("{", exports.INVALID), ("[]", exports.INVALID), ('{"x": 1}', exports.INVALID), ('{"data_files": []}', exports.MANIFEST)):
        assert exports.parse_exports(made(content)).count() == 0
        with pytest.raises(Exception, match=message):
            exports.parse_exports(made(content), strict=True).collect()
    turns = json.dumps({"chat_messages": [{"sender": "human", "text": f"t{i}", "created_at": f"2024-01-0{9 - i}T00:00:00Z"} for i in range(3)], "uuid": "u"})
    messages = exports.parse_exports(made(turns, "{"), strict=True)
    assert [r["text"] for r in exports.ledger_messages(messages).collect()] == ["t2", "t1", "t0"]
    with pytest.raises(Exception, match="more than 2 messages"):
        exports.ledger_messages(messages, most=2).collect()
    with pytest.raises(Exception, match="too large to scan"):
        exports.ledger_messages(messages, longest=1).collect()
    links = made(json.dumps({"data_files": [{"category": "conversations", "filename": "a", "export_url": f"https://{h}/x"} for h in ("claude.ai", "files.claude.ai")]}))
    assert [r["url"] for r in exports.manifest_links(links).collect()] == ["https://claude.ai/x"]


def test_planted_categories_are_counted_and_nothing_gets_out(spark, tmp_path):
    messages = exports.parse_exports(samples.sample_export(spark))
    mine = report.users(messages)
    found = detect(mine)
    hit = report.hits(found)
    assert {r["category"]: r["conversations"] for r in report.counts_by_type(hit).collect()} == samples.COUNTS
    parts = {"counts": report.counts_by_type(hit), "riskiest": report.riskiest(hit, mine), "repeated": report.top_repeated(hit), "timeline": report.timeline(messages, hit), "summary": report.summary(messages, hit)}
    sinks.write_report(parts, str(tmp_path / "report"))
    written = "".join(p.read_text() for p in (tmp_path / "report").rglob("*.json"))
    assert '"category":"PERSON"' in written
    for private in ("robin.marlow@example.org", "Robin Marlow", "4111 1111", "A private title", "Harbor"):
        assert private not in written
    with pytest.raises(ValueError, match="would hold"):
        sinks.write_report({"found": found}, str(tmp_path / "report"))
    top = report.riskiest(hit, mine).select("conversation_id", "title")
    order = {r["conversation_id"]: i for i, r in enumerate(mine.groupBy("conversation_id").agg(F.min("seq").alias("s")).orderBy("s").collect(), 1)}
    assert all(r["title"] == f"Conversation {order[r['conversation_id']]}" for r in top.collect())


def test_timeline_is_filled_for_a_bounded_time(spark):
    m = spark.createDataFrame([(dt.datetime(1800, 1, 5),), (dt.datetime(1999, 1, 5),)], "created_at timestamp")
    hit = spark.createDataFrame([(dt.datetime(1998, 12, 1), "c")], "created_at timestamp, conversation_id string")
    months = [(r["month"], r["conversations"]) for r in report.timeline(m, hit).orderBy("month").collect()]
    assert len(months) == 1201 and months[0] == ("1800-01", 0) and months[-2:] == [("1899-12", 0), ("1998-12", 1)]


def test_tables_and_answers_are_replaced_whole(spark, tmp_path):
    table = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), table)
    sinks.replace_table(sinks.read_table(spark, table).where("id > 2"), table)  # reads what it replaces
    assert sorted(r["id"] for r in sinks.read_table(spark, table).collect()) == [3, 4] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(3).select(F.raise_error("no").alias("id")), table)
    assert sinks.read_table(spark, table).count() == 2
    rows = [(t, q, text, a, [("https://x.example/", "X")]) for t in ("claude", "gemini") for q, text in policy.QUESTIONS for a in ("SAMPLE text" if t == "gemini" else "They say so.",)]
    answers = spark.createDataFrame(rows, "tool_id string, question_id string, question string, answer string, citations array<struct<url:string,title:string>>")
    target = str(tmp_path / "answers")
    sinks.write_answers(answers, "2024-01-01", target)
    sinks.write_answers(answers.where("tool_id = 'gemini'"), "2024-02-01", target)
    assert {(r["tool_id"], r["answer"]) for r in sinks.read_answers(spark, target).collect()} == {("claude", "They say so.")}
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.json").write_text('{"tool_id": "claude", "answers": []}')
    with pytest.raises(Exception, match="stored answers"):
        sinks.read_answers(spark, str(tmp_path / "bad")).collect()
    sinks.write_redacted(spark.createDataFrame([("/x/notes.docx", "to person_1")], "path string, text string"), str(tmp_path / "red"))
    assert [p.read_text() for p in Path(tmp_path / "red").rglob("part-*")] == ["to person_1\n"] and (tmp_path / "red" / "file=notes-redacted.txt").exists()


def test_settings_and_checks(spark):
    o, sites = checks.settings({"userTerms": {"names": [" Ann ", "Ann", 3, ""], "emails": "x"}, "allowlist": ["a"], "enabledTypes": ["SSN", "EMAIL", "NO"], "sites": ["gemini", "other"]})
    assert o == Options(terms=UserTerms(names=("Ann",)), allowlist=("a",), types=("EMAIL", "SSN")) and sites == ("gemini",)
    assert checks.settings(None) == (Options(), ("chatgpt", "claude", "gemini"))
    urls = ["https://chatgpt.com/c/1", "https://CLAUDE.ai/", "http://claude.ai/", "https://x.claude.ai/", "no url", None]
    keys = ["map:chatgpt:a", "approved:gemini:b", "map:claude:", "map:claude:a:b", None, "map:chatgpt:x"]
    df = spark.createDataFrame(list(zip(range(6), urls, keys)), "i int, url string, key string").orderBy("i")
    got = df.select(checks.site_of(F.col("url")).alias("s"), checks.session_key_error(F.col("key"), F.col("url")).alias("e")).collect()
    assert [r["s"] for r in got] == ["chatgpt", "claude", None, None, None, None]
    assert [r["e"] for r in got] == [None, "wrong site", "invalid session key", "invalid session key", "invalid session key", None]
    good = {"version": 2, "since": None, "cost": 1.0, "prompts": 1.0, "conversations": 1.0, "findings": 0.0, "shared": 0.0, "protected": 0.0, "score": 100.0, "categories": ["EMAIL"]}
    cases = [(good, True), (good | {"version": 1}, False), (good | {"score": 101.0}, False), (good | {"cost": -1.0}, False), (good | {"prompts": math.nan}, False), (good | {"shared": None}, False), (good | {"categories": ["a"]}, False), (good | {"categories": [None]}, False), (good | {"categories": []}, True), (good | {"since": math.inf}, False)]
    schema = "struct<version:int,since:double,cost:double,prompts:double,conversations:double,findings:double,shared:double,protected:double,score:double,categories:array<string>>"
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], f"i int, s {schema}").select("i", checks.valid_stats(F.col("s")).alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in rows] == [ok for _, ok in cases]


def test_sql_functions_equal_the_columns(spark):
    sql.register(spark)
    values = ["", " Ab 12-34 ", "021000021", "000000000", "a@b.example", "sk-12345678", "12 Main St", "10.0.0.9", "ünïcode "]
    df = spark.createDataFrame([(t, v) for t in ENTITY_TYPES for v in values], "type string, value string")
    t, v = F.col("type"), F.col("value")
    got = df.select(S.normalize_key(t, v).alias("a"), F.expr("normalize_key(type, value)").alias("a2"), S.mask_value(t, v).alias("b"), F.expr("mask_value(type, value)").alias("b2"), S.shannon_entropy(v).alias("c"), F.expr("shannon_entropy(value)").alias("c2"), S.aba(v).alias("d"), F.expr("aba_check(value)").alias("d2"))
    assert got.where("not (a <=> a2 and b <=> b2 and round(c, 9) <=> round(c2, 9) and d <=> d2)").count() == 0


def test_questions_are_guarded(spark):
    q = spark.createDataFrame([(1, "How long do you keep a@b.example.org?"), (2, "How long?"), (3, None)], "id long, question string")
    assert [(r["blocked"], r["safe_question"]) for r in policy.guarded(q).orderBy("id").collect()] == [(True, None), (False, "How long?"), (False, "")]
    assert [r["safe_question"] for r in policy.guarded(q, replace=True).orderBy("id").collect()] == ["How long do you keep person_1@b.example.org?", "How long?", ""]


def test_a_failed_call_is_made_again(spark):
    asked = spark.createDataFrame([("q", "claude", "How?", [(1, "https://a.example/", "A", "They keep it.")])], "question_id string, tool_id string, question string, excerpts array<struct<rank:int,source_url:string,source_title:string,chunk_text:string>>").coalesce(1)

    def flaky(fail):
        calls = []

        def complete(prompts):
            calls.append(1)
            if len(calls) <= fail:
                raise OSError("busy")
            return policy.extractive(prompts)

        return complete

    assert policy.answered(asked, flaky(1), kind="ask").first()["answer"] == "They keep it."
    with pytest.raises(Exception, match="busy"):
        policy.answered(asked, flaky(2)).collect()
    r = spark.createDataFrame([("claude", "How long?", ["EMAIL"], "x" * 9000), ("claude", "How long?", ["NO"], ""), ("claude", "How long?", [], "")], "tool_id string, question string, categories array<string>, body string")
    assert [x["error"] for x in policy.request_errors(r).collect()] == ["too large", "unknown category", None]


def test_slow_results_come_too_late(spark):
    fast = spark.createDataFrame([(i, "fast", 0) for i in range(3)], "seq long, findings string, topics int")
    full = spark.createDataFrame([(0, "full", 1, 900), (1, "full", 1, 1501)], "seq long, findings string, topics int, took int")
    assert [r["findings"] for r in full_over_fast(fast, full, ["seq"], 1500).orderBy("seq").collect()] == ["full", "fast", "fast"]


def test_word_lists_are_read(spark, tmp_path):
    (tmp_path / "w.txt").write_text("The and\nand  OR\n\n")
    assert word_list(spark, str(tmp_path / "w.txt")) == {"the", "and", "or"}
    with pytest.raises(ValueError):
        word_list(spark, str(tmp_path / "w.txt"), 2)


def test_reviews_end_by_the_streams_own_time(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "tab string, review_id long, kind string, ts timestamp"
    for i, row in enumerate([("t", 1, "open", t), ("other", 2, "open", t + dt.timedelta(hours=2)), ("other", 2, "decide", t + dt.timedelta(hours=2, seconds=1))]):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    out = live.run_available(live.pending_reviews(s, late="1 minute"), "ended", str(tmp_path / "cp"))
    assert {(r["tab"], r["review_id"], r["outcome"]) for r in out.collect()} == {("t", 1, "expired"), ("other", 2, "decided")}


def test_readers_see_the_last_commit(spark, tmp_path):
    from veilspark.sources.versions import Versions

    path, t = tmp_path / "t", Versions(spark, str(tmp_path / "t"))
    assert t.read() is None and t.read("id long").count() == 0
    assert t.append(spark.range(3), ("s", 0)) and not t.append(spark.range(9), ("s", 0)) and t.append(spark.range(3, 5), ("s", 1))
    held = t.read()
    spark.range(99).write.parquet(str(path / "part-killed"))  # a write that was killed before its commit
    (path / "_commits" / f"{3:012d}").write_text('{"parts": ["part-ki')  # or in it
    assert sorted(r["id"] for r in t.read().collect()) == [0, 1, 2, 3, 4]
    t.replace(t.read().where("id > 3"))
    assert [r["id"] for r in t.read().collect()] == [4] and held.count() == 5  # who reads the old version still can
    with pytest.raises(Exception):  # another writer was there first
        t._committed(3, [], {})
    t.append(spark.range(10), ("s", 2))
    t.compact(lambda rows: rows.where("id % 2 = 0"))
    t.vacuum()
    assert t.read().count() == 6 and len([p for p in path.iterdir() if p.name.startswith("part-")]) == 3


def test_ledger_tables_add_once_and_stay_within_a_cap(spark, tmp_path):
    from veilspark.sources.versions import Versions

    target = str(tmp_path / "ledger")
    rows = lambda a, b: spark.range(a, b).selectExpr("cast(id as string) id", "timestamp_seconds(id) ts")
    for batch_id in (0, 0, 1):
        live.appended(target, "ledger")(rows(batch_id * 10, batch_id * 10 + 10), batch_id)
    assert Versions(spark, target).read().count() == 20
    live.compacted(spark, target, 5)
    assert sorted(int(r["id"]) for r in Versions(spark, target).read().collect()) == [15, 16, 17, 18, 19]


def test_stale_results_are_dropped(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "editor string, kind string, version long, findings string, ts timestamp"
    rows = [("e", "edit", 1, None), ("e", "result", 1, "a"), ("e", "edit", 3, None), ("e", "result", 2, "old"), ("e", "result", 3, "b"), ("f", "result", 0, "c")]
    spark.createDataFrame([(*r, t + dt.timedelta(seconds=i)) for i, r in enumerate(rows)], schema).write.parquet(str(tmp_path / "in"))
    out = live.run_available(live.fresh_results(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "fresh", str(tmp_path / "cp"))
    assert {(r["editor"], r["findings"]) for r in out.collect()} == {("e", "a"), ("e", "b"), ("f", "c")}


class Fake:
    """A service with a clock of its own: prompts are done after some seconds, fail some times, or never end."""

    def __init__(self, seconds, fails=(), never=()):
        self.now, self.seconds, self.fails, self.never = 0.0, seconds, list(fails), never
        self.calls, self.most, self.open = [], 0, set()

    def clock(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds

    def submit(self, prompt):
        self.calls.append(prompt)
        ticket = (prompt, len(self.calls), self.now + self.seconds)
        self.open.add(ticket)
        self.most = max(self.most, len({t for t in self.open if t[0] not in self.never}))
        return ticket

    def poll(self, ticket):
        if ticket[0] in self.never or self.now < ticket[2]:
            return None
        self.open.discard(ticket)
        if ticket[0] in self.fails:
            self.fails.remove(ticket[0])
            raise OSError("busy")
        return ticket[0].upper()


def test_completions_are_bounded_and_tried_again():
    run = lambda fake, prompts, **more: policy.completions(prompts, fake, clock=fake.clock, sleep=fake.sleep, **more)
    fake = Fake(1.0)
    assert run(fake, [f"p{i % 10}" for i in range(30)], at_once=3) == {f"p{i}": f"P{i}" for i in range(10)}
    assert sorted(fake.calls) == sorted({f"p{i}" for i in range(10)}) and fake.most == 3 and fake.now < 6
    fake = Fake(1.0, fails=["b"])
    assert run(fake, ["a", "b"]) == {"a": "A", "b": "B"} and fake.calls.count("b") == 2
    with pytest.raises(OSError, match="busy"):
        run(Fake(1.0, fails=["b", "b"]), ["a", "b"])
    fake = Fake(1.0, never=("c",))
    with pytest.raises(TimeoutError):
        run(fake, ["c", "d"])
    assert fake.calls.count("c") == 2 and 40 <= fake.now < 42
    assert run(Fake(0.0), []) == {}

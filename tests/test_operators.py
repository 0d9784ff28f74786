"""Operators on small inputs: requests, stores, registry, sinks and sources."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.functions import fixed, kernels, registry
from textloom.functions.text import scan
from textloom.operators import compress, conversations, govern, ingest, ledger, requests, retrieval, training
from textloom.sources import files

USERS = json.dumps([{"id": i, "name": f"user {i}", "email": f"u{i}@example.org", "active": True} for i in range(20)])


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- requests ---------------------------------------------------------------


def test_chat_requests(spark):
    body = {"model": "m", "messages": [{"role": "system", "content": USERS}, {"role": "user", "content": USERS, "name": "n"}, {"role": "user", "content": [{"type": "image"}]}, {"role": "assistant", "content": "ok"}]}
    df = frame(spark, [(1, json.dumps(body)), (2, "not json"), (3, None), (4, '{"messages": 5}'), (5, json.dumps({"messages": [{"role": "user", "content": "short"}]}))], "id int, body string")
    got = {r.id: r for r in requests.compress_requests(df).collect()}
    new = json.loads(got[1].body)
    assert new["messages"][0]["content"] == USERS and new["messages"][1]["content"].startswith("@csv") and new["messages"][1]["name"] == "n"
    assert new["messages"][2:] == body["messages"][2:] and new["model"] == "m"
    before, after = kernels.tokens(USERS), kernels.tokens(new["messages"][1]["content"])
    assert tuple(got[1])[2:] == (before, after, before - after, 1, round(after / before, 4), True)
    assert [got[i].body for i in (2, 3, 4)] == ["not json", None, '{"messages": 5}'] and all(tuple(got[i])[2:] == (0, 0, 0, 0, 1.0, False) for i in (2, 3, 4, 5))
    both = requests.compress_requests(df.where("id = 1"), system_too=True).first()
    assert both.blocks == 2 and json.loads(both.body)["messages"][0]["content"].startswith("@csv")
    assert requests.compress_requests(df.where("id = 1"), keep_cache=True).first().blocks == 0
    off = requests.compress_requests(df.where("id = 1"), enabled=False).first()
    assert json.loads(off.body) == body and tuple(off)[2:] == (0, 0, 0, 0, 1.0, False)
    with pytest.raises(ValueError):
        requests.compress_requests(df, "other")


def test_block_requests(spark):
    tool = {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": USERS}, {"type": "image", "data": "x" * 300}]}
    body = {"system": USERS, "messages": [{"role": "user", "content": USERS}, {"role": "user", "content": [{"type": "text", "text": "hi"}, tool]}]}
    df = frame(spark, [(json.dumps(body),)], "body string")
    got = requests.compress_requests(df, "blocks").first()
    new = json.loads(got.body)
    assert new["system"] == USERS and new["messages"][0]["content"].startswith("@csv") and got.blocks == 2
    assert new["messages"][1]["content"][1]["content"][0]["text"].startswith("@csv") and new["messages"][1]["content"][1]["content"][1] == tool["content"][1]
    last = json.loads(requests.compress_requests(df, "blocks", keep_cache=True, system_too=True).first().body)
    assert last["messages"][0]["content"] == USERS and last["system"] == USERS and last["messages"][1] == new["messages"][1]
    assert json.loads(requests.compress_requests(df, "blocks", system_too=True).first().body)["system"].startswith("@csv")


def test_instruction_and_completions(spark):
    df = frame(spark, [(100, 40, 60, 0.4), (0, 0, 0, 1.0)], "tokens_before long, tokens_after long, tokens_saved long, ratio double")
    cost = max(1, len(fixed.INSTRUCTION) // 4)
    assert [tuple(r) for r in requests.with_instruction(df).collect()] == [(100, 40 + cost, 60 - cost, round((40 + cost) / 100, 4), cost), (0, cost, -cost, 1.0, cost)]
    answers = ['{"usage": {"completion_tokens": 7}}', '{"usage": {"output_tokens": 9, "x": 1}}', '{"usage": {"completion_tokens": -2, "output_tokens": 3}}', '{"usage": [1]}', "x", None, '{"usage": {"completion_tokens": "8"}}']
    got = requests.completion_tokens(frame(spark, list(enumerate(answers)), "i int, answer string")).orderBy("i").collect()
    assert [r.output_tokens for r in got] == [7, 9, 3, 0, 0, 0, 0]


def test_redact_payloads(spark):
    key = "sk" + "-" + "a1" * 12
    body = {"model": "m", "messages": [{"content": f"my {key} and {key}", "n": 5, "list": ["a@b.org", None, True]}]}
    df = frame(spark, [(json.dumps(body),), (f"no json {key}",), (None,)], "body string")
    got = requests.redact_payloads(df, pii=True).collect()
    assert json.loads(got[0].body) == {"model": "m", "messages": [{"content": "my [REDACTED:openai_key] and [REDACTED:openai_key]", "n": 5, "list": ["[REDACTED:email]", None, True]}]}
    assert got[0].counts == {"openai_key": 2, "email": 1} and got[1].body == "no json [REDACTED:openai_key]" and got[2].body is None


# --- compression ------------------------------------------------------------


def test_one_pass_for_each_text(spark):
    """Detection, cleaning and compression stay out of the plan's expressions."""
    df = frame(spark, [("a",)], "text string")
    plan = compress.compress_blocks(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.lower().count("regexp_replace") == 0 == plan.count("RLIKE")
    plan = govern.redaction_counts(df, pii=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace") == 0


def test_types_agree_with_expressions(spark):
    from textloom.functions.text import is_code, is_logs

    texts = ["", " ", "[1, 2]", '{"a": ', "x = 1;\n}\n", "def f():\n  pass", "```py\nx```", "\n".join(f"2024-01-0{k} 10:00:00 INFO x" for k in range(1, 9)), "word\n" * 8, "INFO a\n" * 4 + "b\n" * 90, "const a\nlet b", "make: x\n" * 9]
    df = frame(spark, [(t,) for t in texts], "text string")
    rows = df.select("text", kernels.json_parses("text").alias("j"), is_logs(F.col("text")).alias("l"), is_code(F.col("text")).alias("c")).collect()
    by_rules = ["json" if r.j else "logs" if r.l else "code" if r.c else "text" for r in rows]
    assert by_rules == [kernels.detect(t) for t in texts] == [r.type for r in compress.with_type(df).collect()]
    assert {"json", "logs", "code", "text"} == set(by_rules)


def test_clean_agrees_with_expressions(spark):
    from textloom.functions.text import invisible

    flag = "\U0001f3f4\U000e0067\U000e0062\U000e0065\U000e006e\U000e0067\U000e007f"
    texts = ["plain", "a​b‍c", "x‮y⁩", f"{flag} and \U000e0041\U000e0042", "1 2 3", "️︁a"]
    df = frame(spark, [(t,) for t in texts], "text string")
    for code in (False, True):
        got = [tuple(r[0]) for r in df.select(invisible(F.col("text"), code, True)).collect()]
        assert got == [kernels.cleaned(t, code, True) for t in texts]
    found = df.select(scan(F.concat("text", F.lit(" pаypal"))).alias("x")).collect()
    assert [r.x.invisible for r in found][1] == 2 and all(r.x.mixed == ["pаypal"] for r in found)


def test_savings_measure_floor(spark):
    from textloom.plans.queries import savings_measure

    rows = {r.kind: r for r in savings_measure(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == 7 and rows[None].saved_percent >= 60
    assert rows[None].tokens_before == sum(r.tokens_before for k, r in rows.items() if k)


def test_word_dropping():
    assert kernels.tidy("a , b ; , c . . end") == "A, b, c. end"
    assert kernels.drop_words("", lambda w: []) == ""
    kept = kernels.drop_words("keep this , drop that .", lambda words: [1.0 if w in ("keep", "this") else 0.0 for w in words])
    assert kept == "Keep this,."
    half = kernels.drop_words("one three seven", lambda w: [float(len(x)) for x in w], target_ratio=0.34)
    assert half == "Three seven"


def test_json_in_text():
    assert kernels.json_in('so: {"a": [1]} done') == '{"a":[1]}'
    assert [kernels.json_in(t) for t in ("", "}{", "{x}", "none", "[1]")] == [None] * 5


def test_html_to_text():
    assert kernels.html_to_text("<script>x()</script><p>a &amp;\n b</p><STYLE>p{}</STYLE>c") == "a & b c"


def test_block_comments():
    code = "int a; /* x */ int b;\n/* one\n two\n three */ int c; // d\nint e; /* open\nstill */\n"
    assert kernels.compress_code(code, "c") == "int a;  int b;\n int c;\nint e;"


# --- stores -----------------------------------------------------------------


def test_originals_are_kept(spark, tmp_path):
    path = f"{tmp_path}/store"
    out = compress.compress_blocks(frame(spark, [(USERS,), ("short",)], "text string"))
    compress.save_originals(out, path, "2024-01-01 00:00:00")
    compress.save_originals(out, path, "2024-01-01 05:00:00")
    store = files.load_rows(spark, path, compress.STORE)
    assert store.count() == 1 and compress.retrieve(store, store.select("id"), "2024-01-01 10:00:00").first().original == USERS
    assert compress.store_info(store).first().original_chars == len(USERS)
    assert compress.cleanup(store, "2024-01-03 00:00:00").count() == 0


def test_chunk_store(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    retrieval.save_chunks(frame(spark, [(1, "a" * 1500), (2, "two")], "doc_id long, text string"), path, parts=2)
    retrieval.save_chunks(frame(spark, [(1, "one"), (3, "three")], "doc_id long, text string"), path, parts=2)
    assert sorted((r.doc_id, r.text) for r in retrieval.load_chunks(spark, path).collect()) == [(1, "one"), (2, "two"), (3, "three")]


def test_conversation_store(spark, tmp_path):
    path = f"{tmp_path}/conv"
    assert conversations.load_messages(spark, path).count() == 0
    rows = [(1, 0, "system", "s", "2024-01-01 00:00:00"), (1, 1, "user", "q" * 60, "2024-01-01 00:01:00"), (2, 0, "assistant", "a", "2024-01-02 00:00:00"), (3, 0, "user", None, "2024-01-01 00:00:30")]
    df = frame(spark, rows, "conv_id long, turn long, role string, text string, ts string")
    conversations.add_messages(df.where("conv_id < 3"), path)
    conversations.add_messages(df.where("conv_id = 3"), path)
    m = conversations.load_messages(spark, path)
    assert [(r.conv_id, r.title) for r in conversations.recent(m).collect()] == [(2, "New Conversation"), (1, "q" * 50 + "…"), (3, "")]
    one = frame(spark, [(1,)], "conv_id long")
    assert conversations.messages_of(m, one).count() == 2 and conversations.without(m, one).count() == 2


def test_ledger_files_and_dashboard(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    assert ledger.load(spark, path).count() == 0
    events = frame(spark, [("2024-01-01 01:00:00", "t", 100, 60, 40, 1), ("2024-01-02 01:00:00", "u", 10, 10, 0, 1)], "ts string, tool string, before long, after long, saved long, blocks long")
    ledger.append(events, path)
    got = ledger.load(spark, path)
    board = {r.section: json.loads(r.body) for r in ledger.dashboard(got, "2024-01-02", 3).collect()}
    assert board["lifetime"]["tokens_saved"] == 40 and board["lifetime"]["percent_saved"] == 36.4 and [d["tokens_saved"] for d in board["daily"]] == [0, 40, 0]
    assert board["by_tool"] == [{"key": "t", "tokens_before": 100, "tokens_after": 60, "tokens_saved": 40, "requests": 1}] and board["output_effect"]["verdict"] == "not enough data yet"
    ledger.clear(spark, path)
    assert ledger.load(spark, path).count() == 0
    assert spark.range(1).select(ledger.usd(F.lit(1200)).alias("x")).first().x == 0.0036


def test_audit_and_purge(spark, tmp_path):
    path = f"{tmp_path}/audit"
    govern.append_audit(frame(spark, [("2024-01-01 00:00:00", "a")], "ts string, what string"), path)
    govern.append_audit(frame(spark, [("2024-03-01 00:00:00", "b")], "ts string, what string"), path)
    audit = spark.read.parquet(path)
    store = frame(spark, [("2024-03-01 12:00:00",)], "stored_at string")
    active = frame(spark, [("2024-03-01 00:00:00",), ("2024-03-01 22:00:00",)], "last_active string")
    got = {r.kind: (r.removed, r.kept) for r in govern.purge(store, active, audit, "2024-03-01 22:30:00").collect()}
    assert got == {"originals": (0, 1), "sessions": (1, 1), "audit": (1, 1)}
    assert {r.kind: r.removed for r in govern.purge(store, active, audit, "2024-03-01 22:30:00", max_days=0).collect()}["audit"] == 0


def test_limiter(spark):
    rows = [("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:00:10"), ("a", 3, "2024-01-01 00:00:20"), ("a", 4, "2024-01-01 00:01:00"), ("b", 5, "2024-01-01 00:00:20")]
    events = frame(spark, rows, "client string, event_id long, ts string")
    got = {r.event_id: (r.allowed, r.retry_after) for r in govern.rate_limited(events, 2, 60).collect()}
    # 60 s after the first one its place is free again; the rejected one took none
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 41), 4: (True, 0), 5: (True, 0)}
    assert govern.limiter_stats(events, "2024-01-01 00:01:10", 2, 60).first().tracked_clients == 2
    assert govern.limiter_reset(events, frame(spark, [("a", "2024-01-01 00:00:15")], "client string, at string").withColumn("at", F.col("at").cast("timestamp"))).count() == 3


def test_encryption(spark):
    df, key = frame(spark, [("secret ü",), (None,), ("",)], "text string"), F.lit("k" * 32).cast("binary")
    sealed = govern.encrypted(df, "text", key)
    assert sealed.first().text != "secret ü" and govern.encrypted(df, "text", key).first().text != sealed.first().text
    assert [r.text for r in govern.decrypted(sealed, "text", key).collect()] == ["secret ü", None, ""]
    assert govern.decrypted(sealed, "text", F.lit("x" * 32).cast("binary")).first().text is None


# --- functions in SQL -------------------------------------------------------


def test_registry(spark):
    def fails(text):
        raise RuntimeError("no " + text)

    names = registry.register(spark, shout=lambda t: t.upper(), fails=fails)
    assert {"compress_json", "shout", "page_tables"} <= set(names)
    assert spark.sql("SELECT text_type('[1]'), shout('a'), fails('b'), json_found('x {\"a\":1}')").first()[:] == ("json", "A", "error: no b", '{"a":1}')
    rows = spark.sql("SELECT t.* FROM VALUES ('<table><tr><th>k</th></tr><tr><td>1</td></tr></table>') AS p(html), LATERAL page_tables(p.html) t").collect()
    assert [(r.table_no, r.headers, r.row) for r in rows] == [(0, ["k"], {"k": "1"})]


# --- training ---------------------------------------------------------------


@pytest.mark.parametrize("n, want", [(9, None), (10, 1), (57, 5), (2000, 200)])
def test_split_sizes(spark, n, want):
    got = training.split(spark.range(n), F.col("id").cast("string"))
    counts = {r.part: r["count"] for r in got.groupBy("part").count().collect()}
    assert counts == ({} if want is None else {"eval": want, "train": n - want})


def test_token_accuracy_and_drops(spark):
    df = frame(spark, [([1, 0, 1], [1, 1, -100]), ([], [])], "predicted array<int>, labels array<int>")
    assert training.token_accuracy(df).first()[0] == 0.5 and training.token_accuracy(df.limit(0)).first()[0] == 0.0
    labelled = frame(spark, [(1, [1, 1]), (2, [1, 0, 0, 1]), (3, [])], "doc_id int, labels array<int>")
    assert [(r.doc_id, r.dropped) for r in training.dropped_share(labelled).collect()] == [(2, 0.5)]


# --- sources ----------------------------------------------------------------


def test_docx(spark):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {ns}><w:body><w:p><w:r><w:t>One &amp; two</w:t><w:tab/><w:t>three</w:t></w:r></w:p><w:p/><w:p/><w:p/><w:p><w:r><w:t>four</w:t><w:br/><w:t>five</w:t></w:r></w:p></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    assert files.docx_text(data.getvalue()) == "One & two three\n\nfour\nfive"
    assert files.docx_text(b"no zip") == ""


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"id": 1, "t": "a"}')
    (tmp_path / "a" / "bad.json").write_text("{")
    assert [tuple(r) for r in files.json_objects(spark, f"{tmp_path}/a", "id int, t string").collect()] == [(1, "a")]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "t.md").write_text("short\n" + "  long line " * 9 + "\n\nlast")
    assert [r.text for r in files.corpus_lines(spark, f"{tmp_path}/b").collect()] == [("  long line " * 9).strip()]
    lines = [(r.line_no, r.line) for r in files.text_lines(spark, f"{tmp_path}/b").collect()]
    assert [n for n, _ in lines] == [1, 2, 4]
    cut = files.file_text(spark, f"{tmp_path}/b", 5).first()
    assert cut.text == "short" and cut.truncated
    (tmp_path / "b" / ".git").mkdir()
    (tmp_path / "b" / ".git" / "x").write_text("no")
    assert [r.path.rsplit("/", 1)[1] for r in files.file_list(spark, f"{tmp_path}/b").collect()] == ["t.md"]
    files.write_jsonl(frame(spark, [(1,)], "a int"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().a == 1
    for n in (1, 2):
        files.adopt(frame(spark, [(n,)], "a int"), f"{tmp_path}/adopted")
    assert spark.read.parquet(f"{tmp_path}/adopted").first().a == 1


def test_grep_strips_all_white_space(spark):
    got = retrieval.grep(frame(spark, [(1, "x\n\tLicense here \r\nz")], "doc_id long, text string"), "license").collect()
    assert [(r.line_no, r.line) for r in got] == [(2, "License here")]


def test_chunks_merge_paragraphs(spark):
    text = "\n\n".join("p" * 250 for _ in range(4)) + "\n \n" + "q" * 1300
    got = [r.text for r in retrieval.chunk_table(frame(spark, [(1, text)], "doc_id long, text string")).orderBy("chunk_no").collect()]
    assert got == ["p" * 250 + "\n" + "p" * 250] * 2 + ["q" * 600, "q" * 600, "q" * 100]


def test_page_kind(spark):
    df = frame(spark, [("text/html", "a", ""), (None, "x.PDF", ""), ("application/vnd.wordprocessingml", "", ""), ("", "y", "<HTML>"), (None, None, None)], "c string, p string, b string")
    assert [r[0] for r in df.select(ingest.page_kind(F.col("c"), F.col("p"), F.col("b"))).collect()] == ["html", "pdf", "docx", "html", "raw"]


def test_helper_columns_leave_callers_own(spark):
    """A caller's columns with the names that operators use inside stay as they are."""
    df = frame(spark, [(1, 1, "user", "some text", "a", "b", "c", "d")], "conv_id int, turn int, role string, text string, __r string, __digest string, __last string, __draw string")
    for rows in (compress.compress_blocks(df), compress.align_messages(df), compress.compress_messages(df, keep_cache=True), govern.redacted(df), training.split(df, F.col("conv_id"), least=1)):
        assert tuple(rows.select("__r", "__digest", "__last", "__draw").first()) == ("a", "b", "c", "d")
    body = frame(spark, [('{"a": "b"}', "own")], "body string, __r string")
    assert requests.compress_requests(body).first()["__r"] == requests.redact_payloads(body).first()["__r"] == "own"
    late = frame(spark, [(1, 0, "own")], "request_id int, output_tokens long, __late string")
    assert tuple(ledger.fill_output(late, frame(spark, [(1, 5)], "request_id int, output_tokens long")).first()) == (1, 5, "own")

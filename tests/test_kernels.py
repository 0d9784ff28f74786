"""Text rules on small cases."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from textloom.functions import kernels as k
from textloom.functions import kernels as k_
from textloom.functions.text import chunks, client_name, invisible
from textloom.operators import compress, govern, ingest, training
from textloom.sources.files import docx_text


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


def test_json():
    rows = [{"id": i, "name": f"n,{i}", "none": None, "only": True} for i in range(3)]
    rows[1]["more"] = "x"
    assert k.compress_json(json.dumps(rows)) == '@csv const(none=,only=true) cols=id,name extra(more=x)\n0,"n,0"\n1,"n,1"\n2,"n,2"'
    assert k.compress_json('{"a":null,"b":"","c":[],"d":{},"e":{"url":"u","v":1}}') == '{"e":{"v":1}}'
    assert k.compress_json(json.dumps({"s": "x" * 300})) == json.dumps({"s": "x" * 200 + "…<+100c>"}, ensure_ascii=False, separators=(",", ":"))
    assert k.compress_json('{"r":[{"a":1,"b":2},{"a":3,"b":4},{"a":5,"b":6}]}') == '{"r":{"k":["a","b"],"v":[[1,2],[3,4],[5,6]]}}'
    assert k.compress_json("[1,2]") == "[1,2]" and k.compress_json("not json") == "not json"
    assert k.parses(" [1] ") and not k.parses("[1] x") and not k.parses("1") and not k.parses("")


def test_logs():
    assert k.compress_logs("a\nb") == "a\nb"
    lines = [f"INFO step {i}" for i in range(40)] + ["ERROR broke"] + [f"INFO after {i}" for i in range(10)]
    out = k.compress_logs("\n".join(lines)).split("\n")
    assert out == ["INFO step 0 (x3)", "… 37 lines omitted …", "ERROR broke", "INFO after 0 (x2)", "… 5 lines omitted …", "INFO after 7 (x3)"]
    trace = ["start"] * 10 + ["Traceback (most recent call last):"] + [x for i in range(6) for x in (f'  File "f{i}.py", line {i}', f"    call{i}()")] + ["ValueError: bad exception"] + ["end"] * 10
    assert "call5()" in k.compress_logs("\n".join(trace))


def test_code():
    source = "import a\nimport b\nimport c\nimport d\n\ndef f():  # note\n    return 1\n"
    assert k.compress_code(source) == "# 4 imports collapsed\nimport a\nimport b\n# ... +2 more\ndef f():\n    return 1"
    java = "public class A {\n/* gone */ int x;\n/* long\ncomment */\nprivate int y; // no\n}"
    assert k.compress_code(java) == "public class A {\n int x;\nprivate int y;\n}"
    assert k.compress_code("see\n```py\nx = 1  # c\n```\nend") == "see\n```py\nx = 1\n```\nend"


def test_prose():
    assert k.compress_prose("Basically, in order to win, it is able to wait.") == "To win, it can wait."
    long = "this line is longer than twenty characters"
    assert k.compress_prose(f"{long}\n\n\n\n\n{long}\nshort\nshort") == f"{long.capitalize()}\n\nShort\nShort"
    assert k.compress_prose("A clean sentence.") == "A clean sentence."
    assert k.truncate_paragraphs("a. " * 400).startswith("a. [... ")


def test_invisible(spark):
    text = "a" + chr(0x200B) + "b" + chr(0x200D) + "c" + chr(0x202E) + "d" + chr(0xA0) + chr(0x435)
    got = one(spark, lambda c: invisible(c), text)
    assert (got["text"], got["invisible"], got["bidi"], got["nbsp"]) == ("ab" + chr(0x200D) + "cd" + chr(0xA0) + chr(0x435), 1, 1, 1)
    assert one(spark, lambda c: invisible(c, True, True), text)["text"] == "abcd " + chr(0x435)
    flag = "\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in "gbeng") + "\U000e007f"
    got = one(spark, lambda c: invisible(c), flag + "".join(chr(0xE0000 + ord(c)) for c in "run"))
    assert (got["text"], got["smuggled"]) == (flag, 3)
    assert k.mixed_script_words("pаypal paypal привет") == ["pаypal"]


def test_redact(spark):
    key = "sk" + "-" + "a1" * 12
    got = one(spark, k_.redaction(k_.redacted, True), f"key {key} and {key} from x@y.org at 10.1.2.3")
    assert got["text"] == "key [REDACTED:openai_key] and [REDACTED:openai_key] from [REDACTED:email] at [REDACTED:ipv4]"
    assert got["counts"] == {"openai_key": 2, "email": 1, "ipv4": 1}
    assert one(spark, k_.redaction(k_.redacted), "x@y.org")["counts"] == {}


def test_chunks(spark):
    got = one(spark, lambda c: chunks(c, 20), "one\n\ntwo words\n \nthree is long here\n\n" + "x" * 50)
    assert got == ["one\ntwo words", "three is long here", "x" * 20, "x" * 20, "x" * 10]
    assert one(spark, chunks, " \n ") == [] == one(spark, chunks, None)


def test_types_and_cases(spark):
    rows = [(1, '[{"a":1}]'), (2, "[42] starting"), (3, None), (4, ""), (5, "def f():\n    return 1"), (6, "\n".join(f"2024-01-01 00:00:0{i} INFO x" for i in range(9)))]
    df = spark.createDataFrame(rows, "id int, text string").withColumn("found", F.lit("clash")).drop("found")
    assert {r["id"]: r["type"] for r in compress.with_type(df).collect()} == {1: "json", 2: "text", 3: "text", 4: "text", 5: "code", 6: "logs"}
    out = {r["id"]: r for r in compress.compress_blocks(df).collect()}
    assert out[3]["compressed"] == "" and out[4]["tokens_before"] == 1 and out[3]["tokens_saved"] == 0
    assert compress.compress_blocks(df.limit(0)).count() == 0


def test_clients_and_policy(spark):
    assert one(spark, client_name, "Mozilla/5.0 Cursor/1") == "Cursor" and one(spark, client_name, "Own/2 x") == "Own" and one(spark, client_name, None) == ""
    df = spark.createDataFrame([("Big-Model", "text"), (None, "secret WORD"), ("m", None)], "model string, text string")
    assert [r["reason"] for r in govern.check_policy(df, "big", ["(", "secret\\s+word"]).collect()] == ["model: big", "pattern: secret\\s+word", None]


def test_pages(spark):
    page = '<table><tr><th>a<th>b</th></tr></table><table><tr><td>1</td><td>x &amp; y</td></tr><tr></tr></table>'
    assert k.tables(page)[-1] == {"table_no": 1, "headers": [], "rows": [{"0": "1", "1": "x & y"}]}
    assert k.links('<a href="/b#c"><a href=\'http://o.org/\'><a href="mailto:x">', "https://h.org/a") == ["https://h.org/b"]
    lines = spark.createDataFrame([("h", i, s) for i, s in enumerate(("User-agent: a", "Disallow: /x", "User-agent: *", "Disallow:", "disallow: /y"))], "host string, line_no int, line string")
    assert [r["path"] for r in ingest.robots_disallow(lines, "bot").collect()] == ["/y"]
    site = [(1, "http://h.org/a", '<p>' + "word " * 20 + '</p><a href="/b">'), (2, "http://h.org/b", '<a href="/c"><p>' + "more " * 20), (3, "http://h.org/c", "x"), (4, "http://h.org/d", "y" * 99)]
    got = ingest.crawl(spark.createDataFrame(site, "page_id long, url string, html string"), "http://h.org/a")
    assert [(r["url"], r["depth"]) for r in got.collect()] == [("http://h.org/a", 0), ("http://h.org/b", 1)]


def test_docx():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>one</w:t><w:tab/><w:t>two &amp; three</w:t></w:p><w:p><w:t>four</w:t></w:p></w:document>")
    assert docx_text(data.getvalue()) == "one two & three\nfour" and docx_text(b"no") == ""


def test_training(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (1, 4, "assistant", None), (2, 0, "assistant", "x")], "conv_id int, turn int, role string, text string")
    got = {(r["conv_id"], r["turn"]): (len(r["history"]), r["response"]) for r in training.training_pairs(df).collect()}
    assert got == {(1, 1): (1, "b"), (1, 4): (4, "")}
    pair = spark.createDataFrame([(1, "The cat saw the dog .", "the dog.")], "doc_id int, original string, compressed string")
    row = training.label_words(pair).first()
    assert row["words"] == ["The", "cat", "saw", "the", "dog", "."] and row["labels"] == [1, 0, 0, 0, 1, 1]

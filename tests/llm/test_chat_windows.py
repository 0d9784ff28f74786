import hashlib
import random
import re

import pytest

from textloom.llm import chat_windows as cw
from textloom.llm.word_tokens import public_path

SCHEMA = "conv_id long, turn long, role string, text string, segment int, kind string, nth int"
MODEL = public_path(cw.TOKENIZER)
BITS = ["[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>", "[TURN x]", "[/TURN]", "\\", "<", "[", "]", ">", "/", "INST]", "SYS>>", " ok ", "é日\n", "s>"]


def ordered(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", escape(r[3] or ""))
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    return {c: [(r[2] or "", r[3] or "") for r in sorted(own, key=key)] for c, own in convs.items()}


def escape(x):
    return re.sub(rf"([<\[])(\\*)({cw._REST})", r"\1\2\\\3", x)


def expected(rows):
    out = {}
    for c, turns in ordered(rows).items():
        loss = "".join(x for role, x in turns if role == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def some(n=60, seed=1):
    rng, rows = random.Random(seed), []
    for c in range(n):
        turns = rng.choice([1, 2, 5, 40]) if c else 400
        if c % 3:
            rows.append((c, 0, "system", "be brief " * rng.randrange(4)))
        for t in range(turns):
            text = "".join(rng.choices(BITS, k=rng.randrange(12))) if rng.random() < 0.5 else "word " * rng.randrange(60)
            rows.append((c, t + 1, ["user", "assistant", "tool ]+é", "assistant", None][rng.choice([0, 1, 0, 1, 2, 3, 4])], text))
    rows += [(None, 1, "user", "a"), (None, 2, "assistant", "b"), (77, 1, "user", None), (77, 1, "user", None), (78, None, "assistant", ""), (79, 5, "system", "late"), (79, 1, "user", "word " * 3000), (79, 2, "assistant", "answer " * 3000)]
    return rows


PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_query(spark, sf_tables):
    rows = some()
    got = cw.op13_chat_windows(spark, sf_tables(conversations=([(*r, 1, "x", 2) for r in rows], SCHEMA)))
    found = {r[0]: tuple(r)[1:] for r in got.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert {c: r[:4] for c, r in found.items()} == expected(rows + PLANTED)
    chars = {}
    for c, _, role, text in rows:
        chars[c] = chars.get(c, 0) + len(text or "")
    assert all(found[c][4] > n for c, n in chars.items())


def test_empty_table(spark, sf_tables):
    got = cw.op13_chat_windows(spark, sf_tables(conversations=([], SCHEMA))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_chars, r.formatted_chars) for r in got] == [(-7, 2, 21, len("<s>[INST]" + "<\\/s>[\\INST] ok [\\/INST]" * 2 + "[/INST]</s>"))]


def brute(turns, count, budget, history):
    """Windows of one conversation, in plain order: repeated turns and own ones, as texts and roles."""
    pieces = [(r, x, count(r, x)) for r, x in turns]
    before = [0]
    for *_, n in pieces:
        before.append(before[-1] + n)
    size = cw.SEGMENT * budget
    system = pieces[0] if pieces[0][0] == "system" else None
    out, own, used, segment = [], [], 0, 0
    for i, (role, text, n) in enumerate(pieces):
        if own and (before[i] // size != segment or used + n > budget):
            out[-1] = (*out[-1], own)
            own = []
        if not own:
            segment = before[i] // size
            used = 1 + (system[2] if system and i else 0)
            back, held = [], 0
            for j in range(i - 1, 0 if system else -1, -1):
                held += pieces[j][2]
                if held > history or used + n + pieces[j][2] > budget:
                    break
                back.append(j)
                used += pieces[j][2]
            out.append((int(bool(system and i)), len(back), i))
        own.append(i)
        used += n
    return [*out[:-1], (*out[-1], own)]


@pytest.mark.parametrize("budget, history, parts", [(60, 20, 3), (60, 0, 7), (200, 50, 1)])
def test_windows_against_brute_force(spark, monkeypatch, budget, history, parts):
    import sentencepiece

    monkeypatch.setattr(cw, "SEGMENT", 4)
    rows = [r for r in some(25, budget) if r[0] not in (77, 78)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = cw.windows(df, MODEL, budget, history).collect()
        back = {r.conv_id: tuple(r)[1:5] for r in cw.read_back(cw.windows(df, MODEL, budget, history)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert back == expected(rows)
    tokens = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    from urllib.parse import quote_plus

    def piece(role, x):
        x = escape(x)
        known = {"system": f"<<SYS>>{x}<</SYS>>", "user": f"[INST]{x}[/INST]", "assistant": f"{x}</s>"}
        return known.get(role) or f"[TURN {quote_plus(role, safe='*')}]{x}[/TURN]"

    for c, turns in ordered(rows).items():
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: (r.segment, r.window))
        want = brute(turns, lambda r, x: max(1, len(tokens.encode(piece(r, x)))), budget, history)
        assert [(r.n_system, r.n_history, r.first_turn, r.n_turns) for r in own] == [(s, h, i, len(o)) for s, h, i, o in want]
        for r, (s, h, i, o) in zip(own, want, strict=True):
            shown = ([turns[0]] if s else []) + turns[i - h : i] + [turns[k] for k in o]
            assert r.text == "<s>" + "".join(piece(*t) for t in shown) and cw.turns_of(r.text) == shown
            assert [r.text[x.start : x.start + x.length] for x in r.loss] == [escape(turns[k][1]) for k in o if turns[k][0] == "assistant"]
            assert r.over == (r.n_tokens > budget) and (not r.over or r.n_turns == 1 and r.n_history == 0)
    assert any(r.n_history for r in got) == (history > 0) and any(r.segment for r in got) and any(r.over for r in got)


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(14))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cw.escaped(cw.F.col("t")).alias("e")).collect()
    marks = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN ", "[/TURN]")
    assert all(cw.unescaped(r.e) == r.t and not any(m in r.e for m in marks) for r in got)
    assert len({r.e for r in got}) == len(set(texts))

import random
import re

import duckdb

from textloom.llm import license_scan as ls


def expected(docs):
    out = []
    for doc_id, text in docs:
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        words = [w for w in re.split(ls.NOT_WORD, low) if w]
        places = [(i, label) for p, label in ls.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        found = []
        for g in range(0, max(1, len(words)), ls.STRIDE):
            segment = words[g : g + ls.SEGMENT]
            for size in ls.SIZES:
                for at in range(0, min(ls.STRIDE, len(segment)), size):
                    have = set(segment[at : at + 2 * size])
                    for (label, *_), s, own, keys in zip(ls.TEMPLATES, ls.SETS, ls.BLOCK_SIZES, ls.KEYS, strict=True):
                        if own == size and 100 * len(have & set(s)) >= ls.PERCENT * len(s) and have.issuperset(keys):
                            found.append((label, len(have & set(s)) / len(s)))
        base = {x for _, x in places}
        at = [i for i, _ in places]
        score = 1.0 if at else max([0.0, *(s for _, s in found)])
        out.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), score))
    return out


def wrapped(text, width=9):
    """A text as licenses are set: a few words a line, behind a comment sign."""
    words = text.split()
    return "\n".join(" * " + " ".join(words[i : i + width]) for i in range(0, len(words), width))


def test_query(spark, sf_tables):
    rng = random.Random(5)
    sentences = [t for *_, t in ls.TEMPLATES]
    texts = [None, "", "MIT license mit LICENSE", "mit\nlicense", "Apache-License general public license", "İmit license K license", "long " * 3000 + "mit license", "license " * 5000]
    texts += sentences + [" ".join(t.split()[:-2]) for t in sentences] + [" ".join(reversed(t.split())) + "\nmore" for t in sentences]
    texts += [wrapped(t) for t in sentences]
    for t in sentences:  # at any place of a long text, with words lost
        words = [w for w in t.split() if rng.random() > 0.15]
        texts.append(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1200))) + " " + " ".join(words) + " end" * rng.randrange(400))
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (5, "mit license"), (5, "mit license")]
    sf = sf_tables(documents=([(*d, "clash") for d in docs], "doc_id long, text string, words string"))
    got = sorted(map(tuple, ls.op6_license_join(spark, sf).collect()), key=str)
    assert got == sorted(expected(docs), key=str)
    by_id = {r[0]: r for r in got}
    for k, (label, *_) in enumerate(ls.TEMPLATES):  # every sentence is found, whole and wrapped
        assert label in by_id[8 + k][6].split(",") and label in by_id[8 + 3 * len(sentences) + k][6].split(",")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    assert sorted(c.sql(ls.oracle()).fetchall(), key=str) == got


def test_each_filter_rejects_something_and_loses_nothing(spark):
    rng = random.Random(2)
    rows = []
    for t, own in enumerate(ls.SETS):
        for n in range(len(own)):
            words = rng.sample(own, n + 1) + [f"w{k}" for k in range(5)]
            rng.shuffle(words)
            rows.append((len(rows), " ".join(words[: 2 * ls.BLOCK_SIZES[t]])))
    docs = spark.createDataFrame(rows, "rid long, text string")
    texts = docs.select("rid", ls._segments(ls.words_of(docs.text)).alias("segments"))
    order, index, ranks = ls.inverted({w: rng.randrange(9) for w in ls.VOCABULARY})
    blocks = ls.blocks_with(texts, order, sorted({w for w, *_ in index})).cache()
    everything = blocks.count() * len(ls.TEMPLATES)
    met = ls.candidates(blocks, index).cache()
    longer = ls.candidates(blocks, [(w, r, t, 1) for w, r, t, _ in index])
    passed = ls.positional(met)
    assert everything > longer.count() > met.count() > passed.count() > ls.verified(passed, ranks, order).count() > 0
    assert ls.verified(met, ranks, order).exceptAll(ls.verified(passed, ranks, order)).count() == 0


def test_plan_is_native(spark, sf_tables):
    sf = sf_tables(documents=([(1, "a")], "doc_id long, text string"))
    plan = ls.op6_license_join(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_table(spark, sf_tables):
    assert ls.op6_license_join(spark, sf_tables(documents=([], "doc_id long, text string"))).collect() == []

import random

import corpus_pipeline
from textloom.llm import near_dedup, quality_rules, toxicity
from textloom.llm.common import table
from textloom.llm.packing import MAX_TOKENS

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark, tmp_path):
    docs = first = table(spark, SF, "documents")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs, before = spark.read.parquet(f"{tmp_path}/{name}"), docs
        if name != "packing":
            assert docs.schema == first.schema and docs.exceptAll(before).count() == 0
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    everything = {r["doc_id"] for r in first.select("doc_id").collect()}
    rules = {r["doc_id"] for r in quality_rules.judged(first, quality_rules.fit(first)).where("rules.kept").select("doc_id").collect()}
    assert kept[0] == rules < everything
    stage = spark.read.parquet(f"{tmp_path}/quality_rules")
    bad = toxicity.judged(stage, toxicity.learn(stage, table(spark, SF, "labels"))).where("toxicity.score >= 0.5")
    assert kept[1] == kept[0] - {r["doc_id"] for r in bad.select("doc_id").collect()} < kept[0]
    stage = spark.read.parquet(f"{tmp_path}/toxicity")
    groups = near_dedup.near_duplicates(stage).collect()
    assert kept[2] == {r["component_id"] for r in groups} < kept[1]
    assert kept[3] == kept[2]
    used = docs.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] < MAX_TOKENS for r in used) == 1 and max(r[1] for r in used) == MAX_TOKENS


def test_empty(spark, sf_tables):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    sf = sf_tables(documents=([], schema), labels=([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_cases_and_clashing_columns(spark, sf_tables):
    """Nulls, empties, repeated rows and ids, and columns named as the stages name theirs."""
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(60)) + "."
    texts = [prose() for _ in range(40)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [rows[3]] * 3 + [(5, texts[6], "en", "s"), (None, texts[7], None, None), (None, None, "en", "s"), (50, "", "en", None), (51, None, None, "s"), (52, texts[9] + " you idiot moron scum stupid idiot moron", "en", "s")]
    more = ["rules", "toxicity", "own_id", "least_row", "by_source", "model", "Kept", "h", "u"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in more)
    sf = sf_tables(documents=([(*r, len(r[1] or ""), *(f"{c}{k}" for c in more)) for k, r in enumerate(rows)], schema), labels=([], "doc_id long, quality int, toxic int"))
    docs = first = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        assert docs.columns == first.columns and docs.exceptAll(before).count() == 0, name
    kept = docs.collect()
    assert sorted(r.doc_id for r in kept) == sorted({*range(40)} - {6})  # 5 and 6 are one, null ids join their texts' classes, 52 is toxic
    again = {name: {tuple(r) for r in spark.read.parquet(f"{sf}/{name}").collect()} for name, _ in corpus_pipeline.STAGES[:-1]}
    assert len(again["near_dedup"]) == len(kept) < len(again["toxicity"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()} == {r.doc_id for r in kept}

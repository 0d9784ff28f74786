import numpy as np
import pyarrow as pa

from textloom.llm import quality_classifier as qc

SF = "/root/testdata/sf0.1"


def test_linear_time_identity():
    rng = np.random.default_rng(1)
    fm = qc.FactorisationMachine(0.3, rng.normal(size=qc.SIZE), rng.normal(size=(qc.SIZE, qc.RANK)))
    row, slot, value = qc.vectors(pa.array(["a few words, a few", None, "X%%% 12"]), pa.array([18, None, 7]))
    raw, _ = fm.raw(row, slot, value, 3)
    for i in range(3):
        s, x = slot[row == i], value[row == i]
        want = 0.3 + (fm.linear[s] * x).sum() + sum(fm.factors[s[a]] @ fm.factors[s[b]] * x[a] * x[b] for a in range(len(s)) for b in range(a))
        assert abs(raw[i] - want) < 1e-9


def test_held_out_accuracy(spark):
    got = qc.op7_factorisation_machine(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and quality is not null").select("quality", "predicted", "score").collect()
    assert len(got) > 300 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.quality == r.predicted for r in got) / len(got) > 0.97


def test_cases(spark, sf_tables):
    rows = [(1, None, None, "x"), (2, "", 0, "x"), (3, "long " * 30000, 5, "x"), (3, "b", 1, "x"), (None, "c", 1, "x")]
    sf = sf_tables(documents=(rows, "doc_id long, text string, n_chars long, quality_score string"), labels=([], "doc_id long, quality int, toxic int"))
    got = qc.op7_factorisation_machine(spark, sf).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert qc.scored(empty, qc.fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).collect() == []

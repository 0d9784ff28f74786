"""Queries against their SQL on the tables at hand: recall of op2 and op5 is 1 there."""

import duckdb
import pytest

from textloom.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(registry.oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))


def test_planted_copies_against_sql(spark, sf_tables):
    """The same for vectors that are linked, copied, repeated or unfit."""
    import numpy as np

    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 12))
    rows = [(i, (base[i % 40] + 0.12 * rng.normal(size=12)).tolist(), i % 2) for i in range(300)]
    rows += [rows[0], (7, rows[9][1], 1), (400, None, 1), (401, [0.0] * 12, 1), (402, [float("nan")] + [1.0] * 11, 1), (403, [1.0] * 5, 1), (None, rows[1][1], 1), (404, rows[2][1], None)]
    sf = sf_tables(embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet/*.parquet'")
    got = registry.queries()["op5_pca_tiles"](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(registry.oracle_sql()["op5_pca_tiles"]).select(*columns).fetchall()
    assert sum(r[columns.index("n_links")] for r in want) > 300
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, want))

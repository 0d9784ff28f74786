"""Every query against its DuckDB SQL; those without SQL against plain Python."""

import html
import re

import duckdb
import pytest

from textloom.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_main_text(spark, duck):
    def brute(x):
        x = re.sub(r"<(script|style|noscript|nav|header|footer|aside|form|svg|button|iframe|template)\b[^>]*>.*?</\1>", " ", x, flags=re.S | re.I)
        x = re.sub(r"<!--.*?-->", " ", x, flags=re.S)
        x = re.sub(r"<br\s*/?>|</(?:p|div|li|h[1-6]|section|article|tr|ul|ol|blockquote|pre)>", "\n", x, flags=re.I)
        x = re.sub(r"[ \t]+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x)))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", x)).strip()

    got = {r["page_id"]: r["n_chars"] for r in QUERIES["html_main_text"](spark, SF).collect()}
    assert got == {i: len(brute(h)) for i, h in duck.sql("SELECT page_id, html FROM pages").fetchall()}


def test_rate_limit_uses_up_nothing_on_rejection(spark, duck):
    got = {r["event_id"]: r["allowed"] for r in QUERIES["rate_limit_log"](spark, SF).collect()}
    taken, want = {}, {}
    for i, user, t in duck.sql("SELECT event_id, user_id, epoch_us(ts) / 1e6 FROM events ORDER BY ts, event_id").fetchall():
        own = [x for x in taken.get(user, []) if t - x < 86_400]
        want[i] = len(own) < 3
        taken[user] = [*own, t] if want[i] else own
    assert got == want and not all(want.values())

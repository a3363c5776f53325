"""Queries and their SQL over tables that tell their rules apart."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as e


def _both(spark, folder, name):
    """Rows of the query and of its SQL, over the Parquet tables of a folder."""
    c = duckdb.connect()
    for f in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = e.queries()[name](spark, str(folder))
    sql = c.execute(e.oracle_sql()[name])
    at = [[d[0] for d in sql.description].index(column) for column in df.columns]
    return Counter(map(tuple, df.collect())), Counter(tuple(row[i] for i in at) for row in sql.fetchall())


@pytest.mark.parametrize("name, rows", [("card_spans", 6), ("flagship_mask_summary", 1), ("echo_report", 4)])
def test_cards_before_letters(spark, tmp_path, name, rows):
    """A card ends where no digit follows; a letter, an underscore or a letter of another script may, and cards may stand side by side."""
    texts = ["ab4111111111111111cd", "4111111111111111_ 4111 1111 1111 1111Ж", "4111111111111111 4111111111111111 4111111111111111z9", "41111111111111119 4111111111111112a"]
    values = ", ".join(f"({i}, 'en', '{t}')" for i, t in enumerate(texts))
    duckdb.sql(f"SELECT * FROM (VALUES {values}) t(doc_id, lang, text)").write_parquet(str(tmp_path / "documents.parquet"))
    query, sql = _both(spark, tmp_path, name)
    assert query == sql
    if name == "card_spans":
        assert sum(n * row[2] for row, n in query.items()) == rows
    else:
        assert len(query) == rows


def test_equal_spans_are_of_one_island(spark, tmp_path):
    """Of equal spans the first begins an island, whatever order an engine takes them in."""
    rows = "SELECT i // 7 AS l_orderkey, CASE WHEN i % 7 < 3 THEN 12 ELSE 22 END AS l_partkey, 1 AS l_suppkey, i % 7 AS l_linenumber, 'N' AS l_returnflag FROM range(70000) t(i) ORDER BY hash(i)"
    duckdb.sql(rows).write_parquet(str(tmp_path / "lineitem.parquet"))
    query, sql = _both(spark, tmp_path, "interval_merge")
    assert query == sql == Counter({(doc, start, start + 2): 1 for doc in range(10000) for start in (12, 22)})

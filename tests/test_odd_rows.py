"""Queries against their SQL on rows that the driver's small tables don't have."""

import pytest

from inkspark import queries as library

library.load()
LONG = "One sentence here. " * 60 + "x" * 700
TEXTS = [(1, LONG), (1, LONG), (1, "short"), (2, ""), (2, None), (3, " \n\t "), (4, None), (None, "no id"), (None, "no id"), (5, "a😀b. " * 400), (6, " one　 " * 300), (7, "\x0b" + "y z " * 200)]


def against(spark, tmp_path, name, **tables):
    """Both results, sorted; ``tables`` are (rows, schema)."""
    import duckdb

    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = library.QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, got.collect()), key=repr), sorted(con.sql(f"SELECT {', '.join(got.columns)} FROM ({library.SQL[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("name", ["y06_soft_pieces", "y06_speech_pieces"])
def test_pieces_of_odd_texts(spark, tmp_path, name):
    got, want = against(spark, tmp_path, name, documents=(TEXTS, "doc_id long, text string"))
    assert got == want and len(got) == sum(bool(x) for _, x in TEXTS) + (name == "y06_speech_pieces") * sum(not x for _, x in TEXTS)

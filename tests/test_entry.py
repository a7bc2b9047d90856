import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", ["boolean_two_hops", "groups_format", "timeline_of_reasoning", "conversation_lines", "watched_scan", "candidates", "record_keys", "web_projection", "knowledge_gaps", "new_page_owners", "sheet_cells", "text_functions"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    mine = entry.queries()[name](spark, FOLDER).toPandas()
    theirs = con.sql(entry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    assert sorted(map(repr, mine[columns].astype(str).itertuples(index=False))) == sorted(map(repr, theirs[columns].astype(str).itertuples(index=False)))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

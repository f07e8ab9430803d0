"""Queries beside their SQL, on small tables of kinds that the given ones don't hold."""

import duckdb
import pytest

import __spark_entry__ as entry


def beside_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's, sorted; tables: SELECTs, written below folder first."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.sql(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    want = con.sql(f"SELECT * FROM ({entry.oracle_sql()[name]})")
    got = entry.queries()[name](spark, str(folder)).select(*(f"`{c}`" for c in want.columns))
    return sorted(map(tuple, got.collect())), sorted(want.fetchall())


#: 40 texts in two languages each, some of them twice in one.
SHARED = "SELECT CAST(i AS BIGINT) AS doc_id, 'text ' || i % 40 AS text, CASE WHEN i % 120 < 40 THEN 'en' ELSE 'de' END AS lang, 's' AS source FROM range(200) r(i)"


@pytest.mark.parametrize("name", ["renormalised_split", "source_partitions_split"])
def test_a_text_of_two_languages_is_split_in_each(spark, tmp_path, name):
    got, want = beside_sql(spark, tmp_path, name, documents=SHARED)
    assert len(want) == 200 and got == want


def test_pages_of_one_url_are_judged_each_by_its_own_bytes(spark, tmp_path):
    pages = "SELECT CAST(i AS BIGINT) AS page_id, 'http://x/' || i % 7 AS url, '<p>' || i AS html FROM range(40) r(i)"
    got, want = beside_sql(spark, tmp_path, "bytes_changed", pages=pages)
    assert got == want

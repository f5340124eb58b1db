"""Realignment and its SQL where the form left out is the beginning of the next one."""

import duckdb
import pytest

from lexloom.plans import catalog
from tests.test_queries import rows


@pytest.mark.parametrize("line", ["Reing a and on and off", "Reing a and on with", "x a a1 b", "x b ab y ab", "x a and"])
def test_form_left_out_begins_the_next(spark, tmp_path, line):
    docs = spark.createDataFrame([(1, "p\nq\nr\ns\n" + line, "en", "web", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got, want = catalog.QUERIES["j22_realign"](spark, str(tmp_path)), con.sql(catalog.ORACLES["j22_realign"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())

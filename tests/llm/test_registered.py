"""The registered queries of this subpackage against their SQL on the smallest dataset."""

import os

import pytest

from folium.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no dataset here")


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, tmp_path, name):
    import duckdb

    duck = duckdb.connect()
    for table in os.listdir(SF):
        duck.sql(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{SF}/{table}'")
    Q.QUERIES[name](spark, SF).write.parquet(str(tmp_path / "s"))
    duck.sql("CREATE TABLE o AS " + Q.ORACLE_SQL[name])
    duck.sql(f"CREATE TABLE s AS SELECT * FROM '{tmp_path}/s/*.parquet'")
    columns = ", ".join(f'"{r[0]}"' for r in duck.sql("DESCRIBE o").fetchall())
    assert duck.sql("SELECT count(*) FROM o").fetchall()[0][0] > 0
    for a, b in (("o", "s"), ("s", "o")):
        assert duck.sql(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall()[:3] == []

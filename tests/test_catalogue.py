import duckdb
import pytest

from tallgrass.plans import catalogue

SMALL = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    for f in df.schema:
        assert TYPES.get(f.dataType.simpleString(), kinds[f.name]) == kinds[f.name], f.name
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.sql(f"SELECT {quoted} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, want))

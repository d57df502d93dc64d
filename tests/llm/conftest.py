import duckdb
import pytest


@pytest.fixture(scope="session")
def read():
    def rows(sql, sf="sf0.001"):
        return duckdb.sql(sql.replace("{", f"'/root/testdata/{sf}/").replace("}", ".parquet'")).fetchall()

    return rows

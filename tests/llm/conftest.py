import pytest


@pytest.fixture()
def folder(spark, tmp_path):
    """Writes rows as a table of a folder and returns the folder."""

    def make(table, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / f"{table}.parquet"))
        return str(tmp_path)

    return make

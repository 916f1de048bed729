import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from opslens.session import local_session

    session = local_session("tests", 8)
    yield session
    session.stop()


@pytest.fixture
def ask(spark):
    """Value of one column expression over one text value."""
    from pyspark.sql import functions as F

    def run(build, *values):
        names = [f"v{i}" for i in range(len(values))]
        types = {str: "string", int: "bigint", float: "double", bool: "boolean", type(None): "string"}
        ddl = ", ".join(f"{n} {types[type(v)]}" for n, v in zip(names, values))
        df = spark.createDataFrame([tuple(values)], ddl)
        return df.select(build(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return run

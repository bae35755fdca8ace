import pytest

from claimspark.session import configure, local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "claimspark-tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column expression for each of some texts, in order."""
    from pyspark.sql import functions as F

    def run(expression, values, dtype="STRING"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {dtype}")
        rows = df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()
        return [r["out"] for r in rows]

    return run


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"

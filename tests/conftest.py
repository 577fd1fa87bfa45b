import pytest

from feedlake.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "feedlake-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """Evaluate SQL text over one row of named string columns."""

    def run(expression, **columns):
        names = list(columns) or ["unused"]
        row = tuple(columns.values()) or ("",)
        schema = ", ".join(f"{n} string" for n in names)
        return spark.createDataFrame([row], schema).selectExpr(f"{expression} AS r").first()["r"]

    return run


@pytest.fixture
def values(spark):
    """Evaluate SQL text of column ``x`` over many strings, in order."""

    def run(expression, inputs):
        rows = [(i, x) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i int, x string").selectExpr("i", f"{expression} AS r")
        return [r["r"] for r in sorted(df.collect(), key=lambda r: r["i"])]

    return run

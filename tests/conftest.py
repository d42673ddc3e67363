import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "cohortline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def final_plans(spark):
    """Runs a query; the plans that ran, its subqueries' included."""

    def run(df):
        df.collect()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        text = df._jdf.queryExecution().explainString(mode)
        return "".join(re.findall(r"== Final Plan ==(.*?)== Initial Plan ==", text, re.DOTALL))

    return run


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""

    def collect(df, *columns):
        picked = df.select(*[f"`{c}`" for c in columns]) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect

import pytest

from tidalframe.session import build_session


@pytest.fixture(scope="session")
def shared(tmp_path_factory):
    return str(tmp_path_factory.mktemp("shared"))


@pytest.fixture(scope="session", autouse=True)
def folders(spark, shared):
    """A shared folder of the tests' own, where the session names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return build_session

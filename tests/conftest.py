import pytest

from quarrydeck.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    s = local_session(4, "quarrydeck-tests", spark__sql__warehouse__dir=str(base / "warehouse"), spark__driver__memory="4g")
    s.sparkContext.setCheckpointDir(str(base / "checkpoints"))
    yield s
    s.stop()

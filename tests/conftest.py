import pytest

from faultline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "8",
        shuffle_partitions=4,
        **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write_log(tmp_path):
    """Write a log file below tmp_path and return its folder as a string."""

    def write(name, lines, folder="logs", encoding="utf-8", newline="\n"):
        target = tmp_path / folder
        target.mkdir(exist_ok=True)
        text = newline.join(lines) + (newline if lines else "")
        (target / name).write_bytes(text.encode(encoding))
        return str(target)

    return write

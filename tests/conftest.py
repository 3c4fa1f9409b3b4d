import pytest

from textwarden.session import local_session, shared_dir


@pytest.fixture(scope="session")
def spark():
    # code that cannot be compiled fails a test instead of running interpreted
    session = local_session(4, partitions=4, **{"spark.sql.codegen.fallback": "false"})
    shared_dir(session)
    yield session
    session.stop()

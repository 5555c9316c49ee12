import pytest

from streamloom.session import local_session

CHUNK_CONF = "spark.streamloom.maxChunkRows"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=2)
    yield session
    session.stop()


@pytest.fixture(params=["whole", "chunked"])
def chunking(request, spark):
    """Run a test with plain windows and again with streams cut into tiny chunks."""
    if request.param == "chunked":
        spark.conf.set(CHUNK_CONF, "2")
    yield request.param
    spark.conf.unset(CHUNK_CONF)


@pytest.fixture
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")

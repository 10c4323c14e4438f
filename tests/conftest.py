import pytest

from siftmill.session import get_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session("siftmill-tests", 4, shuffle_partitions=4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("work")))
    session.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
    yield session
    session.stop()


@pytest.fixture
def make_files(spark):
    def make(*rows):
        """(path, text) or (project, path, text) rows as files."""
        from pyspark.sql import functions as F

        from siftmill.sources.files import language_of

        full = [r if len(r) == 3 else ("p", *r) for r in rows]
        return spark.createDataFrame(full, "project_id string, path string, text string").withColumn("language", language_of(F.col("path")))

    return make

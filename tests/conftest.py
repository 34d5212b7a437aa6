import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    """{path: text} -> source files with their lines."""
    from linesieve.operators import files
    from linesieve.sources.corpus import corpus_from_table

    def build(texts, include_tests=True):
        df = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, path string, content string")
        corpus = corpus_from_table(df, "repo", "path", "content")
        return files.source_lines(files.collect_files(corpus, include_tests))
    return build

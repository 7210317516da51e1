import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from playseq.domain import ROUNDS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# One game of four rounds: (round, move of a, outcome of a, move of b, outcome of b).
HAND = [
    (1, "rock", "loss", "paper", "win"),
    (2, "paper", "tie", "paper", "tie"),
    (3, "none", "loss", "rock", "win"),
    (4, "scissors", "tie", "scissors", "tie"),
]


@pytest.fixture(scope="session")
def hand(spark):
    rows = []
    for number, a_move, a_outcome, b_move, b_outcome in HAND:
        rows.append(("g1", "a", number, a_move, a_outcome))
        rows.append(("g1", "b", number, b_move, b_outcome))
    # Deliberately not in round order.
    return spark.createDataFrame(rows[::-1], ROUNDS)

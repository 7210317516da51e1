import pytest

from playseq.domain import ROUNDS
from playseq.sources import complete_rounds, read_rounds, write_table

CSV = """game_id,extra,round_index,player_id,player_move,player_outcome
g1,x,1,a,rock,win
g1,x,2,a,NA,loss
g1,x,1,b,,""
"""


def test_csv_binds_by_name_and_reads_missing_values(spark, tmp_path):
    file = tmp_path / "rounds.csv"
    file.write_text(CSV)
    df = read_rounds(spark, str(file))
    assert df.schema == ROUNDS
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(
        [
            ("g1", "a", 1, "rock", "win"),
            ("g1", "a", 2, None, "loss"),
            ("g1", "b", 1, None, None),
        ],
        key=repr,
    )


def test_csv_drops_blanks_and_reads_whole_decimals(spark, tmp_path):
    file = tmp_path / "rounds.csv"
    file.write_text("game_id,player_id,round_index,player_move,player_outcome\n g1 ,a,1.0, rock,win\ng1,a, 2 ,paper , NA\n")
    got = read_rounds(spark, str(file)).orderBy("round_index").collect()
    assert [tuple(r) for r in got] == [("g1", "a", 1, "rock", "win"), ("g1", "a", 2, "paper", None)]


@pytest.mark.parametrize("limit", [None, 0])
def test_incomplete_players_are_dropped_over_all_their_games(spark, limit):
    from playseq.operators.sizes import Limits

    rows = [
        ("g1", "a", 1, "rock", "win"), ("g1", "a", 5, "rock", "win"),
        ("g1", "b", 5, "rock", "win"),
        ("g2", "a", 2, "rock", "win"),
        ("g2", "c", 2, "rock", "win"),  # incomplete
        ("g3", "d", None, "rock", "win"), ("g3", "d", 1, "rock", "win"),  # unknown, kept
        ("g4", None, 3, "rock", "win"),  # no id, incomplete as one player
    ]
    df = spark.createDataFrame(rows, ROUNDS)
    limits = Limits() if limit is None else Limits(broadcast_rows=limit)
    kept = complete_rounds(df, 5, limits=limits)
    assert sorted({r.player_id for r in kept.collect()}) == ["a", "b", "d"]
    assert kept.count() == 6


def test_players_without_id_are_kept_when_complete(spark):
    rows = [("g4", None, 7, "rock", "win"), ("g4", None, 1, "rock", "win"), ("g4", "z", 1, "rock", "win")]
    assert complete_rounds(spark.createDataFrame(rows, ROUNDS), 7).count() == 2


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_results_can_be_written_and_read_back(spark, tmp_path, format):
    df = spark.createDataFrame([("g", "p", 1, "rock", "win")], ROUNDS)
    write_table(df, str(tmp_path / "out"), format)
    assert read_rounds(spark, str(tmp_path / "out"), format).collect() == df.collect()

"""The flagship query: the value leaderboard at the last day of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog.registry import EVENT, workspace
from tidemark.operators.board import board_as_of, leaderboard


def value_board(spark: SparkSession, sf_dir: str, symbol: str = "type") -> DataFrame:
    ws = workspace(spark, sf_dir, symbol)
    board = board_as_of(ws.candles, ws.coins, ws.rates, ws.last_day, EVENT)
    return leaderboard(board, "value")

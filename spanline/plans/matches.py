"""From match and pick rows to the table a predictor is trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from spanline.operators.joins import valid_at
from spanline.operators.segment import previous_value
from spanline.operators.tables import canonical_pair
from spanline.operators.votes import bucket_rare, pivot_wide, share_of_total


def match_table(
    matches: DataFrame,
    versions: DataFrame,
    match_key: Sequence[str],
    order: Sequence[str],
    player_cols: Sequence[str],
    min_matches: int,
) -> DataFrame:
    """Match rows with teams in order, previous result, version and progress, rare players
    bucketed.  ``matches``: ``date, team1, team2, result`` and the player columns."""
    paired = canonical_pair(
        matches, "team1", "team2", "result",
        {"Team1wins": "Team2wins", "Team2wins": "Team1wins"},
        list(zip(player_cols[: len(player_cols) // 2], player_cols[len(player_cols) // 2 :], strict=True)),
    )
    with_previous = previous_value(paired, match_key, order, "result", "Start", "previous_result")
    versioned = valid_at(with_previous, versions, "date")
    return bucket_rare(versioned, player_cols, min_matches, "unknown_player")


def pick_table(picks: DataFrame, heroes: Sequence[str]) -> DataFrame:
    """Hero shares per player and map, one column per hero, missing ones zero."""
    shares = share_of_total(picks, ["player", "map"], "hero", "time")
    return pivot_wide(shares, ["player", "map"], "hero", "share", heroes)

"""From labelled samples of recordings to rounds, games and match documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.operators.intervals import filter_min_duration, run_length_encode
from spanline.operators.joins import overlap_duration
from spanline.operators.segment import forward_fill, relabel_pauses, segment_games, segment_rounds
from spanline.operators.votes import nest_rounds
from spanline.ordered import Layout
from spanline.session import cut_lineage
from spanline.timeunits import SECOND


@dataclass(frozen=True)
class RoundRules:
    """Durations of the round rules, in microseconds."""

    flicker: int = 1 * SECOND
    short_pause: int = 4 * SECOND
    between_games: int = 1 * SECOND
    not_game: int = 10 * SECOND
    game: int = 30 * SECOND
    pause: int = 1 * SECOND
    replay: int = 1 * SECOND
    small_window: int = 4 * SECOND
    round: int = 20 * SECOND

    def scaled(self, factor: int) -> "RoundRules":
        return RoundRules(**{k: v * factor for k, v in self.__dict__.items()})


def vote_in_rounds(
    states: DataFrame, rounds: DataFrame, key: str, out: str, layout: Layout
) -> DataFrame:
    """Per round the value with the longest duration (first seen wins ties)."""
    per = overlap_duration(states, rounds, [key], "round", layout=layout)
    best = F.max_by("status", F.struct(F.col("dur"), -F.col("seen")))
    return per.groupBy(key, "round").agg(best.alias(out))


def rounds_of_recordings(
    labels: DataFrame,
    key: str,
    rules: RoundRules | None = None,
    order: tuple[str, ...] = (),
    layout: Layout | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rounds with map, attacking side and numbering, and their parts.

    ``labels``: ``(key, attr, t, label)`` with attributes ``game``, ``map`` and
    ``attacking_side``.  One layout check on the samples serves every step, since
    no step has more rows per key.
    """
    rules = rules or RoundRules()
    layout = layout or Layout.inspect(labels, [key])
    keys = [key]

    # One pass over the samples encodes every attribute; the intervals are far fewer
    # and used several times, so they are written once.
    encoded = cut_lineage(
        run_length_encode(labels, [key, "attr"], "t", "label", order, layout).drop("n")
    )

    def states(attr: str) -> DataFrame:
        return encoded.filter(F.col("attr") == attr).drop("attr")

    game = filter_min_duration(states("game"), keys, {"not_game": rules.flicker}, layout=layout)
    game = relabel_pauses(game, keys, rules.short_pause, rules.between_games, layout=layout)
    limits = {
        "not_game": rules.not_game,
        "game": rules.game,
        "pause": rules.pause,
        "replay": rules.replay,
        "smaller_window": rules.small_window,
    }
    game = filter_min_duration(game, keys, limits, protect_initial=True, layout=layout)
    rounds, parts = segment_rounds(game, keys, rules.round, layout=layout)
    rounds = cut_lineage(rounds)
    for attr, out in (("map", "map"), ("attacking_side", "attacking_side")):
        voted = vote_in_rounds(states(attr), rounds.select(key, "round", "b", "e"), key, out, layout)
        rounds = rounds.join(voted, [key, "round"], "left")
    rounds = forward_fill(rounds, keys, ["b"], ["map"], layout)
    code = {"left": "L", "right": "R"}
    side = F.lit("N")
    for name, letter in code.items():
        side = F.when(F.col("attacking_side") == name, letter).otherwise(side)
    rounds = rounds.withColumn("attacking_side", side)
    return segment_games(rounds, keys, ["b"], "map", layout), parts


def match_documents(rounds: DataFrame, key: str) -> DataFrame:
    """One document per game, rounds in order."""
    return nest_rounds(
        rounds, [key, "game_number"], ["round_number"], ["b", "e", "map", "attacking_side"], "rounds"
    )

"""From interval truth to training samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanline.operators.features import adaptive_sample, split_train_val
from spanline.operators.intervals import uniform_grid
from spanline.operators.joins import exclude_boundary, label_grid
from spanline.operators.tables import mask_unknown
from spanline.ordered import Layout, deal


def samples_from_truth(
    sequences: DataFrame,
    truth: DataFrame,
    key: str,
    attrs: Sequence[str],
    step_us: int,
    dense: DataFrame | None = None,
    every: int = 4,
    entity: str | None = None,
    defaults: Mapping[str, str] | None = None,
    train_share: float = 0.8,
    seed: int = 0,
    trim_us: int = 100_000,
) -> DataFrame:
    """Labelled samples ``(key, t, <attrs>, split)`` on a grid over the sequences.

    Samples exactly on an interval begin are left out; with ``dense`` ranges the
    grid is thinned outside them; labels that depend on ``entity`` are masked
    where it is unknown; each key gives ``floor(train_share * n)`` to training.
    """
    keys = [key]
    per = F.floor((F.col("e") - F.col("b")) / step_us) + 1
    layout = Layout.of_sizes(
        sequences.groupBy(*keys).agg(F.sum(per).alias("n"))
    )
    # dealt before the grid is laid out: its points, far more than sequences, stay in place
    sequences, truth = (deal(df, keys, layout.tasks) for df in (sequences, truth))
    grid = uniform_grid(sequences, keys, step_us, trim_us)
    if dense is not None:
        grid = adaptive_sample(grid, dense, keys, every, layout)
    grid = exclude_boundary(grid, truth, keys, layout=layout)
    labelled = label_grid(grid, truth, keys, attrs, defaults=defaults, layout=layout)
    if entity is not None:
        labelled = mask_unknown(labelled, entity, [a for a in attrs if a != entity])
    return split_train_val(labelled, keys, "t", train_share, seed, layout)

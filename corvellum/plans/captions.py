"""Captions and tables of stages, written from their numbers."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame


def qc_caption(n_before: int, n_after: int, impact: dict[str, float]) -> str:
    """What a filter did."""
    parts = ", ".join(f"{int(v)} by {k.replace('_', ' ')}" for k, v in impact.items() if k.startswith("too_"))
    return f"{n_after:,} of {n_before:,} units were kept ({parts})."


def components_caption(n: int, share: float, null_runs: int) -> str:
    """How many components were used and why."""
    return f"{n} components hold {100 * share:.0f} % of the variance above that of shuffled data ({null_runs} runs)."


def cluster_caption(n: int, resolution: float, stability: float) -> str:
    """How a clustering was picked."""
    return f"{n} clusters at resolution {resolution:g}; agreement of 80 % resamples {stability:.2f}."


def calls_caption(tiers: dict[str, int]) -> str:
    """How sure the names are."""
    return "Names: " + ", ".join(f"{n} {t}" for t, n in sorted(tiers.items())) + "."


def comparison_caption(n_called: int, n_tested: int, swap_median: float) -> str:
    """What was called, and what swapped labels call."""
    return f"{n_called} of {n_tested} features differ at a false discovery rate of 5 %; with swapped labels the median is {swap_median:g}."


def write_captions(folder: str, captions: dict[str, str]) -> dict[str, str]:
    """Add captions to ``figure_captions.json`` in a folder; later ones replace earlier ones of the same name."""
    path = os.path.join(folder, "figure_captions.json")
    all_of_them = read_captions(folder) | captions
    with open(f"{path}.part", "w") as f:
        json.dump(all_of_them, f, indent=1, sort_keys=True)
    os.replace(f"{path}.part", path)
    return all_of_them


def read_captions(folder: str) -> dict[str, str]:
    """Captions of a folder; none if there is no file."""
    path = os.path.join(folder, "figure_captions.json")
    return json.load(open(path)) if os.path.exists(path) else {}


def write_table(df: DataFrame, path: str) -> None:
    """A result table of bounded size as CSV with a header, one file. Nested columns go in as JSON."""
    from pyspark.sql import functions as F

    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)

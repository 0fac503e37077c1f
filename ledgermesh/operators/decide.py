"""Decisions from probabilities: threshold, best candidate, one owner, and the tuning grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import score_groups
from .rules import best_owner, ranked


def decide(predictions: DataFrame, t: float = 0.5, t_best: float | None = None, one_owner: bool = False) -> DataFrame:
    """``(s1_id, cand_id, p)``: pairs of probability ``t`` or more, and each record's best pair from ``t_best`` (default t) on.

    One-owner resolution comes after the threshold.
    """
    best = t if t_best is None else t_best
    placed = ranked(predictions, "p") if "rk" not in predictions.columns else predictions
    chosen = placed.where((F.col("p") >= t) | ((F.col("rk") == 1) & (F.col("p") >= best))).select("s1_id", "cand_id", "p")
    return best_owner(chosen, F.desc("p")) if one_owner else chosen


def coarse_grid() -> list[tuple[bool, float, float]]:
    """(one owner, t, t_best) in the order that ties are resolved in."""
    steps = [(oo, t / 100, d) for oo in (False, True) for t in range(30, 95, 10) for d in (0.0, 0.15, 0.3)]
    return [(oo, t, max(round(t - d, 4), 0.05)) for oo, t, d in steps]


def fine_grid(one_owner: bool, t0: float, tb0: float) -> list[tuple[bool, float, float]]:
    """Around the coarse optimum; t_best never above t nor, but for t itself, below 0.05."""
    out = []
    for i in range(-4, 5):
        t = round(t0 + i * 0.02, 4)
        near = sorted({max(round(tb0 + j * 0.05, 4), 0.05) for j in range(-2, 3)} | {t})
        out += [(one_owner, t, tb) for tb in near if tb <= t]
    return out


def grid_scores(predictions: DataFrame, truth: DataFrame, reference: DataFrame, grid: list[tuple[bool, float, float]], digits: int | None = 6) -> DataFrame:
    """Macro F0.5 of every setting, from one ranked table crossed with the grid.

    Pairs that no setting accepts go first, and only settings with one owner look at owners.
    """
    table = [(i, *g) for i, g in enumerate(grid)]
    settings = predictions.sparkSession.createDataFrame(table, "setting int, one_owner boolean, t double, t_best double")
    least, least_best = min(g[1] for g in grid), min(g[2] for g in grid)
    placed = ranked(predictions, "p").where((F.col("p") >= least) | ((F.col("rk") == 1) & (F.col("p") >= least_best)))
    placed = placed.crossJoin(F.broadcast(settings))  # a few dozen rows
    chosen = placed.where((F.col("p") >= F.col("t")) | ((F.col("rk") == 1) & (F.col("p") >= F.col("t_best"))))
    owner = F.row_number().over(Window.partitionBy("setting", "cand_id").orderBy(F.desc("p"), "s1_id"))
    columns = ("setting", "s1_id", "cand_id")
    owned = chosen.where("one_owner").withColumn("place", owner).where("place = 1").select(*columns)
    parts = [chosen.where("NOT one_owner").select(*columns)] if not all(g[0] for g in grid) else []
    parts += [owned] if any(g[0] for g in grid) else []
    chosen = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return score_groups(chosen, settings, "setting", truth, reference, digits).select("setting", "one_owner", "t", "t_best", "pairs", "macro_f05")


def tune(predictions: DataFrame, truth: DataFrame, reference: DataFrame) -> tuple[bool, float, float]:
    """Best setting: coarse grid, then a fine one around it; the first of equal scores wins."""
    first = lambda grid: grid_scores(predictions, truth, reference, grid, None).orderBy(F.desc("macro_f05"), "setting").first()
    a = first(coarse_grid())
    b = first(fine_grid(a["one_owner"], a["t"], a["t_best"]))
    best = b if b is not None and b["macro_f05"] > a["macro_f05"] else a
    return best["one_owner"], best["t"], best["t_best"]

"""Orderings and top-k selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from wavelane.operators import prep as P


def top_shapelets(scored: DataFrame, n: int, score: tuple[str, ...] = ("gain", "gap"),
                  tie: tuple[str, ...] = ("series_id", "start", "length")) -> DataFrame:
    """Best n rows by score, then by the tie columns, all descending."""
    return scored.orderBy(*[F.desc(c) for c in (*score, *tie)]).limit(n)


def top_candidates(powers: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """k strongest windows per length, in (series, start) order on ties.

    The rank limit is applied in every partition before the shuffle, so at most k rows per
    length and partition move.
    """
    by = Window.partitionBy(*(by or []), "length").orderBy(F.desc("power"), "series_id", "start")
    return powers.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def select_best(scored: DataFrame, score: str = "score", size: str = "points", n: int = 1,
                tie: tuple[str, ...] = ()) -> DataFrame:
    """Highest score, fewest points."""
    return scored.orderBy(F.desc(score), F.asc(size), *tie).limit(n)


def tournament_draws(spark, slots: int, individuals: int, seed: int, size: int = 3) -> DataFrame:
    """(slot, ind_id): ``size`` random individuals per slot, from 0 to individuals - 1."""
    return spark.range(slots).select(F.col("id").alias("slot"), F.explode(F.array(*[
        F.pmod(P.random_key(seed, "id", F.lit(i)), F.lit(individuals)) for i in range(size)])).alias("ind_id"))


def tournament(scored: DataFrame, draws: DataFrame, score: str = "score", points: str = "points") -> DataFrame:
    """Winner of every drawn group: highest score, then fewest points, then smallest id."""
    return draws.join(scored, "ind_id").groupBy("slot").agg(
        F.max_by("ind_id", F.struct(F.col(score), -F.col(points), -F.col("ind_id"))).alias("ind_id"))


def elitist_union(winners: DataFrame, best: DataFrame) -> DataFrame:
    """Next population: tournament winners plus the best of parents and offspring."""
    return winners.unionByName(best)


def sort_by_cost(datasets: DataFrame, rows: str = "n", points: str = "m") -> DataFrame:
    """Data sets in order of search cost, rows^2 * points^3."""
    cost: Column = F.pow(F.col(rows), 2) * F.pow(F.col(points), 3)
    return datasets.withColumn("cost", cost).orderBy("cost")

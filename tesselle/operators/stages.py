"""Stages as functions from DataFrame to DataFrame, registered by name and run in the order of their dependencies."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .masks import connected, label_boxes

REGISTRY: dict[str, Callable] = {}


def stage(name: str | None = None, needs: Iterable[str] | Sequence[Iterable[str]] = (), gives: Iterable[str] = ()) -> Callable:
    """Registers a function whose DataFrame parameters are inputs and whose others are arguments.

    `needs` names the columns of the first input, or is a list with the columns of each input; `gives` those of the result.
    They are checked when the stage is called, before anything runs.
    """
    columns = [list(x) for x in needs] if needs and not all(isinstance(x, str) for x in needs) else [list(needs)]

    def wrap(f: Callable) -> Callable:
        def run(*frames: DataFrame, **arguments) -> DataFrame:
            inspect.signature(f).bind(*frames, **arguments)
            for k, (df, wanted) in enumerate(zip(frames, columns, strict=False), 1):
                missing = set(wanted) - set(df.columns)
                if missing:
                    raise ValueError(f"{f.__name__} needs the columns {sorted(missing)} of input {k}")
            out = f(*frames, **arguments)
            missing = set(gives) - set(out.columns)
            if missing:
                raise ValueError(f"{f.__name__} doesn't give the columns {sorted(missing)}")
            return out

        run.__name__ = name or f.__name__
        REGISTRY[run.__name__] = run
        return run

    return wrap


def per_tile(task: Callable[[pd.DataFrame], pd.DataFrame], keys: Sequence[str], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A stage that hands each tile, the rows with equal keys, to a task."""
    return lambda df: df.groupBy(*keys).applyInPandas(task, schema)


def to_driver(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a small result. More than `most` are an error, and no more than that come."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the result has more than {most} rows")
    return rows


@dataclass
class Workflow:
    """Steps (name, stage, names of the steps they read, arguments). Lazy: Spark runs what an action needs."""

    steps: dict[str, tuple[str, tuple[str, ...], dict]] = field(default_factory=dict)

    def add(self, name: str, stage_name: str, reads: Iterable[str] = (), **arguments) -> Workflow:
        self.steps[name] = (stage_name, tuple(reads), arguments)
        return self

    def order(self) -> list[str]:
        return [x for x in TopologicalSorter({k: v[1] for k, v in self.steps.items()}).static_order() if x in self.steps]

    def run(self, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All steps' results. The first error is raised, so no step after it is planned."""
        done = dict(inputs)
        for name in self.order():
            stage_name, reads, arguments = self.steps[name]
            done[name] = REGISTRY[stage_name](*[done[r] for r in reads], **arguments)
        return done

    def attempt(self, inputs: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, str]]:
        """The results of the steps that succeed, written as they are made, and the state of each step: done, failed (with its
        error), or cancelled, which a step is if one that it reads failed or was cancelled. Others go on."""
        done, state = dict(inputs), {}
        for name in self.order():
            stage_name, reads, arguments = self.steps[name]
            if any(state.get(r, "done") != "done" for r in reads):
                state[name] = "cancelled"
                continue
            try:
                done[name] = durable(REGISTRY[stage_name](*[done[r] for r in reads], **arguments))
                state[name] = "done"
            except Exception as error:  # the step's own code, on the driver or in a task
                state[name] = f"failed: {type(error).__name__}"
        return done, state

    def transaction(self, inputs: dict[str, DataFrame], names: Iterable[str], callback: Callable[..., None]) -> dict[str, DataFrame]:
        """Runs the workflow, writes the results of the named steps, and only then calls `callback` with them."""
        done = self.run(inputs)
        for name in names:
            done[name] = durable(done[name])
        callback(*[done[name] for name in names])
        return done


def per_parameter_set(data: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of `data` for each parameter set. Sets are a table of the study's size, which is broadcast behind a check."""
    if sets.count() > 100_000:
        raise ValueError("more than 100,000 parameter sets")
    return data.crossJoin(F.broadcast(sets))


def run_shared(data: DataFrame, sets: DataFrame, stages: Sequence[tuple[Sequence[str], Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """The stages one after the other for each parameter set (param_set_id and the parameters), each run once for each
    combination of the parameters up to it: param_set_id and what the last stage gives.

    A stage is its parameters and a function that adds columns to rows that hold them. What stages share is planned once,
    and each stage's result is written, so sets with a common beginning share its work.
    """
    used: list[str] = []
    for own, f in stages:
        combinations = sets.select(*used, *own).distinct()
        data = per_parameter_set(data, combinations) if not used else data.join(F.broadcast(combinations), used)
        used += own
        data = durable(f(data))
    return data.join(F.broadcast(sets.select("param_set_id", *used)), used)


def closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """All (node, needs) pairs of a dependency table, by doubling the length of known paths. Each round is written to
    the checkpoint folder, so none is computed twice."""
    paths = durable(edges.select("node", "needs").distinct())
    count = paths.count()
    for _ in range(rounds):
        further = paths.alias("p").join(paths.alias("q"), F.col("p.needs") == F.col("q.node")).select("p.node", "q.needs")
        paths = durable(paths.union(further).distinct())
        new = paths.count()
        if new == count:
            return paths
        count = new
    raise ValueError("the dependencies are deeper than expected")


@stage("normalize", needs=("value",), gives=("value",))
def normalize_colours(pixels: DataFrame, mean: float, std: float) -> DataFrame:
    """Moves each channel's mean and spread to the given ones."""
    own = pixels.groupBy("channel").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    scaled = F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s") * std + mean).otherwise(F.lit(mean))
    return pixels.join(F.broadcast(own), "channel").withColumn("value", F.round(scaled, 6)).drop("m", "s")  # a row per channel


@stage("segment", needs=("tile", "y", "x", "value"), gives=("label",))
def segment(pixels: DataFrame, threshold: float, least_pixels: int = 1) -> DataFrame:
    """Pixels above a threshold, as connected objects of at least so many pixels."""
    bright = pixels.filter(F.col("value") > threshold).select("tile", "y", "x", F.lit(1).alias("label"))
    found = connected(bright)
    kept = found.groupBy("tile", "label").count().filter(F.col("count") >= least_pixels).drop("count")
    return found.join(kept, ["tile", "label"])


@stage("features", needs=(("tile", "y", "x", "label"),), gives=("pixels",))
def boxes_of(objects: DataFrame) -> DataFrame:
    """Each object's box and number of pixels."""
    return label_boxes(objects)


@stage("segment_and_features", needs=("tile", "y", "x", "value"), gives=("pixels",))
def segment_and_features(pixels: DataFrame, threshold: float, least_pixels: int = 1, least_objects: int = 1) -> DataFrame:
    """Both stages in one: tiles in which fewer than `least_objects` objects are found go no further."""
    found = segment(pixels, threshold, least_pixels)
    kept = found.groupBy("tile").agg(F.count_distinct("label").alias("n")).filter(F.col("n") >= least_objects).select("tile")
    return label_boxes(found.join(kept, "tile", "left_semi"))


@stage("add")
def add_columns(df: DataFrame, a: str, b: str, out: str, plus: int = 0) -> DataFrame:
    return df.withColumn(out, F.col(a) + F.col(b) + plus)

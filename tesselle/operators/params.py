"""Parameter studies as tables: grids, prefix sharing, memoised scores, objectives, and population operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, values: dict[str, Sequence]) -> DataFrame:
    """All combinations; the last parameter varies fastest. No values for a parameter make no rows."""
    sizes = [len(v) for v in values.values()]
    total = 1
    for n in sizes:
        total *= n
    df, step = spark.range(total).withColumnRenamed("id", "param_set_id"), total
    for (name, own), n in zip(values.items(), sizes, strict=True):
        step //= max(1, n)
        df = df.withColumn(name, F.element_at(F.array(*map(F.lit, own)), (F.floor(F.col("param_set_id") / step) % n + 1).cast("int")) if n else F.lit(None))
    return df


def span(first: int, last: int, step: int = 1) -> list[int]:
    """From first to last, both included."""
    return list(range(first, last + 1, step))


def shared_prefix(sets: DataFrame, stages: Sequence[Sequence[str]]) -> DataFrame:
    """How many runs each stage needs when runs with equal parameters up to it are shared, against one run per set."""
    out, used = None, []
    for k, own in enumerate(stages):
        used = [*used, *own]
        row = sets.select(*used).distinct().agg(F.count("*").alias("runs")).select(F.lit(k).alias("stage"), "runs")
        out = row if out is None else out.union(row)
    return out


def unseen(candidates: DataFrame, trace: DataFrame, keys: Sequence[str]) -> DataFrame:
    return candidates.join(trace.select(*keys).distinct(), list(keys), "left_anti")


def best(trace: DataFrame) -> DataFrame:
    """The row with the least score; of equal ones the first trial."""
    return trace.agg(F.min_by(F.struct("param_set_id", "trial", "score"), F.struct("score", "trial")).alias("b")).select("b.*")


def repeat_stats(trace: DataFrame) -> DataFrame:
    return trace.groupBy("param_set_id").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.median("score"), 6).alias("median_score"))


def constrained(sets: DataFrame, *rules: str) -> DataFrame:
    """The parameter sets that fulfil all rules, each an SQL condition over the parameters. A rule that is null rejects."""
    for rule in rules:
        sets = sets.filter(F.expr(rule))
    return sets


#: Fixed value: the least step of a 32-bit float above 1, which the objective takes for metrics of 0 or less.
EPSILON = 1.1920928955078125e-07


def objective(trace: DataFrame, metric_weight: float, time_weight: float, second: str | None = None) -> DataFrame:
    """1 / (weighted metric + weighted speed), where speed is 1 for the fastest set and 0 for the slowest; infinite if the
    sum is 0 or less, or the metric isn't above EPSILON. With a `second` metric the mean of both counts. A negative
    score, which negative weights can make, loses its sign."""
    whole = trace.agg(F.max("time").alias("slow"), F.min("time").alias("fast"))
    t = trace.crossJoin(F.broadcast(whole))  # one row
    speed = F.when((F.lit(time_weight) > 0) & (F.col("slow") > F.col("fast")), (F.col("slow") - F.col("time")) / (F.col("slow") - F.col("fast"))).otherwise(0.0)
    metric = (F.col("metric") + F.col(second)) / 2 if second else F.col("metric")
    total = metric_weight * metric + time_weight * speed
    return t.select("param_set_id", F.when((total > 0) & (metric > EPSILON), F.abs(1 / total)).otherwise(F.lit(float("inf"))).alias("score"))


def ranked(population: DataFrame) -> DataFrame:
    """By fitness, stable. A population is a few hundred rows."""
    return population.withColumn("rank", F.row_number().over(Window.orderBy("fitness", "idx")))


def elite(population: DataFrame, n: int) -> DataFrame:
    """The n worst take the genes and fitness of the n best, best for worst."""
    r, size = ranked(population), population.count()
    top = r.filter(F.col("rank") <= n).select((F.lit(size + 1) - F.col("rank")).alias("rank"), F.col("gene").alias("g"), F.col("fitness").alias("f"))
    return r.join(top, "rank", "left").select("idx", F.coalesce("g", "gene").alias("gene"), F.coalesce("f", "fitness").alias("fitness"))


def survivors(parents: DataFrame, children: DataFrame) -> DataFrame:
    """The best of both, as many as there are parents; of equal ones children stay, parents go."""
    both = parents.withColumn("kind", F.lit(1)).union(children.withColumn("kind", F.lit(0)))
    return both.withColumn("rank", F.row_number().over(Window.orderBy("fitness", "kind", "idx"))).filter(F.col("rank") <= parents.count()).select("rank", "gene", "fitness")


def better_of(parents: DataFrame, children: DataFrame) -> DataFrame:
    c = children.select("idx", F.col("gene").alias("g"), F.col("fitness").alias("f"))
    return parents.join(c, "idx").select("idx", F.when(F.col("f") < F.col("fitness"), F.col("g")).otherwise(F.col("gene")).alias("gene"), F.least("f", "fitness").alias("fitness"))


def folds(items: DataFrame, n_folds: int, n_train: int, seed: int) -> DataFrame:
    """Per fold `n_train` items chosen by a seeded hash, the others for testing."""
    each = items.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    order = Window.partitionBy("fold").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "fold", "id")), "id")
    return each.withColumn("train", F.row_number().over(order) <= n_train)


def cross_validate(scores: DataFrame, parts: DataFrame) -> DataFrame:
    """fold, param_set_id, train_score, test_score: for each fold the parameter set that is best (least mean score, then least
    id) on its images for training, and its mean score on the others. scores: param_set_id, image, score; parts: fold,
    id, train, as `folds` gives them. Folds without images for testing have a null test score."""
    both = scores.join(parts.select("fold", F.col("id").alias("image"), "train"), "image")
    means = both.groupBy("fold", "param_set_id").agg(F.avg(F.when(F.col("train"), F.col("score"))).alias("train_score"), F.avg(F.when(~F.col("train"), F.col("score"))).alias("test_score"))
    best = F.min_by(F.struct("param_set_id", "train_score", "test_score"), F.struct("train_score", "param_set_id")).alias("best")
    return means.filter("train_score is not null").groupBy("fold").agg(best).select("fold", "best.*")

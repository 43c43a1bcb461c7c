"""Feedback on terms and the preference model trained on it."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C

FEATURES = ["quality_score", "in_case_freq", "freq_rank_normalized", "num_algorithms", "has_ner", "has_rake", "is_person", "is_medical", "is_technical", "is_place", "is_unknown"]


def term_key(term: str = "term") -> Column:
    return F.lower(F.trim(term))


def latest(df: DataFrame) -> DataFrame:
    """The last row of each term, cleared ones (0) included.

    A maximum over a struct keeps one row per term before the shuffle, so a
    term that holds a third of the log is no hot group.
    """
    cols = [c for c in df.columns if c != "feedback_ts"]
    row = F.struct(F.col("feedback_ts"), *[F.col(c) for c in sorted(cols)])
    return df.where(F.col("term").isNotNull()).groupBy(term_key().alias("term_key")).agg(F.max(row).alias("r")).select("term_key", "r.*")


def counts(df: DataFrame) -> DataFrame:
    """One row: rated terms by sign, cleared ones, rows since the last training (all
    of them, as no model is kept), and whether to retrain: thirty rated terms and ten
    new rows at least."""
    last = latest(df)
    n = lambda v: F.count(F.when(F.col("feedback") == v, 1))
    return last.agg(n(1).alias("liked"), n(-1).alias("disliked"), n(0).alias("cleared")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("pending")))).withColumn("retrain", (F.col("liked") + F.col("disliked") >= C.ML_MIN_SAMPLES) & (F.col("pending") >= C.ML_RETRAIN_AFTER))


def features(df: DataFrame) -> DataFrame:
    """The eleven features of a row; BM25 counts as no algorithm here."""
    rank = F.coalesce(F.col("freq_rank"), F.lit(0)).cast("double")
    algorithms, kind = F.lower(F.coalesce("algorithms", F.lit(""))), F.lower(F.coalesce("term_type", F.lit("Unknown")))
    ner, rk = algorithms.contains("ner").cast("double"), algorithms.contains("rake").cast("double")
    freq = F.coalesce(F.col("in_case_freq"), F.lit(1)).cast("double")
    out = df.withColumns(
        {
            "quality_score": F.coalesce(F.col("quality_score"), F.lit(0.0)).cast("double"),
            "in_case_freq": F.when(freq == 0, 1.0).otherwise(freq),
            "freq_rank_normalized": F.when(rank > 0, F.least(rank / 300_000, F.lit(1.0))).otherwise(0.0),
            "num_algorithms": ner + rk,
            "has_ner": ner,
            "has_rake": rk,
        }
    )
    return out.withColumns({f"is_{t}": (kind == t).cast("double") for t in ("person", "medical", "technical", "place", "unknown")})


def train(df: DataFrame) -> PipelineModel | None:
    """A balanced logistic regression on the latest ratings; None where there
    are fewer than thirty, or fewer than three of a class."""
    rows = features(latest(df).where("feedback <> 0")).withColumn("label", (F.col("feedback") > 0).cast("double"))
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}  # two numbers
    total = sum(n.values())
    if total < C.ML_MIN_SAMPLES or len(n) < 2 or min(n.values()) < C.ML_MIN_PER_CLASS:
        return None
    weight = F.when(F.col("label") == 1.0, total / (2.0 * n[1.0])).otherwise(total / (2.0 * n[0.0]))
    stages = [
        VectorAssembler(inputCols=FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(weightCol="weight", regParam=1.0 / total, standardization=False, maxIter=1000),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("weight", weight))


def predict(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """The rows with ``preference``; 0.5 without a model."""
    if model is None:
        return df.withColumn("preference", F.lit(0.5))
    scored = model.transform(features(df.withColumn("_row", F.struct("*"))))
    return scored.select("_row.*", vector_to_array("probability")[1].alias("preference"))


def boost(score: Column, preference: Column) -> Column:
    return F.bround(F.least(F.greatest(score + (preference - 0.5) * 30, F.lit(0.0)), F.lit(100.0)), 1)


def redelivered_once(df: DataFrame) -> DataFrame:
    """Rows that were delivered again count once."""
    return df.drop("loaded_at").distinct()

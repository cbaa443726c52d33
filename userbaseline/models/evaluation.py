"""How well predictions agree with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column, share: float = 1 / 3) -> Column:
    """Whether rows of a text key are kept back from training: equal keys always go together."""
    return F.substring(F.md5(key), 1, 4) < f"{int(share * 16**4):04x}"


def confusion_matrix(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n) for the pairs that occur."""
    return (
        predicted.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of labelled rows whose prediction is right."""
    right = F.when(F.col(label) == F.col(prediction), 1).otherwise(0)
    return predicted.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull()).agg(
        F.avg(right).alias("accuracy")
    )

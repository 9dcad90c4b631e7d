"""Retention, source audits and the fit of weights."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import stored

#: Distinct rows that one task descends on by itself.
ONE_FIT = 200_000


def cleared_texts(rows: DataFrame, row_id: str, text: str, applications: DataFrame, held: list[str] = ("applied", "shortlisted")) -> DataFrame:
    """rows with the text of those out of scope cleared, unless their status or an application holds them.
    Columns used: in_scope, status; applications has the row_id."""
    has = applications.select(F.col(row_id).alias("_a")).where("_a IS NOT NULL").distinct()
    out = rows.join(has, rows[row_id] == F.col("_a"), "left")
    goes = ~F.coalesce("in_scope", F.lit(False)) & ~F.coalesce(F.col("status").isin(*held), F.lit(False)) & F.col("_a").isNull()
    return out.withColumn(text, F.when(~goes, F.col(text))).select(*rows.columns)


def stale_payloads(payloads: DataFrame, payload_id: str, fetched: str, references: DataFrame, reference: str, as_of: Column, days: int = 90) -> DataFrame:
    """Payloads older than days that no kept row refers to."""
    kept = references.select(F.col(reference).alias("_r")).where("_r IS NOT NULL")
    old = payloads.where(F.col(fetched) < as_of - F.make_dt_interval(F.lit(days)))
    return old.join(kept, old[payload_id] == F.col("_r"), "left_anti")


def low_yield(rows: DataFrame, source: list[str], in_scope: Column, fed: Column, most: int = 3, rate: float = 0.01) -> DataFrame:
    """Sources with rows that never fed the queue and have none in scope, or few and rarely."""
    n, k = F.count("*"), F.count_if(in_scope)
    out = rows.groupBy(*source).agg(n.alias("n"), k.alias("n_in_scope"), F.coalesce(F.bool_or(fed), F.lit(False)).alias("fed"))
    return out.where(~F.col("fed") & ((F.col("n_in_scope") == 0) | ((F.col("n_in_scope") < most) & (F.col("n_in_scope") / F.col("n") < rate)))).drop("fed")


def reprobed(sources: DataFrame, as_of: Column, days: int = 14) -> DataFrame:
    """Sources disabled for a low yield more than days ago are enabled again.  Columns used: enabled,
    disabled_reason, disabled_at."""
    again = F.coalesce(~F.col("enabled") & (F.col("disabled_reason") == "low_yield") & (F.col("disabled_at") < as_of - F.make_dt_interval(F.lit(days))), F.lit(False))
    out = sources.withColumn("_again", again)
    return out.withColumns({"enabled": F.col("enabled") | F.col("_again"), "disabled_reason": F.when(~F.col("_again"), F.col("disabled_reason")), "disabled_at": F.when(~F.col("_again"), F.col("disabled_at"))}).drop("_again")


def fitted_weights(rows: DataFrame, features: list[str], label: str, l2: float = 0.5) -> dict[str, float]:
    """Coefficients of a logistic regression on standardised features, at the optimum of the mean
    loss plus l2 / (2 n) times the squared coefficients; the intercept is not penalised.  Rows with
    nulls are left out; with fewer than two classes there is nothing to learn: all 0."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    fine = rows.select(F.col(label).cast("double").alias("label"), *(F.col(c).cast("double").alias(c) for c in features)).dropna()
    n, classes = fine.agg(F.count("*"), F.count_distinct("label")).first()
    if classes < 2:
        return dict.fromkeys(features, 0.0)
    drawn = VectorAssembler(inputCols=features, outputCol="raw").transform(fine)
    scaled = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(drawn).transform(drawn)
    model = LogisticRegression(regParam=l2 * (n - 1) / n**2, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(scaled)
    # the scaler divides by the deviation of a sample; penalty and coefficients are brought to that of all rows
    return {c: float(w) * ((n - 1) / n) ** 0.5 for c, w in zip(features, model.coefficients)}


def gradient(x: np.ndarray, y: np.ndarray, count: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum over rows, each count times, of the error times the features; x ends with a column of ones."""
    error = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y
    return x.T @ (error * count)


def stepped(w: np.ndarray, g: np.ndarray, n: int, l2: float, rate: float) -> np.ndarray:
    """One step; the last weight, the intercept, is not penalised."""
    return w - rate * (g + l2 * np.r_[w[:-1], 0.0]) / n


def descended_weights(rows: DataFrame, features: list[str], label: str, l2: float = 0.5, steps: int = 800, rate: float = 0.1, one_fit: int = ONE_FIT) -> DataFrame:
    """(feature, weight) of a logistic regression on standardised features after so many steps of plain
    gradient descent from zero, which on labels that are nearly separable is far from the optimum of
    ``fitted_weights``.  Rows with nulls are left out; constant features are not scaled; without rows
    the weights are 0.

    Equal rows are counted together first.  Up to one_fit distinct rows go through all steps in one
    task; with more, every step is a pass of all tasks that brings one sum a feature to the driver."""
    fine = rows.select(F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features))).dropna()
    spark, names = rows.sparkSession, [f"x{i}" for i in range(len(features))]
    told = fine.agg(F.count("*").alias("n"), *(f(c) for c in names for f in (F.avg, F.stddev_pop))).first()
    n, mean, spread = told[0], [told[1 + 2 * i] for i in range(len(names))], [told[2 + 2 * i] or 1.0 for i in range(len(names))]
    zero = np.zeros(len(names) + 1)
    if not n:
        return spark.createDataFrame([(f, 0.0) for f in features], "feature string, weight double")
    alike = stored(fine.groupBy("y", *names).agg(F.count("*").alias("k")))

    def arrays(table):
        x = np.column_stack([*((table[c].to_numpy() - m) / s for c, m, s in zip(names, mean, spread)), np.ones(table.num_rows)])
        return x, table["y"].to_numpy(), table["k"].to_numpy().astype(float)

    if alike.count() <= one_fit:

        def descend(table):
            (x, y, k), w = arrays(table), zero
            for _ in range(steps):
                w = stepped(w, gradient(x, y, k, w), n, l2, rate)
            return pa.table({"feature": features, "weight": w[:-1]})

        return alike.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(descend, "feature string, weight double")
    w = zero
    for _ in range(steps):

        def partial(batches, w=w):
            g = np.zeros_like(w)
            for batch in batches:
                g += gradient(*arrays(batch), w)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(g)), pa.int32()), pa.array(g)], names=["i", "g"])

        sums = dict(alike.mapInArrow(partial, "i int, g double").groupBy("i").agg(F.sum("g")).collect())
        w = stepped(w, np.array([sums[i] for i in range(len(w))]), n, l2, rate)
    return spark.createDataFrame(list(zip(features, w[:-1].tolist())), "feature string, weight double")

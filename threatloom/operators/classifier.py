"""The structural classifier: training, thresholds, adoption."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features that a host alone has; the others keep fixed weights.
FITTED = ("punycode", "abused_tld_f", "many_subdomains", "host_digits_ratio", "host_hyphens", "lure_tokens", "brand_in_subdomain")


def held_out(key: str = "host"):
    """A fifth of the rows, by a digest of their key."""
    return F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("long") % 5 == 0


def train(labelled: DataFrame, features: tuple[str, ...] = FITTED, l2: float = 0.001) -> dict:
    """Non-negative L2 logistic regression on distinct feature vectors of the rows that aren't held out, weighted by
    their counts: {"bias", "weights", "n_rows"}, rounded to four places."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import Matrices

    rows = labelled.where(~held_out()).groupBy(*features, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    vectors = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    zero = Matrices.dense(1, len(features), [0.0] * len(features))
    model = LogisticRegression(regParam=l2, elasticNetParam=0.0, standardization=False, weightCol="weight", family="binomial", maxIter=200, tol=1e-9, lowerBoundsOnCoefficients=zero).fit(vectors)
    return {"bias": round(float(model.intercept), 4), "weights": {k: round(float(w), 4) for k, w in zip(features, model.coefficients)}, "n_rows": labelled.count()}


def apply(rows: DataFrame, model: dict, column: str) -> DataFrame:
    """``rows`` with the probability that a model gives, rounded to hundredths; 0 on trusted roots."""
    z = " + ".join([f"{model['bias']}D", *(f"{k} * {w}D" for k, w in model["weights"].items())])
    return rows.withColumn(column, F.expr(f"CASE WHEN trusted THEN 0D ELSE floor(1 / (1 + exp(-({z}))) * 100 + 0.5D) / 100 END"))


def thresholds(scored: DataFrame, at: tuple[float, ...] = (0.8, 0.92)) -> DataFrame:
    """Confusion and rates of (label, probability) at each threshold; the thresholds are a literal array."""
    rows = scored.select("label", "probability", F.explode(F.array(*map(F.lit, at))).alias("threshold"))
    hit, bad = F.col("probability") >= F.col("threshold"), F.col("label") == 1
    out = rows.groupBy("threshold").agg(F.count_if(hit & bad).alias("tp"), F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & ~bad).alias("tn"), F.count_if(~hit & bad).alias("fn"))
    rate = lambda a, b: F.floor(F.when(b > 0, a / b).otherwise(0.0) * 10000 + 0.5) / 10000
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    return out.withColumns({"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "fpr": rate(fp, fp + tn), "accuracy": rate(tp + tn, tp + fp + tn + fn)})


def adopt_gate(scored: DataFrame, threshold: float = 0.8, least: int = 120) -> DataFrame:
    """Whether a new model (p_new) replaces the old one (p_old): recall up by 0.02, precision not down by
    0.02, no more false alarms on sign-in pages (is_login), enough rows of both classes."""
    bad = F.col("label") == 1
    new, old = F.col("p_new") >= threshold, F.col("p_old") >= threshold
    out = scored.agg(
        F.count_if(bad).alias("n_bad"), F.count_if(~bad).alias("n_good"),
        *[F.count_if(hit & bad).alias(f"tp_{k}") for k, hit in (("new", new), ("old", old))],
        *[F.count_if(hit & ~bad).alias(f"fp_{k}") for k, hit in (("new", new), ("old", old))],
        *[F.count_if(hit & ~bad & F.col("is_login")).alias(f"login_fp_{k}") for k, hit in (("new", new), ("old", old))],
    )
    for k in ("new", "old"):
        tp, fp = F.col(f"tp_{k}"), F.col(f"fp_{k}")
        out = out.withColumns({f"recall_{k}": F.when(F.col("n_bad") > 0, tp / F.col("n_bad")).otherwise(0.0), f"precision_{k}": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)})
    return out.withColumn("adopt", F.expr(f"n_bad >= {least} AND n_good >= {least} AND recall_new > recall_old + 0.02 AND precision_new >= precision_old - 0.02 AND login_fp_new <= login_fp_old"))

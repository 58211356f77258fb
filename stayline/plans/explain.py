"""Additive attributions of a linear model, in long form (key, feature, value, phi)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.functions.ordering import number_array
from stayline.operators.limits import top_contributions
from stayline.operators.text import snippet
from stayline.plans.models import score


def background_mean(df: DataFrame, features: str = "features", k: int = 50, seed: int = 42) -> list[float]:
    """Mean of the k-means centres, the background a linear explanation compares with."""
    centres = KMeans(featuresCol=features, k=k, seed=seed).fit(df.select(features)).clusterCenters()
    return [float(sum(c[i] for c in centres) / len(centres)) for i in range(len(centres[0]))]


def linear_attribution(
    df: DataFrame, key: str, features, names: Sequence[str], coefficients: Sequence[float], background: Sequence[float]
) -> DataFrame:
    """phi = coefficient * (value - background mean) per row and feature.

    `features` is a vector column or an array expression; the constants are one small array each.
    """
    values = vector_to_array(features) if isinstance(features, str) else features
    labels = F.split(F.lit("\x1f".join(names)), "\x1f")
    # the outer form: the plain one would compute the values once more for a size filter
    long = df.select(key, F.posexplode_outer(values).alias("_i", "value"))
    at = F.col("_i") + 1
    phi = F.element_at(number_array(coefficients), at) * (F.col("value") - F.element_at(number_array(background), at))
    return long.select(key, F.element_at(labels, at).alias("feature"), "value", phi.alias("phi"))


def base_value(intercept: float, coefficients: Sequence[float], background: Sequence[float]) -> float:
    return intercept + sum(c * b for c, b in zip(coefficients, background))


def global_importance(phi: DataFrame) -> DataFrame:
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance")).orderBy(F.desc("importance"), "feature")


def _shifted(features, coefficients: Sequence[float], background: Sequence[float]) -> Column:
    values = vector_to_array(features) if isinstance(features, str) else features
    terms = F.arrays_zip(values.alias("x"), number_array(coefficients).alias("c"), number_array(background).alias("m"))
    return F.transform(terms, lambda t: t["c"] * (t["x"] - t["m"]))


def vector_importance(
    df: DataFrame, features, names: Sequence[str], coefficients: Sequence[float], background: Sequence[float]
) -> DataFrame:
    """(feature, importance): mean absolute attribution of every feature, added up as vectors.

    No row per row and feature is made: each task keeps one vector of sums, and one comes to the driver.
    """
    phi = df.select(F.lit(0).alias("all"), array_to_vector(_shifted(features, coefficients, background)).alias("phi"))
    sums = phi.groupBy("all").agg(Summarizer.metrics("normL1", "count").summary(F.col("phi")).alias("s"))  # no row for no rows
    found = sums.select("s.normL1", "s.count").first()
    rows = [(name, float(total) / found["count"]) for name, total in zip(names, found["normL1"])] if found else []
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def chosen_attributions(
    df: DataFrame, key: str, features, names: Sequence[str], coefficients: Sequence[float], background: Sequence[float],
    wanted: Iterable[str],
) -> DataFrame:
    """(key, feature, value, phi) of the wanted features alone, in whatever order; unknown names give no rows."""
    place = {n: i for i, n in enumerate(names)}
    at = [place[w] for w in dict.fromkeys(wanted) if w in place]
    values = vector_to_array(features) if isinstance(features, str) else features
    picked = F.array(*[
        F.struct(
            F.lit(names[i]).alias("feature"), F.get(F.col("_x"), F.lit(i)).alias("value"),
            (F.lit(float(coefficients[i])) * (F.get(F.col("_x"), F.lit(i)) - F.lit(float(background[i])))).alias("phi"),
        )
        for i in at
    ]) if at else F.array().cast("array<struct<feature:string,value:double,phi:double>>")
    return df.select(key, values.alias("_x")).select(key, F.inline(picked))


def row_attribution(phi: DataFrame, key: str, value, base: float) -> DataFrame:
    """All contributions of one row, largest first, with the base value they add to."""
    return phi.filter(F.col(key) == value).withColumn("base", F.lit(float(base))).orderBy(F.desc(F.abs("phi")), "feature")


def dependence_table(phi: DataFrame, key: str, features: Iterable[str], interaction: str | None = None) -> DataFrame:
    """(key, feature, value, phi, interaction value) of the chosen features; unknown names give no rows."""
    chosen = phi.filter(F.col("feature").isin(*features))
    if interaction is None:
        return chosen.withColumn("interaction", F.col("value"))
    other = phi.filter(F.col("feature") == interaction).select(key, F.col("value").alias("interaction"))
    return chosen.join(other, key, "left")


def token_contributions(phi: DataFrame, key: str, matched: DataFrame) -> DataFrame:
    """Summed phi and presence per row over the features matched to a token; `matched` is (token, feature)."""
    return phi.join(matched, "feature").groupBy("token", key).agg(
        F.sum("phi").alias("phi_token"), (F.sum("value") > 0).alias("present")
    )


def token_story(
    contributions: DataFrame, rows: DataFrame, key: str, token: str, text: str, n: int = 15, extra: Iterable[str] = (),
    model=None,
) -> DataFrame:
    """The n most positive and negative rows among those that contain the token, with snippets.

    With a `model`, `prob` is its probability for these rows; `rows` then hold its features.
    """
    mine = contributions.filter((F.col("token") == token) & F.col("present")).select(key, "phi_token")
    extra = list(extra)
    top = top_contributions(mine, "phi_token", key, n)
    # at most 2n rows meet the texts
    found = rows.join(F.broadcast(top), key)
    if model is not None:
        found, extra = score(model, found), [*extra, "prob"]
    return found.select(key, "side", "phi_token", *extra, snippet(text, token).alias("snippet"))

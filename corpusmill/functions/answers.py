"""Scores of single answers: token F1 in the JVM, and the JSON check, which follows json.loads and so needs Python."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import bound, tokens


def token_f1(prediction: str, reference: str) -> Column:
    """Harmonic mean of word precision and recall; repeated words count as often as they occur. 0 when a side is missing.

    The words of both sides are sorted together, those of the prediction first among equals, and one pass counts how many of
    the reference's find a partner.
    """

    def shared(sides: Column) -> Column:
        ours = F.transform(sides["p"], lambda w: F.struct(w.alias("w"), F.lit(0).alias("side")))
        theirs = F.transform(sides["r"], lambda w: F.struct(w.alias("w"), F.lit(1).alias("side")))
        start = F.struct(F.lit("").alias("w"), F.lit(0).alias("free"), F.lit(0).alias("found"))

        def step(seen: Column, entry: Column) -> Column:
            free = F.when(seen["w"] == entry["w"], seen["free"]).otherwise(0)
            partner = ((entry["side"] == 1) & (free > 0)).cast("int")
            return F.struct(
                entry["w"].alias("w"),
                (free + F.when(entry["side"] == 0, 1).otherwise(-partner)).alias("free"),
                (seen["found"] + partner).alias("found"),
            )

        return F.aggregate(F.sort_array(F.concat(ours, theirs)), start, step, lambda seen: seen["found"])

    def score(sides: Column) -> Column:
        words = F.size(sides["p"]) + F.size(sides["r"])
        return F.when(words == 0, F.lit(1.0)).otherwise(2.0 * shared(sides) / words)

    sides = F.struct(tokens(F.col(prediction)).alias("p"), tokens(F.col(reference)).alias("r"))
    missing = F.col(prediction).isNull() | F.col(reference).isNull()
    return F.when(missing, F.lit(0.0)).otherwise(bound(sides, score))


def _parses(text: str | None) -> bool:
    try:
        json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(T.BooleanType())
def is_json(text: pd.Series) -> pd.Series:
    return text.map(_parses).astype(bool)

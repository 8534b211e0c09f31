"""Word runs and subsequences that two texts share, for BLEU and ROUGE."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import tokens

ORDERS = 4  # word runs of one to four words


def clipped(left: list[str], right: list[str], n: int) -> int:
    """Runs of ``n`` words that both have, each as often as the side that has it less often."""
    sides = [Counter(zip(*(words[k:] for k in range(n)))) for words in (left, right)]
    return (sides[0] & sides[1]).total()


def common_subsequence(left: list[str], right: list[str]) -> int:
    """Length of the longest common subsequence. A row of the table is one whole number: a clear bit marks a place where it grows."""
    places: dict[str, int] = {}
    for i, word in enumerate(left):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for word in right:
        meets = row & places.get(word, 0)
        row = (row + meets | row - meets) & full
    return len(left) - row.bit_count()


_NAMES = [*(f"shared_{n}" for n in range(1, ORDERS + 1)), "subsequence"]


@F.pandas_udf(T.StructType([T.StructField(name, T.LongType()) for name in _NAMES]))
def _shared(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    rows = []
    for a, b in zip(left, right):
        a, b = list(a), list(b)
        rows.append((*(clipped(a, b, n) for n in range(1, ORDERS + 1)), common_subsequence(a, b)))
    return pd.DataFrame(rows, columns=_NAMES)


def shared_runs(prediction: str, reference: str) -> Column:
    """A struct of shared_1 to shared_4 and subsequence; a missing side has no words."""
    words = lambda name: F.coalesce(tokens(F.col(name)), F.array().cast("array<string>"))
    return _shared(words(prediction), words(reference))

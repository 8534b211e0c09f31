"""Augmentation, balancing and splits. Every choice is a hash of the row, so reruns agree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import WHITESPACE, stable_hash
from corpusmill.operators.position import SEGMENT, with_position

# Words and what may stand in for them.
SYNONYMS = {
    "good": ("great", "excellent", "fine"),
    "great": ("good", "excellent", "wonderful"),
    "explain": ("describe", "elaborate", "clarify"),
    "describe": ("explain", "illustrate", "depict"),
    "fast": ("quick", "rapid", "swift"),
    "quick": ("fast", "rapid", "speedy"),
    "big": ("large", "huge", "enormous"),
    "large": ("big", "huge", "vast"),
    "small": ("tiny", "little", "compact"),
    "important": ("significant", "crucial", "vital"),
    "simple": ("easy", "basic", "straightforward"),
    "hard": ("difficult", "tough", "challenging"),
    "show": ("display", "present", "demonstrate"),
    "make": ("create", "build", "produce"),
    "use": ("utilize", "employ", "apply"),
    "help": ("assist", "aid", "support"),
}

COPIES_PER_BLOCK = 10_000


def swap_synonyms(text: Column, seed: Column, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> Column:
    """Replace known words; white space collapses to single spaces, an initial capital stays.

    ``seed`` and the place of the word decide which synonym is taken.
    """
    table = F.create_map(
        *[c for word, others in synonyms.items() for c in (F.lit(word), F.array(*[F.lit(o) for o in others]))]
    )

    def swap(word: Column, place: Column) -> Column:
        options = F.try_element_at(table, F.lower(word))
        pick = F.element_at(options, (stable_hash(seed, place) % F.size(options) + 1).cast("int"))
        first = F.substring(word, 1, 1)
        cased = F.when((first == F.upper(first)) & (first != F.lower(first)), F.initcap(pick)).otherwise(pick)
        return F.when(options.isNull(), word).otherwise(cased)

    words = F.filter(F.split(text, f"{WHITESPACE}+"), lambda w: w != "")
    return F.array_join(F.transform(words, swap), " ")


def _copies(df: DataFrame, copies: Column) -> DataFrame:
    """Repeat rows ``copies`` times, numbered from 0 in ``copy``.

    A row that needs very many copies is first spread over blocks, so no task writes them all.
    """
    blocks = F.ceil(F.col("_copies") / COPIES_PER_BLOCK)
    spread = (
        df.withColumn("_copies", copies)
        .where(F.col("_copies") > 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .repartition(F.col("_block"), *[F.col(c) for c in df.columns if c.startswith("_key")])
    )
    first = F.col("_block") * COPIES_PER_BLOCK
    last = F.least(first + COPIES_PER_BLOCK, F.col("_copies")) - 1
    return spread.withColumn("copy", F.explode(F.sequence(first, last))).drop("_copies", "_block")


def augment_synonyms(
    df: DataFrame,
    *,
    id_column: str,
    target_multiplier: float = 2.0,
    preserve_originals: bool = True,
    seed: int = 0,
    segment: int = SEGMENT,
) -> DataFrame:
    """Synonym variants of the rows, round-robin in ``id_column`` order, until the data set holds
    ``int(rows * target_multiplier)`` rows. ``copy`` is 0 for originals, then 1, 2, ..."""
    placed = with_position(df, order_by=id_column, segment=segment, name="_position", total="_total")
    target = F.floor(F.col("_total") * F.lit(float(target_multiplier))).cast("long")
    needed = target - F.col("_total") if preserve_originals else target
    # Row p gets one variant in every full round and one more when p falls into the last, partial one.
    rounds = F.greatest(F.ceil((needed - F.col("_position")) / F.col("_total")), F.lit(0)).cast("long")
    repeated = _copies(placed.withColumn("_key", F.col(id_column)), rounds).withColumn("copy", F.col("copy") + 1)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    variants = repeated.withColumns(
        {name: swap_synonyms(F.col(name), F.concat_ws("|", F.lit(seed), id_column, "copy", F.lit(name))) for name in texts}
    ).select(*df.columns, "copy")
    if not preserve_originals:
        return variants
    return df.withColumn("copy", F.lit(0).cast("long")).unionByName(variants)


def balance_categories(
    df: DataFrame, *, category: str, id_column: str, target_multiplier: float = 2.0, segment: int = SEGMENT
) -> DataFrame:
    """The copies that bring every category to ``int(largest * target_multiplier)`` rows, taken in
    turn from its rows. Rows without a category take no part."""
    rows = df.where(F.col(category).isNotNull())
    placed = with_position(
        rows, order_by=id_column, within=[category], segment=segment, name="_position", total="_total"
    )
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.agg(F.max("_n").alias("_largest")).withColumn("_one", F.lit(1))
    joined = placed.withColumn("_one", F.lit(1)).join(F.broadcast(largest), "_one").drop("_one")  # one row
    needed = F.floor(F.col("_largest") * F.lit(float(target_multiplier))).cast("long") - F.col("_total")
    copies = F.greatest(F.ceil((needed - F.col("_position")) / F.col("_total")), F.lit(0)).cast("long")
    return _copies(joined.withColumn("_key", F.col(id_column)), copies).select(*df.columns, "copy")


def with_balanced(df: DataFrame, **options) -> DataFrame:
    """Originals followed by the balancing copies."""
    return df.withColumn("copy", F.lit(-1).cast("long")).unionByName(balance_categories(df, **options))


def holdout_split(df: DataFrame, *, id_column: str, ratio: float = 0.1, seed: int = 0) -> DataFrame:
    """Mark each row ``train`` or ``test`` by a hash of its id: stable under any partitioning."""
    bucket = stable_hash(F.lit(seed), F.col(id_column)) % 1000
    return df.withColumn("split", F.when(bucket < int(ratio * 1000), "test").otherwise("train"))


def comparison_sample(df: DataFrame, *, id_column: str, size: int = 50, seed: int = 0) -> DataFrame:
    """A repeatable sample of ``size`` rows, as a top-k on the hash."""
    rank = stable_hash(F.lit(seed), F.col(id_column))
    return df.withColumn("_rank", rank).orderBy("_rank", id_column).limit(size).drop("_rank")

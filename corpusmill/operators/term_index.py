"""An inverted index over all words, searched with upper bounds.

Postings say which text holds a term and how much it weighs there, as a share of the text's length (so a score is a cosine); every term knows its greatest
share. A query's rarest terms are looked up first; their sums bound its k-th best score from below. Terms whose greatest contributions together stay
below that bound cannot bring in a text by themselves, so the long lists of common words are not opened to find candidates. Candidates whose sum
plus those contributions stays below the bound drop out, and the rest is looked up for the candidates alone, by (term, text).

The index is kept by text: its words in order and their weights, with the length. Words are counted inside a row, and texts are dealt to blocks of
bounded size, each with a dictionary of its words, so that a word's document frequency travels once per block and not once per posting.
A search opens the postings of the words that are asked for.

Weights are whole numbers (``SCALE`` times the inverse document frequency, times the count), so sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import bound
from corpusmill.session import stored

WORD_BREAK = r"[^\p{L}\p{N}]+"
SCALE = 1_000
SEEDS = 4  # terms of a query that are looked up for its bound
HOT_POSTINGS = 1 << 16  # a longer list is dealt to several keys
SCORE_PLACES = 9
SLACK = 1e-9
BLOCK_BYTES = 32 << 20  # text of a block, about
LEFT_SHUT = 0.3  # share of the bound that the terms left unopened may add; the smaller, the fewer candidates are looked up


@dataclass(frozen=True)
class TermIndex:
    """``texts``: doc, terms (in order, joined by spaces), weights, length. ``terms``: term, idf, salts."""

    texts: DataFrame
    terms: DataFrame


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def _counts(texts: DataFrame, key: str, content: str) -> DataFrame:
    return texts.select(F.col(key).alias("doc"), F.explode(words(F.col(content))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))


def _shares(weighted: DataFrame) -> DataFrame:
    """Rows of doc, term, weight with ``share``: the weight over the length of the text's weights."""
    length = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    return weighted.join(length, "doc").withColumn("share", F.col("weight") / F.col("length"))


def _bags(rows: DataFrame) -> DataFrame:
    """doc, terms (in order, joined by spaces) and counts of texts with words; ``rows`` has doc and words. Rows of one doc are one text, rows without doc stay apart."""
    ids = rows.where("doc IS NOT NULL").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    repeated = stored(ids.select("doc"), "repeated-docs")

    def counted(held: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(held)), lambda i: (i == F.size(held)) | (i == 0) | (F.get(held, i) != F.get(held, i - 1)))
        terms = lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda i: F.get(held, i))
        counts = lambda at: F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, k: F.get(at, k + 1) - i)
        return bound(first, lambda at: F.struct(F.array_join(terms(at), " ").alias("terms"), counts(at).alias("counts")))

    def once(singles: DataFrame) -> DataFrame:
        bags = singles.where("size(words) > 0").select("doc", bound(F.array_sort("words"), counted).alias("bag"))
        return bags.select("doc", "bag.terms", "bag.counts")

    if repeated.isEmpty():
        return once(rows)
    merged = rows.join(repeated, "doc", "left_semi").select("doc", F.explode("words").alias("term")).groupBy("doc", "term").agg(F.count("*").cast("int").alias("n"))
    bags = merged.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("_l"))  # one text's words
    bags = bags.select("doc", F.array_join("_l.term", " ").alias("terms"), F.col("_l.n").alias("counts"))
    return once(rows.join(repeated, "doc", "left_anti")).unionByName(bags)


def _weigh(key: tuple, bags: pa.Table, dictionary: pa.Table) -> pa.Table:
    """The texts of a block with the weights of their terms and their length; terms that weigh nothing go."""
    split = pc.split_pattern(bags.column("terms").combine_chunks(), " ")
    terms, sizes = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
    counts = bags.column("counts").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    at = pc.index_in(terms, value_set=dictionary.column("term").combine_chunks()).to_numpy(zero_copy_only=False)
    weights = counts * dictionary.column("idf").to_numpy()[at]
    text = np.repeat(np.arange(len(sizes)), sizes)
    kept = weights > 0
    left = np.bincount(text[kept], minlength=len(sizes))
    length = np.sqrt(np.bincount(text, weights * weights, minlength=len(sizes)))
    ends = np.r_[0, np.cumsum(left)].astype("int32")
    held = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), terms.filter(pa.array(kept))), " ")
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(weights[kept]))
    done = pa.table({"doc": bags.column("doc"), "terms": held, "weights": lists, "length": pa.array(length)})
    return done.filter(pa.array(left > 0))


def build_term_index(texts: DataFrame, *, key: str = "chunk_id", content: str = "content") -> TermIndex:
    """Index all words of all texts. Null and empty texts have none. A word that all texts hold weighs nothing and is left out."""
    rows = texts.select(F.col(key).alias("doc"), F.col(content).alias("content"))
    total, size = rows.agg(F.count("*"), F.sum(F.octet_length("content"))).first()
    blocks = int((size or 0) // BLOCK_BYTES) + 1
    rows = rows.select("doc", F.coalesce(words(F.col("content")), F.array().cast("array<string>")).alias("words"))
    bags = _bags(rows).withColumn("block", F.expr(f"pmod(xxhash64(doc, terms), {blocks})").cast("int"))
    bags = stored(bags.repartition(blocks, "block"), "term-counts")
    unnamed = bags.where("doc IS NULL")
    named = bags.where("doc IS NOT NULL")
    found = named.select("block", F.explode(F.split("terms", " ")).alias("term")).groupBy("block", "term").agg(F.count("*").alias("n"))
    found = stored(found, "block-terms")
    unnamed = unnamed.select(F.explode(F.split("terms", " ")).alias("term")).distinct().select("term", F.lit(1).cast("long").alias("n"))  # texts without id are one
    df = found.select("term", "n").unionByName(unnamed).groupBy("term").agg(F.sum("n").alias("df"))
    idf = F.round(SCALE * F.log((F.lit(total) + 1) / (F.col("df") + 1))).cast("double")
    salts = F.ceil(F.col("df") / HOT_POSTINGS).cast("int")
    terms = stored(df.select("term", idf.alias("idf"), salts.alias("salts")), "terms")
    dictionary = found.select("block", "term").join(terms.select("term", "idf"), "term")
    kind = dict(bags.dtypes)["doc"]
    weighed = named.groupBy("block").cogroup(dictionary.groupBy("block"))
    weighed = weighed.applyInArrow(_weigh, f"doc {kind}, terms string, weights array<double>, length double")
    return TermIndex(stored(weighed, "postings"), terms.where("idf > 0"))


def _postings(index: TermIndex, asked: DataFrame) -> DataFrame:
    """term, salt, doc and share of the postings of the terms in ``asked`` (term, salts)."""
    each = index.texts.select("doc", "length", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), "weights")).alias("e"))
    each = each.select("doc", F.col("e.term").alias("term"), (F.col("e.weights") / F.col("length")).alias("share")).join(asked, "term")
    return stored(each.select("term", F.expr("pmod(xxhash64(doc), salts)").cast("int").alias("salt"), "doc", "share"), "postings")


def _contributions(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, doc, part): what the terms of ``asked`` (query_id, term, salts, weight) add to the score of texts that hold them."""
    dealt = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    return dealt.join(postings, ["term", "salt"]).select("query_id", "doc", (F.col("mine") * F.col("share")).alias("part"))


def search_terms(index: TermIndex, queries: DataFrame, *, k: int, key: str = "query_id", content: str = "content") -> DataFrame:
    """The ``k`` texts of highest cosine for every query: query_id, chunk_id, score, rank; ties go by chunk_id.

    A hit shares at least one weighing word with its query, so a query may have fewer than ``k``, or none if no text knows its words.
    """
    mine = stored(_counts(queries, key, content).join(index.terms, "term").withColumn("weight", F.col("n") * F.col("idf")), "asked-words")
    postings = _postings(index, mine.select("term", "salts").distinct())
    tops = postings.groupBy("term").agg(F.max("share").alias("top"))
    asked = _shares(mine).join(tops, "term")
    asked = asked.select(F.col("doc").alias("query_id"), "term", "salts", F.col("share").alias("mine"), (F.col("share") * F.col("top")).alias("most"))
    falling = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
    rising = Window.partitionBy("query_id").orderBy("most", F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = stored(asked.withColumns({"nth": F.row_number().over(falling), "below": F.sum("most").over(rising)}), "asked-terms")

    def ranked(scores: DataFrame, score: str) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc(score), "doc")
        return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    seeds = _contributions(postings, asked.where(F.col("nth") <= SEEDS)).groupBy("query_id", "doc").agg(F.sum("part").alias("sum"))
    bounds = ranked(seeds, "sum").where(F.col("rank") == k).select("query_id", (F.col("sum") - SLACK).alias("bound"))
    marked = asked.join(bounds, "query_id", "left").withColumn("opens", F.coalesce(F.col("below") >= LEFT_SHUT * F.col("bound"), F.lit(True)))
    marked = stored(marked, "marked-terms")
    unopened = marked.where(~F.col("opens"))
    rest = marked.groupBy("query_id").agg(F.max("bound").alias("bound"), F.coalesce(F.sum(F.when(~F.col("opens"), F.col("most"))), F.lit(0.0)).alias("rest"))
    opened = _contributions(postings, marked.where("opens")).groupBy("query_id", "doc").agg(F.sum("part").alias("sum"))
    opened = stored(opened, "opened-sums")
    better = ranked(opened, "sum").where(F.col("rank") == k).select("query_id", (F.col("sum") - SLACK).alias("better"))
    opened = opened.join(rest.join(better, "query_id", "left"), "query_id")
    candidates = opened.where(F.coalesce(F.col("sum") + F.col("rest") + SLACK >= F.greatest("bound", "better"), F.lit(True))).select("query_id", "doc", "sum")
    looked = candidates.join(unopened.select("query_id", "term", "mine"), "query_id").join(postings.select("term", "doc", "share"), ["term", "doc"])
    added = looked.groupBy("query_id", "doc").agg(F.sum(F.col("mine") * F.col("share")).alias("added"))
    score = F.round(F.col("sum") + F.coalesce("added", F.lit(0.0)), SCORE_PLACES)
    scored = candidates.join(added, ["query_id", "doc"], "left").select("query_id", "doc", score.alias("score"))
    return ranked(scored, "score").select("query_id", F.col("doc").alias("chunk_id"), "score", "rank")


def term_vectors(index: TermIndex) -> DataFrame:
    """The texts' weights as vectors over their own terms, in the order of the terms: chunk_id, terms, vector."""
    return index.texts.select(F.col("doc").alias("chunk_id"), F.split("terms", " ").alias("terms"), F.col("weights").alias("vector"))

"""Line dedup with a log-template tree.

Every line goes down a tree of fixed depth: its number of tokens, then its ``LEADING`` first tokens. Tokens with a digit are variable
fields, ``<*>``. Inside a leaf that enough documents reach, the token that most of its different lines have at a position is constant there; a line
that agrees with ``AGREE`` of the leaf's positions has the leaf's template, with its other tokens as variable fields. Lines that do not fit go
one level down, ``LEVELS`` at most: where some fitted, the others are a node of their own, else each line follows the token that it shares with most
others of its node, but not with all. A line that fits nowhere is its own template. Constants come from counts, so the
tree does not depend on the order of lines or on copies, and no leaf is gathered anywhere.

A template recurs if it is in at least ``MIN_DOCUMENTS`` documents that are not copies of one another. Copies are told by
sketches: the smallest leaf hash of a document's lines under a few hash functions. Copies, near ones too, mostly
agree in a sketch; unrelated documents that share a passage do not. Where copies are many, the documents are counted that are
alone with at least half of their sketches, and each group of copies once. Lines of recurring templates are dropped.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage, in_parts

LEADING = 3
AGREE = 0.8
#: Nodes on the way down from a leaf, the leaf included.
LEVELS = 4
MIN_DOCUMENTS = 5
#: Of the documents with a template, the share that are no copies of others, for any sketch to tell them apart alone.
MIN_UNRELATED = 0.5
SKETCHES = 8
SALTS = 32
VARIABLE = "<*>"
#: Tokens of different lines that one task takes on the way down the tree.
TOKENS_PER_TASK = 400_000


WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: A whole token with a digit; it is tried at starts of tokens only, so a token is read once however long it is.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _masked(line: Column) -> Column:
    """A line without white space at its ends and with its variable fields masked."""
    inner = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.when(line.rlike("[0-9]"), F.regexp_replace(inner, FIELD, VARIABLE)).otherwise(inner)


def _least_leaf(entries: str, seed: int) -> Column:
    """The smallest hash of any line's leaf under one hash function."""
    return F.array_min(F.transform(entries, lambda e: F.xxhash64(e["leaf"], F.lit(seed))))


def parsed(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, sketches, and entries of n (place of the line), leaf and own (hash of the masked line) for lines that are not blank."""
    rows = docs.select("doc_id", F.transform(F.split("text", "\n"), _masked).alias("_masked")).where("doc_id IS NOT NULL")

    def entry(line: Column, n: Column) -> Column:
        leading = F.slice(F.split(line, WORD_BREAKS, LEADING + 1), 1, LEADING)
        leaf = F.xxhash64(F.regexp_count(line, F.lit(WORD_BREAKS)), leading)
        return F.when(line != "", F.struct(n.alias("n"), leaf.alias("leaf"), F.xxhash64(line).alias("own")))

    rows = rows.select("doc_id", F.filter(F.transform("_masked", entry), lambda e: e.isNotNull()).alias("entries"))
    return rows.select("doc_id", "entries", F.array(*[_least_leaf("entries", k) for k in range(SKETCHES)]).alias("sketches"))


def _constants(counts: DataFrame) -> DataFrame:
    """node and its constants, null where no token has a majority. ``counts``: node, p, token and n, the lines with the token there."""
    best = counts.groupBy("node", "p").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("lines"))
    constant = F.when(2 * F.col("top.n") > F.col("lines"), F.col("top.token"))
    parts = best.select("node", F.struct("p", constant.alias("token")).alias("part"))
    return parts.groupBy("node").agg(F.transform(F.sort_array(F.collect_list("part")), lambda e: e["token"]).alias("constants"))


def _token_counts(lines: DataFrame) -> DataFrame:
    return lines.select("node", F.posexplode("tokens").alias("p", "token")).groupBy("node", "p", "token").agg(F.count("*").alias("n"))


def _below(judged: DataFrame, size: int) -> DataFrame:
    """The lines that do not fit, under their nodes of the next level. Lines that share no token with a part of their node go. ``size``: tokens of all lines."""
    nodes = judged.groupBy("node").agg(F.count_if("fits").alias("fitted"), F.count_if(~F.col("fits")).alias("others")).where("others > 1")
    rest = judged.where("NOT fits").join(nodes, "node").select("leaf", "own", "node", "tokens", "fitted", "others")
    rest = in_parts(cut_lineage(rest), size, TOKENS_PER_TASK)
    again = rest.where("fitted > 0").select("leaf", "own", F.xxhash64("node", F.lit("others")).alias("node"), "tokens")
    split = rest.where("fitted = 0")
    shared = _token_counts(split).where("n > 1")
    each = split.select("node", "own", "others", F.posexplode("tokens").alias("p", "token")).join(shared, ["node", "p", "token"]).where("n < others")
    most = each.groupBy("node", "own").agg(F.max(F.struct("n", (-F.col("p")).alias("p"), "token")).alias("most"))
    most = in_parts(cut_lineage(most), size, TOKENS_PER_TASK)
    down = split.join(most, ["node", "own"]).select("leaf", "own", F.xxhash64("node", "most.p", "most.token").alias("node"), "tokens")
    return again.unionByName(down)


def _templates(docs: DataFrame, within: DataFrame) -> DataFrame:
    """leaf, own and template of the lines that fit a node. Tokens are fetched once for each kind of line, and a kind counts once."""
    kinds = within.groupBy("leaf", "own").agg(F.min(F.struct("doc_id", "n")).alias("at"))
    several = kinds.groupBy("leaf").agg(F.count("*").alias("kinds")).where("kinds > 1").select("leaf")
    wanted = kinds.join(several, "leaf", "left_semi").groupBy("at.doc_id").agg(F.collect_list(F.struct("at.n", "leaf", "own")).alias("_wanted"))
    lines = docs.select("doc_id", "text").where("doc_id IS NOT NULL").join(wanted, "doc_id")
    fetched = lines.select(F.split("text", "\n").alias("_lines"), F.explode("_wanted").alias("e"))
    tokens = fetched.select("e.leaf", "e.own", F.split(_masked(F.get("_lines", F.col("e.n"))), WORD_BREAKS).alias("tokens"))
    agree = F.size(F.filter(F.zip_with("tokens", "constants", lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False))))
    found, lines = [], cut_lineage(tokens.dropDuplicates(["leaf", "own"]))
    size = lines.agg(F.sum(F.size("tokens"))).first()[0] or 0  # of all levels: lines only get fewer on the way down
    lines = lines.withColumn("node", F.col("leaf"))
    for level in range(LEVELS):
        lines = in_parts(lines, size, TOKENS_PER_TASK)
        judged = lines.join(_constants(_token_counts(lines)), "node").select("leaf", "own", "node", "tokens", (agree >= AGREE * F.size("tokens")).alias("fits"))
        judged = in_parts(cut_lineage(judged), size, TOKENS_PER_TASK)
        found.append(judged.where("fits").select("leaf", "own", F.xxhash64("node", F.lit("template")).alias("_template")))
        if level + 1 < LEVELS:
            lines = cut_lineage(_below(judged, size))
    return functools.reduce(DataFrame.unionByName, found)


def _recurring(told: DataFrame, documents: DataFrame) -> DataFrame:
    """Templates in enough documents that are not copies of one another."""
    once = told.select("template", "doc_id").distinct()
    often = once.groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCUMENTS).select("template")
    rows = once.join(often, "template", "left_semi").join(documents.select("doc_id", "sketches").dropDuplicates(["doc_id"]), "doc_id")
    rows = rows.select("template", "doc_id", F.posexplode("sketches").alias("k", "sketch"))
    families = rows.groupBy("template", "k", "sketch").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    found = families.groupBy("template", "k").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.count_if(F.col("n") > 1).alias("groups"))
    enough = (F.col("kinds") >= MIN_DOCUMENTS) & (F.col("kinds") >= MIN_UNRELATED * F.col("n"))
    found = found.groupBy("template").agg(F.max(enough).alias("enough"), F.max("kinds").alias("kinds"), F.min("groups").alias("groups"))
    found = cut_lineage(found.where(F.col("enough") | (2 * F.col("kinds") >= MIN_DOCUMENTS)))  # fewer kinds cannot come to enough
    open_ = found.where("NOT enough").select("template", "groups")
    salted = families.where("n = 1").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))  # one template may have most rows
    salts = open_.select("template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    alone = salted.join(salts, ["template", "salt"], "left_semi").groupBy("template", "salt", "doc_id").agg(F.count("*").alias("n"))
    alone = alone.where(2 * F.col("n") >= SKETCHES).groupBy("template").agg(F.count("*").alias("alone"))
    others = open_.join(alone, "template", "left").where(F.coalesce("alone", F.lit(0)) + F.col("groups") >= MIN_DOCUMENTS).select("template")
    return found.where("enough").select("template").unionByName(others)


def recurring_lines(docs: DataFrame) -> DataFrame:
    """doc_id and n of every line whose template recurs. Hashes of lines, not texts, are kept in the shared folder and shuffled."""
    documents = cut_lineage(parsed(docs))
    leaves = documents.select("doc_id", F.explode(F.array_distinct(F.transform("entries", lambda e: e["leaf"]))).alias("leaf"))
    reached = leaves.groupBy("leaf").agg(F.count("*").alias("documents")).where(F.col("documents") >= MIN_DOCUMENTS).select("leaf")
    every = documents.select("doc_id", F.explode("entries").alias("e")).select("doc_id", "e.n", "e.leaf", "e.own")
    within = cut_lineage(every.join(reached, "leaf", "left_semi"))
    told = within.join(_templates(docs, within), ["leaf", "own"], "left")
    told = cut_lineage(told.select("doc_id", "n", F.coalesce("_template", "own").alias("template")))
    return told.join(_recurring(told, documents), "template", "left_semi").select("doc_id", "n")


def drop_recurring(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``text`` less the lines of recurring templates, and ``n_lines`` and ``n_dropped`` in the struct ``dedup``.

    Null texts stay null and have no lines; blank lines are never dropped. Rows without doc_id, and other columns of any
    name, come through unchanged; repeated rows lose the same lines. Ties at a position of a leaf go to the greater token. An
    empty table stays empty. Very long lines are parsed whole.
    """
    found = recurring_lines(docs).groupBy("doc_id").agg(F.collect_set("n").alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"))
    rows = rows.join(found.withColumnRenamed("doc_id", "_id"), "_id", "left")
    split = F.split("_row.text", "\n")
    gone = F.coalesce("_gone", F.array().cast("array<int>"))
    text = F.when(F.size(gone) == 0, F.col("_row.text")).otherwise(F.array_join(F.filter(split, lambda _, i: ~F.array_contains(gone, i)), "\n"))
    measures = F.struct(F.coalesce(F.size(split), F.lit(0)).alias("n_lines"), F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(gone)).alias("n_dropped"))
    kept = [text.alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`") for c in docs.columns]
    return rows.select(*kept, measures.alias("dedup"))

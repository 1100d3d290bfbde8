"""Exact and near-duplicate folding that keeps the semantics of input order.

The near-duplicate pass is a greedy one: rows come in ``seq`` order and each
is compared with the rows kept so far; it folds into the first whose token
set resembles its own by more than the threshold. Set-wise, the kept rows are
the lexicographically first maximal independent set of the resemblance graph:

1. rows with equal token sets fold into their first row, whatever the graph;
2. edges come from an equi-join on the rarest tokens that any two sufficiently
   similar sets must share (prefix filtering), then length and position
   filters and exact resemblance;
3. rounds: a row none of whose earlier neighbours is undecided or kept is
   kept, a row with a kept earlier neighbour folds, until no edge is left;
4. a folded row counts for the smallest kept earlier neighbour.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..storage import small, stage


class DedupResult(NamedTuple):
    """``folds``: (seq, keeper, pass) of each row that folded, pass ``exact`` or ``fuzzy``."""

    survivors: DataFrame
    folds: DataFrame
    exact_dropped: int
    fuzzy_dropped: int


def exact_groups(df: DataFrame, key: Column, seq: str = "seq") -> DataFrame:
    """(key, first, hits): the first row of each key and how many rows share it."""
    return df.groupBy(key.alias("key")).agg(F.min(seq).alias("first"), F.count("*").alias("hits"))


def dedup_exact(df: DataFrame, key: str = "content_hash", seq: str = "seq") -> DataFrame:
    """The first row of each ``key`` with ``hits`` set to the number of its rows.

    ``seq`` must be unique. Null keys are one key. Only (key, seq) is
    aggregated; contents are fetched by a join on ``seq``.
    """
    groups = exact_groups(df, F.col(key), seq)
    return df.drop("hits").join(groups.select(F.col("first").alias(seq), "hits"), seq)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(token, seq, n, place): of n tokens, ordered by rarity, the first n - ceil(threshold * n) + 1."""
    each = sets.select("seq", F.explode("toks").alias("token"))
    rarity = each.groupBy("token").agg(F.count("*").alias("df"))
    # tokens of one row alone can join nothing, but they fill its prefix
    ordered = each.join(rarity, "token").groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    n = F.size("s")
    length = F.least(n, n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1)
    placed = F.transform(F.slice("s", 1, length), lambda x, i: F.struct(x["token"].alias("token"), x["df"].alias("df"), i.alias("place")))
    return ordered.select("seq", n.alias("n"), F.explode(F.filter(placed, lambda x: x["df"] > 1)).alias("x")).select("x.token", "seq", "n", "x.place")


def similar_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(i, j, similarity): pairs i < j of ``sets(seq, toks)`` resembling each other by more than ``threshold``.

    For 0 <= threshold < 1, and sets that are neither empty nor equal among
    each other.
    """
    prefix = stage(_prefixes(sets, threshold), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    long_enough = (F.col("a.n") >= threshold * F.col("b.n") - 1e-9) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9)
    # nothing is shared before the first token that two sets share, so one more than the shorter rest bounds the overlap
    rest = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    enough = rest * (1 + threshold) >= threshold * (F.col("a.n") + F.col("b.n")) - 1e-9
    candidates = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.seq") < F.col("b.seq")) & long_enough & enough).select(F.col("a.seq").alias("i"), F.col("b.seq").alias("j")).distinct()
    left, right = sets.select(F.col("seq").alias("i"), F.col("toks").alias("x")), sets.select(F.col("seq").alias("j"), F.col("toks").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similarity = both.cast("double") / (F.size("x") + F.size("y") - both).cast("double")
    return candidates.join(left, "i").join(right, "j").select("i", "j", similarity.alias("similarity")).where(F.col("similarity") > threshold)


def resolve(edges: DataFrame) -> DataFrame:
    """(seq, keeper) of the rows that fold, for edges(i, j), i < j.

    One round a link of the longest chain of folds; real tables need two or three.
    """
    edges = stage(edges.select("i", "j"), "edges")
    open_, folded = edges, edges.select(F.col("j").alias("seq")).where(F.lit(False))
    while not open_.isEmpty():
        heads = stage(open_.select("i").distinct().join(open_.select(F.col("j").alias("i")).distinct(), "i", "left_anti"), "kept")
        hit = stage(open_.join(small(heads), "i", "left_semi").select("j").distinct(), "folded")
        folded = folded.unionByName(hit.select(F.col("j").alias("seq")))
        gone = small(hit)
        open_ = stage(open_.join(gone, "j", "left_anti").join(gone.select(F.col("j").alias("i")), "i", "left_anti"), "open")
    kept = edges.join(folded.select(F.col("seq").alias("i")), "i", "left_anti")
    return kept.groupBy("j").agg(F.min("i").alias("keeper")).select(F.col("j").alias("seq"), "keeper")


def token_sets(df: DataFrame, content: str = "content", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(sets(seq, toks), copies(seq, first, n)): the first row of each set of tokens that is not empty, and the other rows of a set (an empty one too)."""
    rows = stage(df.select(F.col(seq).alias("seq"), F.transform(F.array_sort(tokens(F.coalesce(F.col(content), F.lit("")))), lambda t: F.xxhash64(t)).alias("toks")), "tokens")
    key = (F.xxhash64("toks").alias("a"), F.xxhash64(F.lit("set"), "toks").alias("b"), F.size("toks").alias("n"))
    same = stage(rows.groupBy(*key).agg(F.min("seq").alias("first"), F.count("*").alias("c")), "token-sets")
    sets = stage(rows.join(same.select(F.col("first").alias("seq")), "seq", "left_semi").where(F.size("toks") > 0), "sets")
    copies = rows.select("seq", *key).join(same.where("c > 1"), ["a", "b", "n"]).where("seq <> first").select("seq", "first", "n")
    return sets, copies


def fuzzy_folds(df: DataFrame, threshold: float, content: str = "content", seq: str = "seq") -> DataFrame:
    """(seq, keeper) of the rows that fold in the near-duplicate pass.

    Any threshold is allowed: from 1 on nothing folds, below 0 everything
    folds into the first row, at 0 one common token is enough. Rows without
    tokens are alike.
    """
    if threshold >= 1.0:
        return df.select(F.col(seq).alias("seq"), F.col(seq).alias("keeper")).where(F.lit(False))
    if threshold < 0.0:
        low = df.agg(F.min(seq).alias("keeper"))
        return df.select(F.col(seq).alias("seq")).join(F.broadcast(low), F.col("seq") > F.col("keeper"))
    sets, copies = token_sets(df, content, seq)
    folded = stage(resolve(similar_pairs(sets, threshold)), "folds")
    # copies of a folded first row fold where it does
    moved = copies.join(folded.withColumnsRenamed({"seq": "first"}), "first", "left").select("seq", F.coalesce("keeper", "first").alias("keeper"))
    return folded.unionByName(moved)


def dedup_fuzzy(df: DataFrame, threshold: float, content: str = "content", seq: str = "seq") -> DataFrame:
    """The kept rows, ``hits`` raised by one for each row folded into them (whatever that row's own hits)."""
    folds = stage(fuzzy_folds(df, threshold, content, seq), "folds")
    return _merged(df, folds, seq)


def _merged(df: DataFrame, folds: DataFrame, seq: str) -> DataFrame:
    more = folds.groupBy("keeper").agg(F.count("*").alias("__more")).withColumnRenamed("keeper", seq)
    kept = df.join(folds.select(F.col("seq").alias(seq)), seq, "left_anti")
    return kept.join(more, seq, "left").withColumn("hits", F.col("hits") + F.coalesce("__more", F.lit(0))).drop("__more")


def dedup(df: DataFrame, threshold: float, key: str = "content_hash", content: str = "content", seq: str = "seq") -> DedupResult:
    """Exact, then near-duplicate folding; survivors keep ``seq``, whose order is input order."""
    groups = stage(exact_groups(df, F.col(key), seq), "groups")
    first = stage(df.drop("hits").join(groups.select(F.col("first").alias(seq), "hits"), seq), "exact")
    folds = stage(fuzzy_folds(first, threshold, content, seq), "folds")
    survivors = _merged(first, folds, seq)
    counts = groups.agg(F.sum(F.col("hits") - 1).alias("n")).first()["n"] or 0
    exact = df.join(groups.withColumnRenamed("first", "keeper"), F.col(key).eqNullSafe(F.col("key"))).where(F.col(seq) != F.col("keeper")).select(F.col(seq).alias("seq"), "keeper", F.lit("exact").alias("pass"))
    return DedupResult(survivors, exact.unionByName(folds.withColumn("pass", F.lit("fuzzy"))), int(counts), folds.count())

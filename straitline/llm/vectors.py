"""Shards of vectors and blocks of queries, which the two vector searches share."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from straitline.llm.common import stored

#: Queries of a block.
BLOCK = 256


def usable(table: DataFrame, id_col: str, vector: str, zero: bool) -> DataFrame:
    """``id, vec, dim``: rows with an id and a vector of finite components, one row an id (of several the smallest vector).

    Empty vectors take no part, nor, unless ``zero``, vectors of zeros only.
    """
    vec = F.col(f"`{vector}`").cast("array<double>")
    # NaN and infinities are the numbers that zero does not absorb.
    fine = F.forall("vec", lambda x: x.isNotNull() & (x * 0 == 0))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec")).filter(
        F.col("id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & fine)
    if not zero:
        rows = rows.filter(F.exists("vec", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def matrix(vectors) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def indexed(rows: DataFrame, shard_rows: int, build: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """A stored index ``dim, shards, shard, data``: rows dealt by a hash of their id into shards of about ``shard_rows``."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("long").alias("shards"))
    dealt = rows.join(F.broadcast(sizes) if sizes.limit(1001).count() <= 1000 else sizes, "dim") \
        .withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shards": pdf["shards"].iloc[:1], "shard": pdf["shard"].iloc[:1],
                             "data": [build(pdf["id"].to_numpy(np.int64), matrix(pdf["vec"]))]})

    return stored(dealt.groupBy("dim", "shard").applyInPandas(make, "dim int, shards long, shard long, data binary"), "index")


def searched(index: DataFrame, queries: DataFrame, answer: Callable, k: int, score: str, ascending: bool) -> DataFrame:
    """``query_id, rank, vec_id, score``: the best ``k`` of what ``answer(data, ids, matrix)`` finds for each query in each shard.

    Queries go in blocks to every shard of their dimension; a shard returns ``k`` rows a query at most, and these are ranked.
    """
    blocks = max(1, math.ceil(queries.count() / BLOCK))
    rows = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("dim", "block").agg(
        F.collect_list(F.struct("id", "vec")).alias("rows"))
    shards = index.groupBy("dim").agg(F.max("shards").alias("shards"))
    sent = rows.join(shards, "dim").select("dim", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    pairs = index.select("dim", "shard", "data").join(sent, ["dim", "shard"]).select("data", "rows.id", "rows.vec")

    def find(batches):
        for b in batches:
            for data, ids, vecs in zip(b["data"], b["id"], b["vec"]):
                found = answer(data, np.asarray(ids, np.int64), matrix(vecs))
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    hits = pairs.mapInPandas(find, f"query_id long, vec_id long, score {score}")
    best: Column = F.col("score").asc() if ascending else F.col("score").desc()
    order = W.partitionBy("query_id").orderBy(best, "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

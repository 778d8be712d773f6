"""Longest-path layering of a directed graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that one task lays out by itself, in time and memory that follow their number.
LOCAL = 2_000_000


def layers(nodes: DataFrame, edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """node, layer: the length of the longest path that ends in a node (node: id; edges: src, dst). Nodes on or behind a cycle have
    layer null. Paths of any length: a graph of up to ``local`` edges is laid out by one task, of a larger one each connected part of up
    to so many. Parts beyond that lose a layer with each join and aggregate until they have so few."""
    ids = nodes.select("node").distinct().checkpoint()
    left = edges.select("src", "dst").join(
        ids.select(F.col("node").alias("src")), "src", "left_semi"
    ).join(ids.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst").distinct().checkpoint()
    n = left.count()
    found = None
    if n > local:
        parts = _parts(left)
        left = left.join(parts.select(F.col("node").alias("src"), "part"), "src").checkpoint()
        small = left.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") <= local).select("part").checkpoint()
        found = _laid(left.join(small, "part", "left_semi"), "part", 0).checkpoint()
        left = left.join(small, "part", "left_anti").select("src", "dst").checkpoint()
        n = left.count()
    at = 0
    while n > local:  # only edges are left: their sources without predecessors are the layer
        now = left.select(F.col("src").alias("node")).distinct().join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").checkpoint()
        if now.isEmpty():
            break
        rest = left.join(now.select(F.col("node").alias("src")), "src", "left_anti").checkpoint()
        # a node that loses its last edge is a layer on
        last = left.select(F.col("dst").alias("node")).distinct().join(
            rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti"
        )
        laid = now.withColumn("layer", F.lit(at).cast("long")).unionByName(last.withColumn("layer", F.lit(at + 1).cast("long"))).checkpoint()
        found, left, at = laid if found is None else found.unionByName(laid), rest, at + 1
        n = left.count()
    if n > local:
        rest = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("layer", F.lit(None).cast("long"))
    else:
        rest = _laid(left.withColumn("part", F.lit(0).cast("long")), "part", at)
    found = (rest if found is None else found.unionByName(rest)).withColumn("__found", F.lit(True))
    return ids.join(found, "node", "left").select("node", F.when(F.col("__found").isNull(), 0).otherwise(F.col("layer")).alias("layer"))


def _laid(edges: DataFrame, part: str, first: int) -> DataFrame:
    """node, layer of the nodes of edges (src, dst), those without predecessors at ``first``; each part in one task."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        both = pa.concat_arrays([*table["src"].chunks, *table["dst"].chunks]).dictionary_encode()
        at, size = both.indices.to_numpy(), len(both.dictionary)
        src, dst = at[:n], at[n:]
        order = np.argsort(src, kind="stable")
        start = np.searchsorted(src[order], np.arange(size + 1)).tolist()
        to, waits, layer = dst[order].tolist(), np.bincount(dst, minlength=size).tolist(), [first] * size
        ready = [i for i, w in enumerate(waits) if not w]
        for i in ready:  # grows while it is read
            for j in to[start[i] : start[i + 1]]:
                layer[j] = max(layer[j], layer[i] + 1)
                waits[j] -= 1
                if not waits[j]:
                    ready.append(j)
        return pa.table({"node": both.dictionary, "layer": pc.if_else(pa.array(np.array(waits) == 0), pa.array(layer, pa.int64()), None)})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy(part).applyInArrow(run, f"node {kind}, layer long")


def _parts(edges: DataFrame) -> DataFrame:
    """node, part: the smallest node that each node of edges (src, dst) is connected with, by large-star and small-star steps."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        ).where("u <> v").distinct().checkpoint()
        row = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if row == mark:
            break
        mark = row
    every = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return every.join(now.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").select("node", F.coalesce("part", "node").alias("part")).checkpoint()

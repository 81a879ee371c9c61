"""Affinity propagation on a sparse similarity graph.

A point is similar to its nearest ``neighbours`` in order of value on either
side; a cohort of at most that many samples and one has the dense graph.  Loci
of up to ``local_edges`` edges exchange their messages within one grouped task.
Larger ones do so in rounds over all of them at once: a round is two window
passes over the edges (by sender, by receiver) that share one exchange by
locus, and blocks of rounds are written out, so that plans stay short and a
lost executor costs one block.  Both give the same messages.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from windrow.sources.scratch import written

#: Rounds of a block, and blocks with unchanged exemplars that end the search.
BLOCK, QUIET = 5, 3
#: Share of the preference by which ties are broken, by a hash of the pair.
TIE = 1e-6


def similarities(obs: DataFrame, neighbours: int) -> DataFrame:
    """Edges ``locus, i, k, s`` between ranks by (mu, sample), loops with the preference (the median similarity; -1 for a single point) included."""
    points = obs.select("locus", "mu", F.row_number().over(Window.partitionBy("locus").orderBy("mu", "sample")).cast("long").alias("i"))
    other = points.select("locus", F.col("i").alias("k"), F.col("mu").alias("at"))
    near = points.withColumn("k", F.explode(F.sequence(F.col("i") - neighbours, F.col("i") + neighbours))).where("k <> i").join(other, ["locus", "k"])
    pairs = near.select("locus", "i", "k", (-F.abs(F.col("mu") - F.col("at"))).alias("s"))
    middle = points.select("locus").distinct().join(pairs.groupBy("locus").agg(F.median("s").alias("p")), "locus", "left").select("locus", F.coalesce("p", F.lit(-1.0)).alias("p"))
    loops = points.join(middle, "locus").select("locus", "i", F.col("i").alias("k"), F.col("p").alias("s"))
    tie = F.crc32(F.concat(F.col("i").cast("string"), F.lit(":"), F.col("k").cast("string")).cast("binary")) / float(1 << 32) * TIE
    return pairs.union(loops).join(middle, "locus").select("locus", "i", "k", (F.col("s") + tie * F.abs("p")).alias("s"))


def _round(edges: DataFrame, damping: float) -> DataFrame:
    """Responsibilities, then availabilities, each mixed with ``damping`` of the old."""
    sender, receiver = Window.partitionBy("locus", "i"), Window.partitionBy("locus", "k")
    d, loop = F.lit(damping), F.col("i") == F.col("k")
    e = edges.withColumn("v", F.col("a") + F.col("s")).withColumn("top", F.max(F.struct("v", "k")).over(sender))
    best = F.col("top.k") == F.col("k")
    e = e.withColumn("second", F.max(F.when(~best, F.col("v"))).over(sender))
    # a point without any other candidate is an exemplar
    rival = F.when(best, F.coalesce("second", F.col("s") - F.abs("s") - 1)).otherwise(F.col("top.v"))
    e = e.withColumn("r", d * F.col("r") + (1 - d) * (F.col("s") - rival)).drop("v", "top", "second")
    support = F.sum(F.when(loop, F.lit(0.0)).otherwise(F.greatest("r", F.lit(0.0)))).over(receiver)
    own = F.max(F.when(loop, F.col("r"))).over(receiver)
    e = e.withColumn("support", support).withColumn("own", own)
    new = F.when(loop, F.col("support")).otherwise(F.least(F.lit(0.0), F.col("own") + F.col("support") - F.greatest("r", F.lit(0.0))))
    return e.withColumn("a", d * F.col("a") + (1 - d) * new).drop("support", "own")


def _passed(damping: float, rounds: int) -> callable:
    """All rounds of one locus on arrays of its edges."""

    def of(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["i", "k"])
        i, k, s = p.i.to_numpy(), p.k.to_numpy(), p.s.to_numpy()
        sent = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        sender = np.repeat(np.arange(len(sent)), np.diff(np.append(sent, len(i))))
        receiver, loop = k - k.min(), i == k
        points = np.arange(len(s))
        r, a = np.zeros(len(s)), np.zeros(len(s))
        before, quiet = None, 0
        for _ in range(-(-rounds // BLOCK)):
            for _ in range(BLOCK):
                v = a + s
                top = np.maximum.reduceat(v, sent)
                # of equal values the largest k is the best, as in the windows' order
                best = np.maximum.reduceat(np.where(v == top[sender], points, -1), sent)
                rest = v.copy()
                rest[best] = -np.inf
                second = np.maximum.reduceat(rest, sent)
                rival = top[sender]
                rival[best] = np.where(np.isfinite(second), second, s[best] - np.abs(s[best]) - 1)
                r = damping * r + (1 - damping) * (s - rival)
                good = np.where(loop, 0.0, np.maximum(r, 0.0))
                support = np.bincount(receiver, good)[receiver]
                own = np.bincount(receiver, np.where(loop, r, 0.0))[receiver]
                a = damping * a + (1 - damping) * np.where(loop, support, np.minimum(0.0, own + support - good))
            now = k[loop & (r + a > 0)].tobytes()
            quiet = quiet + 1 if now == before else 0
            before = now
            if quiet >= QUIET:
                break
        return p.assign(r=r, a=a)[["locus", "i", "k", "s", "r", "a"]]

    return of


def _in_rounds(edges: DataFrame, damping: float, rounds: int) -> DataFrame:
    """The messages of loci of any size; a locus rests once its exemplars have not changed over QUIET blocks."""
    whole = Window.partitionBy("locus")
    heads = F.when((F.col("i") == F.col("k")) & (F.col("r") + F.col("a") > 0), F.xxhash64("k"))
    state = edges.withColumn("n", F.lit(-1).cast("long")).withColumn("h", F.lit(0).cast("long")).withColumn("quiet", F.lit(0))
    rested = []
    for _ in range(-(-rounds // BLOCK)):
        step = state.repartition("locus")  # the passes of every round keep to it
        for _ in range(BLOCK):
            step = _round(step, damping)
        step = step.withColumn("m", F.count(heads).over(whole)).withColumn("g", F.coalesce(F.bit_xor(heads).over(whole), F.lit(0).cast("long")))
        step = step.withColumn("quiet", F.when((F.col("m") == F.col("n")) & (F.col("g") == F.col("h")), F.col("quiet") + 1).otherwise(0))
        step = written(step.select("locus", "i", "k", "s", "r", "a", F.col("m").alias("n"), F.col("g").alias("h"), "quiet"), "messages")
        rested.append(step.where(F.col("quiet") >= QUIET))
        state = step.where(F.col("quiet") < QUIET)
        if not state.take(1):
            break
    out = state
    for x in rested:
        out = out.union(x)
    return out.select("locus", "i", "k", "s", "r", "a")


def affinity_propagation(obs: DataFrame, damping: float = 0.7, rounds: int = 100, neighbours: int = 64, local_edges: int = 1 << 21) -> DataFrame:
    """Exemplars of the points ``obs(locus, sample, mu)``: ``locus, sample, mu, exemplar`` (a sample's name).

    ``rounds`` at most, in blocks of BLOCK; a locus is done once its exemplars
    have not changed over QUIET blocks.  A point belongs to the most similar
    exemplar among its neighbours; it has a null exemplar if there is none.  A
    locus' only point is its own exemplar.  Points of equal value are told
    apart by sample; rows with a null mu are left out.
    """
    points = written(obs.where("mu is not null").select("locus", "sample", "mu"), "points")
    edges = written(similarities(points, neighbours).withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0)), "edges")
    large = edges.groupBy("locus").agg(F.count("*").alias("n")).where(F.col("n") > local_edges).select("locus")
    one_task = edges.join(large, "locus", "left_anti")
    done = one_task.groupBy("locus").applyInPandas(_passed(damping, rounds), one_task.schema)
    if large.take(1):
        done = done.union(_in_rounds(edges.join(large, "locus", "left_semi"), damping, rounds))
    edges = written(done, "messages")
    heads = edges.where((F.col("i") == F.col("k")) & (F.col("r") + F.col("a") > 0)).select("locus", F.col("k").alias("exemplar"))
    mine = edges.withColumnRenamed("k", "exemplar").join(heads, ["locus", "exemplar"]).select("locus", "i", "s", "exemplar")
    # an exemplar is its own
    best = mine.groupBy("locus", "i").agg(F.max_by("exemplar", F.when(F.col("i") == F.col("exemplar"), float("inf")).otherwise(F.col("s"))).alias("exemplar"))
    named = points.withColumn("i", F.row_number().over(Window.partitionBy("locus").orderBy("mu", "sample")).cast("long"))
    names = named.select("locus", F.col("i").alias("exemplar"), F.col("sample").alias("name"))
    out = named.join(best, ["locus", "i"], "left").join(names, ["locus", "exemplar"], "left")
    return out.select("locus", "sample", "mu", F.col("name").alias("exemplar"))

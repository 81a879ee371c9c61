"""Affinity propagation against a dense plain version, over every locus of the table and over small cases."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from windrow.operators import affinity
from windrow.plans import registry
from windrow.plans.queries_genotype import obs

SCHEMA = "locus long, sample string, mu double"


class Dense:
    """Messages of one locus on full matrices."""

    def __init__(self, values, near):
        self.n = n = len(values)
        x = np.array(values)
        s = -np.abs(x[:, None] - x[None])
        apart = np.abs(np.arange(n)[:, None] - np.arange(n)[None])
        self.edge = (apart <= near)
        off = s[self.edge & (apart > 0)]
        p = float(np.median(off)) if len(off) else -1.0
        s[np.arange(n), np.arange(n)] = p
        tie = np.array([[zlib.crc32(f"{i + 1}:{k + 1}".encode()) / 2**32 * affinity.TIE for k in range(n)] for i in range(n)])
        self.s = np.where(self.edge, s + tie * abs(p), -np.inf)
        self.r, self.a = np.zeros((n, n)), np.zeros((n, n))

    def step(self, damping):
        n = self.n
        for i in range(n):
            v = np.where(self.edge[i], self.a[i] + self.s[i], -np.inf)
            new = np.zeros(n)
            for k in np.flatnonzero(self.edge[i]):
                rest = np.delete(v, k)
                rival = rest.max() if len(rest) and rest.max() > -np.inf else self.s[i, k] - abs(self.s[i, k]) - 1
                new[k] = self.s[i, k] - rival
            self.r[i] = damping * self.r[i] + (1 - damping) * new
        for k in range(n):
            pos = np.where(self.edge[:, k], np.maximum(self.r[:, k], 0), 0)
            for i in np.flatnonzero(self.edge[:, k]):
                new = pos.sum() - pos[k] if i == k else min(0.0, self.r[k, k] + pos.sum() - pos[k] - pos[i])
                self.a[i, k] = damping * self.a[i, k] + (1 - damping) * new

    def exemplars(self):
        return [k for k in range(self.n) if self.r[k, k] + self.a[k, k] > 0]

    def labels(self):
        heads, out = self.exemplars(), []
        for i in range(self.n):
            own = [k for k in heads if self.edge[i, k]]
            out.append(i if i in heads else max(own, key=lambda k: self.s[i, k]) if own else None)
        return out


def plain(rows, damping=0.7, rounds=100, near=64):
    loci = defaultdict(list)
    for locus, sample, mu in rows:
        if mu is not None:
            loci[locus].append((mu, sample))
    dense = {locus: Dense([m for m, _ in sorted(p)], near) for locus, p in loci.items()}
    for d in dense.values():
        before, quiet = None, 0
        for _ in range(-(-rounds // affinity.BLOCK)):
            for _ in range(affinity.BLOCK):
                d.step(damping)
            now = d.exemplars()
            quiet = quiet + 1 if now == before else 0
            before = now
            if quiet >= affinity.QUIET:
                break
    out = set()
    for locus, p in loci.items():
        names = [s for _, s in sorted(p)]
        out |= {(locus, names[i], None if k is None else names[k]) for i, k in enumerate(dense[locus].labels())}
    return out


def got(df):
    return {(r["locus"], r["sample"], r["exemplar"]) for r in df.collect()}


def test_every_locus_of_the_table(spark, tiny):
    rows = [(r["locus"], r["sample"], r["mu"]) for r in obs(spark, tiny).collect()]
    want = plain(rows)
    assert got(registry.queries()["affinity_exemplars"](spark, tiny)) == want
    per = defaultdict(set)
    for locus, _, head in want:
        per[locus].add(head)
    assert max(len(h - {None}) for h in per.values()) >= 2


@pytest.mark.parametrize("near", [3, 64])
def test_clear_groups_single_points_and_equal_values(spark, near):
    draw = np.random.default_rng(6)
    rows = [(1, f"s{i:02d}", float(round(c + draw.normal() * 0.02, 6))) for i, c in enumerate([1.0, 2.0, 3.0] * 6)]
    rows += [(2, "only", 2.0), (3, "a", 1.0), (3, "b", 1.0), (3, "c", 1.0), (4, "x", None), (4, "y", 1.5), (4, "z", 2.5)]
    answer = got(affinity.affinity_propagation(spark.createDataFrame(rows, SCHEMA), rounds=60, neighbours=near))
    assert answer == plain(rows, rounds=60, near=near)
    if near == 64:
        heads = {head for locus, _, head in answer if locus == 1}
        value = {s: m for locus, s, m in rows if locus == 1}
        assert sorted(round(value[h]) for h in heads) == [1, 2, 3]
        assert all(abs(value[s] - value[h]) < 0.5 for locus, s, h in answer if locus == 1)
    assert (2, "only", "only") in answer


def test_messages_in_rounds_equal_those_in_one_task(spark):
    draw = np.random.default_rng(8)
    rows = [(locus, f"s{i:02d}", float(round(draw.choice([1, 2, 3]) + draw.normal() * 0.1, 6))) for locus in (1, 2) for i in range(9 + locus)] + [(3, "one", 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    answer = got(affinity.affinity_propagation(df, rounds=30, neighbours=4, local_edges=0))
    assert answer == got(affinity.affinity_propagation(df, rounds=30, neighbours=4)) == plain(rows, rounds=30, near=4)


def test_rounds_share_one_exchange(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], SCHEMA)
    edges = affinity.similarities(df, 4).selectExpr("*", "0D as r", "0D as a").repartition("locus")
    exchanges = lambda e: e._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(affinity._round(affinity._round(edges, 0.9), 0.9)) == exchanges(edges) > 0


def test_empty(spark):
    assert affinity.affinity_propagation(spark.createDataFrame([], SCHEMA)).count() == 0

"""Iterative algorithms over whole tables against plain versions that share no code with them."""

import math
from collections import defaultdict

import numpy as np
import pytest

from windrow.operators import chain
from windrow.plans import registry
from windrow.plans import views as v


@pytest.fixture(scope="module")
def run(spark, tiny):
    held = {}

    def of(name):
        if name not in held:
            held[name] = [r.asDict() for r in registry.queries()[name](spark, tiny).collect()]
        return held[name]

    return of


@pytest.fixture(scope="module")
def track(spark, tiny):
    out = defaultdict(list)
    for r in v.track(spark, tiny).orderBy("contig", "w").collect():
        out[r["contig"]].append((r["w"], r["start"], r["end"], r["cp"]))
    return dict(out)


@pytest.fixture(scope="module")
def panel(spark, tiny):
    out = defaultdict(list)
    for r in v.panel(spark, tiny).orderBy("contig", "sample", "w").collect():
        out[r["contig"], r["sample"]].append((r["w"], r["start"], r["end"], r["cp"]))
    return dict(out)


# "affinity_exemplars" is compared in test_affinity.py, "refined_chain" in test_refine.py, "called_segments" in test_chains.py


# ---- segmentation


def mirror(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def plain_edges(x, sigma):
    n, r = len(x), int(4 * sigma + 0.5)
    phi = {o: math.exp(-o * o / (2 * sigma**2)) for o in range(-r, r + 1)}
    total = sum(phi.values())
    d1 = [sum(x[mirror(i + o, n)] * phi[o] / total * o / sigma**2 for o in phi) for i in range(n)]
    d2 = [sum(x[mirror(i + o, n)] * phi[o] / total * (o * o / sigma**4 - 1 / sigma**2) for o in phi) for i in range(n)]
    sign = [(q > 1e-300) - (q < -1e-300) for q in d2]
    cut = [i for i in range(n) if i in (0, n - 1) or sign[i] != sign[i - 1]]
    keep = n if len(cut) == n else min(len(cut), n - len(cut))
    best = sorted(cut, key=lambda i: (-abs(d1[i]), i))[:keep]
    return {i for i in best if sign[i]}


def plain_contours(x, n_scales):
    n = len(x)
    levels = [plain_edges(x, k) for k in range(1, n_scales)]
    seen = {}
    for top in range(len(levels) - 1, 1, -1):
        for start in sorted(levels[top]):
            if start not in levels[top]:
                continue
            at, scale = start, top
            while scale:
                levels[scale].discard(at)
                left = min((at - c for c in levels[scale - 1] if c <= at), default=1 << 40)
                right = min((c - at for c in levels[scale - 1] if c >= at), default=1 << 40)
                step = min(left, right, at, n - 1 - at)
                if step == at:
                    at, scale = 0, 0
                elif step == n - 1 - at:
                    at, scale = n - 1, 0
                else:
                    at, scale = at - left if left == step else at + right, scale - 1
            seen.setdefault(at, top)
    return seen


def plain_merge(x, edges, limit):
    edges = sorted(edges)
    while len(edges) > 2:
        m = [float(np.median(x[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        step = [abs(a - b) for a, b in zip(m[:-1], m[1:], strict=True)]
        if not min(step) < limit:
            break
        del edges[step.index(min(step)) + 1]
    return [(a, b, float(np.median(x[a:b]))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def plain_segments(x, n_scales, cutoff, limit):
    kept = {p for p, top in plain_contours(x, n_scales).items() if top >= cutoff}
    return plain_merge(x, kept | {0, len(x)}, limit)


def test_contours(run, track):
    want = {(c, rows[p][0], s) for c, rows in track.items() for p, s in plain_contours([q[3] for q in rows], 21).items()}
    assert {(r["contig"], r["w"], r["scale"]) for r in run("contours")} == want


def test_heap_merge(run, track):
    want = set()
    for c, rows in track.items():
        x = [q[3] for q in rows]
        want |= {(c, rows[a][0], rows[b - 1][0] + 1, rows[a][1], rows[b - 1][2], round(m, 9), b - a) for a, b, m in plain_segments(x, 8, 0, 0.02)}
    assert {(r["contig"], r["w0"], r["w1"], r["start"], r["end"], round(r["value"], 9), r["n"]) for r in run("heap_merge")} == want


def test_merges_between_given_breaks(run, track):
    rows = {k: sorted((r["contig"], r["w0"], r["w1"], round(r["value"], 9)) for r in run(k)) for k in ("heap_merge_breaks", "iterative_merge", "greedy_merge")}
    merged, greedy = [], []
    for c, q in track.items():
        x, w = [p[3] for p in q], [p[0] for p in q]
        edges = sorted({0, len(x), *(w.index(at) for at in range(w[0], w[-1] + 1, 3) if at in w)})
        merged += [(c, w[a], w[b - 1] + 1, round(m, 9)) for a, b, m in plain_merge(x, edges, 0.08)]
        spans = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if spans and abs(np.median(x[spans[-1][0] : spans[-1][1]]) - np.median(x[a:b])) < 0.08:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        greedy += [(c, w[a], w[b - 1] + 1, round(float(np.median(x[a:b])), 9)) for a, b in spans]
    assert rows["heap_merge_breaks"] == rows["iterative_merge"] == sorted(merged)
    assert rows["greedy_merge"] == sorted(greedy)


def test_segment_e2e_and_reported_calls(run, panel, track):
    every = [q[3] for rows in panel.values() for q in rows]
    null_mean, null_var, root = np.mean(every), np.var(every), math.sqrt(len(every))
    scored = []
    for (c, s), rows in panel.items():
        x = [q[3] for q in rows]
        for a, b, _ in plain_segments(x, 21, 3, 0.3):
            mean, var, n = np.mean(x[a:b]), np.var(x[a:b]), max(math.sqrt(b - a), 2)
            e, f = var / n, null_var / root
            t, df = (mean - null_mean) / math.sqrt(e + f), (e + f) ** 2 / (e * e / (n - 1) + f * f / (root - 1))
            # Student's distribution by the trapezoid rule in the angle
            grid = np.linspace(0, math.atan(abs(t) / math.sqrt(df)), 4001)
            y = np.cos(grid) ** (df - 1)
            tail = 0.5 - math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi) * float(((y[1:] + y[:-1]) / 2 * np.diff(grid)).sum())
            scored.append((0.5 if var < 1e-18 else tail, c, s, rows[a][0], rows[b - 1][0] + 1, b - a))
    got = {(r["contig"], r["sample"], r["w0"]): r for r in run("segment_e2e")}
    assert len(got) == len(scored)
    for p, c, s, w0, w1, n in scored:
        r = got[c, s, w0]
        assert (r["w1"], r["n"]) == (w1, n)
        assert r["p"] == pytest.approx(p, abs=1e-6)
    ranks = sorted(got.values(), key=lambda r: (r["p"], r["contig"], r["sample"], r["w0"]))
    assert [r["rank"] for r in ranks] == list(range(len(ranks)))
    last = max((k for k, r in enumerate(ranks) if r["p"] < 0.05 * (k + 1) / len(ranks)), default=-1)
    assert all(r["significant"] == (k <= last) for k, r in enumerate(ranks))

    ends, want = {c: {q[0]: q[2] for q in rows} for c, rows in track.items()}, set()
    for (c, s), rows in panel.items():
        for a, b, m in plain_segments([q[3] for q in rows], 11, 2, 0.2)[:-1]:
            if rows[b - 1][0] + 1 in ends[c]:
                want.add((c, s, rows[a][1], ends[c][rows[b - 1][0] + 1], round(m, 9), b - a))
    assert {(r["contig"], r["sample"], r["start"], r["call_end"], round(r["value"], 9), r["n"]) for r in run("reported_calls")} == want


# ---- mixtures


def plain_partitions(x):
    """Centroid linkage by the closest pair of all, cut at 0.2, 0.201, ... below 1.5."""
    nodes, merges = [([i], 0.0) for i in range(len(x))], []
    order = sorted(range(len(x)), key=lambda i: (x[i], i))
    nodes = [([i], 0.0) for i in order]
    mean = lambda m: sum(x[i] for i in m) / len(m)
    while len(nodes) > 1:
        gaps = [mean(b[0]) - mean(a[0]) for a, b in zip(nodes[:-1], nodes[1:], strict=True)]
        i = gaps.index(min(gaps))
        height = max(gaps[i], nodes[i][1], nodes[i + 1][1])
        merges.append((height, nodes[i][0], nodes[i + 1][0]))
        nodes[i : i + 2] = [(nodes[i][0] + nodes[i + 1][0], height)]
    out, last = [], None
    for cut in np.arange(0.2, 1.5, 0.001):
        done = [m for m in merges if m[0] <= cut]
        if len(done) == last:
            continue
        last = len(done)
        name = list(range(len(x)))
        for _, a, b in done:
            low = min(name[i] for i in a + b)
            for i in a + b:
                name[i] = low
        out.append(name)
    return out


def plain_fit(x, groups):
    kinds = sorted(set(groups))
    part = [[a for a, g in zip(x, groups, strict=True) if g == k] for k in kinds]
    mean, var, weight = [np.mean(p) for p in part], [max(np.var(p), 1e-4) for p in part], [len(p) / len(x) for p in part]
    before = None

    def logs():
        return [[math.log(w) - 0.5 * (math.log(2 * math.pi * s) + (a - m) ** 2 / s) for m, s, w in zip(mean, var, weight, strict=True)] for a in x]

    for _ in range(1000):
        rows = logs()
        total = [max(r) + math.log(sum(math.exp(q - max(r)) for q in r)) for r in rows]
        if before is not None and abs(sum(total) - before) < 1e-2:
            break
        before = sum(total)
        post = [[math.exp(q - t) for q in r] for r, t in zip(rows, total, strict=True)]
        size = [sum(p[k] for p in post) + 1e-300 for k in range(len(kinds))]
        weight = [s / sum(size) for s in size]
        mean = [sum(p[k] * a for p, a in zip(post, x, strict=True)) / size[k] for k in range(len(kinds))]
        var = [sum(p[k] * (a - mean[k]) ** 2 for p, a in zip(post, x, strict=True)) / size[k] + 1e-4 for k in range(len(kinds))]
    rows = logs()
    ll = sum(max(r) + math.log(sum(math.exp(q - max(r)) for q in r)) for r in rows)
    return {"labels": [r.index(max(r)) for r in rows], "mean": mean, "aic": 6 * len(kinds) - 2 * ll}


def test_gmm_genotype(run):
    loci = defaultdict(list)
    for r in run("gmm_genotype"):
        loci[r["locus"]].append(r)
    for rows in loci.values():
        rows.sort(key=lambda r: r["sample"])
        x = [r["mu"] for r in rows]
        fits = [plain_fit(x, g) for g in plain_partitions(x) if len(set(g)) <= 30]
        best = min(fits, key=lambda f: f["aic"])
        assert rows[0]["aic"] == pytest.approx(best["aic"], abs=1e-6)
        assert rows[0]["n_comp"] == len(best["mean"])
        order = sorted(range(len(best["mean"])), key=lambda k: (best["mean"][k], k))
        assert [r["label"] for r in rows] == [order.index(k) for k in best["labels"]]


def test_copy_numbers_of_merged_fits(run):
    """Merging only joins components; copy numbers follow the rule from the labels, sample by sample."""
    fits = {(r["locus"], r["sample"]): r["label"] for r in run("gmm_genotype")}
    merged = defaultdict(dict)
    for r in run("gmm_merge"):
        merged[r["locus"]][r["sample"]] = (r["mu"], r["label"])
    for locus, rows in merged.items():
        kinds = len({fits[locus, s] for s in rows})
        assert len({lab for _, lab in rows.values()}) <= kinds
    got = {(r["locus"], r["sample"]): r["cn"] for r in run("genotype_e2e")}
    for locus, rows in merged.items():
        part = defaultdict(list)
        for mu, lab in rows.values():
            part[lab].append(mu)
        order = sorted(part, key=lambda k: (np.mean(part[k]), k))
        mean = [float(np.mean(part[k])) for k in order]
        near = min(range(len(mean)), key=lambda i: (abs(mean[i] - 2), i))
        cn = [2 - near + i if abs(mean[near] - 2) < 1 else math.floor(mean[0] + 0.5) + i for i in range(len(mean))]
        cn = [c - min(0, *cn, 0) for c in cn]
        mode = max(range(len(order)), key=lambda i: (len(part[order[i]]), -order[i]))
        if cn[mode] % 2 and len(part[order[mode]]) >= 0.5 * len(rows):
            cn = [c + (1 if mean[mode] > cn[mode] or min(cn) == 0 else -1) for c in cn]
        assert {s: got[locus, s] for s in rows} == {s: cn[order.index(lab)] for s, (_, lab) in rows.items()}


def test_info_records(run, spark, tiny):
    from windrow.plans.queries_genotype import cells

    held = defaultdict(set)
    for r in cells(spark, tiny).select("locus", "w").distinct().collect():
        held[r["locus"]].add(r["w"])
    rows = run("info_records")
    assert {r["locus"] for r in rows} == set(held)
    for r in rows:
        assert r["wnd_size"] == len(held[r["locus"]])
        assert r["is_singleton"] == (r["n_clusts"] == 2 and r["min_allele_count"] == 1)
        assert not (r["is_dup_singleton"] and r["is_del_singleton"])
        assert 0 <= r["min_responsibility"] <= r["mean_responsibility"] <= 1
        assert r["min_mu_d"] <= r["mu_mu_d"] <= r["max_mu_d"] or r["n_clusts"] == 1


def test_mean_shift(run):
    loci = defaultdict(list)
    for r in run("mean_shift_labels"):
        loci[r["locus"]].append(r)
    from windrow.plans.queries_genotype import obs  # values only

    mu = {}
    import tests.conftest  # noqa: F401

    from pyspark.sql import SparkSession

    for r in obs(SparkSession.getActiveSession(), "/root/testdata/sf0.001").collect():
        mu[r["locus"], r["sample"]] = r["mu"]
    for locus, rows in loci.items():
        x = [mu[locus, r["sample"]] for r in rows]
        at = list(x)
        for _ in range(300):
            new = [np.mean([q for q in x if a - 0.2 <= q <= a + 0.2]) for a in at]
            if max(abs(a - b) for a, b in zip(at, new, strict=True)) < 2e-4:
                break
            at = new
        modes = sorted(at)
        ids, k = {}, 0
        for i, m in enumerate(modes):
            k += i > 0 and m - modes[i - 1] > 0.2
            ids[m] = k
        assert [r["label"] for r in rows] == [ids[a] for a in at], locus


# ---- complex loci


def spans_above(panel, limit):
    out = defaultdict(list)
    for (c, s), rows in panel.items():
        for w, _, _, cp in rows:
            if cp > limit:
                if out[s] and out[s][-1][0] == c and out[s][-1][2] == w:
                    out[s][-1][2] = w + 1
                else:
                    out[s].append([c, w, w + 1])
    return out


def test_correlated_segments(run, panel):
    want = set()
    for c in {c for c, _ in panel}:
        rows = {s: {w: cp for w, _, _, cp in q} for (k, s), q in panel.items() if k == c}
        w = sorted({x for r in rows.values() for x in r})
        at = list(range(w[0], w[-1] + 2, 8))
        while len(at) > 2:
            m = []
            for a, z in zip(at[:-1], at[1:], strict=True):
                m.append([np.mean(q) if (q := [r[x] for x in r if a <= x < z]) else np.nan for _, r in sorted(rows.items())])
            with np.errstate(all="ignore"):
                r = [np.corrcoef(p, q)[0, 1] for p, q in zip(m[:-1], m[1:], strict=True)]
            cut = [min(0.9 / min(np.nanmean(p), np.nanmean(q)) ** 0.6 + 0.5, 0.9) for p, q in zip(m[:-1], m[1:], strict=True)]
            if not any(a > b for a, b in zip(r, cut, strict=True)):
                break
            at = [p for i, p in enumerate(at) if not (0 < i < len(at) - 1 and abs(r[i - 1]) >= cut[i - 1])]
        want |= {(c, a, z) for a, z in zip(at[:-1], at[1:], strict=True)}
    assert {(r["locus"], r["w0"], r["w1"]) for r in run("correlated_segments")} == want


def test_sample_clusters(run, panel):
    spans = spans_above(panel, 2.1)
    names = sorted({s for _, s in panel})
    size = {s: sum(e - b for _, b, e in spans[s]) for s in names}

    def far(a, b):
        o = sum(max(0, min(e, z) - max(s, y)) for c, s, e in spans[a] for d, y, z in spans[b] if c == d)
        q = 1 - min(o / size[a], o / size[b]) if o else 1
        return q if q < 0.9 else 1

    groups = [[s] for s in names]
    while len(groups) > 1:
        d, i, j = min((max(far(a, b) for a in groups[i] for b in groups[j]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if d > 0.95 or d >= 1:
            break
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
    groups.sort(key=min)
    assert {r["sample"]: r["cluster"] for r in run("sample_clusters")} == {s: k for k, g in enumerate(groups) for s in g}


def test_shared_chunks(run, panel):
    spans = spans_above(panel, 2.0)
    pairs = defaultdict(set)
    for _, s in panel:
        pairs[int(s) // 2].add(s)
    want = []
    for cluster, members in pairs.items():
        for c in {c for c, _ in panel}:
            rows, chunk = sorted((b * v.WIDTH, e * v.WIDTH, s) for s in members for k, b, e in spans[s] if k == c), []
            for x in [*rows, None]:
                if chunk and (x is None or x[0] > max(e for _, e, _ in chunk)):
                    if {s for *_, s in chunk} == members:
                        want.append((cluster, c, float(np.median([b for b, *_ in chunk])), float(np.median([e for _, e, _ in chunk])), len(members)))
                    chunk = []
                if x:
                    chunk.append(x)
    assert sorted((r["cluster"], r["chr"], r["start"], r["end"], r["members"]) for r in run("shared_chunks")) == sorted(want)


def planted(rng, carriers, spans, n=30, m=60):
    wide = rng.normal(2, 0.05, (n, m))
    for who, (a, e), by in zip(carriers, spans, [1] * len(spans), strict=True):
        wide[who, a:e] += by
    return wide


def test_complex_locus_with_one_varying_span_is_simple():
    rng = np.random.default_rng(1)
    got = chain.assess(planted(rng, [[0, 1, 2, 3]], [(20, 40)]), np.arange(60), [0, 20, 40, 60])
    assert got == [((20, 40), list(range(30)), True)]


def test_complex_locus_parts_overlapping_carriers():
    """Samples 0-5 carry 10 to 30, samples 12-17 carry 20 to 40: neither is assessed where it carries the other span."""
    rng = np.random.default_rng(2)
    one, two = list(range(6)), list(range(12, 18))
    wide = planted(rng, [one, two], [(10, 30), (20, 40)])
    got = {s: who for s, who, simple in chain.assess(wide, np.arange(60), [0, 10, 20, 30, 40, 60], chain.Limits(singleton_sigma=2, dup_sigma=2)) if not simple}
    assert got == {(10, 30): [i for i in range(30) if i not in two], (20, 40): [i for i in range(30) if i not in one]}
    # a second panel that does not vary there rejects the spans of high copy number
    flat = rng.normal(2, 0.01, wide.shape)
    assert chain.assess(wide, np.arange(60), [0, 10, 20, 30, 40, 60], chain.Limits(singleton_sigma=2, dup_sigma=2), second=flat * 0 + 2) == []


def test_complex_loci_query(run):
    rows = run("complex_loci")
    assert all(r["w0"] < r["w1"] and r["samples"] for r in rows)

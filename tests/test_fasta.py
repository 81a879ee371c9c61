"""FASTA source: index by splits of every width, fetches against plain slices, write and read back."""

import random

import pytest

from tests.oracle import assert_same
from windrow.plans import registry
from windrow.sources import fasta


def draw(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGTNacgt") for _ in range(n))


CONTIGS = {"chr1": draw(1_234, 1), "chr2 second": draw(60, 2), "empty": "", "tiny": "A", "long": draw(5_000, 3)}


def text(contigs, width, end="\n"):
    out = []
    for name, s in contigs.items():
        out.append(f">{name}")
        out += [s[i : i + width] for i in range(0, len(s), width)]
    return end.join(out) + end


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("fasta")
    (f / "a.fa").write_bytes(text(CONTIGS, 60).encode())
    (f / "b.fa").write_bytes(text({"other": draw(333, 4), "last": draw(77, 5)}, 25, "\r\n").encode().rstrip())
    return f


SEQUENCES = {k.split()[0]: s for k, s in CONTIGS.items()} | {"other": draw(333, 4), "last": draw(77, 5)}


def plain_index(path):
    """contig -> (length, offset, bases, bytes) by reading the file line by line."""
    out, at, name = {}, 0, None
    for line in path.read_bytes().splitlines(keepends=True):
        body = line.rstrip(b"\r\n")
        if body.startswith(b">"):
            name = body[1:].split()[0].decode()
            out[name] = [0, None, None, None]
        elif body:
            e = out[name]
            if e[1] is None:
                e[1:] = [at, len(body), len(line) if line.endswith(b"\n") else len(line) + 1]
            e[0] += len(body)
        at += len(line)
    return {k: tuple(x) for k, x in out.items()}


@pytest.mark.parametrize("split", [17, 61, 1_000, 1 << 20])
def test_index_does_not_depend_on_splits(spark, folder, split):
    got = {r["contig"]: (r["length"], r["offset"], r["line_bases"], r["line_bytes"]) for r in fasta.fasta_index(spark, f"file://{folder}", split).collect()}
    assert got == plain_index(folder / "a.fa") | plain_index(folder / "b.fa")


def test_regions_equal_slices(spark, folder):
    index = fasta.fasta_index(spark, f"file://{folder}/*.fa", 500).persist()
    r = random.Random(7)
    regions = [(i, r.choice([*SEQUENCES, "none"]), s := r.randrange(-20, 1_300), s + r.randrange(0, 400)) for i in range(300)]
    df = spark.createDataFrame(regions, "id long, contig string, start long, end long").repartition(5)
    got = {r["id"]: r["bases"] for r in fasta.fetched_bases(index, df).collect()}
    assert got == {i: SEQUENCES[c][max(0, s) : max(0, e)] for i, c, s, e in regions if c in SEQUENCES}
    whole = fasta.fetched_bases(index, fasta.chunks(index, 100)).collect()
    for name, s in SEQUENCES.items():
        assert "".join(x["bases"] for x in sorted((x for x in whole if x["contig"] == name), key=lambda x: x["start"])) == s


def test_bases_after_the_start(spark, folder):
    index = fasta.fasta_index(spark, f"file://{folder}", 500)
    loci = [(c, p) for c in [*SEQUENCES, "none"] for p in (-1, 0, 1, 59, 60, 61, 332, 1_233, 1_234, 4_999, 5_000)]
    df = spark.createDataFrame(loci * 2, "contig string, start long").selectExpr("*", "1 as chunk", "2 as bases", "3 as file", "4 as ref_")
    got = sorted((r["contig"], r["start"], r["ref"]) for r in fasta.with_reference(df, index, 100).collect())
    want = [(c, p, SEQUENCES[c][p] if c in SEQUENCES and 0 <= p < len(SEQUENCES[c]) else "N") for c, p in loci]
    assert got == sorted(want * 2)


def test_gc(spark, folder):
    index = fasta.fasta_index(spark, f"file://{folder}")
    axis = [(c, s, s + 50) for c in SEQUENCES for s in range(0, 1_300, 50)]
    got = {(r["contig"], r["start"]): r["gc"] for r in fasta.window_gc(spark.createDataFrame(axis, "contig string, start long, end long"), index).collect()}
    for c, s, e in axis:
        part = SEQUENCES[c][s:e].upper()
        known = sum(part.count(b) for b in "ACGT")
        assert got[c, s] == (pytest.approx((part.count("G") + part.count("C")) / known) if known else None)


@pytest.mark.parametrize("width", [7, 60])
def test_write_and_read_back(spark, tmp_path, width):
    whole = {"a": draw(500, 8), "b": draw(61, 9)}
    pieces = [("a", 0, whole["a"][:13]), ("a", 13, whole["a"][13:200]), ("a", 205, whole["a"][205:]), ("b", 3, whole["b"][3:]), ("b", 0, "")]
    at = f"file://{tmp_path}/out"
    fasta.write_fasta(spark.createDataFrame(pieces, "contig string, start long, bases string"), at, width)
    index = fasta.fasta_index(spark, at, 100)
    got = {r["contig"]: r["bases"] for r in fasta.fetched_bases(index, index.selectExpr("contig", "0L as start", "length as end")).collect()}
    assert got == {"a": whole["a"][:200] + "N" * 5 + whole["a"][205:], "b": "NNN" + whole["b"][3:]}
    lines = sorted(r["value"].split("\t") for r in fasta.index_lines(index).collect())
    assert [(x[0], x[1], x[3], x[4]) for x in lines] == [("a", "500", str(width), str(width + 1)), ("b", "61", str(min(61, width)), str(min(61, width) + 1))]


def test_uneven_lines_and_compressed_files_are_refused(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACGT\nAC\nACGT\n")
    with pytest.raises(Exception, match="unequal length in contig a"):
        fasta.fasta_index(spark, f"file://{tmp_path}/x.fa").collect()
    for split in (5, 9):
        with pytest.raises(Exception, match="unequal length in contig a"):
            fasta.fasta_index(spark, f"file://{tmp_path}/x.fa", split).collect()
    (tmp_path / "x.fa.gz").write_bytes(b"")
    with pytest.raises(ValueError, match="compressed"):
        fasta.fasta_index(spark, f"file://{tmp_path}")


@pytest.mark.parametrize("name", ["fasta_bases", "fasta_gc"])
def test_queries(spark, tiny, name):
    assert_same(registry.queries()[name](spark, tiny), registry.oracle_sql()[name], tiny)

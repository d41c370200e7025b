import gzip

import random

import pytest

from pairlocus.sources import bed, vcf

VCF = """##fileformat=VCFv4.2
##contig=<ID=1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
1\t11\t.\tA\tC\t.\t.\tMR=0.5\tGT:GQ\t0/1:30\t1|1:.
1\t21\t.\tA\tC,G\t.\t.\tX=1;MR=1.5\tGT:GQ\t0/2:9\t0/0:8
1\t31\t.\tT\tC\t.\t.\tMR=2.0\tGT:GQ\t0/0:1\t./.:2
"""


@pytest.fixture
def variants(tmp_path):
    path = tmp_path / "a.vcf.gz"
    path.write_bytes(gzip.compress(VCF.encode()))
    return str(path)


def alleles(row):
    return [(g.a0, g.a1) for g in row.gt]


def test_genotypes(spark, variants):
    assert vcf.header(spark, variants) == ["A", "B"]
    rows = {r.pos: r for r in vcf.read_genotypes(spark, variants, multiallelic=True, allow_missing=True).collect()}
    assert alleles(rows[10]) == [(0, 1), (1, 1)] and rows[10].gq == [30.0, None]
    assert rows[20].alt == ["C", "G"] and alleles(rows[30])[1] == (None, None)
    two = vcf.read_genotypes(spark, variants, allow_missing=True, region=(0, 25, 30)).collect()
    assert [r.pos for r in two] == [10]
    swapped = vcf.read_genotypes(spark, variants, region=(0, 20), samples=["B", "A"]).first()
    assert alleles(swapped) == [(1, 1), (0, 1)]
    with pytest.raises(ValueError, match="doesn't have"):
        vcf.read_genotypes(spark, variants, samples=["Z"])


def test_missing_genotypes_fail_unless_allowed(spark, variants):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        vcf.read_genotypes(spark, variants).collect()


def test_masks_and_lengths(spark, variants):
    mask = spark.createDataFrame([("1", 5, 12), ("1", 18, 19), ("1", 30, 31)], "chrom string, start long, end long")
    kept = vcf.read_genotypes(spark, variants, mask, allow_missing=True)
    assert sorted(r.pos for r in kept.collect()) == [10, 30]
    kept = vcf.read_genotypes(spark, variants, mask, min_length=1, allow_missing=True)
    assert [r.pos for r in kept.collect()] == [10]


def test_rates_contigs_and_coverage(spark, variants):
    rates = {r.pos: r.u / vcf.RATE_UNIT for r in vcf.read_mutation_rates(spark, variants).collect()}
    assert rates == pytest.approx({10: 0.5, 20: 1.5, 30: 2.0})
    assert [tuple(r) for r in vcf.contig_lengths(spark, variants).collect()] == [("1", 1000)]
    assert sorted((r.start, r.end) for r in vcf.coverage(spark, variants).collect()) == [(10, 11), (20, 21), (30, 31)]


def test_merged_files_fill_with_the_reference(spark):
    schema = "chrom string, pos long, ref string, alt array<string>, gt array<struct<a0: int, a1: int>>"
    a = spark.createDataFrame([("1", 1, "A", ["C"], [(0, 1)]), ("1", 2, "A", ["C"], [(1, 1)])], schema)
    b = spark.createDataFrame([("1", 2, "A", ["G"], [(0, 1), (0, 0)]), ("1", 3, "T", ["G"], [(1, 1), (0, 1)])], schema)
    rows = {r.pos: r for r in vcf.merge_variants(a, b).collect()}
    assert alleles(rows[1]) == [(0, 1), (0, 0), (0, 0)]
    assert alleles(rows[2]) == [(1, 1), (0, 2), (0, 0)] and rows[2].alt == ["C", "G"]
    assert alleles(rows[3]) == [(0, 0), (1, 1), (0, 1)]
    assert sorted(r.pos for r in vcf.variable(vcf.merge_variants(a, b)).collect()) == [1, 2, 3]


def test_alleles_of_many_files_keep_their_letters(spark):
    """Four files of random alternatives, repeated and missing sites: every allele is the letter it was."""
    rng = random.Random(4)
    schema = "chrom string, pos long, ref string, alt array<string>, gt array<struct<a0: int, a1: int>>"
    files, want = [], {}
    for n in range(4):
        rows = []
        for pos in rng.sample(range(30), 18):
            alt = rng.choice([["."], ["C"], ["G", "C"], ["T", "G", "<DEL>"]])
            size = 0 if alt == ["."] else len(alt)
            gt = [tuple(rng.choice([None, *range(size + 1)]) for _ in "ab") for _ in range(n % 2 + 1)]
            rows.append(("1", pos, rng.choice("AA T".split())[0], alt, gt))
        files.append(spark.createDataFrame(rows, schema))
        for _, pos, ref, alt, gt in rows:
            want.setdefault((pos, ref), {})[n] = [tuple(None if a is None else [ref, *alt][a] for a in g) for g in gt]
    got = {(r.pos, r.ref): r for r in vcf.merge_variants(*files).collect()}
    assert got.keys() == want.keys()
    for (pos, ref), own in want.items():
        row = got[pos, ref]
        letters = [tuple(None if a is None else [ref, *row.alt][a] for a in g) for g in alleles(row)]
        assert letters == [g for n in range(4) for g in own.get(n, [(ref, ref)] * (n % 2 + 1))]
        assert len(set(row.alt)) == len(row.alt) and "." not in row.alt


def test_repeated_sites_go_one_by_one(spark):
    schema = "chrom string, pos long, ref string, alt array<string>, gt array<struct<a0: int, a1: int>>"
    a = spark.createDataFrame([("1", 1, "A", ["C"], [(1, 1)]), ("1", 1, "A", ["G"], [(1, 0)])], schema)
    b = spark.createDataFrame([("1", 1, "A", ["T"], [(0, 1)])], schema)
    rows = sorted((r.alt, alleles(r)) for r in vcf.merge_variants(a, b).collect())
    assert rows == [(["C", "T"], [(1, 1), (0, 2)]), (["G"], [(1, 0), (0, 0)])]
    empty = spark.createDataFrame([], schema)
    assert len(vcf.merge_variants(a, empty).collect()) == 2 and vcf.merge_variants(empty, empty).collect() == []
    assert [alleles(r) for r in vcf.merge_variants(b, empty, samples=[1, 2]).collect()] == [[(0, 1), (0, 0), (0, 0)]]


def test_sites_round_trip(spark, tmp_path):
    rows = [("1", p, [p]) for p in range(50)] + [("2", 7, [7])]
    vcf.write_sites(spark.createDataFrame(rows, "chrom string, pos long, gt array<int>"), str(tmp_path / "sites"))
    back = spark.read.schema("pos long, gt array<int>, chrom string").parquet(str(tmp_path / "sites"))
    assert sorted((r.chrom, r.pos) for r in back.collect()) == sorted(r[:2] for r in rows)


@pytest.mark.parametrize("head", ["", "#chrom\tchromStart\tchromEnd\n"])
def test_bed(spark, tmp_path, head):
    (tmp_path / "a.bed").write_text(head + "1\t5\t9\n")
    assert [tuple(r) for r in bed.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [("1", 5, 9)]
    assert bed.read_bed(spark, str(tmp_path / "a.bed"), min_length=4).count() == 0
    bed.write_bed(bed.read_bed(spark, str(tmp_path / "a.bed")), str(tmp_path / "out"), header=True, compression="gzip")
    assert [tuple(r) for r in bed.read_bed(spark, str(tmp_path / "out")).collect()] == [("1", 5, 9)]


def test_bedgraph(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#chrom,start,end,u,w\n1,0,1e3,0.5,2\n1,1000,2000,,3\n")
    df = bed.read_bedgraph(spark, str(tmp_path / "a.csv"))
    assert sorted(tuple(r) for r in df.collect())[0] == ("1", 0, 1000, 0.5, 2.0)
    bed.write_bedgraph(df, str(tmp_path / "out"))
    assert bed.read_bedgraph(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "b.csv").write_text("chrom,from,to\n1,0,1\n")
    with pytest.raises(ValueError, match="header"):
        bed.read_bedgraph(spark, str(tmp_path / "b.csv"))


def test_small_texts(spark, tmp_path):
    (tmp_path / "map").write_text("Position(bp) Rate Map(cM)\n10 1 0.0\n20 1 0.5\n")
    assert [tuple(r) for r in bed.read_recombination_map(spark, str(tmp_path / "map"), "1").collect()] == [("1", 10.0, 0.0), ("1", 20.0, 0.5)]
    with pytest.raises(ValueError, match="columns"):
        bed.read_recombination_map(spark, str(tmp_path / "map"), "1", "other")
    (tmp_path / "windows").write_text("0.0e+00 1.5e+02 2e2\n")
    assert [tuple(r) for r in bed.read_windows(spark, str(tmp_path / "windows"), "1").collect()] == [("1", 0, 150, 200)]
    (tmp_path / "bins").write_text("1e-3\n1e-6 1e-4\n")
    assert bed.read_edges(spark, str(tmp_path / "bins")) == [1e-6, 1e-4, 1e-3]
    (tmp_path / "pops").write_text("s1 X\ns2 Y\n")
    assert bed.read_populations(spark, str(tmp_path / "pops")) == [("s1", "X"), ("s2", "Y")]
    (tmp_path / "pops").write_text("s1 X\ns2 X\n")
    with pytest.raises(ValueError, match="unique"):
        bed.read_populations(spark, str(tmp_path / "pops"))

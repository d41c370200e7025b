"""Block-gzipped files: split reads, regions by index, ordered writes that show nothing when they fail."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from pairlocus.sources import blocks, vcf


def lines_of(n, rng, chroms=("1", "2", "chrX")):
    out = []
    for c in chroms:
        pos = 0
        for _ in range(n):
            pos += rng.randint(1, 60)
            out.append(f"{c}\t{pos}\t{'x' * rng.choice([1, 30, 300])}")
    return out


def file_of(path, lines, sizes):
    """Members of text cut anywhere, lines across them."""
    text, at = "\n".join(lines).encode() + b"\n", 0
    data = b""
    for n in sizes:
        data += blocks.member(text[at : at + n])
        at += n
        if at >= len(text):
            break
    assert at >= len(text)
    path.write_bytes(data + blocks.LAST)
    return str(path)


@pytest.mark.parametrize("split", [200, 1500, 1 << 20])
def test_every_line_once_wherever_members_are_cut(tmp_path, split):
    rng = random.Random(split)
    lines = ["##header", "#CHROM\tPOS", *lines_of(200, rng)]
    path = file_of(tmp_path / "a.gz", lines, (rng.choice([1, 40, 700, 3000]) for _ in range(5000)))
    reader = blocks.BlockReader({"path": path, "split": str(split)})
    parts = reader.partitions()
    got = [v for p in parts for b in reader.read(p) for v in b["value"].to_pylist()]
    assert got == lines and (split > 1 << 19 or len(parts) > 3)
    assert gzip.decompress((tmp_path / "a.gz").read_bytes()).decode().splitlines() == lines


def test_members_end_with_lines(tmp_path):
    lines = [f"1\t{n}\tx" for n in range(1, 100)]
    path = file_of(tmp_path / "a.gz", lines, [sum(len(x) + 1 for x in lines[i : i + 3]) for i in range(0, 99, 3)])
    reader = blocks.BlockReader({"path": path, "split": "90"})
    assert [v for p in reader.partitions() for b in reader.read(p) for v in b["value"].to_pylist()] == lines


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(blocks.LAST)
    assert blocks.is_blocked(str(tmp_path / "a.gz")) and blocks.read_blocks(spark, str(tmp_path / "a.gz")).collect() == []
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"1\t2\n"))
    assert not blocks.is_blocked(str(tmp_path / "b.gz")) and not blocks.is_blocked(str(tmp_path))


@pytest.fixture
def written(spark, tmp_path):
    rng = random.Random(3)
    lines = lines_of(4000, rng)
    rng.shuffle(lines)
    rows = [(x.split("\t")[0], int(x.split("\t")[1]) - 1, x) for x in lines]
    path = str(tmp_path / "w.gz")
    blocks.write_blocks(spark.createDataFrame(rows, blocks.SCHEMA).repartition(7), path, "##a\n#CHROM\tPOS")
    return path, sorted(rows)


def test_one_sorted_file_and_back(spark, written):
    path, rows = written
    text = gzip.open(path, "rt").read().splitlines()
    assert text[:2] == ["##a", "#CHROM\tPOS"] and text[2:] == [r[2] for r in rows]
    df = blocks.read_blocks(spark, path, 1 << 14)
    assert df.rdd.getNumPartitions() > 3
    assert sorted(tuple(r) for r in df.where("chrom is not null").collect()) == rows
    with pytest.raises(Exception, match="there already"):
        blocks.write_blocks(df.where("chrom = '1'"), path)
    before = open(path, "rb").read()
    bad = df.where("chrom = '2'").withColumn("value", F.when(F.col("pos") > 50_000, F.raise_error(F.lit("no such line"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no such line"):
        blocks.write_blocks(bad, path, overwrite=True)
    assert open(path, "rb").read() == before
    with pytest.raises(Exception, match="no such line"):
        blocks.write_blocks(bad, path + "2")
    import os

    assert sorted(os.listdir(os.path.dirname(path))) == ["w.gz", "w.gz.csi"]


def test_regions_read_few_members(spark, written):
    path, rows = written
    for chrom, low, high in (("1", 0, 500), ("2", 30_000, 33_000), ("chrX", 100_000, 10**9), ("2", 5, 6), ("none", 0, 9)):
        df = blocks.read_blocks(spark, path).where((F.col("chrom") == chrom) & (F.col("pos") >= low) & (F.col("pos") < high))
        assert sorted(tuple(r) for r in df.collect()) == [r for r in rows if r[0] == chrom and low <= r[1] < high]
        reader = blocks.BlockReader({"path": path})
        list(reader.pushFilters([blocks.EqualTo(("chrom",), chrom), blocks.GreaterThanOrEqual(("pos",), low), blocks.LessThan(("pos",), high)]))
        read = sum(len(b) for p in reader.partitions() for b in reader.read(p))
        assert read < len(rows) / 2


def test_tabix_index(tmp_path):
    """The older format, with chunks that begin and end within members."""
    lines = [f"{c}\t{p}\tv" for c in ("a", "b") for p in range(1, 60_000, 100)]
    path = file_of(tmp_path / "t.gz", lines, [700] * 200)
    offsets, at = [], 0  # where each member begins
    while at < len((tmp_path / "t.gz").read_bytes()) - len(blocks.LAST):
        offsets.append(at)
        at += blocks.member_size((tmp_path / "t.gz").read_bytes()[at : at + 18])
    ends = [0]
    for line in lines:
        ends.append(ends[-1] + len(line) + 1)
    place = [offsets[min(e // 700, len(offsets) - 1)] << 16 | e % 700 for e in ends[:-1]] + [at << 16]
    raw = b"TBI\x01" + struct.pack("<8i", 2, 2, 1, 2, 0, ord("#"), 0, 4) + b"a\0b\0"
    for c in ("a", "b"):
        own: dict[int, list] = {}
        for n, line in enumerate(lines):
            if line.startswith(c):
                p = int(line.split("\t")[1]) - 1
                own.setdefault(blocks.bin_of(p, p, 14, 5), []).append((place[n], place[n + 1]))
        raw += struct.pack("<i", len(own))
        for k, chunks in own.items():
            raw += struct.pack("<Ii", k, 1) + struct.pack("<QQ", chunks[0][0], chunks[-1][1])
        raw += struct.pack("<i", 0)
    (tmp_path / "t.gz.tbi").write_bytes(gzip.compress(raw))
    for chrom, low, high in (("a", 0, 100), ("b", 20_000, 40_000), ("b", 59_000, 1 << 40)):
        reader = blocks.BlockReader({"path": path})
        list(reader.pushFilters([blocks.EqualTo(("chrom",), chrom), blocks.GreaterThanOrEqual(("pos",), low), blocks.LessThan(("pos",), high)]))
        got = [v for p in reader.partitions() for b in reader.read(p) for v in b["value"].to_pylist()]
        want = [x for x in lines if x.startswith(chrom) and low <= int(x.split("\t")[1]) - 1 < high]
        assert [x for x in got if x in set(want)] == want and len(got) == len(set(got)) < len(lines)


def test_variants_round_trip(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, p, "A", ["C", "G"][: 1 + p % 2], [(rng.choice([None, 0, 1]), 1), (0, 0)]) for c in ("1", "2") for p in rng.sample(range(3000), 500)]
    sites = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt array<string>, gt array<struct<a0: int, a1: int>>")
    path = str(tmp_path / "v.vcf.gz")
    vcf.write_variants(sites, path, ["s", "t"])
    assert vcf.header(spark, path) == ["s", "t"]

    def plain(df):
        return sorted((r.chrom, r.pos, r.alt, [(g.a0, g.a1) for g in r.gt]) for r in df.collect())

    want = sorted((c, p, alt, gt) for c, p, _, alt, gt in rows)
    assert str(plain(vcf.read_genotypes(spark, path, multiallelic=True, allow_missing=True))) == str(want)
    some = vcf.read_genotypes(spark, path, region=(500, 700), chrom="2", multiallelic=True, allow_missing=True)
    assert str(plain(some)) == str([r for r in want if r[0] == "2" and 500 <= r[1] < 700])

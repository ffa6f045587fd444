import gzip
import random
import struct

import pytest

from lociflow.sources import binary as S


def record(ref, pos, name, mapq, flag, cigar, seq, qual, tags=b"", mate=-1, mate_pos=-1, size=0):
    packed = bytearray((len(seq) + 1) // 2)
    for i, c in enumerate(seq):
        packed[i // 2] |= S.BASES.index(c) << (4 if i % 2 == 0 else 0)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), mate, mate_pos, size)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | S.OPS.index(o)) for n, o in cigar) + bytes(packed)
    body += (bytes(ord(q) - 33 for q in qual) if qual else b"\xff" * len(seq)) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    header = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(header)) + header + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 99)
    tags = b"NMC\x02MDZ4A0\0XBBs" + struct.pack("<ihh", 2, -1, 7)
    data += record(0, 4, "r1", 60, 16, [(2, "S"), (3, "M")], "ACGTN", "IIII!", tags, 0, 9, -30)
    data += record(-1, -1, "u", 0, 4, [], "", None)
    with gzip.open(tmp_path / "x.bam", "wb") as f:
        f.write(data)
    a, b = S.read_bam(spark, f"{tmp_path}/*.bam").orderBy("name").collect()
    assert (a.name, a.flag, a.chrom, a.pos, a.mapq, a.mate_chrom, a.mate_pos, a.insert_size) == ("r1", 16, "c1", 5, 60, "c1", 10, -30)
    assert [tuple(c) for c in a.cigar] == [(2, "S"), (3, "M")] and (a.seq, a.qual) == ("ACGTN", "IIII!")
    assert a.tags == {"NM": "i:2", "MD": "Z:4A0", "XB": "B:s,-1,7"}
    assert (b.chrom, b.pos, b.cigar, b.seq, b.qual, b.tags) == (None, 0, None, None, None, {})
    (tmp_path / "y.bam").write_bytes(gzip.compress(b"nope"))
    with pytest.raises(Exception, match="no BAM file"):
        S.read_bam(spark, f"{tmp_path}/y.bam").collect()
    assert S.read_bam(spark, f"{tmp_path}/none*.bam").collect() == []


def test_plink(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "VARIANTS", 2)
    (tmp_path / "g.fam").write_text("".join(f"f s{i} 0 0 1 1\n" for i in range(5)))
    (tmp_path / "g.bim").write_text("".join(f"1 v{i} 0 {10 + i} A C\n" for i in range(3)))
    rows = [[2, -1, 1, 0, 2], [0, 0, 0, 0, 0], [1, 2, -1, 2, 1]]
    code = {2: 0, -1: 1, 1: 2, 0: 3}
    raw = b"".join(bytes([sum(code[g] << 2 * j for j, g in enumerate(r[i : i + 4])) for i in (0, 4)]) for r in rows)
    (tmp_path / "g.bed").write_bytes(b"\x6c\x1b\x01" + raw)
    got = S.read_plink(spark, f"{tmp_path}/g").orderBy("pos").collect()
    assert [r.copies for r in got] == rows and [r.id for r in got] == ["v0", "v1", "v2"]


@pytest.mark.parametrize("split, block", [(1_000, 300), (5_000, 4_000), (777, 60_000), (20_000, 9_000)])
def test_ranges_of_a_bam_file_hold_every_record_once(spark, tmp_path, monkeypatch, split, block):
    rng = random.Random(split)
    schema = "name string, flag int, chrom string, pos int, mapq int, cigar array<struct<len:int,op:string>>, mate_chrom string, mate_pos int, insert_size int, seq string, qual string, tags map<string,string>"
    rows = []
    for i in range(900):
        n = rng.choice([0, 1, 30, 100, 101, 3000 if i % 97 == 0 else 50])
        seq = "".join(rng.choice("ACGT") for _ in range(n)) or None
        rows.append((f"read{i:05d}", 4 * (i % 2), rng.choice(["c1", "c2", None]), rng.randint(0, 10**6), rng.randint(0, 60), [(n, "M")] if n else None, None, 0, 0, seq, "I" * n if n and i % 3 else None, {"NM": f"i:{i}", "RG": "Z:\x1f\x08"} if i % 5 else {}))
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    S.write_bam(spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path), [("c1", 10**6), ("c2", 10**6)])
    path = next(str(x) for x in tmp_path.iterdir())
    size = S.files.size(path)
    monkeypatch.setattr(S, "SPLIT", split)
    parts = S._BamReader({"path": path}).partitions()
    assert len(parts) > 1 and parts[-1].last == size
    got = [r for p in parts for r in S.bam_range(path, p.first, p.last)]
    assert got == list(S.bam_records(path)) and [r[1] for r in got] == [r[0] for r in rows]
    assert sorted(r.name for r in S.read_bam(spark, path).collect()) == [r[0] for r in rows]

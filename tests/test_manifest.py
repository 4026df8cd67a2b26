from __future__ import annotations

import hashlib

import pytest

from areascreen.sources import manifest


def plain_root(raw: bytes, width: int, fan: int) -> str:
    level = [hashlib.sha256(raw[k : k + width]).hexdigest() for k in range(0, len(raw), width)]
    while True:
        level = [hashlib.sha256("".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
        if len(level) == 1:
            return level[0]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "data"
    (root / "below").mkdir(parents=True)
    (root / "large.bin").write_bytes(bytes((k * k) % 251 for k in range(10_007)))
    (root / "below" / "edge.bin").write_bytes(b"x" * 1000)
    (root / "small.txt").write_bytes(b"few")
    (root / "empty.txt").write_bytes(b"")
    return root


@pytest.mark.parametrize("fan", [4, 1024])
def test_manifest_has_plain_digests_of_small_files_and_roots_of_large_ones(spark, folder, monkeypatch, fan):
    monkeypatch.setattr(manifest, "FAN", fan)
    got = {r.file_name: (r.byte_size, r.sha256) for r in manifest.file_manifest(spark, str(folder), range_bytes=1000).collect()}
    assert got["small.txt"] == (3, hashlib.sha256(b"few").hexdigest())
    assert got["below/edge.bin"] == (1000, hashlib.sha256(b"x" * 1000).hexdigest())
    assert got["large.bin"] == (10_007, plain_root((folder / "large.bin").read_bytes(), 1000, fan))
    assert len(got) == 3  # an empty file has no row


def test_one_changed_byte_is_named_by_its_range(spark, folder):
    ranges = lambda: manifest.range_digests(spark, str(folder), range_bytes=1000)
    before = spark.createDataFrame(ranges().collect(), ranges().schema)
    whole = spark.createDataFrame(manifest.file_manifest(spark, str(folder), range_bytes=1000).collect())
    raw = bytearray((folder / "large.bin").read_bytes())
    raw[4_321] ^= 1
    (folder / "large.bin").write_bytes(bytes(raw))
    verdicts = {(r.file_name, r.start): r.status for r in manifest.verify_ranges(ranges(), before).collect()}
    assert [k for k, v in verdicts.items() if v != "match"] == [("large.bin", 4000)] and len(verdicts) == 13  # eleven ranges of the large file, one of each other
    changed = {r.file_name for r in manifest.verify_manifest(manifest.file_manifest(spark, str(folder), range_bytes=1000), whole).collect() if r.status == "changed"}
    assert changed == {"large.bin"}
    (folder / "large.bin").write_bytes(bytes(raw) + b"more" * 300)
    grown = {(r.start, r.status) for r in manifest.verify_ranges(ranges(), before).collect() if r.status != "match"}
    assert grown == {(4000, "changed"), (10000, "changed"), (11000, "unexpected")}

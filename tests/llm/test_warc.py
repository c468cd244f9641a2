"""WARC archives: exact round trips, deterministic files, revisits."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest

from patraka.llm import warc
from patraka.llm.queries import ORACLES, op3_warc
from tests.compare import duck, same

LONG = "<p>" + "x" * 200 + "</p>"


def files(folder: Path) -> dict[str, bytes]:
    return {p.name: p.read_bytes() for p in folder.glob("*.warc.gz")}


def test_query_like_sql(spark, sf):
    same(op3_warc(spark, sf), duck(sf), ORACLES["op3_warc"])


def test_payloads_come_back(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    manifest = warc.write(pages, f"file://{tmp_path}/a", roll=20_000, shard_bytes=100_000).collect()
    assert len(manifest) > 3 and max(m.bytes for m in manifest) < 60_000
    assert {m.file for m in manifest} == set(files(tmp_path / "a"))
    assert all(hashlib.sha256(files(tmp_path / "a")[m.file]).hexdigest() == m.sha256 for m in manifest)
    got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    payload = {r.page_id: (r.url, (r.html or "").encode()) for r in pages.collect()}
    assert set(got) == set(payload)
    for i, (url, body) in payload.items():
        assert got[i].url == url and got[i].payload_digest == hashlib.sha256(body).hexdigest()
        source = got[i] if got[i].record_type == "response" else got[got[i].refers_to]
        assert bytes(source.payload) == body
    assert not list((tmp_path / "a").glob(".tmp*"))


def test_same_bytes_whatever_the_partitions(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write(pages, f"file://{tmp_path}/a", roll=20_000, shard_bytes=100_000)
    warc.write(pages.repartition(7), f"file://{tmp_path}/b", roll=20_000, shard_bytes=100_000)
    assert files(tmp_path / "a") == files(tmp_path / "b")


def test_files_are_gzip_members_of_whole_records(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/ b", "é" * 80), (2, None, None)], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/a")
    (data,) = files(tmp_path / "a").values()
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 2 and data.count(b"\x1f\x8b\x08") >= 2
    assert b"WARC-Target-URI: http://a/ b\r\n" in text


def test_revisits(spark, tmp_path):
    rows = [(5, "u", LONG), (3, "v", LONG), (9, "w", LONG), (1, "s", "short"), (2, "s", "short"), (4, None, None), (6, None, ""), (None, "n", LONG), (3, "v", LONG)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as digest", "1 as shard")
    warc.write(df, f"file://{tmp_path}/a")
    got = warc.read(spark, f"file://{tmp_path}/a").collect()
    assert len(got) == len(rows)
    said = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert said == [(0, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "revisit", 3), (6, "response", None), (9, "revisit", 3)]
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", LONG)], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/a")
    (path,) = (tmp_path / "a").glob("*.warc.gz")
    path.write_bytes(gzip.compress(gzip.decompress(path.read_bytes()).replace(b"xxxx</p>", b"xxxy</p>")))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"file://{tmp_path}/a").collect()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write(df, f"file://{tmp_path}/a").count() == 0
    assert warc.read(spark, f"file://{tmp_path}/a").count() == 0


def test_payloads_with_blank_lines_and_binary_looks(spark, tmp_path):
    odd = "\r\n\r\nWARC/1.1\r\n\x00\x01" + "z" * 120
    df = spark.createDataFrame([(1, "u", odd), (2, "u", "\n\n")], "page_id long, url string, html string")
    warc.write(df, f"file://{tmp_path}/a")
    got = {r.page_id: bytes(r.payload) for r in warc.read(spark, f"file://{tmp_path}/a").collect()}
    assert got == {1: odd.encode(), 2: b"\n\n"}


def spread(spark, rows, folder, shard_bytes):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(df, f"file://{folder}", shard_bytes=shard_bytes).collect()
    got = warc.read(spark, f"file://{folder}").collect()
    assert len(got) == len(rows) == sum(m.records for m in manifest)
    per = {}
    for m in manifest:
        per[m.shard] = per.get(m.shard, 0) + m.records
    return got, per


def test_outlying_and_extreme_ids_are_spread(spark, tmp_path):
    rows = [(i, "u", f"{i} " + "y" * 150) for i in range(2000)] + [(2**63 - 1, "u", LONG), (-(2**63), "u", LONG), (10**15, None, "z" * 300)]
    got, per = spread(spark, rows, tmp_path / "a", 100_000)
    assert len(per) >= 10 and max(per.values()) <= 200
    assert {r.page_id for r in got} == {r[0] for r in rows}
    assert [(r.record_type, r.refers_to) for r in got if r.page_id == 2**63 - 1] == [("revisit", -(2**63))]


def test_null_ids_are_spread(spark, tmp_path):
    rows = [(None, "u", f"{i} " + "y" * 150) for i in range(2000)] + [(1, "u", "0 " + "y" * 150)]
    got, per = spread(spark, rows, tmp_path / "a", 100_000)
    assert len(per) >= 10 and max(per.values()) <= 200
    assert sum(r.record_type == "revisit" for r in got) == 1


def test_a_very_long_payload(spark, tmp_path):
    long_ = "<p>é" * 6_000_000
    got, _ = spread(spark, [(1, "u", long_), (2, "u", "short"), (3, "u", long_)], tmp_path / "a", 1 << 20)
    said = {r.page_id: (r.record_type, r.payload_bytes, r.refers_to) for r in got}
    n = len(long_.encode())
    assert said == {1: ("response", n, None), 2: ("response", 5, None), 3: ("revisit", n, 1)}
    assert next(bytes(r.payload) for r in got if r.page_id == 1) == long_.encode()

"""The log as a data source: segments, pruning, damage, following."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.sources import codec, manifest
from tidelog.errors import InvalidArgument
from tidelog.sources.wal import LogAppender, WalReader, WalWriter, register

ROWS = "lsn decimal(20,0), command int, arguments array<binary>"


@pytest.fixture
def wal(spark, tmp_path):
    register(spark)
    return str(tmp_path / "wal")


def log(spark, lsns, size=10):
    return spark.createDataFrame([(Decimal(n), 1, [b"k%d" % n, b"\xff\x00" * size]) for n in lsns], ROWS)


def write(df, folder, **options):
    df.write.format("wal").mode("append").options(**options).save(folder)


def lsns(df):
    return sorted(int(r.lsn) for r in df.collect())


def test_round_trip_over_segments_and_borders(spark, wal):
    numbers = [0, 1, 2**63, 2**64 - 1, *range(10, 400)]
    write(log(spark, numbers, 400).repartitionByRange(3, "lsn").sortWithinPartitions("lsn"), wal, segmentBytes=70_000)
    assert len(manifest.read_manifest(wal)) > 3 and manifest.is_ordered(wal)
    back = spark.read.format("wal").load(wal)
    assert lsns(back) == sorted(numbers)
    assert back.where("lsn = 2").count() == 0
    assert bytes(back.where("lsn = 10").first().arguments[1]) == b"\xff\x00" * 400
    assert lsns(back.where("lsn >= 300 AND lsn < 310")) == list(range(300, 310))
    assert lsns(back.where(F.col("lsn") > 2**62)) == [2**63, 2**64 - 1]


def test_segments_outside_the_bounds_are_skipped(spark, wal):
    write(log(spark, range(1000), 50).coalesce(1), wal, segmentBytes=8000)
    segments = manifest.read_manifest(wal)
    reader = WalReader({"path": wal})
    reader.low, reader.high = segments[5].lsn_start, segments[5].lsn_start + 1
    assert [s.segment for s in reader.partitions()] == [segments[5].name]


def test_overlapping_segments_are_never_skipped(spark, wal):
    write(log(spark, range(0, 200, 2)).coalesce(1), wal)
    write(log(spark, range(1, 200, 2)).coalesce(1), wal)
    assert not manifest.is_ordered(wal)
    assert lsns(spark.read.format("wal").load(wal).where("lsn >= 150")) == list(range(150, 200))


def test_foreign_folder_with_damage(spark, wal):
    os.makedirs(wal)
    good = codec.encode_record(7, 3, [b"k"])
    for name, data in (("a.log", good), ("b.log", good + b"\x02\x01"), ("c.log", b"")):
        open(os.path.join(wal, name), "wb").write(data)
    open(os.path.join(wal, manifest.MANIFEST), "w").write("a.log,7\nnot a line\nb.log,7\nc.log,9\nmissing.log,10\n")
    rows = spark.read.format("wal").option("mode", "PERMISSIVE").load(wal).collect()
    assert sum(r.error is None for r in rows) == 2 and {r.error for r in rows if r.error} == {
        "failed to decode arguments number", "failed to read segment: No such file or directory",
    }
    with pytest.raises(Exception, match="failed to decode|No such file"):
        spark.read.format("wal").load(wal).collect()


def test_nulls_are_refused_and_leave_nothing(spark, wal):
    with pytest.raises(Exception, match="nulls"):
        write(spark.createDataFrame([(Decimal(1), 1, [None])], ROWS), wal)
    assert manifest.read_manifest(wal) == []


def test_following_over_rotation(spark, wal, tmp_path):
    out, seen = str(tmp_path / "cp"), []

    def follow():
        q = (
            spark.readStream.format("wal").option("startingLsn", 5).load(wal).writeStream
            .foreachBatch(lambda df, _: seen.extend(lsns(df))).option("checkpointLocation", out).trigger(availableNow=True).start()
        )
        q.awaitTermination()

    write(log(spark, range(0, 50), 50).coalesce(1), wal, segmentBytes=2000)
    follow()
    write(log(spark, range(50, 90), 50).coalesce(1), wal, segmentBytes=2000)
    # A record that is still being written is not read yet.
    last = manifest.read_manifest(wal)[-1].name
    whole = codec.encode_record(90, 3, [b"k"])
    with open(os.path.join(wal, last), "ab") as f:
        f.write(whole[:3])
    follow()
    assert sorted(seen) == list(range(5, 90))
    with open(os.path.join(wal, last), "ab") as f:
        f.write(whole[3:])
    follow()
    assert sorted(seen) == list(range(5, 91))


def test_manifest_lookup_and_next_lsn(tmp_path):
    folder = str(tmp_path)
    assert manifest.read_manifest(folder) == [] and manifest.next_lsn(folder) == 0
    s = [manifest.Segment("a", 100), manifest.Segment("b", 200)]
    assert [manifest.segment_for_lsn(s, x) for x in (5, 100, 199, 200, 999)] == [0, 0, 0, 1, 1]
    open(os.path.join(folder, "a"), "wb").write(codec.encode_record(105, 3, [b"k"]) + codec.encode_record(103, 3, [b"k"]))
    manifest.append_manifest(folder, s[:1])
    assert manifest.next_lsn(folder) == 106
    open(os.path.join(folder, "a"), "wb").write(bytes(200))
    assert manifest.next_lsn(folder) == 10_100


def test_uris_and_the_shared_folder(spark, tmp_path):
    register(spark)
    folder = f"file://{tmp_path}/by-uri"
    write(log(spark, range(20)), folder)
    assert lsns(spark.read.format("wal").load(folder)) == list(range(20)) == lsns(spark.read.format("wal").load(f"{tmp_path}/by-uri"))


def test_records_longer_than_a_piece_and_odd_arguments(spark, wal):
    rows = [(Decimal(1), 1, [b"k", b"x" * 9_000_000]), (Decimal(2), 3, []), (Decimal(3), 1, [b"", b""]), (Decimal(300), 1000, [b"a"] * 200), (Decimal(2**64 - 1), 3, [b"z" * 128])]
    write(spark.createDataFrame(rows, ROWS).coalesce(1), wal)
    back = {int(r.lsn): (r.command, [bytes(a) for a in r.arguments]) for r in spark.read.format("wal").load(wal).collect()}
    assert back == {int(n): (c, a) for n, c, a in rows}


def test_bytes_are_those_of_the_layout(spark, wal):
    rows = [(n, 1, [b"k" * (n % 300), b"v%d" % n]) for n in range(0, 60_000, 97)] + [(2**64 - 1, 3, [b""])]
    write(spark.createDataFrame([(Decimal(n), c, a) for n, c, a in rows], ROWS).coalesce(1), wal, segmentBytes=1 << 24)
    (segment,) = manifest.read_manifest(wal)
    assert open(os.path.join(wal, segment.name), "rb").read() == b"".join(codec.encode_record(*r) for r in rows)


def test_numbers_out_of_range_and_options_are_refused(spark, wal):
    with pytest.raises(Exception, match="out of the unsigned"):
        write(spark.createDataFrame([(Decimal(-1), 1, [b"k"])], ROWS), wal)
    for bad in ({"segmentBytes": "0"}, {"batchRecords": "many"}, {}):
        with pytest.raises(InvalidArgument):
            WalWriter({"path": wal} | bad if bad else {})
    with pytest.raises(InvalidArgument):
        WalReader({"path": wal, "mode": "LAX"})


def test_commit_reads_no_segment_that_the_manifest_covers(spark, wal, monkeypatch):
    write(log(spark, range(50)).coalesce(1), wal, segmentBytes=500)
    monkeypatch.setattr(manifest, "scan_records", lambda *a, **k: pytest.fail("a closed segment was read"))
    assert manifest.next_lsn(wal) == 50
    write(log(spark, range(50, 60)).coalesce(1), wal)
    assert manifest.next_lsn(wal) == 60


def test_appender_continues_a_partly_filled_segment(spark, wal):
    with LogAppender(wal, 1000) as a:
        assert a.next_lsn == 0
        a.append([(100, 1, [b"k", b"v"]), (101, 3, [b"k"])])
    with LogAppender(wal, 1000) as a:
        assert a.next_lsn == 102
        a.append([(102, 1, [b"k", b"w"])])
    assert len(manifest.read_manifest(wal)) == 1 and lsns(spark.read.format("wal").load(wal)) == [100, 101, 102]
    a = LogAppender(wal, 1000)
    a.append([(n, 1, [b"k", b"x" * 90]) for n in range(200, 230)])
    # Not closed, as after a crash: what the manifest says of the greatest LSN is out of date and must not be believed.
    assert [s.lsn_start for s in manifest.read_manifest(wal)] == [100, 200] and manifest.next_lsn(wal) == 230
    a.close()
    with open(os.path.join(wal, manifest.read_manifest(wal)[-1].name), "ab") as f:
        f.write(b"\x05\x01")
    with LogAppender(wal, 10_000) as a:
        assert a.next_lsn == 10_200
        a.append([(a.next_lsn, 3, [b"k"])])
    assert len(manifest.read_manifest(wal)) == 3


def test_appender_that_goes_back_marks_the_log(spark, wal):
    with LogAppender(wal, 100) as a:
        a.append([(50, 1, [b"k", b"v" * 80])])
        a.append([(10, 1, [b"k", b"v" * 80])])
    assert not manifest.is_ordered(wal) and lsns(spark.read.format("wal").load(wal).where("lsn < 20")) == [10]

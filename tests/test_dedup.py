"""The deduplicating stream against a plain pass over all batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelog.schema import LOG_BATCH
from tidelog.streaming.dedup import Deduplicator

SCHEMA = f"batch_id bigint, master_id string, slave_id string, sent_at timestamp_ntz, total int, events {LOG_BATCH['events'].dataType.simpleString()}, reply string, extra int"
T0 = dt.datetime(2031, 1, 1)


def batch(i, lsns, at=0, master="m", slave="s", total=None):
    sent = None if at is None else T0 + dt.timedelta(hours=at)
    return (i, master, slave, sent, len(lsns) if total is None else total, [(x, 1, ["k", "v"]) for x in lsns], None, 0)


def brute(batches):
    seen, surplus = {}, set()
    for b in sorted(batches):
        if b[4] and b[5] and len(b[5]) <= b[4] and all(e[2] and e[1] is not None and e[1] >= 0 for e in b[5]):
            for pos, e in enumerate(b[5]):
                if e[0] is not None and seen.setdefault((b[1], b[2], e[0]), (b[0], pos)) != (b[0], pos):
                    surplus.add((b[0], pos))
    return surplus, set(seen.values())


def write(spark, folder, batches, name):
    rows = [(*b[:5], [(None if e[0] is None else __import__("decimal").Decimal(e[0]), *e[1:]) for e in b[5]] if b[5] is not None else None, *b[6:]) for b in batches]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def result(d):
    surplus = [(r.batch_id, r.event_pos) for r in d.surplus().collect()]
    kept = [(r.batch_id, r.event_pos) for r in d.kept().collect()]
    assert len(surplus) == len(set(surplus)) and len(kept) == len(set(kept))
    return set(surplus), set(kept)


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/in"


def make(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        start = r.randrange(1, 400)
        lsns = [start + r.randrange(8) for _ in range(r.randrange(0, 12))]
        at = None if r.random() < 0.1 else i * 3 - r.choice([0, 0, 200])
        out.append(batch(i, lsns, at, r.choice("mn"), r.choice("st"), total=r.choice([None, None, 50, 1, 0])))
    return out


def test_all_copies_but_the_first(spark, folder):
    batches = make(1, 60)
    batches[3] = (*batches[3][:5], None, *batches[3][6:])
    batches.append((1000, "m", "s", T0, 3, [(5, 1, []), (6, 1, ["k"])], None, 0))
    batches.append((1001, "m", "s", T0, 3, [(None, 1, ["k"]), (6, 1, ["k"]), (2**64 - 1, 1, ["k"])], None, 0))
    batches.append((1002, "m", "s", T0, 1, [(2**64 - 1, 1, ["k"])], None, 0))
    write(spark, folder, batches, "a")
    assert result(Deduplicator(spark).run(folder)) == brute(batches)


def test_files_out_of_order_expired_state_and_restarts(spark, folder, tmp_path):
    batches = make(2, 80)
    parts = [batches[40:60], batches[:20], batches[60:], batches[20:40]]
    path = f"file://{tmp_path}/out"
    for i, part in enumerate(parts):
        write(spark, folder, part, str(i))
        # Each run resumes from the checkpoint; the short horizon has let most states expire by then.
        d = Deduplicator(spark, path, horizon="1 hour", files_per_trigger=1).run(folder)
    assert result(d) == brute(batches)
    assert any("step=1" in str(p) for p in (tmp_path / "out").rglob("*")), "no expired state was looked up in the ledger"


def test_null_ids_after_expiry(spark, folder, tmp_path):
    """Copies that come after their state has expired are found, whatever ids are null."""
    ids = [("m", "s"), ("m", None), (None, "s"), (None, None)]
    batches = [batch(i, [5, 7], 0, m, s) for i, (m, s) in enumerate(ids)]
    batches += [batch(10, [1], 1000, "x", "y"), batch(11, [1], 2000, "x", "y")]
    batches += [batch(20 + i, [7, 9], 0, m, s) for i, (m, s) in enumerate(ids)]
    path = f"file://{tmp_path}/out"
    for i, part in enumerate((batches[:4], batches[4:5], batches[5:6], batches[6:])):
        write(spark, folder, part, str(i))
        d = Deduplicator(spark, path, horizon="1 hour").run(folder)
    assert result(d) == brute(batches)
    checked = [p for p in (tmp_path / "out" / "ledger").rglob("*.parquet") if "outcome=check" in str(p)]
    assert checked, "nothing was looked up: the states had not expired"


def test_late_rows_are_not_filtered(spark, folder, tmp_path):
    """Pins what the operator relies on: rows behind the watermark reach the state and none is counted as dropped."""
    path = f"file://{tmp_path}/out"
    for i, part in enumerate(([batch(1, [1], 5000)], [batch(2, [1], 5001)], [batch(3, [2], 0), batch(4, [2], 0)])):
        write(spark, folder, part, str(i))
        d = Deduplicator(spark, path, horizon="1 hour").run(folder)
    assert result(d) == ({(2, 0), (4, 0)}, {(1, 0), (3, 0)})


def test_repeated_rows_and_null_batch_ids(spark, folder):
    rows = [batch(1, [5, 6]), batch(1, [5, 6]), batch(None, [5, 9]), batch(None, [9, 8])]
    write(spark, folder, rows, "a")
    d = Deduplicator(spark).run(folder)
    assert {(r.batch_id, r.event_pos, int(r.pos) + 2**63) for r in d.surplus().collect()} == {(None, 0, 5), (None, 1, 9)}
    assert sorted((int(r.pos) + 2**63, r.batch_id, r.event_pos) for r in d.kept().where("batch_id IS NOT NULL").collect()) == [(5, 1, 0), (6, 1, 1)]
    assert {(int(r.pos) + 2**63, r.event_pos) for r in d.kept().where("batch_id IS NULL").collect()} == {(9, 0), (8, 1)}


def test_large_batches_over_many_blocks(spark, folder):
    r = random.Random(8)
    batches = [batch(i, [r.randrange(6000) for _ in range(2500)]) for i in range(4)]
    write(spark, folder, batches, "a")
    assert result(Deduplicator(spark, bits=8).run(folder)) == brute(batches)


def test_lookup_reads_only_the_slots_of_late_copies(spark, folder, tmp_path):
    batches = [batch(i, [i], 0, f"m{i}") for i in range(40)]
    path = f"file://{tmp_path}/out"
    for i, part in enumerate((batches, [batch(100, [1], 1000)], [batch(101, [2], 2000)], [batch(102, [3], 0, "m3")])):
        write(spark, folder, part, str(i))
        d = Deduplicator(spark, path, horizon="1 hour").run(folder)
    slots = {p.name for p in (tmp_path / "out/ledger/outcome=kept").iterdir()}
    late = {p.name for p in (tmp_path / "out/ledger/outcome=check").iterdir()}
    assert len(slots) > 1 and len(late) == 1
    files = d._rows("kept", [int(x[5:]) for x in late]).inputFiles()
    assert files and all(f"/{x}/" in f for f in files for x in late)
    assert result(d)[0] == {(102, 0)}


def test_repeated_epoch_replaces_its_output(spark, folder, tmp_path):
    batches = make(3, 20)
    write(spark, folder, batches, "a")
    d = Deduplicator(spark, f"file://{tmp_path}/out").run(folder)
    rows = spark.read.parquet(f"{d.path}/ledger").where("epoch = 0 AND step = 0").withColumn("block", F.shiftright("pos", d.bits)).drop("slot", "epoch", "step")
    once = result(d)
    again = spark.createDataFrame(rows.collect(), rows.schema)
    d._settle(again, 0)
    assert result(d) == once == brute(batches)


def test_single_file_and_empty_input(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(folder)
    assert result(Deduplicator(spark).run(folder)) == (set(), set())
    write(spark, f"file://{tmp_path}/one", batches := make(4, 10), "a")
    single = next((tmp_path / "one").glob("*.parquet"))
    assert result(Deduplicator(spark).run(f"file://{single}")) == brute(batches)


def test_compaction_between_runs_and_an_interrupted_one(spark, folder, tmp_path):
    from tidelog.session import rename_path

    batches = make(9, 60)
    path = f"file://{tmp_path}/out"
    for i in range(4):
        write(spark, folder, batches[i * 12 : i * 12 + 12], str(i))
        d = Deduplicator(spark, path, horizon="1 hour", files_per_trigger=1).run(folder)
    files = lambda: sum(1 for _ in (tmp_path / "out/ledger").rglob("*.parquet"))
    before = files()
    assert result(d.compact()) == brute(batches[:48]) and files() < before
    write(spark, folder, batches[48:], "late")
    d = Deduplicator(spark, path, horizon="1 hour").run(folder)
    assert result(d) == brute(batches)
    d.compact()
    rename_path(spark, f"{path}/ledger", f"{path}/ledger-new")
    (tmp_path / "out/ledger-old").mkdir()
    assert result(Deduplicator(spark, path)) == brute(batches)

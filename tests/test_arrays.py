"""Arrays by ranges of rows, and arrays of slots that are filled bit by bit."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.sources import arrays, readers


def rows_of(df):
    return {r.place: list(r.v) for r in df.collect()}


@pytest.mark.parametrize("x", [np.arange(7, dtype="<f4"), np.arange(60, dtype="<i2").reshape(10, 6), np.arange(24, dtype=">f8").reshape(4, 3, 2), np.zeros((0, 5)), np.zeros((3, 0)), np.float64(4.0), np.array([True, False])], ids=lambda x: f"{x.dtype}{x.shape}")
def test_ranges_are_the_rows(spark, tmp_path, x):
    at = str(tmp_path / "x.npy")
    np.save(at, x)
    want = {i: r.ravel().astype(float).tolist() for i, r in enumerate(np.atleast_1d(x))}
    for size in (1, 40, 1 << 20):
        assert rows_of(arrays.read_ranges(spark, at, size)) == want
    assert rows_of(arrays.read_ranges(spark, f"file://{at}")) == want
    if x.ndim:
        assert rows_of(readers.npy_rows(spark, at)) == want


def test_a_large_file_is_many_tasks(spark, tmp_path):
    """4 GB (a file with holes) in 64 ranges; one of them reads its own rows only."""
    at, width = str(tmp_path / "large.npy"), 1 << 10
    x = np.lib.format.open_memmap(at, "w+", "<f4", (1 << 20, width))
    x[777_777, 3] = 5.0
    del x
    reader = arrays.NpyRanges({"path": at}).reader(None)
    parts = reader.partitions()
    assert len(parts) == 64 and sum(p.rows for p in parts) == 1 << 20 and os.path.getsize(at) > 1 << 32
    part = parts[777_777 // parts[0].rows]
    got = [(b.column("place")[i].as_py(), b.column("v")[i][3].as_py()) for b in reader.read(part) for i in range(b.num_rows) if b.column("place")[i].as_py() == 777_777]
    assert got == [(777_777, 5.0)]


def test_a_folder_and_what_cannot_be_read(spark, tmp_path):
    for i in range(3):
        np.save(tmp_path / f"{i}.npy", np.full((i, 2), float(i)))
    (tmp_path / "notes.txt").write_text("no array")
    assert arrays.read_ranges(spark, str(tmp_path)).groupBy("path").count().count() == 2
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(Exception, match="Fortran"):
        arrays.read_ranges(spark, str(tmp_path / "f.npy")).collect()
    np.save(tmp_path / "c.npy", np.ones((300, 2)))
    with open(tmp_path / "c.npy", "r+b") as f:
        f.truncate(2000)
    with pytest.raises(Exception, match="cut off"):
        arrays.read_ranges(spark, str(tmp_path / "c.npy")).collect()


def frame(spark, rows):
    return spark.createDataFrame(rows, "place long, v array<double>")


def test_slots_fill_bit_by_bit(spark, tmp_path):
    at = str(tmp_path / "slots")
    row = lambda i: [float(i), float(-i)]
    arrays.write_slots(frame(spark, [(i, row(i)) for i in range(0, 40, 2)]).repartition(5), at, 95, 2, 10)
    assert sorted(r.place for r in arrays.pending_slots(spark, at).collect()) == [*range(1, 40, 2), *range(40, 95)]
    before = {x: os.stat(f"{at}/{x}").st_mtime_ns for x in os.listdir(at)}
    arrays.write_slots(frame(spark, [(i, row(i)) for i in range(11, 20, 2)] + [(94, row(94))]), at, 95, 2)
    touched = {x for x in os.listdir(at) if before.get(x) != os.stat(f"{at}/{x}").st_mtime_ns}
    assert touched == {"slots-00000001.npy", "slots-00000009.npy", "_slots.json"}  # only shards that got rows
    assert sorted(r.place for r in arrays.pending_slots(spark, at).collect()) == [*range(1, 10, 2), *range(21, 40, 2), *range(40, 94)]
    arrays.write_slots(frame(spark, [(i, row(i)) for i in (r.place for r in arrays.pending_slots(spark, at).collect())]), at, 95, 2)
    assert rows_of(arrays.read_slots(spark, at)) == {i: row(i) for i in range(95)} and arrays.pending_slots(spark, at).count() == 0
    assert arrays.damaged_slots(at) == []
    whole = np.concatenate([np.load(f"{at}/slots-{i:08d}.npy") for i in range(10)])  # plain arrays
    assert whole.shape == (95, 2) and whole.dtype == np.float32 and (whole[:, 0] == np.arange(95)).all()


@pytest.mark.parametrize(("rows", "why"), [([(95, [1.0, 1.0])], "places"), ([(-1, [1.0, 1.0])], "places"), ([(3, [1.0])], "width"), ([(3, [1.0, 2.0]), (3, [1.0, 2.0])], "twice")])
def test_a_write_that_fails_leaves_all_as_it_was(spark, tmp_path, rows, why):
    at = str(tmp_path / "slots")
    arrays.write_slots(frame(spark, [(i, [1.0, 2.0]) for i in range(50)]), at, 95, 2, 10)
    before = {x: (tmp_path / "slots" / x).read_bytes() for x in os.listdir(at)}
    with pytest.raises(Exception, match=why):
        arrays.write_slots(frame(spark, [(i, [9.0, 9.0]) for i in range(60, 90)] + rows), at, 95, 2)
    assert {x: (tmp_path / "slots" / x).read_bytes() for x in os.listdir(at)} == before


def test_nulls_fill_nothing_and_damage_is_found(spark, tmp_path):
    at = str(tmp_path / "slots")
    arrays.write_slots(frame(spark, [(0, None), (1, [None, 1.0]), (2, [3.0, 4.0])]), at, 4, 2, 2)
    assert sorted(r.place for r in arrays.pending_slots(spark, at).collect()) == [0, 1, 3]
    with pytest.raises(ValueError, match="holds 4 rows"):
        arrays.write_slots(frame(spark, []), at, 5, 2)
    os.remove(f"{at}/slots-00000000.npy")
    with open(f"{at}/slots-00000001.npy", "ab") as f:
        f.write(b"x")
    assert arrays.damaged_slots(at) == [0, 1]
    arrays.write_slots(frame(spark, []), str(tmp_path / "none"), 3)
    assert arrays.pending_slots(spark, str(tmp_path / "none")).count() == 3
    with pytest.raises(FileNotFoundError):
        arrays.pending_slots(spark, str(tmp_path / "nowhere"))


def test_ranges_meet_spark(spark, tmp_path):
    """Columns and filters as of any table."""
    at = str(tmp_path / "x.npy")
    np.save(at, np.arange(1000.0).reshape(100, 10))
    got = arrays.read_ranges(spark, at, 800).where("place >= 90").agg(F.sum(F.get("v", F.lit(9))).alias("s")).first().s
    assert got == sum(i * 10 + 9 for i in range(90, 100))

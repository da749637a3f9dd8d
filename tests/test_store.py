"""Keyed tables: crashes between the steps, replays, growth, and tables that follow their configuration."""

import random
from pathlib import Path

import pytest

from tidemark.streaming import store
from tidemark.streaming.sinks import dim_upsert, read_table, sync_stores, upsert

KIND = "k string, ts long, v string"


def rows_of(spark, path, *names):
    return sorted((tuple(r) for r in read_table(spark, path).select(*names).collect()), key=str)


def test_a_crash_leaves_the_old_version_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    write = upsert(path, ["k"], ["ts"])
    write(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], KIND), 0)
    reader = read_table(spark, path)
    two = spark.createDataFrame([("a", 2, "new"), ("c", 2, "z")], KIND)
    for step in ("_switch", "_write"):
        with monkeypatch.context() as m:

            def crash(*a, **k):
                raise OSError("killed")

            m.setattr(store, step, crash)
            with pytest.raises(OSError, match="killed"):
                write(two, 1)
        assert rows_of(spark, path, "k", "v") == [("a", "x"), ("b", "y")]
    write(two, 1)
    write(two, 1)
    assert rows_of(spark, path, "k", "v") == [("a", "new"), ("b", "y"), ("c", "z")]
    assert sorted(r["v"] for r in reader.collect()) == ["x", "y"]  # began before
    assert store.manifest(spark, path).batches == {"": 1}
    upsert(path, ["k"], ["ts"], writer="other")(spark.createDataFrame([("d", 1, "w")], KIND), 0)
    assert ("d", "w") in rows_of(spark, path, "k", "v")


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """While one batch is written, another writer commits, and one that empties the table."""
    path = str(tmp_path / "t")
    one, two = upsert(path, ["k"], ["ts"], writer="one"), upsert(path, ["k"], ["ts"], writer="two")
    one(spark.createDataFrame([(str(i), 0, "old") for i in range(50)], KIND), 0)
    whole, told = store._switch, []

    def meet(*a):
        if not told:
            told.append(1)
            two(spark.createDataFrame([("b", 1, "two"), ("c", 1, "two")], KIND), 0)
        whole(*a)

    monkeypatch.setattr(store, "_switch", meet)
    one(spark.createDataFrame([("a", 1, "one"), ("c", 2, "one")], KIND), 1)
    monkeypatch.undo()
    assert rows_of(spark, path, "k", "v")[-3:] == [("a", "one"), ("b", "two"), ("c", "one")] and read_table(spark, path).count() == 53
    for n in range(2, 8):
        one(spark.createDataFrame([("a", n, f"v{n}")], KIND), n)
    used = {p.path for name in store._versions(spark, path) for p in store._load(spark, path, name).parts}
    assert used == {f"parts/{p.name}" for p in Path(path, "parts").iterdir()}
    assert ("a", "v7") in rows_of(spark, path, "k", "v")


def test_what_is_written_follows_the_batch(spark, tmp_path):
    path = str(tmp_path / "t")
    write = upsert(path, ["k"], ["ts"], 1)
    write(spark.range(20_000).selectExpr("cast(id as string) k", "0L ts", "repeat(cast(id as string), 5) v"), 0)
    size = lambda: {str(f): f.stat().st_size for f in Path(path, "parts").rglob("*.parquet")}
    first, written = size(), 0
    seen = set(first)
    for n in range(1, 17):
        write(spark.createDataFrame([(str(n), n, "v")], KIND), n)
        written += sum(b for f, b in size().items() if f not in seen)
        seen |= set(size())
    assert written < sum(first.values()) / 3
    assert len(store.manifest(spark, path).parts) < 8 and len(list(Path(path, "_versions").glob("*.json"))) == store.KEPT
    assert {r["k"]: r["v"] for r in read_table(spark, path).where("ts > 0").collect()} == {str(n): "v" for n in range(1, 17)}
    assert read_table(spark, path).count() == 20_000


def test_changes_in_any_order_and_again(spark, tmp_path):
    """Batches in three orders, some of them twice, against the changes in order of time."""
    rng = random.Random(5)
    changes = [(rng.choice("abcdef"), rng.choice(["insert", "update", "update", "delete"]), t, rng.choice([None, f"p{t}"]), rng.choice([None, f"q{t}"])) for t in range(60)]
    want = {}
    for k, kind, _, p, q in changes:
        old = want.get(k, (None, None))
        want[k] = None if kind == "delete" else (p or (old or (None, None))[0], q or (old or (None, None))[1])
    want = sorted((k, *v) for k, v in want.items() if v)
    for seed in range(3):
        mixed = changes[:] if not seed else random.Random(seed).sample(changes, len(changes))
        path = str(tmp_path / f"d{seed}")
        write = dim_upsert(path, ["k"], ["ts"], ["p", "q"])
        for n in range(6):
            batch = spark.createDataFrame(mixed[10 * n : 10 * n + 10 + 5 * bool(seed)], "k string, type string, ts long, p string, q string")
            write(batch, n)
        assert rows_of(spark, path, "k", "p", "q") == want


def test_tables_follow_their_configuration(spark, tmp_path):
    root = str(tmp_path / "dims")
    follow = sync_stores(root)
    config = lambda *rows: spark.createDataFrame(rows, "op string, at long, sink_table string, sink_columns string")
    put = lambda n, *rows: dim_upsert(f"{root}/dim_x", ["row_key"], ["ts"], ["id"])(spark.createDataFrame(rows, "row_key string, type string, ts long, id string"), n)
    follow(config(("c", 1, "dim_x", "id"), ("r", 2, "dim_x", "id")), 0)
    assert rows_of(spark, f"{root}/dim_x", "row_key", "ts", "id") == []
    put(0, ("a", "insert", 1, "1"))
    follow(config(("c", 1, "dim_x", "id")), 0)
    assert rows_of(spark, f"{root}/dim_x", "row_key", "id") == [("a", "1")]
    follow(config(("d", 3, "dim_x", None)), 1)
    with pytest.raises(FileNotFoundError):
        read_table(spark, f"{root}/dim_x")
    put(1, ("b", "insert", 2, "2"))
    follow(config(("c", 4, "dim_x", "id, name")), 2)
    assert read_table(spark, f"{root}/dim_x").columns == ["row_key", "ts", "id", "name"] and rows_of(spark, f"{root}/dim_x", "row_key") == []
    put(2, ("c", "insert", 3, "3"))
    follow(config(("u", 5, "dim_x", "id")), 3)
    assert rows_of(spark, f"{root}/dim_x", "row_key") == []
    put(3, ("d", "insert", 4, "4"))
    follow(config(("u", 5, "dim_x", "id")), 3)  # again: the rows stay
    assert rows_of(spark, f"{root}/dim_x", "row_key", "id") == [("d", "4")]
    with pytest.raises(FileNotFoundError):
        read_table(spark, f"{root}/never")

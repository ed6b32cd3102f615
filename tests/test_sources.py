"""Sources, sinks, registry and incremental work."""

import pytest
from pyspark.sql import functions as F

from tessella.sources import commits, io
from tessella.streaming import incremental


def test_publish_is_whole_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/t"
    io.publish(df, path, key="k")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(FileExistsError):
        io.publish(df, path)
    with pytest.raises(ValueError):
        io.publish(df.union(df), f"file://{tmp_path}/u", key="k")
    assert not io.exists(spark, f"file://{tmp_path}/u")
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_frozen_json(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    io.write_frozen_json(spark, {"b": 1, "a": 2}, path)
    io.write_frozen_json(spark, {"a": 2, "b": 1}, path)
    with pytest.raises(FileExistsError):
        io.write_frozen_json(spark, {"a": 3}, path)
    assert io.read_json(spark, path, {"a": 2})["b"] == 1
    with pytest.raises(ValueError):
        io.read_json(spark, path, {"a": 9})


def test_keyed_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    (tmp_path / "y.jsonl").write_text('{"id": 1}\n{"id": 1}\n')
    assert io.read_keyed_jsonl(spark, f"{tmp_path}/x.jsonl", "id int", "id").count() == 2
    with pytest.raises(ValueError):
        io.read_keyed_jsonl(spark, f"{tmp_path}/y.jsonl", "id int", "id")


def test_boxes(spark, tmp_path):
    head = "image_id,source_width,source_height,x0,y0,x1,y1\n"
    (tmp_path / "b.csv").write_text(head + "a,1,1,0,0,1,0.5\n")
    (tmp_path / "c.csv").write_text(head + "a,1,1,0.5,0,0.5,0.5\n")
    assert io.read_boxes(spark, f"{tmp_path}/b.csv").count() == 1
    with pytest.raises(ValueError):
        io.read_boxes(spark, f"{tmp_path}/c.csv")


def test_tagged_files(spark, tmp_path):
    spark.range(2).coalesce(1).write.parquet(f"{tmp_path}/d")
    part = next(p for p in (tmp_path / "d").iterdir() if p.name.endswith(".parquet"))
    part.rename(tmp_path / "A_seed3.parquet")
    got = io.read_tagged(spark, f"{tmp_path}/*_seed*.parquet", r"^([A-Z])_seed(\d+)\.", ["condition", "seed"])
    assert {(r.condition, r.seed) for r in got.collect()} == {("A", "3")}


def test_registry(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    rows = spark.createDataFrame([("a", None, "run"), ("b", "a", "run"), ("c", "b", "run")], "experiment_id string, parent_experiment_id string, status string")
    io.upsert(spark, path, rows)
    got = io.upsert(spark, path, rows.where("experiment_id = 'b'").withColumn("status", F.lit("done")))
    assert {r.experiment_id: r.status for r in got.collect()} == {"a": "run", "b": "done", "c": "run"}
    assert {(r.experiment_id, r.ancestor) for r in io.ancestors(got).collect()} == {("b", "a"), ("c", "b"), ("c", "a")}


def test_resume(spark, tmp_path):
    log, plan = f"file://{tmp_path}/log", spark.range(10)
    assert incremental.resume(spark, plan.where("id < 4"), log, "id", lambda d: d) == 4
    assert incremental.resume(spark, plan, log, "id", lambda d: d) == 10


def test_follow(spark, tmp_path):
    rows = spark.sql("select 1 as k, timestamp'2024-01-01 00:00:00' as at union all select 1, timestamp'2024-01-01 00:00:10' union all select 2, timestamp'2024-01-01 00:00:20'")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    incremental.follow(stream, "k", "at", f"{tmp_path}/out", f"{tmp_path}/cp", lambda d: d).awaitTermination(60)
    assert sorted(r.k for r in commits.table(spark, f"{tmp_path}/out").collect()) == [1, 2]


def test_contracts(spark, tmp_path):
    from tessella.operators import contracts

    with pytest.raises(PermissionError):
        contracts.read_split(spark, f"{tmp_path}", "final", "training")
    path = f"file://{tmp_path}/design"
    first = contracts.freeze_or_match(spark, {"seed": 1, "note": "a"}, ["seed"], path)
    assert contracts.freeze_or_match(spark, {"seed": 1, "note": "b"}, ["seed"], path) == first
    with pytest.raises(FileExistsError):
        contracts.freeze_or_match(spark, {"seed": 2}, ["seed"], path)
    contracts.register_evaluation(spark, "r1", f"file://{tmp_path}/run")
    contracts.register_evaluation(spark, "r1", f"file://{tmp_path}/run")
    with pytest.raises(PermissionError):
        contracts.register_evaluation(spark, "r2", f"file://{tmp_path}/run")
    assert contracts.table_text(spark.createDataFrame([(1, 0.5)], "a int, bb double")) == "a  bb\n1  0.5000"


def test_commits_of_two_writers_both_stay(spark, tmp_path):
    """Two interleaved upserts: the second commits while the first is at work; both rows are there, and each version's provenance is its own."""
    path = f"file://{tmp_path}/r"
    row = lambda k: spark.createDataFrame([(k, "x")], "experiment_id string, status string")
    calls = []

    def slow(old):
        calls.append(old is None)
        if len(calls) == 1:
            io.upsert(spark, path, row("b"))
        return row("a") if old is None else old.unionByName(row("a"))

    record = commits.commit(spark, path, slow, key="experiment_id", provenance={"by": "a"})
    assert calls == [True, False] and {r.experiment_id for r in commits.table(spark, path).collect()} == {"a", "b"}
    assert [r["provenance"] for r in commits.history(spark, path)] == [None, {"by": "a"}] and record["n_rows"] == 2


def test_a_failed_commit_leaves_the_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    commits.commit(spark, path, lambda _: spark.range(3))
    for step in ("observe", "claim"):
        with monkeypatch.context() as m, pytest.raises((RuntimeError, ValueError)):
            if step == "claim":
                m.setattr(commits, "claim", lambda *_: (_ for _ in ()).throw(RuntimeError("dies before the commit's file")))
            commits.commit(spark, path, lambda _: spark.range(9), check=(lambda _: (_ for _ in ()).throw(ValueError("checked"))) if step == "observe" else None)
        assert commits.table(spark, path).count() == 3
    commits.commit(spark, path, lambda _: spark.range(9))
    assert commits.table(spark, path).count() == 9 and not commits.claim(spark, f"{path}/commits/{0:020d}.json", "{}")


def test_publish_survives_each_step(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    io.publish(spark.range(3), path, provenance={"v": 1})
    real = io._fs

    class Dies:
        """A file system whose k-th rename fails: returns false, or throws."""

        def __init__(self, fs, left, throws):
            self.fs, self.left, self.throws = fs, left, throws

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            self.left[0] -= 1
            if self.left[0] == 0:
                if self.throws:
                    raise RuntimeError("rename")
                return False
            return self.fs.rename(a, b)

    for k in (1, 2):
        for throws in (False, True):
            left = [k]
            with monkeypatch.context() as m, pytest.raises((OSError, RuntimeError)):
                m.setattr(io, "_fs", lambda s, p, left=left, throws=throws: (Dies(real(s, p)[0], left, throws), real(s, p)[1]))
                io.publish(spark.range(9), path, once=False, provenance={"v": 2})
            assert spark.read.parquet(path).count() == 3 and io.provenance_of(spark, path) == {"v": 1, "n_rows": 3}
            assert [p.name for p in tmp_path.iterdir()] == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.old-1")  # a process that died between the renames
    io.publish(spark.range(9), path, once=False, provenance={"v": 2})
    assert spark.read.parquet(path).count() == 9 and io.provenance_of(spark, path)["v"] == 2


def test_two_resumes_at_once(spark, tmp_path):
    log, plan, first = f"file://{tmp_path}/log", spark.range(10), []

    def work(todo):
        if not first:
            first.append(1)
            assert incremental.resume(spark, plan.where("id < 7"), log, "id", lambda d: d) == 7
        return todo

    assert incremental.resume(spark, plan, log, "id", work) == 10
    assert sorted(r.id for r in commits.table(spark, log).collect()) == list(range(10))


def test_a_retried_batch_is_appended_once(spark, tmp_path, monkeypatch):
    """A batch that dies behind its commit, and one that dies before it, are both there once after a restart."""
    rows = spark.sql("select id as k, timestamp'2024-01-01 00:00:00' as at from range(20)")
    rows.write.parquet(f"{tmp_path}/in")
    real, fails = commits.commit, ["behind", "before"]

    def dies(*args, **more):
        how = fails.pop(0) if fails else None
        if how == "before":
            raise RuntimeError(how)
        out = real(*args, **more)
        if how:
            raise RuntimeError(how)
        return out

    monkeypatch.setattr(commits, "commit", dies)
    run = lambda: incremental.follow(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "k", "at", f"file://{tmp_path}/out", f"{tmp_path}/cp", lambda d: d).awaitTermination(60)
    for _ in range(2):
        with pytest.raises(Exception, match="behind|before"):
            run()
    run()
    assert not fails and sorted(r.k for r in commits.table(spark, f"file://{tmp_path}/out").collect()) == list(range(20))

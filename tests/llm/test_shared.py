"""What a task leaves behind in its worker."""

from hoopspark.llm import shared


def left(batches):
    shared._powers(shared._BASE, 100)
    for batch in batches:
        yield batch, len(shared._grown)


def test_lean_task_passes_its_batches_and_leaves_no_tables_behind():
    got = list(shared.lean(left)(iter("abc")))
    assert got == [("a", 1), ("b", 1), ("c", 1)]
    assert not shared._grown


def test_lean_task_that_is_given_up_leaves_none_either():
    task = shared.lean(left)(iter("abc"))
    assert next(task) == ("a", 1)
    task.close()
    assert not shared._grown


def test_lean_task_runs_in_workers(spark):
    def kept(batches):
        for batch in batches:
            shared._powers(shared._BASE, 100)
            yield batch

    def tables(batches):
        import pyarrow as pa
        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(shared._grown)], pa.int64())})

    rows = spark.range(0, 40, 1, 4)
    assert rows.mapInArrow(shared.lean(kept), "id long").count() == 40
    assert {r["n"] for r in rows.mapInArrow(tables, "n long").collect()} == {0}

from fiberloom.streaming import fold
from tests.code_fixture import ROWS


def put(root, rows):
    for path, source in rows:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(source)


def test_fold_and_refold(spark, tmp_path):
    root, store, state = tmp_path / "src", str(tmp_path / "store"), str(tmp_path / "state")
    put(root, ROWS[:4])
    fold.fold(fold.stream_modules(spark, str(root)), store, state).awaitTermination()
    one = fold.latest_facts(spark, store)
    assert {r.path for r in one.select("path").distinct().collect()} == {p for p, _ in ROWS[:4]}
    put(root, [("pkg/engine2.py", "class Root:\n    x: int = 1\n"), *ROWS[4:5]])
    fold.fold(fold.stream_modules(spark, str(root)), store, state).awaitTermination()
    two = fold.latest_facts(spark, store)
    assert two.where("path = 'pkg/engine.py'").count() == one.where("path = 'pkg/engine.py'").count()
    assert two.where("path = 'pkg/engine2.py' and family = 'field'").count() == 1
    before = fold.manifest(spark, store).count()
    fold.fold_batch(fold.code.modules_from_rows(spark.createDataFrame(ROWS[:2], "path string, source string")), 77, store)
    assert fold.manifest(spark, store).count() == before  # nothing new to parse

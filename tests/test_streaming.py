"""A stream of submissions gives the tables a single batch gives."""

from test_boards import raw, report

from assentlake.plans.leaderboard import apply_submissions
from assentlake.session import names_in
from assentlake.streaming.submissions import current_tables, start, write_batch


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def test_stream_equals_batch(spark, tmp_path):
    models = [{"model": "m", "droolCount": 1, "totalMessages": 10}]
    parts = [
        raw(spark, (1, 1, 5, report(1, 10, models)), (2, 2, 1, report(2, 10)), (3, 4, 1, "[]")),
        raw(spark, (4, 1, 2, report(9, 10, models)), (5, 2, 3, report(7, 10, models))),
    ]
    source, path, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(part.schema).parquet(source)
        start(stream, path, checkpoint).awaitTermination(60)
    write_batch(parts[1], 1, path)  # the same batch once more, as after a failure
    got, want = current_tables(spark, path), apply_submissions(parts[0].unionByName(parts[1]))
    for table in ("entries", "submissions", "models", "harnesses", "rejected"):
        assert rows_of(getattr(got, table)) == rows_of(getattr(want, table)), table
    assert {r.user_id: r.hits for r in got.entries.collect()} == {1: 1, 2: 7}


def test_many_batches_open_few_files(spark, tmp_path):
    """Batches of one submission, one run twice, one part of a version already, one not committed."""
    path, rows, every, n_batches = str(tmp_path / "out"), [], 4, 11
    for n in range(n_batches):
        row = (n, n % 3, 200 - n if n % 5 == 3 else n, report(n, 1000, [{"model": f"m{n % 3}", "droolCount": 1, "totalMessages": 10}]))
        rows.append(row)
        for _ in range(2 if n == 9 else 1):
            write_batch(raw(spark, row).coalesce(1), n, path, every)
    write_batch(raw(spark, rows[5]), 5, path, every)
    for part in ("entries", "submissions"):  # a batch that was lost before its commit
        spark.read.parquet(f"{path}/changes/{part}/batch=9").write.parquet(f"{path}/changes/{part}/batch={n_batches}")
    got, want = current_tables(spark, path), apply_submissions(raw(spark, *rows))
    for table in ("entries", "submissions", "models", "harnesses", "rejected"):
        assert rows_of(getattr(got, table)) == rows_of(getattr(want, table)), table
    # Entries: one version, and the batches behind it.
    assert names_in(spark, f"{path}/versions/done") == ["3", "7"]
    folders = {f.rsplit("/", 2)[1] for f in got.entries.inputFiles()}
    assert folders == {"upto=7", "batch=8", "batch=9", "batch=10"}
    assert {f.rsplit("/", 2)[1] for f in got.submissions.inputFiles()} == {"upto=3", *folders}

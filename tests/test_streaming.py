"""Pages that come as streams: completeness, lines that come late or twice, and a restart from the checkpoint."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import align
from lectern.sources import package
from lectern.streaming import pages

START = datetime.datetime(2024, 1, 1)
R = random.Random(3)


def minute(n):
    return START + datetime.timedelta(minutes=n)


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, pages.LINE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def word():
    return "".join(R.choice("abcd ") for _ in range(R.randint(0, 12)))


@pytest.fixture
def arrived(spark):
    """25 pages whose lines are dealt over six files, some of them twice."""
    package.send(spark)
    rows = []
    for page in range(25):
        truth = [word() for _ in range(R.randint(0, 6))]
        pred = [word() for _ in range(R.randint(0 if truth else 1, 5))]
        if page < 8:
            pred, truth = (pred[:1] or ["x"]), truth[:1]
        rows += [(page, "pred", i, x, len(pred), len(truth), minute(1)) for i, x in enumerate(pred)] + [(page, "truth", i, x, len(pred), len(truth), minute(2)) for i, x in enumerate(truth)]
    R.shuffle(rows)
    return [rows[i::6] + (rows[:20] if i > 3 else []) for i in range(6)], rows


def batch(spark, rows):
    df = spark.createDataFrame(rows, pages.LINE)
    return align.align_pages(df.where("side = 'pred'").selectExpr("page_id", "idx as pred_idx", "text as pred"), df.where("side = 'truth'").selectExpr("page_id", "idx as gt_idx", "text as gt"))


def stream(spark, folder, **options):
    source = spark.readStream.schema(pages.LINE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    return pages.align_stream(source, **options)


def test_a_stream_that_stops_and_goes_on_equals_the_batch(spark, arrived, tmp_path):
    """Four of six files, a run that fails in the middle of the rest, and a third run from the same checkpoint."""
    files, rows = arrived
    for k in range(4):
        write(spark, f"{tmp_path}/in", f"f{k}", files[k])
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    pages.start(stream(spark, f"{tmp_path}/in"), out, check).awaitTermination()
    some = spark.read.parquet(out).select("page_id").distinct().count()
    for k in range(4, 6):
        write(spark, f"{tmp_path}/in", f"f{k}", files[k])
    last = max({r[0] for r in rows if len([x for x in rows if x[0] == r[0] and x[1] == "pred"])} - {r.page_id for r in spark.read.parquet(out).select("page_id").collect()})
    failing = stream(spark, f"{tmp_path}/in").withColumn("page_id", F.when(F.col("page_id") == last, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("page_id")))
    assert 0 < some < 25
    with pytest.raises(Exception, match="lost"):
        pages.start(failing, out, check).awaitTermination()
    pages.start(stream(spark, f"{tmp_path}/in"), out, check).awaitTermination()
    got = spark.read.schema(failing.schema).parquet(out)
    assert sorted(map(tuple, got.where("complete").drop("complete").collect())) == sorted(map(tuple, batch(spark, rows).collect()))
    assert got.where("not complete").count() == 0


def test_pages_whose_time_is_over_are_aligned_as_they_are(spark, tmp_path):
    package.send(spark)
    line = lambda page, side, i, x, at, n=2: (page, side, i, x, n, n, minute(at))
    write(spark, f"{tmp_path}/in", "f0", [line(1, "pred", 0, "ab", 0), line(1, "truth", 0, "ab", 0), line(1, "truth", 1, None, 1)])
    write(spark, f"{tmp_path}/in", "f1", [line(2, "pred", 0, "x", 200, 1), line(2, "truth", 0, "x", 200, 1)])
    write(spark, f"{tmp_path}/in", "f2", [line(3, "pred", 0, "y", 201, 1), line(2, "pred", 0, "again", 201, 1), line(2, "truth", 0, "x", 201, 1)])
    write(spark, f"{tmp_path}/in", "f3", [line(1, "pred", 1, "too late", 2), line(4, "pred", 0, "z", 202, 1)])
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"
    pages.start(stream(spark, f"{tmp_path}/in", late="30 minutes", wait="10 minutes"), out, check).awaitTermination()
    got = {(r.page_id, r.pred_idx, r.pred_text, r.matched_gt, r.complete) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0, "ab", "ab", False), (2, 0, "x", "x", True)}


def test_pages_of_a_batch_are_aligned_together(spark, arrived, tmp_path):
    """Distances are taken by tasks that hold many pages, behind the state."""
    write(spark, tmp_path, "all", arrived[1])
    plan = stream(spark, tmp_path)._jdf.queryExecution().toString()
    assert plan.index("MapInArrow") < plan.index("FlatMapGroupsInPandasWithState") and "levenshtein" not in plan

"""A service with a quota: nothing is asked twice, whatever is cut, refused or left for another day."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import ledger
from lectern.sources import package

DAY = 86_400.0


@pytest.fixture
def texts(spark):
    package.send(spark)
    return spark.createDataFrame([(i, t) for i, t in enumerate([f"text {i % 30}" for i in range(90)] + ["", "  ", None])], "k int, text string").repartition(5)


def service(log, refuse=()):
    """Upper-cases; writes down each request; refuses the first request of some texts, and dies at others."""

    def load():
        def answer(text):
            path = f"{log}/{text.replace(' ', '_')}"
            n = len([f for f in os.listdir(log) if f.startswith(os.path.basename(path) + ".")])
            open(f"{path}.{n}", "w").close()
            if text in refuse and n < refuse[text]:
                raise RuntimeError("busy: please retry in 0.5s")
            if os.path.exists(f"{log}/die") and text == "text 7":
                os._exit(1)
            return text.upper()

        return answer

    return load


def asked(log):
    return Counter(f.rsplit(".", 1)[0].replace("_", " ") for f in os.listdir(log) if f.startswith("text"))


def test_each_text_is_asked_once(spark, texts, tmp_path):
    os.mkdir(log := f"{tmp_path}/log")
    book = f"file://{tmp_path}/book"
    assert ledger.ask(texts, service(log), book, every=4) == {"success": 30}
    assert ledger.ask(texts, service(log), book, every=4) == {} and set(asked(log).values()) == {1}
    more = texts.unionByName(spark.createDataFrame([(100, "text new")], "k int, text string"))
    assert ledger.ask(more, service(log), book) == {"success": 1} and asked(log).total() == 31
    got = {r.k: (r.answer, r.status) for r in ledger.answered(texts, book, "text", "answer").collect()}
    assert all(got[i] == (f"TEXT {i % 30}", "success") for i in range(90)) and [got[i] for i in (90, 91, 92)] == [("", "empty_input"), ("  ", "empty_input"), (None, "empty_input")]


def test_a_run_that_is_cut_asks_nothing_twice(spark, texts, tmp_path):
    """A worker's process ends in the middle: of all texts only the one that it died at is asked again."""
    os.mkdir(log := f"{tmp_path}/log")
    open(f"{log}/die", "w").close()
    book = f"file://{tmp_path}/book"
    with pytest.raises(Exception):  # noqa: B017
        ledger.ask(texts, service(log), book, workers=2)
    first = asked(log)
    os.remove(f"{log}/die")
    ledger.ask(texts, service(log), book, workers=2)
    now = asked(log)
    assert first["text 7"] >= 1 and now["text 7"] == first["text 7"] + 1 and all(n == 1 for t, n in now.items() if t != "text 7") and len(now) == 30
    assert ledger.answers(spark, book).count() == 30


def test_refusals_and_retries(spark, texts, tmp_path):
    os.mkdir(log := f"{tmp_path}/log")
    book, waits = f"file://{tmp_path}/book", f"{tmp_path}/waits"
    refuse = {"text 1": 1, "text 2": 99}

    def sleep(s):
        with open(waits, "a") as f:
            f.write(f"{s}\n")

    assert ledger.ask(texts, service(log, refuse), book, sleep=sleep, least=1.0) == {"success": 29, "max_retries_exceeded": 1}
    assert asked(log)["text 1"] == 2 and asked(log)["text 2"] == 3
    assert sorted(map(float, open(waits).read().split())) == [1.5, 1.5, 2.0]
    assert {r.k: r.status for r in ledger.answered(texts, book, "text", "a").collect()}[2] == "unanswered"
    assert ledger.ask(texts, service(log, {}), book) == {"success": 1} and asked(log)["text 2"] == 4


def test_quota_of_a_day_and_a_minute(spark, texts, tmp_path):
    os.mkdir(log := f"{tmp_path}/log")
    book, waits = f"file://{tmp_path}/book", f"{tmp_path}/waits"

    def sleep(s):
        with open(waits, "a") as f:
            f.write(f"{s}\n")

    day = lambda n: (lambda: DAY * n)
    first = ledger.ask(texts, service(log), book, per_day=12, workers=5, now=day(1), sleep=sleep)
    assert first["success"] == asked(log).total() <= 12 and first["success"] + first["deferred"] == 30
    again = ledger.ask(texts, service(log), book, per_day=12, workers=5, now=day(1), sleep=sleep)
    assert asked(log).total() == first["success"] + again.get("success", 0) <= 12
    for n in range(2, 9):
        ledger.ask(texts, service(log), book, per_day=12, workers=5, now=day(n), sleep=sleep)
    assert asked(log) == Counter({f"text {i}": 1 for i in range(30)})
    new = spark.createDataFrame([(f"other {i}",) for i in range(6)], "text string")
    ledger.ask(new.withColumn("text", F.concat(F.lit("text "), "text")), service(log), book, per_minute=30, workers=1, now=day(20), sleep=sleep)
    assert [float(x) for x in open(waits).read().split()] == [2.0] * 5

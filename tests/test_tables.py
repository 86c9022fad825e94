"""Written tables and the scopes that delete them."""

import threading

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tracewell.plans.tables import scratch, stash


def test_a_scope_deletes_its_own_tables_only(spark):
    with scratch():
        with scratch():
            gone, kept = stash(spark.range(3), "gone"), stash(spark.range(4), "kept", keep=True)
        assert kept.count() == 4
        with pytest.raises((PySparkException, Py4JJavaError)):
            gone.count()
    with pytest.raises((PySparkException, Py4JJavaError)):
        kept.count()
    assert stash(spark.range(5), "stays").count() == 5


def test_threads_have_scopes_for_themselves(spark):
    opened, closed, counts = threading.Event(), threading.Event(), []

    def other():
        with scratch():
            table = stash(spark.range(7), "other")
            opened.set()
            closed.wait(60)
            counts.append(table.count())

    thread = threading.Thread(target=other)
    with scratch():
        thread.start()
        assert opened.wait(60)
        stash(spark.range(2), "own")
    closed.set()
    thread.join()
    assert counts == [7]

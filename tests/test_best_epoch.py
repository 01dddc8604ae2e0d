"""Best epochs of all curves."""

from folioscope.plans import reference
from folioscope.operators import training
from tests.conftest import rows

DIR = "/root/testdata/sf0.001"


def test_by_curve(spark):
    df = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 0.9), ("a", 2, 0.9), ("b", 0, 0.3), ("b", 1, None)], "curve string, epoch int, accuracy double")
    assert rows(training.best_epoch(df, "accuracy", by=["curve"])) == [("a", 1, 0.9), ("b", 0, 0.3)]
    assert rows(training.best_epoch(df, "accuracy")) == [(1, 0.9)]


def test_query_has_every_curve(spark):
    want = {}
    for r in reference._epochs(spark, DIR).collect():
        want[r.curve] = max(want.get(r.curve, (-1.0, 0)), (1 - r.cer, -r.epoch))
    got = {r.curve: (r.value, -r.epoch) for r in reference.best_epoch(spark, DIR).collect()}
    assert len(want) > 1 and got == want

import math

import pytest
from pyspark.sql import functions as F

from tracelith.functions import bins as B
from tracelith.functions import kernels as K


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first()[0]


D = lambda v: F.lit(v).cast("double")


@pytest.mark.parametrize(
    "col, want",
    [
        (lambda: K.soft_score(D(5.0), 5.0, 1.0), 0.5),
        (lambda: K.soft_score(D(4.0), 5.0, 1.0), 1.0),
        (lambda: K.soft_score(D(6.0), 5.0, 1.0), 0.0),
        (lambda: K.soft_score(D(None), 5.0, 1.0), None),
        (lambda: K.angle_difference(D(350.0), D(10.0)), 20.0),
        (lambda: K.angle_difference(D(-170.0), D(170.0)), 20.0),
        (lambda: K.signed_angle(D(3 * math.pi)), math.pi),
        (lambda: K.lens_area(D(0.0), D(1.0), D(2.0)), math.pi),
        (lambda: K.lens_area(D(4.0), D(1.0), D(2.0)), 0.0),
        (lambda: K.speed_score(D(39.0), D(1.0)), 1.0),
        (lambda: K.speed_score(D(41.0), D(1.0)), 0.0),
        (lambda: K.position_score(D(10.0), D(0.0), D(1.0)), None),
        (lambda: K.position_speed_score(D(1000.0), D(1.0), D(1.0), D(3.1), D(1.0)), 1.0),
        (lambda: K.position_max_speed_score(D(1.0), D(1.0), D(1.0), D(1.0), D(1.0), D(1.0)), 0.5),
        (lambda: K.frequency_score(D(0.5)), 0.0),
        (lambda: K.confidence(D(None), D(None)), 1e-3),
        (lambda: K.proximity_score(D(100.0), D(0.0), F.array(D(1.0))), 1.0),
        (lambda: K.overlap_score(D(0.0), D(1.0), D(1.0)), 0.0),
        (lambda: K.ratio(D(1.0), D(0.0)), None),
        (lambda: K.ratio(D(1.0), D(0.0), 0.0), 0.0),
        (lambda: K.clamp(D(None), 0.0, 1.0), None),
    ],
)
def test_kernel(spark, col, want):
    got = value(spark, col())
    assert got is None if want is None else got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(
    "text, want", [("an ATTACK, not benign", 1), ("Benign", 0), ("it is 1", 1), ("attacker 0", 0), ("none", None), (None, None)]
)
def test_label(spark, text, want):
    assert value(spark, B.parse_label(F.lit(text).cast("string"))) == want


def test_bins(spark):
    assert [value(spark, B.attacker_bin(F.lit(3), s)) for s in (True, False)] == ["5-8", "2-4"]
    assert [value(spark, B.score_bin(D(v))) for v in (0.0, 1.0, 0.2, -1.0, 2.0, None)] == ["0", "1", "(0,0.2]", "<0", ">1", "null"]
    assert value(spark, B.id_list(F.lit('x ["p1", " p2","p1"] y'))) == ["p1", "p2"]

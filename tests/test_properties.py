"""Property checks: exact statistics equal NumPy on random tied samples, however coarse the sketch."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from studyframe.operators import profile, ranks

SAMPLES = st.lists(st.integers(min_value=-5, max_value=12).map(lambda v: v / 2.0), min_size=12, max_size=160)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(xs=SAMPLES, accuracy=st.sampled_from([4, 20, 10_000]), inside=st.sampled_from([3, 10**9]))
def test_profile_order_statistics_match_numpy(spark, xs, accuracy, inside):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    known = ranks.ACCURACY, ranks.MOST_INSIDE
    ranks.ACCURACY, ranks.MOST_INSIDE = accuracy, inside
    try:
        r = profile.numeric_profile(df, ["x"]).first()
    finally:
        ranks.ACCURACY, ranks.MOST_INSIDE = known
    a = np.array(xs)
    for q, name in ((5, "p_5th"), (50, "median"), (95, "p_95th")):
        assert abs(r[name] - np.percentile(a, q)) < 1e-9
    k = int(0.1 * len(a))
    assert abs(r["trimmed_mean"] - np.sort(a)[k:len(a) - k].mean()) < 1e-9
    vals, counts = np.unique(a, return_counts=True)
    assert r["mode"] == vals[counts == counts.max()].min() and r["n_modes"] == int((counts == counts.max()).sum())

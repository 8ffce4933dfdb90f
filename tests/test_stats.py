"""Distribution helpers against published reference values (SciPy documentation values)."""

import math

from studyframe.functions import stats as S
from studyframe.operators import infer


def close(a, b, tol=1e-9):
    return abs(a - b) <= tol * max(1.0, abs(b))


def test_pearson_p():
    assert close(S.pearson_p(0.5, 20), 0.024769558804109762, 1e-8)
    assert S.pearson_p(1.0, 10) == 0.0


def test_chi2_sf():
    assert close(S.chi2_sf(3.841458820694124, 1), 0.05, 1e-8)
    assert close(S.chi2_sf(5.991464547107979, 2), 0.05, 1e-8)


def test_normal():
    assert close(S.norm_sf(1.959963984540054), 0.025, 1e-9)
    assert close(S.norm_ppf(0.975), 1.959963984540054, 1e-7)


def test_fisher_exact():
    odds, p = S.fisher_exact_2x2(8, 2, 1, 5)
    assert odds == 20.0 and close(p, 0.03496503496503495, 1e-9)
    assert S.fisher_exact_2x2(3, 3, 3, 3)[1] == 1.0
    assert close(S.fisher_exact_2x2(0, 10, 10, 0)[1], 1.0825088224469e-05, 1e-6)


def test_mann_whitney_p_matches_hand_formula():
    # x1 = [1, 2, 3, 4], x0 = [5, 6, 7, 8]: U1 = 0, no ties
    p = infer.mann_whitney_p(0.0, 4, 4, 0.0)
    z = (16 - 8 - 0.5) / math.sqrt(4 * 4 * 9 / 12)
    assert close(p, 2 * S.norm_sf(z))


def test_p_value_note():
    assert S.p_value_note(0.0005, "ok") == "sig_0.001"
    assert S.p_value_note(0.2, "ok") == "ns"
    assert S.p_value_note(0.01, "skipped") == "not_run"

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark import params as P
from riskspark.functions import curves as C
from riskspark.functions import dates as D
from riskspark.functions import numbers as N
from riskspark.functions import ratings as R
from riskspark.functions import text as X
from riskspark.operators.flags import text_severity
from riskspark.operators.lookup import with_state_params

def column(values):
    return [(v,) for v in values]


def test_liquidity_curve(evaluate):
    values = [0.35, 0.50, 0.0, -0.99, -10.0, None, 0.600615, 0.10]
    assert evaluate(C.liquidity_curve, column(values), "x double") == [1.0, 1.0, 0.35, 0.0, 0.0, None, 1.0, 0.6]


def test_budget_curve(evaluate):
    values = [90.0, 100.0, 105.0, 121.0, 200.0, 152.71, 69.9, 0.0, 69.26, None, 80.0, 112.5]
    expected = [1.0, 1.0, 1.0, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0, None, 0.5, 0.75]
    assert evaluate(C.budget_curve, column(values), "x double") == expected


def test_arrears_curve(evaluate):
    assert evaluate(C.arrears_curve, column(range(7)), "x int") == [1.0, 0.75, 0.5, 0.3, 0.1, 0.0, 0.0]


def test_compliance_text_score(evaluate):
    texts = [
        "REGULAR", "CADIN", "Regularidade Fiscal (RFB)", "Adimplência TCU", "CADIN | Regularidade FGTS", None,
        "Regularidade FGTS | SICONFI RREO",
    ]
    assert evaluate(text_severity, column(texts), "x string") == [0.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.15]


@pytest.mark.parametrize(
    ("score", "years", "chronic", "expected"),
    [
        (75.0, 6, 0, 0), (74.9, 6, 0, 1), (54.9, 6, 0, 2), (34.9, 6, 0, 3), (None, 6, 0, 4), (80.0, 0, 0, 4),
        (75.0, 6, 3, 0), (75.0, 6, 4, 1), (75.0, 2, 0, 2), (75.0, 3, 0, 1), (20.0, 2, 0, 3), (90.0, 3, 5, 1),
        (90.0, 2, 5, 2),
    ],
)
def test_classify(evaluate, score, years, chronic, expected):
    def label():
        return R.class_label(R.class_rank(F.col("s"), F.col("y"), F.col("c")))

    names = [*P.RISK_CLASSES, P.NO_DATA_CLASS]
    assert evaluate(label(), [(score, years, chronic)], "s double, y int, c int") == [names[expected]]


def test_half_even_equals_numpy(evaluate):
    values = (np.random.default_rng(3).uniform(-500, 500, 2000).round(3) / 2).tolist() + [722.5, 0.285, -0.004]
    assert evaluate(lambda x: N.half_even(x, 2), column(values), "x double") == [float(np.round(v, 2) + 0.0) for v in values]


def test_half_away(evaluate):
    assert evaluate(lambda x: N.half_away(x, 1), column([0.25, -0.25, 0.75, None]), "x double") == [0.3, -0.3, 0.8, None]


def test_decimal_typing(evaluate):
    got = evaluate(N.parse_decimal9, column(["0.8765432109876543", "123,1234567895", " ", None]), "x string")
    assert [None if v is None else str(v) for v in got] == ["0.876543211", "123.123456790", None, None]


def test_decimal_typing_rejects_garbage(evaluate):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        evaluate(N.parse_decimal9, column(["abc"]), "x string")


def test_parse_bool(evaluate):
    texts = ["True", "sim", "0", "NÃO", "nao", "talvez", "", None]
    assert evaluate(N.parse_bool, column(texts), "x string") == [True, True, False, False, False, True, False, None]


def test_sanitize_names():
    assert X.sanitize_names(["a", "a", "a_1", "A"]) == ["a", "a_1", "a_1_1", "a_2"]
    assert X.sanitize_names(["data coleta", "1.1", "A", "a", "_x", "__"]) == ["data_coleta", "c_1_1", "a", "a_1", "x", "col_5"]


def test_months(spark):
    row = spark.range(1).select(
        D.months_back(date(2026, 4, 28), 6).alias("a"), D.months_back(date(2026, 8, 31), 6).alias("b")
    ).first()
    assert (row.a, row.b) == (date(2025, 10, 28), date(2026, 2, 28))


def test_month_spine(spark):
    span = spark.createDataFrame([(date(2025, 10, 28), date(2026, 4, 28))], "a date, b date")
    months = [(r.month_start, r.month_end) for r in D.month_spine(span, "a", "b").orderBy("month_start").collect()]
    assert len(months) == 7
    assert months[0] == (date(2025, 10, 28), date(2025, 10, 31))
    assert months[-1] == (date(2026, 4, 1), date(2026, 4, 28))


def test_report_delay(evaluate):
    days = D.report_delay_days(F.col("y"), F.col("p"), F.col("r"), date(2026, 3, 1))
    rows = [(2025, 3, "Q"), (2025, 2, "S"), (2025, 1, "Q"), (2026, 1, "Q"), (2025, 4, "Q"), (2025, None, "Q"), (2025, 1, "B")]
    expected = [28, 28, (date(2026, 3, 1) - date(2025, 6, 1)).days, 0, 999, 999, 999]
    assert evaluate(days, rows, "y int, p int, r string") == expected


def test_rating_grades(evaluate):
    values = [0.95, 0.8499, 0.75, 0.65, 0.1, None]
    assert evaluate(R.grade_from_percent, column(values), "x double") == ["A", "C", "C", "D", "E", "SEM_ICF"]


def test_normalize_code(evaluate):
    assert evaluate(X.normalize_code, column(["53", " 2504009.0 ", "12"]), "x string") == ["5300108", "2504009", "0000012"]


def test_state_parameters(spark):
    overrides = {"CE": P.StateOverride(weights={"liquidity": 33.0, "arrears": 27.0}, critical_autonomy=0.081)}
    rows = spark.createDataFrame([(s,) for s in ("PB", "PA", "GO", "SP", "RS", "CE")], "state string")
    got = {r.state: r for r in with_state_params(rows, overrides).collect()}
    limits = {s: got[s].critical_autonomy for s in ("PB", "PA", "GO", "SP", "RS")}
    assert limits == {"PB": 0.05, "PA": 0.053, "GO": 0.075, "SP": 0.066, "RS": 0.078}
    assert (got["CE"].w_liquidity, got["CE"].w_arrears, got["CE"].critical_autonomy) == (33.0, 27.0, 0.081)


def test_regions():
    assert len(P.STATE_REGION) == 27
    assert sum(P.WEIGHTS.values()) == 100
    with pytest.raises(ValueError, match="state without a region"):
        P.region_of("XX")

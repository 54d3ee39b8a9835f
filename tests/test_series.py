"""Runs, verdicts and the backtest report on small series."""

from datetime import date, datetime, timedelta
from math import exp

import pytest
from pyspark.sql import functions as F

from straitline.operators import series as SE
from straitline.operators.prices import find_run_up, price_as_of
from straitline.plans.backtest import run_backtest

START = date(2026, 2, 11)


def scores(cross=None, low=0.3, high=0.8, n=20, blips=()):
    return [high if (cross is not None and i >= cross) or i in blips else low for i in range(n)]


CASES = {
    "lead": (scores(7), ("PASSED", 3, 0)), "late_ok": (scores(12), ("PASSED", -2, 0)), "late": (scores(13), ("FAILED", None, 0)),
    "never": (scores(), ("FAILED", None, 0)), "start": (scores(0), ("INCONCLUSIVE", 10, 0)), "blip": (scores(8, blips=(2, 3)), ("PASSED", 2, 1)),
    "blip_only": (scores(blips=(2,)), ("FAILED", None, 1)), "level": (scores(0, high=0.6), ("FAILED", None, 0)),
    "gap": ([None if i == 9 else s for i, s in enumerate(scores(5))], ("PASSED", 0, 1)),
}


def test_verdicts(spark):
    rows = [(k, START + timedelta(days=i), s) for k, (values, _) in CASES.items() for i, s in enumerate(values)] + [("flat", START, 0.9)]
    series = spark.createDataFrame(rows, "event string, day date, score double")
    prices = spark.createDataFrame([("P", START + timedelta(days=i - 1), 70.0 if i < 11 else 77.0) for i in range(21)] + [("Q", START, 1.0)], "series string, date date, price_usd double")
    windows = spark.createDataFrame([(k, "Hormuz", "Q" if k == "flat" else "P", START, START + timedelta(days=19)) for k in [*CASES, "flat"]],
                                    "event string, corridor string, series string, chart_start date, end date")
    got = {r.event: r for r in SE.validate(series, prices, windows).collect()}
    for k, (_, (verdict, lead, alarms)) in CASES.items():
        assert (got[k].validation, got[k].lead_days, len(got[k].false_alarms)) == (verdict, lead, alarms), k
    assert got["flat"].validation == "NO_PRICE_EVENT"
    assert got["lead"].spike_pct == pytest.approx(10.0) and got["start"].lead_is_lower_bound and "AFTER" in got["late_ok"].reason


def test_run_up_is_the_tightest_climb(spark):
    values = [70, 90, 69, 80, 70, 100, 113, 69, 112]
    px = spark.createDataFrame([("B", date(2026, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)], "series string, date date, price_usd double")
    up = find_run_up(px, 69.0, 114.0).first()
    assert (up.start.day, up.peak.day, up.days) == (8, 9, 1)
    keys = spark.createDataFrame([("B", date(2025, 12, 31)), ("B", date(2026, 1, 3)), ("B", date(2026, 2, 1))], "series string, day date")
    assert {r.day.month: r.price_usd for r in price_as_of(px, keys).collect()} == {12: None, 1: 69.0, 2: 112.0}


def test_backtest_report(spark):
    day0 = datetime(2026, 2, 1)
    events = [(i, "Hormuz", 5, 1.0, day0 + timedelta(days=10, hours=i), f"headline {'abcdefghij'[i] * 9} number {'zyxwvutsrq'[i] * 7}") for i in range(9)]
    df = spark.createDataFrame(events, "event_id long, corridor string, severity int, confidence double, ts timestamp, title string")
    corridors = spark.createDataFrame([("Hormuz", 0.2), ("Cape", 0.05)], "name string, baseline_risk double")
    windows = spark.createDataFrame([("w", "n", "", "Hormuz", "B", day0.date(), date(2026, 2, 20), 69.0, 78.0)],
                                    "event string, name string, note string, corridor string, series string, chart_start date, end date, run_up_low double, run_up_high double")
    prices = spark.createDataFrame([("B", date(2026, 1, 25) + timedelta(days=i), 70.0 if i < 20 else 77.0) for i in range(27)], "series string, date date, price_usd double")
    days = [date(2026, 1, 25) + timedelta(days=i) for i in range(27)]
    ledger = spark.createDataFrame([("w", d, "error" if d.day == 5 else "ok", 96, 96, 7) for d in days], "event string, day date, status string, slices_read long, slices_total long, stored long")
    articles = spark.createDataFrame([("x", "t\nseendate: 20260210T000000Z", True)], "url string, raw_text string, processed boolean")
    r = run_backtest(df, corridors, windows, prices, ledger, articles).first()
    assert (r.validation, r.validation_if_complete, r.lead_days) == ("INCOMPLETE", "PASSED", 3)  # news of Feb 11, price of Feb 14
    assert r.days_ok == 26 and [(g.start.day, g.days) for g in r.gaps] == [(5, 1)] and r.run_up.days == 1
    chart = {x.date.day: x for x in r.series}
    assert [x.date for x in r.series] == sorted(x.date for x in r.series) and len(chart) == 20
    assert chart[1].scores == {"Hormuz": 0.2, "Cape": 0.05}
    ages = [(datetime(2026, 2, 12, 16, 30) - e[4]).total_seconds() / 86400 for e in events[-3:]]  # the three latest are the strongest
    assert chart[12].scores["Hormuz"] == pytest.approx(0.2 + 0.8 * sum(exp(-0.1 * a) for a in ages) / 3, abs=1e-4)
    assert not chart[5].day_sampled and chart[6].unsampled_days_in_lookback == 1
    assert len(chart[12].top_stories) == 3 and chart[14].price_usd == 77.0 and chart[12].events["Hormuz"] == 9

"""As-of access, intervals and membership histories."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import asof, calendar as cal, fundamentals as fu, intervals as iv

D = date.fromisoformat


def test_latest_as_of_and_look_ahead(spark):
    df = spark.createDataFrame(
        [("A", D("2024-01-01"), 1), ("A", D("2024-02-01"), 2), ("A", D("2024-03-01"), 3)],
        "security_id string, available_at date, v int",
    )
    assert asof.latest_as_of(df, "2024-02-15").first().v == 2
    with pytest.raises(asof.LookAheadError, match="1 rows"):
        asof.assert_point_in_time(df, "2024-02-15")
    asof.assert_point_in_time(asof.visible(df, "2024-02-15"), "2024-02-15")


def test_asof_join_against_brute_force(spark):
    rng = np.random.default_rng(5)
    start = D("2020-01-01")
    facts = [(int(rng.integers(0, 4)), start + timedelta(int(d)), float(i)) for i, d in enumerate(rng.integers(0, 300, 120))]
    queries = [(k, start + timedelta(d)) for k in range(5) for d in (5, 60, 61, 200, 320)]
    f = spark.createDataFrame(facts, "security_id int, available_at date, v double")
    q = spark.createDataFrame(queries, "security_id int, as_of_date date")
    for lag in (0, 30):
        got = {(r.security_id, r.as_of_date): r.v for r in asof.asof_join(q, f, ["v"], tie=["v"], lag_days=lag).collect()}
        for k, d in queries:
            seen = [(t, v) for s, t, v in facts if s == k and t <= d - timedelta(lag)]
            assert got[(k, d)] == (max(seen)[1] if seen else None)


def test_future_facts_do_not_change_the_past(spark):
    q = spark.createDataFrame([(1, D("2024-02-15")), (1, D("2024-04-15"))], "security_id int, as_of_date date")
    rows = [(1, D("2024-02-01"), 1.0), (1, D("2024-03-01"), 2.0)]
    schema = "security_id int, available_at date, v double"
    before = asof.asof_join(q, spark.createDataFrame(rows, schema), ["v"]).where("as_of_date < '2024-03-01'")
    changed = asof.asof_join(q, spark.createDataFrame([rows[0], (1, D("2024-03-01"), 20.0)], schema), ["v"])
    assert before.collect() == changed.where("as_of_date < '2024-03-01'").collect()


def test_net_issuance(spark):
    rows = [("A", "2023-01-10", 100.0), ("A", "2024-01-10", 90.0), ("A", "2024-06-01", 50.0),
            ("B", "2023-01-10", 100.0), ("B", "2024-01-10", 120.0), ("B", "2024-06-01", 999.0)]
    shares = spark.createDataFrame([(s, D(d), v) for s, d, v in rows], "security_id string, available_at date, shares_outstanding double")
    q = spark.createDataFrame([("A", D("2024-02-01")), ("B", D("2024-02-01"))], "security_id string, as_of_date date")
    out = asof.asof_join_many(q, fu.share_sources(shares)).select("security_id", fu.net_issuance().alias("n"))
    got = {r.security_id: r.n for r in out.collect()}
    assert got["A"] == pytest.approx(-0.10) and got["B"] == pytest.approx(0.20)


def test_nearest_prefers_the_earlier_of_two(spark):
    base = spark.createDataFrame([(1, D("2024-03-31"))], "k int, end date")
    series = spark.createDataFrame([(1, D("2024-03-28"), 1.0), (1, D("2024-04-03"), 2.0)], "k int, end date, v double")
    assert asof.nearest_join(base, series, ["k"], "end", ["v"]).first().v == 1.0
    far = spark.createDataFrame([(1, D("2024-03-20"), 1.0)], "k int, end date, v double")
    assert asof.nearest_join(base, far, ["k"], "end", ["v"]).first().v is None


def test_product_after_is_strict(spark):
    facts = spark.createDataFrame([(1, D("2024-01-01")), (1, D("2024-02-01")), (2, D("2024-01-01"))], "k int, t date")
    events = spark.createDataFrame([(1, D("2024-02-01"), 2.0), (1, D("2024-03-01"), 3.0)], "k int, d date, f double")
    got = {(r.k, str(r.t)): r.p for r in asof.product_after(facts, events, "k", "t", "d", "f", "p").collect()}
    assert got == {(1, "2024-01-01"): 6.0, (1, "2024-02-01"): 3.0, (2, "2024-01-01"): 1.0}


def test_on_or_before_outside_the_calendar(spark):
    days = cal.trading_calendar(spark.createDataFrame([(D("2024-01-05"),), (D("2024-01-09"),)], "date date"))
    asked = spark.createDataFrame([(D(d),) for d in ("2024-01-04", "2024-01-06", "2024-01-09", "2024-02-01")], "requested date")
    got = {str(r.requested): r.trading_date and str(r.trading_date) for r in cal.on_or_before(asked, days).collect()}
    assert got == {"2024-01-04": None, "2024-01-06": "2024-01-05", "2024-01-09": "2024-01-09", "2024-02-01": "2024-01-09"}


def intervals(df):
    return sorted((r.security_id, str(r.start), str(r.end)) for r in df.collect())


def test_membership_from_change_log(spark):
    changes = spark.createDataFrame([(D("2020-01-01"), "NEW1", "OLD1"), (D("2022-06-01"), "NEW2", "OLD2")], "date date, added string, removed string")
    current = spark.createDataFrame([("KEEP",), ("NEW1",), ("NEW2",)], "security_id string")
    assert intervals(iv.membership_from_changes(current, changes)) == [
        ("KEEP", "None", "None"), ("NEW1", "2020-01-01", "None"), ("NEW2", "2022-06-01", "None"),
        ("OLD1", "None", "2020-01-01"), ("OLD2", "None", "2022-06-01")]


def backward_walk(current, log):
    members, ends, out = set(current), {t: None for t in current}, []
    for day, added, removed in sorted(log, reverse=True):
        if added in members:
            out.append((added, day, ends.pop(added)))
            members.discard(added)
        if removed is not None and removed not in members:
            members.add(removed)
            ends[removed] = day
    return sorted((t, str(s), str(e)) for t, s, e in [*out, *[(t, None, e) for t, e in ends.items()]])


def test_change_log_against_backward_walk(spark):
    rng = np.random.default_rng(11)
    names = list("ABCDEFGH")
    days = sorted({D("2020-01-01") + timedelta(int(k)) for k in rng.integers(0, 900, 60)})
    log = []
    for day in days:
        a, b = rng.choice(names, 2, replace=False)
        log.append((day, str(a), str(b) if rng.random() < 0.8 else None))
    current = [n for n in names if rng.random() < 0.5]
    df = iv.membership_from_changes(
        spark.createDataFrame([(c,) for c in current], "security_id string"),
        spark.createDataFrame(log, "date date, added string, removed string"))
    assert intervals(df) == backward_walk(current, log)


def test_membership_from_snapshots(spark):
    rows = [("2000-01-03", t) for t in ("AAA", "BBB")] + [("2010-05-03", t) for t in ("AAA", "CCC")] + [("2015-01-05", t) for t in ("CCC", "DDD")]
    long = spark.createDataFrame([(D(d), t) for d, t in rows], "date date, security_id string")
    assert intervals(iv.membership_from_snapshots(long)) == [
        ("AAA", "None", "2015-01-05"), ("BBB", "None", "2010-05-03"), ("CCC", "2010-05-03", "None"), ("DDD", "2015-01-05", "None")]


def test_a_fact_without_a_time_is_never_visible(spark):
    facts = spark.createDataFrame([("A", None, 9.0), ("A", date(2024, 2, 10), 1.0), ("B", None, 5.0)], "security_id string, available_at date, v double")
    asked = spark.createDataFrame([(k, d) for k in "AB" for d in (date(2024, 1, 31), date(2024, 2, 29))], "security_id string, as_of_date date")
    got = {(r.security_id, r.as_of_date.month): r.v for r in asof.asof_join(asked, facts, ["v"]).collect()}
    assert got == {("A", 1): None, ("A", 2): 1.0, ("B", 1): None, ("B", 2): None}
    assert asof.latest_as_of(facts, "2024-01-31").count() == 0


def test_a_guarded_plan_fails_the_job_that_reads_it(spark):
    """Nothing is checked until rows are read; then the first row from after its date ends the job."""
    rows = [(1, date(2024, 1, 10), date(2024, 1, 31)), (2, date(2024, 1, 31), date(2024, 1, 31)), (3, date(2024, 2, 1), date(2024, 1, 31))]
    df = spark.createDataFrame(rows, "security_id long, available_at date, as_of_date date")
    fine = asof.guarded(df.where("security_id < 3"), F.col("as_of_date")).groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n"))
    assert fine.first().n == 2
    late = asof.guarded(df, "2024-01-31").groupBy("as_of_date").agg(F.count(F.lit(1)).alias("n"))
    with pytest.raises(Exception, match="look-ahead: available_at 2024-02-01 is not known at 2024-01-31"):
        late.collect()
    unknown = asof.guarded(spark.createDataFrame([(1, None)], "security_id long, available_at date"), "2024-01-31")
    with pytest.raises(Exception, match="look-ahead: available_at unknown"):
        unknown.count()


def test_the_registered_guard_fails_on_a_leak(spark, monkeypatch):
    """The query itself ends if the join it reads from lets the future through."""
    from quantloom.plans import q_market
    from quantloom.plans.catalog import QUERIES

    grid = spark.createDataFrame([(date(2024, 1, 31), 1)], "as_of_date date, security_id long")
    monkeypatch.setattr(q_market.tb, "decision_dates", lambda *_: grid.select("as_of_date"))
    monkeypatch.setattr(q_market.tb, "securities", lambda *_: grid.select("security_id"))
    leak = [date(2024, 1, 20)]

    def facts(*_):
        return spark.createDataFrame([(1, date(2023, 12, 31), leak[0])], "security_id long, event_time date, available_at date")

    def joined(queries, facts, values, **_):
        return queries.join(facts, "security_id")

    monkeypatch.setattr(q_market.tb, "fundamentals", facts)
    monkeypatch.setattr(q_market.asof, "asof_join", joined)
    query = QUERIES["guarded_statements"]
    assert query(spark, "").first().available_at == leak[0]
    leak[0] = date(2024, 2, 1)
    with pytest.raises(Exception, match="look-ahead"):
        query(spark, "").collect()

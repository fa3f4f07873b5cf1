"""Book operators, drift, and one operator on a stream."""

import numpy as np
import pytest

from __spark_entry__ import queries
from quantloom.operators import book as bk, ml
from quantloom.plans import q_views


def test_reconcile(spark):
    b = spark.createDataFrame([("A", 10.0), ("B", 5.0), ("C", 1.0)], "security_id string, qty double")
    led = spark.createDataFrame([("A", 10.0), ("B", 4.0), ("D", 2.0)], "security_id string, qty double")
    got = {r.security_id: r.type for r in bk.reconcile(b, led).collect()}
    assert got == {"B": "QUANTITY_MISMATCH", "C": "UNTRACKED_AT_BROKER", "D": "QUANTITY_MISMATCH"}


def test_order_sizing_rules(spark):
    orders = spark.createDataFrame(
        [("p", "BUYS", "BUY", 0.0, 0.05, 0.05), ("p", "EXIT", "SELL", 0.5, 0.0, -0.5), ("p", "TINY", "BUY", 0.0, 0.00001, 0.00001),
         ("p", "HUGE", "BUY", 0.0, 0.2, 0.2), ("p", "NOPX", "BUY", 0.0, 0.01, 0.01), ("p", "KEEP", "HOLD", 0.1, 0.1, 0.0)],
        "portfolio_id string, security_id string, side string, current_weight double, target_weight double, delta_weight double")
    prices = spark.createDataFrame([(s, 10.0) for s in ("BUYS", "EXIT", "TINY", "HUGE", "KEEP")], "security_id string, price double")
    held = spark.createDataFrame([("p", "EXIT", 7000.0)], "portfolio_id string, security_id string, qty double")
    sized = bk.sized_orders(orders, prices, held, ["portfolio_id"], 100_000.0)
    got = {r.security_id: (r.qty, r.failed_check) for r in sized.collect()}
    assert got == {"BUYS": (497.5, None), "EXIT": (7000.0, None), "HUGE": (1990.0, "MAX_ORDER_SIZE"), "NOPX": (None, "PRICE_AVAILABLE")}
    assert not bk.pre_trade_checks(sized, ["portfolio_id"]).first().pre_trade_ok
    asked = spark.createDataFrame([("none",), (sized.first().portfolio_id,)], "portfolio_id string")
    checked = {r.portfolio_id: r for r in bk.pre_trade_checks(sized, ["portfolio_id"], proposals=asked).collect()}
    assert len(checked) == 2 and checked["none"].pre_trade_ok and checked["none"].n_orders == 0


def test_population_stability(spark):
    rng = np.random.default_rng(4)
    frame = lambda x: spark.createDataFrame([(float(v), 1.0) for v in x], "f double, const double")
    base = frame(rng.normal(size=3000))
    same = {r.feature: r.psi for r in ml.population_stability(base, frame(rng.normal(size=3000)), ["f", "const"]).collect()}
    moved = {r.feature: r.psi for r in ml.population_stability(base, frame(rng.normal(1, 1, 3000)), ["f"]).collect()}
    assert same["f"] < 0.02 and same["const"] == 0.0 and moved["f"] > 0.25


def test_ridge_matches_the_closed_form(spark):
    rng = np.random.default_rng(6)
    x = rng.random((400, 3))
    y = x @ np.array([0.3, -0.2, 0.0]) + rng.normal(0, 0.3, 400)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, target double")
    model = ml.fit_model(rows, "ridge", ["a", "b", "c"])
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(3), xc.T @ yc)
    np.testing.assert_allclose(model.stages[-1].coefficients.toArray(), want, atol=1e-4)


def test_positions_on_a_stream(spark, tmp_path):
    rows = [("A", 5.0), ("B", 1.0), ("A", -5.0), ("B", 2.0)]
    spark.createDataFrame(rows, "security_id string, qty double").write.parquet(str(tmp_path / "fills"))
    stream = spark.readStream.schema("security_id string, qty double").parquet(str(tmp_path / "fills"))
    q = bk.implied_positions(stream).writeStream.format("memory").queryName("positions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.security_id, r.qty) for r in spark.table("positions").collect()] == [("B", 3.0)]


@pytest.mark.parametrize("bad", [-0.1, 1.1])
def test_blend_must_be_a_share(spark, bad):
    with pytest.raises(ValueError):
        ml.blend_scores(None, None, None, bad)


def test_orders_are_sized_at_the_price_of_their_own_date(spark, monkeypatch):
    day = lambda *names: [f"to_date({n}) {n}" for n in names]
    orders = spark.createDataFrame(
        [("p", d, s, "BUY", 0.0, 0.05, 0.05) for d in ("1998-03-31", "2000-03-31") for s in ("A", "B")],
        "portfolio_id string, as_of_date string, security_id string, side string, current_weight double, target_weight double, delta_weight double")
    bars = spark.createDataFrame(
        [("A", "1998-02-28", 10.0), ("A", "1998-03-31", 20.0), ("A", "1998-04-30", 99.0), ("A", "2001-12-31", 500.0),
         ("B", "1999-12-31", 40.0), ("B", "2000-02-29", None)], "security_id string, date string, price_close double")
    held = spark.createDataFrame([], "portfolio_id string, as_of_date date, security_id string, weight double")
    frames = {"orders": orders.selectExpr("* except(as_of_date)", *day("as_of_date")), "current_weights": held}
    for name, frame in frames.items():
        monkeypatch.setattr(q_views, name, lambda spark, sf, frame=frame: frame)
    monkeypatch.setattr(q_views.tb, "bars", lambda spark, sf: bars.selectExpr("security_id", "price_close", *day("date")))
    got = {(str(r.as_of_date), r.security_id): (r.price, r.failed_check) for r in q_views.sized(spark, "").collect()}
    assert got == {("1998-03-31", "A"): (20.0, None), ("1998-03-31", "B"): (None, "PRICE_AVAILABLE"),
                   ("2000-03-31", "A"): (99.0, None), ("2000-03-31", "B"): (40.0, None)}


def test_the_registered_boosted_fit_is_the_operators(spark, monkeypatch):
    asked = []

    class Asked(Exception):
        pass

    def fit(self, rows, params=None):
        asked.append(self.getStages()[1])
        raise Asked

    columns = ", ".join(f"{c} double" for c in q_views._X)
    frame = spark.createDataFrame([], f"as_of_date date, security_id string, label_known_at date, target double, {columns}")
    monkeypatch.setattr(q_views, "panel", lambda spark, sf: frame)
    monkeypatch.setattr(ml.Pipeline, "fit", fit)
    with pytest.raises(Asked):
        queries()["gradient_boosted_fit"](spark, "")
    want = ml.make_estimator("gbm", q_views._X, 1, 1.0).getStages()[1]
    value = lambda m: {p.name: m.getOrDefault(p) for p in m.params if m.isDefined(p)}
    assert value(asked[0]) == value(want) and want.getMaxIter() == 200

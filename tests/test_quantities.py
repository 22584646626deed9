"""Problem 4: units, by table and by links."""

import random

from tables import clashing, nulls, quantities
from tessera.operators import quantities as q
from tessera.operators.unit_graph import conversions
from tessera.plans.workspace import Workspace

UNITS = [("temperature", "degC"), ("pressure", "bar"), ("length", "mm"), ("torque", "N*m"), ("volume", "L"), ("power", "kW"), (None, None)]


def canonical(spark):
    return spark.createDataFrame(UNITS, "parameter string, canonical_unit string")


def cases(spark):
    return quantities(
        spark, {"quantity_id": "a", "raw_text": "315 °F", "value_text": "315", "value": 315.0, "unit_raw": "°F"},
        {"quantity_id": "b", "raw_text": "13,507.0 mbar", "value_text": "13,507.0", "unit_raw": " MBAR.", "parameter": "pressure"},
        {"quantity_id": "c", "raw_text": "25 3/4 mm", "value_text": "25 3/4", "unit_raw": "", "flags": ["fraction"]},
        {"quantity_id": "d", "raw_text": "15", "value_text": "15", "value": 15.0}, {"quantity_id": "d", "raw_text": "15", "value_text": "15", "value": 15.0},
        {"quantity_id": "e", "raw_text": "3–5 bar", "value_text": "3–5", "value_min": 3.0, "value_max": 5.0, "unit_raw": "bar"},
        {"quantity_id": "f", "raw_text": "1 360 hPa", "value_text": "1 360"}, {"quantity_id": "g", "raw_text": "7 pcs", "value_text": "7", "value": 7.0, "unit_raw": "pcs"},
        {"quantity_id": "h", "raw_text": "0,61 gal (UK)", "value_text": "0,61", "unit_raw": "gal (UK)", "flags": ["decimal_comma"]})


WANTED = {"a": ("degC", 157222), "b": ("bar", 13507), "c": ("mm", 25750), "d": ("N*m", 1695), "f": ("bar", 1360), "h": ("L", 2773)}


def run(spark, df):
    e = spark.createDataFrame([("E", "torque 15 in-lb, then"), ("E", "torque 15 in-lb, then"), (None, None), ("E2", None)], "evidence_id string, text string")
    return {r["quantity_id"]: (r["canonical_unit"], r["canonical_milli"]) for r in q.found(df, e, canonical(spark)).collect()}


def test_units(spark):
    assert run(spark, cases(spark)) == WANTED


def test_awkward_tables(spark):
    assert run(spark, clashing(nulls(cases(spark)))) == WANTED
    assert run(spark, cases(spark).limit(0)) == {}


def _linked(spelling: str, unit: str, scale: float, offset: float, n: int, wrong: int, seed: int):
    """n dual statements of a spelling and a unit, some wrong."""
    rng, out = random.Random(seed), []
    for i in range(n):
        x = round(rng.uniform(120, 900), 1)
        y = x if i < wrong else round(scale * x + offset, 1)
        out += [{"quantity_id": f"{spelling}{i}", "value": x, "value_text": str(x), "unit_raw": spelling, "alternate_of": f"{spelling}{i}-b"},
                {"quantity_id": f"{spelling}{i}-b", "value": y, "value_text": str(y), "unit_raw": unit}]
    return out


def test_links_decide_where_the_spelling_is_unknown(spark):
    """kilopunds of a made-up spelling, a temperature with an offset, and one two links away from a canonical unit."""
    df = quantities(spark, *_linked("klaf", "bar", 0.0689475729, 0, 40, 4, 1), *_linked("grad F.", "°C", 5 / 9, -160 / 9, 60, 7, 2),
                    *_linked("zoll", "fuss", 1 / 12, 0, 40, 3, 3), *_linked("fuss", "mm", 304.8, 0, 40, 3, 4), *_linked("quux", "bar", 7.7, 0, 40, 0, 5))
    got = run(spark, df)
    x = {r["quantity_id"]: r["value"] for r in df.collect()}
    for name, unit, scale, offset in (("klaf", "bar", 0.06894757293168361, 0), ("grad F.", "degC", 5 / 9, -160 / 9), ("zoll", "mm", 25.4, 0), ("fuss", "mm", 304.8, 0)):
        assert got[f"{name}9"] == (unit, round((scale * x[f"{name}9"] + offset) * 1000)), name
    assert "quux9" not in got  # fits no exact conversion


def test_links_overrule_the_table_only_when_many(spark):
    df = quantities(spark, *_linked("psi", "bar", 0.980665, 0, 6, 0, 1), *_linked("atm", "bar", 0.980665, 0, 40, 0, 2))
    rows = q.printed(df)
    can = canonical(spark).where("parameter is not null")
    anchors = can.selectExpr("canonical_unit as form", "parameter as measures").replace("N*m", "n.m", "form")
    got = {r["form"]: r["scale"] for r in conversions(q.same_things(rows), can, anchors, Workspace(spark, "test")).collect()}
    assert abs(got["psi"] - 0.0689475729) < 1e-9 and abs(got["atm"] - 0.980665) < 1e-9


def test_case_tells_milliwatt_from_megawatt(spark):
    df = quantities(spark, {"quantity_id": "a", "value": 5.0, "value_text": "5", "unit_raw": "mW"}, {"quantity_id": "b", "value": 5.0, "value_text": "5", "unit_raw": "MW"},
                    {"quantity_id": "c", "value": 300.0, "value_text": "300", "unit_raw": "K"})
    assert run(spark, df) == {"a": ("kW", 0), "b": ("kW", 5_000_000), "c": ("degC", 26850)}

"""Quantities in running text."""

from tessera.operators import extraction


def read(text):
    return [(q[2], q[3], q[5], q[6] and round(q[6], 6), q[7], q[8], q[10] and round(q[10], 4)) for q in extraction.Reader().quantities(text)]


def test_values():
    assert read("Torque max. 45 Nm (33 lb-ft) on 2024-05-06 at 12:30.") == [("45 Nm", "max", "torque", 45.0, None, None, 45.0), ("33 lb-ft", None, "torque", 33.0, None, None, 44.742)]
    assert read("Set 1,500.5 mbar or 0,61 bar or 1 1/2 in.") == [("1,500.5 mbar", None, "pressure", 1500.5, None, None, 1.5005), ("0,61 bar", None, "pressure", 0.61, None, None, 0.61)]
    assert read("Fill 3–5 L at 20 ± 2 °C.") == [("3–5 L", None, "volume", None, 3.0, 5.0, None), ("20 ± 2 °C", None, "temperature", 20.0, 18.0, 22.0, 20.0)]
    assert read("Part HX-420 m, Rev. 3, 7 pcs, 5 mW, 5 MW")[-1][0] == "5 MW"
    assert read("") == [] and read("no numbers") == []


def test_places_are_those_of_the_text():
    text = "Ａ​ gap of 2.7 mm and -40 °F"
    found = list(extraction.Reader().quantities(text))
    assert [text[q[0]:q[1]] for q in found] == ["2.7 mm", "-40 °F"] and round(found[1][10], 6) == -40.0


def test_rows(spark):
    df = spark.createDataFrame([("a", "45 Nm (33 lb-ft)"), ("b", None), ("c", ""), (None, "5 bar"), ("d", "long " * 20_000 + "5 bar")], "evidence_id string, text string")
    out = extraction.extracted(df)
    assert out.count() == 4 and extraction.extracted(df.limit(0)).count() == 0
    assert [r["off"] < 0.01 for r in extraction.restatements(out).collect()] == [True]

"""Spellings of units and their exact conversions.

A spelling is compared after ``plain_marks``: lower case, raised digits lowered, ``.`` for every
product sign, ``u`` for the micro sign.  Products of force and length are made by rule.
"""

from __future__ import annotations

import re

# Exact definitions.  Canonical units: N*m, bar, degC, hour, mm, L, kg, kW, L/min, N.
LBF, KGF, FT, IN, LB, GAL_US, GAL_UK, HP_W, PSI_PA = (
    4.4482216152605, 9.80665, 0.3048, 0.0254, 0.45359237, 3.785411784, 4.54609, 745.69987158227022, 6894.757293168361)

CANONICAL = {"torque": "N*m", "pressure": "bar", "temperature": "degC", "interval": "hour", "length": "mm",
             "volume": "L", "mass": "kg", "power": "kW", "flow": "L/min", "force": "N"}

_SIMPLE: dict[str, list[tuple[float, str]]] = {
    "pressure": [(1.0, "bar|bars|barg|bar(g)|bar (g)|bar g|bara|bar(a)|bar (a)|bar a|bar gauge|bar abs"), (0.001, "mbar|millibar|hpa"),
                 (0.01, "kpa"), (10.0, "mpa|n/mm2"), (1e-5, "pa"), (KGF / 10, "kgf/cm2|kp/cm2|kg/cm2"),
                 (PSI_PA / 1e5, "psi|psig|psia|psi(g)|psi(a)|lbf/in2|lb/in2"), (1.01325, "atm")],
    "interval": [(1.0, "h|hr|hrs|hour|hours|operating hour|operating hours|betriebsstunde|betriebsstunden|std"),
                 (1 / 60, "min|mins|minute|minutes"), (1 / 3600, "s|sec|second|seconds"), (24.0, "d|day|days"),
                 (168.0, "wk|wks|week|weeks"), (730.5, "mo|month|months"), (8766.0, "yr|yrs|year|years")],
    "length": [(1.0, "mm|millimetre|millimetres|millimeter|millimeters"), (10.0, "cm|centimetre|centimetres|centimeter|centimeters"),
               (1000.0, "m|metre|metres|meter|meters"), (0.001, "um|micron|microns|micrometre|micrometres|micrometer|micrometers"),
               (25.4, "in|inch|inches|″|\"|''|′′"), (304.8, "ft|foot|feet"), (0.0254, "thou|mil|mils")],
    "volume": [(1.0, "l|ltr|litre|litres|liter|liters|dm3"), (0.001, "ml|millilitre|millilitres|milliliter|milliliters|cm3|ccm|cc"),
               (0.01, "cl"), (1000.0, "m3|cubic metre|cubic metres"), (GAL_US, "gal (us)|gal(us)|us gal|us gallon|us gallons|gallons (us)|gallon (us)"),
               (GAL_UK, "gal (uk)|gal(uk)|gal (imp)|uk gal|imp gal|imp. gal|imperial gallon|imperial gallons|gallons (uk)|gallon (uk)")],
    "mass": [(1.0, "kg|kgs|kilogram|kilograms|kilogramme|kilogrammes"), (0.001, "g|gram|grams|gramme|grammes"), (1e-6, "mg"),
             (1000.0, "t|tonne|tonnes"), (LB, "lb|lbs|pound|pounds"), (LB / 16, "oz|ounce|ounces")],
    "power": [(1.0, "kw|kilowatt|kilowatts"), (0.001, "w|watt|watts"), (1000.0, "mw|megawatt|megawatts"), (1e-6, "milliwatt|milliwatts"), (HP_W / 1000, "hp|bhp|horsepower"), (0.73549875, "ps")],
    "flow": [(1.0, "l/min|lpm|ltr/min|litres per minute|liters per minute|dm3/min"), (1 / 60, "l/h|lph"), (60.0, "l/s"), (1000 / 60, "m3/h"),
             (1000.0, "m3/min"), (0.001, "ml/min|cm3/min"), (GAL_US, "gpm (us)|gpm(us)|us gpm|gpm")],
    "force": [(1.0, "n|newton|newtons"), (1000.0, "kn|kilonewton|kilonewtons"), (10.0, "dan"), (LBF, "lbf|pound-force|pounds-force"), (KGF, "kgf|kp|kilopond|kiloponds")],
}
_TEMPERATURE = [(1.0, 0.0, "°c|° c|degc|deg c|deg. c|degree celsius|degrees celsius|degrees c|celsius|c"),
                (5 / 9, -160 / 9, "°f|° f|degf|deg f|deg. f|degree fahrenheit|degrees fahrenheit|degrees f|fahrenheit|f"),
                (1.0, -273.15, "k|kelvin|kelvins|°k|deg k")]
_FORCES = [(1.0, "n|newton"), (1000.0, "kn|kilonewton"), (10.0, "dan"), (KGF, "kgf|kp")]
_POUNDS = "lb|lbs|lbf|pound|pounds"
_JOINTS = ("", " ", ".", "-", " . ")
#: Ordinary words, or too short to be told from them in running text: units only in a column of their own.
NOT_IN_TEXT = frozenset(["in", "c", "f", "s", "a", "mo", "std", "ps", "\"", "''", "mil"])


def spellings() -> dict[str, tuple[str, float, float]]:
    """Spelling to (parameter, scale, offset): canonical = scale * value + offset."""
    out = {name: (parameter, scale, 0.0) for parameter, rows in _SIMPLE.items() for scale, names in rows for name in names.split("|")}
    out |= {name: ("temperature", scale, offset) for scale, offset, names in _TEMPERATURE for name in names.split("|")}
    for joint in _JOINTS:
        for scale, names in _FORCES:
            for force in names.split("|"):
                for length in ("m", "metre", "metres", "meter", "meters"):
                    out[force + joint + length] = ("torque", scale, 0.0)
                for length in ("mm", "cm"):
                    out[force + joint + length] = ("torque", scale * {"mm": 0.001, "cm": 0.01}[length], 0.0)
        out["kp" + joint + "m"] = ("torque", KGF, 0.0)
        for scale, names in ((FT, "ft|foot|feet"), (IN, "in|inch|inches")):
            for length in names.split("|"):
                for pound in _POUNDS.split("|"):
                    out[length + joint + pound] = out[pound + joint + length] = ("torque", LBF * scale, 0.0)
    return out


def text_pattern() -> str:
    """A unit at the start of a running text, as a Java pattern over ``plain_marks`` text."""
    names = sorted((n for n in spellings() if n not in NOT_IN_TEXT), key=lambda n: (-len(n), n))
    return r"^ *(" + "|".join(re.sub(r"([.()/*])", r"\\\1", n) for n in names) + r")(?![\p{L}\p{N}]|/\p{L})"

"""Unit conversion as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column

from loomframe.errors import LoomError

# How many base units (kg, m, l, m/s) one unit is.
FACTORS = {
    "weight": {"kg": 1.0, "g": 0.001, "lb": 0.453592, "oz": 0.0283495, "ton": 1000.0},
    "distance": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "mile": 1609.34, "ft": 0.3048, "in": 0.0254},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.78541, "qt": 0.946353, "pt": 0.473176, "cup": 0.236588, "floz": 0.0295735},
    "speed": {"mps": 1.0, "kph": 1 / 3.6, "mph": 0.44704, "knot": 0.514444},
}
_OTHER_NAMES = {"lbs": "lb", "pound": "lb", "kilogram": "kg", "gram": "g", "ounce": "oz", "mi": "mile", "miles": "mile", "foot": "ft", "feet": "ft", "inch": "in", "meter": "m", "liter": "l", "celsius": "c", "fahrenheit": "f", "kelvin": "k", "km/h": "kph", "m/s": "mps"}


def convert(x: Column, kind: str, source: str, target: str, rate: float | None = None) -> Column:
    """x in another unit. kind: weight, distance, volume, speed, temperature (c, f, k) or currency (times rate)."""
    if kind == "currency":
        if rate is None:
            raise LoomError("a conversion of currency needs a rate")
        return x * float(rate)
    a, b = (_OTHER_NAMES.get(u.lower(), u.lower()) for u in (source, target))
    if kind == "temperature":
        into = {"c": lambda t: t, "f": lambda t: (t - 32.0) * 5.0 / 9.0, "k": lambda t: t - 273.15}
        out = {"c": lambda t: t, "f": lambda t: t * 9.0 / 5.0 + 32.0, "k": lambda t: t + 273.15}
        if a not in into or b not in out:
            raise LoomError(f"no temperature unit '{a if a not in into else b}'", "There are: c, f, k")
        return x if a == b else out[b](into[a](x))
    if kind not in FACTORS:
        raise LoomError(f"no kind of unit '{kind}'", f"There are: {', '.join([*FACTORS, 'temperature', 'currency'])}")
    for u in (a, b):
        if u not in FACTORS[kind]:
            raise LoomError(f"no {kind} unit '{u}'", f"There are: {', '.join(FACTORS[kind])}")
    return x * FACTORS[kind][a] / FACTORS[kind][b]

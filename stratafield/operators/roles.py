"""Which column plays which role: on the driver, from names alone."""

from __future__ import annotations

import re

#: Ordered words per role and detector.
BASE = {
    "latitude": ["lat", "latitude", "y", "northing", "utm_northing"],
    "longitude": ["lon", "lng", "longitude", "x", "easting", "utm_easting"],
    "timestamp": ["time", "timestamp", "datetime", "date"],
    "altitude": ["alt", "altitude", "height", "z"],
    "magnetic": ["mag", "magnetic", "btotal", "field"],
    "gamma": ["gamma", "counts", "countrate", "u238"],
    "gpr": ["gpr", "radar", "amplitude", "signal"],
}
BANDS = {
    "blue": ["blue", "b1", "band1", "450", "490"],
    "green": ["green", "b2", "band2", "520", "560"],
    "red": ["red", "b3", "band3", "630", "690"],
    "nir": ["nir", "near_infrared", "b4", "band4", "770", "860"],
    "swir1": ["swir1", "shortwave1", "b5", "band5", "1550", "1650"],
    "swir2": ["swir2", "shortwave2", "b6", "band6", "2100", "2300"],
}
WALK = {
    "timestamp": ["time", "timestamp", "datetime"], "altitude": ["alt", "altitude", "height"],
    "btotal1": ["btotal1", "r1", "magnetic1"], "btotal2": ["btotal2", "r2", "magnetic2"],
    "gps_numeric_time": ["gpstime", "gpstime (s)", "time"], "gps_formatted_time": ["gpstime [hh:mm:ss.sss]"],
} | {f"b{axis}{n}": [f"b{axis}{n}", f"b{axis}_{n}", f"b{n}{axis} [nt]", f"b{n}{axis}"] for n in (1, 2) for axis in "xyz"}
MAGNETIC_FIELDS = ["R1", "Btotal1", "Total", "B_total"]


def _tokens(name: str) -> set[str]:
    return set(re.split(r"[^a-z0-9]+", name.lower()))


def detect(columns: list[str], profile: dict[str, list[str]] = BASE, exact: bool = True) -> dict[str, str]:
    """First column per role that holds a word of it: as a whole token
    (``exact``), or anywhere in the name (the older, eager detectors)."""
    out = {}
    for role, words in profile.items():
        hit = next((c for c in columns if any((w in _tokens(c) or w == c.lower()) if exact else w in c.lower() for w in words)), None)
        if hit is not None:
            out[role] = hit
    return out


def detect_walk(columns: list[str]) -> dict[str, str]:
    return detect(columns, WALK, exact=False)


def detect_bands(columns: list[str], exact: bool = True) -> dict[str, str]:
    return detect(columns, BANDS, exact)


def detect_viewer(columns: list[str]) -> dict[str, str]:
    """Map coordinates: of all hits the last one counts, latitude before longitude."""
    out: dict[str, str] = {}
    for c in columns:
        if any(w in c.lower() for w in BASE["latitude"]):
            out["latitude"] = c
        elif any(w in c.lower() for w in BASE["longitude"]):
            out["longitude"] = c
    return out


def magnetic_column(columns: list[str]) -> str | None:
    return next((c for c in columns if any(w in c.lower() for w in ("mag", "field", "btotal", "magnetic"))), None)


def grid_field(columns: list[str]) -> str | None:
    return next((c for f in MAGNETIC_FIELDS for c in columns if c == f or c.startswith(f + " ")), None)


def sensor(columns: list[str], compat: bool = False) -> str:
    """Processor for a table.  ``compat`` always answers the first registered
    one; otherwise the sensor with most roles of its own."""
    if compat:
        return "magnetic"
    names = " ".join(columns).lower()
    score = {
        "magnetic": len(re.findall(r"btotal|mag|b[12][xyz]|\bnt\b", names)), "gamma": len(re.findall(r"countrate|gamma|u238|k40|th232|cs137", names)),
        "gpr": len(re.findall(r"gpr|radar|trace|samples", names)), "multispectral": len(detect_bands(columns)),
    }
    return max(score, key=score.get)


def coordinate_system(columns: list[str]) -> str:
    """EPSG code guessed from column names: UTM words with a zone 32 to 35, else
    zone 33; WGS84 otherwise."""
    if any(w in c.lower() for c in columns for w in ("utm", "easting", "northing")):
        zone = next((z for z in (32, 33, 34, 35) if str(z) in " ".join(columns)), 33)
        return f"EPSG:258{zone}"
    return "EPSG:4326"


def droppable(columns: list[str]) -> list[str]:
    return [c for c in columns if not c or c.startswith("Unnamed") or c.lower() == "nan"]

"""Fixed schemas of the position-report tables and the roles of their columns. Fixed values throughout."""

from __future__ import annotations


def columns(text: str) -> dict[str, str]:
    """'name type, name type' as a dict; a comma inside a type has no space after it."""
    return dict(part.split(" ", 1) for part in " ".join(text.split()).split(", "))


def ddl(cols: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in cols.items())


SNAPSHOT_JSON = """
now double, messages bigint, aircraft array<struct<
hex string, flight string, r string, t string, type string, alt_baro string, alt_geom int, gs double, track double,
baro_rate int, squawk string, emergency string, category string, lat double, lon double, nic int, rc int,
seen_pos double, version int, nav_qnh double, nav_altitude_mcp int, nav_heading double, nav_modes array<string>,
messages bigint, seen double, rssi double, mlat array<string>, tisb array<string>>>
"""

TRACE_JSON = "icao string, timestamp double, trace array<array<string>>"

# Positions in a trace point, their columns and types. The first eight are required.
TRACE_POINT = [
    ("seconds_offset", "decimal(10,2)"), ("latitude", "decimal(9,6)"), ("longitude", "decimal(9,6)"),
    ("altitude_baro", "int"), ("ground_speed", "decimal(6,1)"), ("track", "decimal(6,2)"), ("flags", "int"),
    ("vertical_rate_baro", "int"), ("metadata", "struct"), ("source_type", "string"), ("altitude_geom", "int"),
    ("vertical_rate_geom", "int"), ("indicated_airspeed", "int"), ("roll_angle", "decimal(6,2)"),
]
REQUIRED_POSITIONS = 8

METADATA = columns("""
flight string, squawk string, category string, nav_qnh decimal(6,1), nav_altitude_mcp int, nav_heading decimal(6,2),
emergency string, nic int, rc int, version int, nic_baro int, nac_p int, nac_v int, sil int, sil_type string, gva int,
sda int
""")

SNAPSHOT_POINTS = columns("""
snapshot_timestamp bigint, hex string, actual_timestamp bigint, snapshot_messages bigint, seen decimal(8,1),
flight string, registration string, type string, aircraft_type string, category string, latitude decimal(9,6),
longitude decimal(9,6), alt_baro int, alt_geom int, ground_speed decimal(6,1), track decimal(6,2), baro_rate int,
nic int, rc int, seen_pos decimal(10,3), version int, nav_modes array<string>, nav_qnh decimal(6,1),
nav_altitude_mcp int, nav_heading decimal(6,2), squawk string, emergency string, messages bigint, rssi decimal(8,1),
mlat array<string>, tisb array<string>
""")
SNAPSHOT_KEY = ["snapshot_timestamp", "hex"]

TRACE_POINTS = columns("""
icao string, actual_timestamp timestamp, base_timestamp bigint, seconds_offset decimal(10,2), latitude decimal(9,6),
longitude decimal(9,6), altitude_baro int, ground_speed decimal(6,1), track decimal(6,2), flags int,
vertical_rate_baro int, altitude_geom int, vertical_rate_geom int, indicated_airspeed int, roll_angle decimal(6,2),
source_type string, source_file_path string, flight string, squawk string, category string, nav_qnh decimal(6,1),
nav_altitude_mcp int, nav_heading decimal(6,2), emergency string, nic int, rc int, version int, nic_baro int,
nac_p int, nac_v int, sil int, sil_type string, gva int, sda int
""")
TRACE_KEY = ["icao", "actual_timestamp"]

# Columns of a trace built from snapshots / from trace points.
SNAPSHOT_TRACE_SCALARS = ["type", "category", "flight", "registration", "squawk", "emergency", "nav_modes"]
SNAPSHOT_TRACE_ARRAYS = ["latitude", "longitude", "alt_baro", "ground_speed", "track", "baro_rate",
                         "nav_altitude_mcp", "nav_heading"]
TRACE_SCALARS = ["flight", "category", "emergency"]
TRACE_ARRAYS = {
    "nav_heading": "decimal(6,2)", "longitude": "decimal(9,6)", "vertical_rate_baro": "int",
    "latitude": "decimal(9,6)", "ground_speed": "decimal(6,1)", "flags": "int", "altitude_baro": "int",
    "nav_altitude_mcp": "int", "track": "decimal(6,2)", "indicated_airspeed": "int", "roll_angle": "decimal(6,2)",
    "squawk": "string",
}

# Point column -> window column.
WINDOW_MEASURES = {"vertical_rate_baro": "vertical_rates", "ground_speed": "ground_speeds", "track": "headings",
                   "altitude_baro": "altitudes"}

# Point column -> prefix of its summary columns.
SUMMARY_MEASURES = {"altitude_baro": "altitude", "ground_speed": "speed", "vertical_rate_baro": "vertical_rate",
                    "latitude": "latitude", "longitude": "longitude"}

"""Fixed values of the timetable model: table columns, route types and limits."""

from __future__ import annotations

#: Columns of each feed table with their Spark types.
TABLES = {
    "agencies": "agency_I long, agency_id string, name string, url string, timezone string, lang string, phone string",
    "stops": "stop_I long, stop_id string, code string, name string, stop_desc string, lat double, lon double, parent_I long, location_type int, wheelchair_boarding int, self_or_parent_I long",
    "routes": "route_I long, route_id string, agency_I long, name string, long_name string, route_desc string, type int, url string, color string, text_color string",
    "trips": "trip_I long, trip_id string, route_I long, service_I long, direction_id string, shape_id string, headsign string, start_time_ds int, end_time_ds int",
    "stop_times": "stop_I long, trip_I long, arr_time string, dep_time string, seq int, arr_time_hour int, shape_break int, arr_time_ds int, dep_time_ds int",
    "calendar": "service_I long, service_id string, m int, t int, w int, th int, f int, s int, su int, start_date date, end_date date",
    "calendar_dates": "service_I long, date date, exception_type int",
    "shapes": "shape_id string, lat double, lon double, seq int, d int",
    "frequencies": "trip_I long, start_time string, end_time string, headway_secs int, exact_times int, start_time_ds int, end_time_ds int",
    "transfers": "from_stop_I long, to_stop_I long, transfer_type int, min_transfer_time int",
    "stop_distances": "from_stop_I long, to_stop_I long, d int, d_walk int, min_transfer_time int, timed_transfer int",
    "feed_info": "feed_publisher_name string, feed_publisher_url string, feed_lang string, feed_start_date string, feed_end_date string, feed_version string, feed_id string",
}
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")

WALK, TRAM, SUBWAY, RAIL, BUS, FERRY, CABLE_CAR, GONDOLA, FUNICULAR, AIRCRAFT = -1, 0, 1, 2, 3, 4, 5, 6, 7, 99
TRANSIT_TYPES = (TRAM, SUBWAY, RAIL, BUS, FERRY, CABLE_CAR, GONDOLA, FUNICULAR)
ALL_TYPES = (WALK, *TRANSIT_TYPES)

#: Extended route types and the basic type each counts as; basic types stand for themselves.
EXTENDED_ROUTE_TYPES = {
    RAIL: (100, 101, 102, 103, 105, 106, 107, 108, 109), BUS: (200, 201, 202, 204, 208, 700, 701, 702, 704, 715, 717, 800, 1501, 1700, 1702),
    SUBWAY: (400, 401, 402, 405), TRAM: (900,), FERRY: (1000,), GONDOLA: (1300,), FUNICULAR: (1400,), CABLE_CAR: (1701,), AIRCRAFT: (1100, 1104),
}
BASIC_ROUTE_TYPE = {t: t for t in (*ALL_TYPES, AIRCRAFT)} | {code: basic for basic, codes in EXTENDED_ROUTE_TYPES.items() for code in codes}

#: By route type: tag, passengers of a vehicle, highest plausible km/h, drawing order, colour.
TAGS = {WALK: "walk", TRAM: "tram", SUBWAY: "subway", RAIL: "rail", BUS: "bus", FERRY: "ferry", CABLE_CAR: "cablecar", GONDOLA: "gondola", FUNICULAR: "funicular"}
CAPACITY = {TRAM: 200, SUBWAY: 600, RAIL: 600, BUS: 80, FERRY: 200, CABLE_CAR: 40, GONDOLA: 20, FUNICULAR: 20}
MAX_SPEED = {TRAM: 100, SUBWAY: 150, RAIL: 300, BUS: 100, FERRY: 80, CABLE_CAR: 50, GONDOLA: 50, FUNICULAR: 50, AIRCRAFT: 1000}
ZORDER = {WALK: 2, BUS: 3, RAIL: 4, SUBWAY: 5, TRAM: 6, FERRY: 7, CABLE_CAR: 8, GONDOLA: 9, FUNICULAR: 10, AIRCRAFT: 11}
COLORS = {WALK: "black", TRAM: "#33a02c", SUBWAY: "#ff7f00", RAIL: "#e31a1c", BUS: "#1f78b4", FERRY: "#ffff99", CABLE_CAR: "#6a3d9a", GONDOLA: "#b15928", FUNICULAR: "#fb9a99", AIRCRAFT: "#fb9a99"}

#: Columns that must not be null, and those that should not.
MUST_HAVE = {
    "agencies": ("agency_I", "agency_id", "timezone"), "stops": ("stop_I", "stop_id", "lat", "lon"), "routes": ("route_I", "route_id", "type"), "trips": ("trip_I", "trip_id", "service_I", "route_I"),
    "stop_times": ("trip_I", "stop_I", "arr_time_ds", "dep_time_ds"), "calendar": ("service_id", "service_I", "m", "t", "w", "th", "f", "s", "su", "start_date", "end_date"),
    "calendar_dates": ("service_I", "date", "exception_type"), "days": ("date", "day_start_ut", "trip_I"), "shapes": ("shape_id", "lat", "lon", "seq"), "stop_distances": ("from_stop_I", "to_stop_I", "d"),
}
SHOULD_HAVE = {"agencies": ("name", "url"), "stops": ("name",), "routes": ("name", "long_name"), "stop_distances": ("d_walk",)}

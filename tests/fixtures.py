"""Small tables with labelled defects.

Each table starts from clean rows made by rule; ``DEFECTS`` changes single cells, and the
expected counts follow from those changes.
"""

from __future__ import annotations

import datetime as dt

# Readings of river gauges.  32 clean rows, then three more with defects of their own.
STATIONS = ["north", "south", "weir"]
READING_SCHEMA = (
    "reading_id int, gauge string, level int, contact string, station string, flow double, "
    "grade string, taken_at timestamp_ntz, gauge_no int, quality int, unit string"
)
CONTACT = r"^[a-z]+[0-9]*@[a-z]+\.example$"
NOON = dt.datetime(2031, 5, 4, 12, 0)


def _reading(i: int) -> dict:
    return {
        "reading_id": i, "gauge": f"gauge {i}", "level": 100 + 7 * (i % 9), "contact": f"keeper{i}@river.example",
        "station": STATIONS[i % 3], "flow": 40.0 + i % 4, "grade": "fine" if i % 3 else "coarse",
        "taken_at": NOON - dt.timedelta(minutes=i), "gauge_no": 500 + i, "quality": 60 + i, "unit": "cm",
    }


#: (row, column, value, what is wrong)
READING_DEFECTS = [
    (31, "reading_id", 4, "key of another row"),
    (6, "gauge", None, "missing"),
    (9, "gauge", "", "empty"),
    (12, "contact", "keeper13@river.example", "contact of another row"),
    (17, "contact", "keeper17 at river", "no address"),
    (3, "level", 99, "below the range"),
    (20, "level", 171, "above the range"),
    (25, "level", None, "missing"),
    (8, "station", "bridge", "unknown station"),
    (28, "gauge_no", 7, "no such gauge"),
    (29, "gauge_no", None, "missing"),
    (14, "quality", -1, "negative"),
    (22, "unit", "inch", "other unit"),
]


def reading_rows() -> list[dict]:
    rows = [_reading(i) for i in range(32)]
    for at, column, value, _ in READING_DEFECTS:
        rows[at][column] = value
    return rows


def readings(spark):
    return spark.createDataFrame([tuple(r.values()) for r in reading_rows()], READING_SCHEMA)


def gauges(spark):
    return spark.range(500, 532).selectExpr("CAST(id AS INT) AS id")


READING_RULES = [
    ("DupEval", {"columns": ["reading_id"]}, "Failed", 2),
    ("EmptyEval", {"columns": ["gauge", "level"]}, "Failed", 3),
    ("UniqueEval", {"columns": ["reading_id"]}, "Failed", 2),
    ("UniqueEval", {"columns": ["contact"]}, "Failed", 2),
    ("DtypeEval", {"columns": {"reading_id": "int", "gauge": "str"}}, "Success", 0),
    ("StringFormatEval", {"column": "contact", "pattern": CONTACT}, "Failed", 1),
    ("SchemaValidationEval", {"expected_schema": {"reading_id": "int", "gauge": "object"}}, "Success", 0),
    ("RangeEval", {"column": "level", "min": 100, "max": 170}, "Failed", 3),
    ("CategoricalValuesEval", {"column": "station", "allowed_values": STATIONS}, "Failed", 1),
    ("StatisticalDistributionEval", {"column": "flow", "mode": "feature_drift",
                                     "reference_stats": {"mean": 30, "std": 1}, "tolerance": 0.1}, "Failed", 0),
    ("StatisticalDistributionEval", {"column": "grade", "mode": "label_balance"}, "Success", 0),
    ("DataFreshnessEval", {"column": "taken_at", "freshness_threshold": "-2h", "as_of": "2031-05-04 09:59:00"}, "Success", 0),
    ("DataFreshnessEval", {"column": "taken_at", "freshness_threshold": "-2h", "as_of": "2031-05-04 10:00:00"}, "Failed", 0),
    ("RowCountEval", {"min": 32, "max": 32}, "Success", 0),
    ("CustomEval", {"column": "quality", "func": "lambda x: x >= 0"}, "Failed", 1),
    ("CustomEval", {"func": "lambda row: row['quality'] > 0 and row['unit'] == 'cm'"}, "Failed", 2),
    ("ReferentialIntegrityEval", {"column": "gauge_no", "reference_df": "gauges", "reference_column": "id"}, "Failed", 2),
]

# Ferry trips: trip, seats sold, fare, state.
STATES = ["planned", "sailed", "moored"]
TRIPS = [(i, 1 + i % 40, 3.5 * (1 + i % 11), STATES[i % 3]) for i in range(60)] + [
    (59, 5, 10.0, "sailed"),  # trip of another row
    (60, 0, 10.0, "sailed"), (61, 41, 10.0, "sailed"),  # seats out of range
    (62, 5, -0.5, "sailed"),  # fare out of range
    (63, 5, 10.0, "sunk"), (64, 5, 10.0, None),  # unknown states
]
TRIP_RULES = [
    ("DupEval", {"columns": ["trip"]}, 2),
    ("RangeEval", {"column": "seats", "min": 1, "max": 40}, 2),
    ("RangeEval", {"column": "fare", "min": 0, "max": 40}, 1),
    ("CategoricalValuesEval", {"column": "state", "allowed_values": STATES}, 2),
]


def trips(spark):
    return spark.createDataFrame(TRIPS, "trip int, seats int, fare double, state string")


#: Four before, three inside with both bounds, two after, one missing.
TIDES = [dt.datetime(2030, 1, 1) + dt.timedelta(hours=6 * k) for k in (-300, -9, -4, -1, 0, 30, 40, 41, 900)] + [None]


def tides(spark):
    return spark.createDataFrame(list(enumerate(TIDES)), "tide int, high timestamp_ntz")


def misread(text: str) -> str:
    """UTF-8 read as Latin-1."""
    return text.encode().decode("latin-1")


# Note and author: the first four notes are damaged, one author is.
NOTES = [
    (misread("trübe"), "Åse"), (misread("après la pluie"), "Bo"), ("level \ufffd cm", "Cy"), (misread("水位"), "Di"),
    ("trübe", misread("Émil")), ("après la pluie", "Fay"), ("水位が高い", "Gil"), ("plain", None), (None, "Hal"),
]


def notes(spark):
    return spark.createDataFrame(NOTES, "note string, author string")


# Names of boats in two ledgers.  The second is half-width, the third holds U+FFFD, the
# fourth was misread, the fifth is another boat.
LEDGER = [
    (1, "海猫", "帆"), (2, "ﾊﾔﾌﾞｻ", "櫂"), (3, "白\ufffd波", "錨"), (4, misread("朝日"), misread("舵")), (5, "夕凪", "綱"),
    (6, "千鳥", "灯"),
]
REGISTER = [(1, "海猫", "帆"), (2, "カモメ", "櫂"), (3, "白波", "錨"), (4, "朝日", "舵"), (5, "夕立", "綱"), (6, "千鳥", "灯")]
# Half-width forms of the same name (2), and U+FFFD (4).
HALF_WIDTH = [(1, "海猫"), (2, "ﾊﾔﾌﾞｻ"), (3, "白波"), (4, "朝\ufffd")]
FULL_WIDTH = [(1, "海猫"), (2, "ハヤブサ"), (3, "白波"), (4, "朝日")]

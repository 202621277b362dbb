"""P11 against the standard parser."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from wayloom.functions.times import parse_iso

TEXTS = """2024-01-01|20240101|2024-01-01T10|2024-W01-1|2024W011|2024-W01|2020-W53-7|2021-W53-1|2024-01-01T10:00:00,5
2024-01-01T10:00:00+0100|2024-01-01T10:00:00.1234567|2024-01-01 10:00|20240101T101112|20240101T101112.5Z|2024-01-01T10:00:00-05:30
2024-01-01T10+01|2024|2024-01|2024-13-01|2024-02-30|x||2024-01-01T25:00|2024-01-01T10:61|2024-01-01T|2024-01-01x10:00|0000-01-01
2024-01-01T10:00:00.|0001-01-01|2024-01-01T10:00Z|2024-01-01T10:00:00+24:00|2024-01-01T10:00:00+23:59|2024-W54-1|2024-W01-8|2024-W01-0
2024-1-1| 2024-01-01|2024-01-01T10:00:00+01:02:03|2024-01-01T1000|2024-01-01T10:0011|9999-12-31T23:59:59.999999|2000-02-29""".replace("\n", "|").split("|")


def standard(text):
    try:
        found = datetime.fromisoformat(text)
    except ValueError:
        return None
    return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found


def test_parse_iso(spark):
    frame = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    rows = frame.select("t", parse_iso(F.col("t")).cast("timestamp_ntz").alias("p")).collect()
    assert {r.t: r.p for r in rows} == {t: standard(t) for t in TEXTS} | {None: None}

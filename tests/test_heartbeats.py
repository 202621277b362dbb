"""Heartbeats by the elapsed time, against a clock in plain Python."""

import random
from datetime import datetime, timedelta

import pytest

from tests import build
from wayloom.operators.heartbeats import heartbeats

START = datetime(2024, 3, 1, 23, 50)


def beats(times, every):
    found, last = [], None
    for at, event in sorted(times):
        if last is None:
            last = at
        elif (at - last) > timedelta(seconds=every):
            found.append((at, event))
            last = at
    return [(number, *beat) for number, beat in enumerate(found, 1)]


def frame(spark, times):
    return build.events(spark, [(event, at, "/s", False, 1, 0, "guide", False) for at, event in times])


@pytest.mark.parametrize("every", [0, 60, 1_000])
def test_random_times(spark, every):
    rng = random.Random(every)
    times = [(START + timedelta(seconds=rng.choice([0, 30, 60]) * rng.randint(0, 300), microseconds=rng.choice([0, 1])), i) for i in range(400)]
    firsts = {}
    for at, event in times:
        firsts[at] = min(event, firsts.get(at, event))
    found = heartbeats(frame(spark, times), every_micros=every * 1_000_000).select("beat", "event_time", "event_id")
    assert sorted(map(tuple, found.collect())) == beats([(at, event) for at, event in firsts.items()], every)


def test_exactly_a_minute_is_not_over_it(spark):
    seconds = [0, 60, 61, 121, 122, 3_723]
    found = heartbeats(frame(spark, [(START + timedelta(seconds=s), s) for s in seconds]))
    assert [(r.beat, r.event_id, r.elapsed) for r in sorted(found.collect())] == [(1, 61, "0:01:01"), (2, 122, "0:02:02"), (3, 3_723, "1:02:03")]


def test_few_events(spark):
    assert heartbeats(frame(spark, [])).count() == 0
    assert heartbeats(frame(spark, [(START, 1), (None, 2)])).count() == 0
    with pytest.raises(ValueError):
        heartbeats(frame(spark, []), every_micros=-1)

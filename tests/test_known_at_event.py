"""Attributes as known at event time, against brute force and in the edge cases."""

import random
from datetime import date, datetime, timedelta


from tradeloom.functions.ids import slug
from tradeloom.operators.asof_state import current_states, versions_in_force, with_attributes

EVENTS = "event long, who string, on date, day string, bucket string"
VERSIONS = "version long, who string, valid_from date, valid_to date, recorded_at timestamp_ntz, party string, entity string"
ARGS = {"event_entity": "who", "event_date": "on", "version_id": "version", "version_entity": "who", "entity_key": slug}


def brute(events, versions):
    key = lambda s: "".join(c for c in (s or "").lower() if c.isalnum()) or None
    out = {}
    for e, who, on, *_ in events:
        if key(who) is None or on is None:
            continue
        ok = [(f, r, v) for v, w, f, t, r, *_ in versions if key(w) == key(who) and f and r and f <= on and (t is None or on < t) and r <= datetime.combine(on, datetime.min.time())]
        out[e] = max(ok)[2] if ok else None
    return out


def run(spark, events, versions, **more):
    found = versions_in_force(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), "event", **ARGS, **more)
    return {r["event"]: r["version"] for r in found.collect()}


def test_against_brute_force_with_a_hot_entity(spark):
    rng = random.Random(5)
    day = lambda: date(2000, 1, 1) + timedelta(days=rng.randrange(6000))
    who = lambda: rng.choice(["a_b", "A B", "a-b ", "c", None, ""])
    versions = []
    for v in range(300):
        f = day()
        t = rng.choice([None, f + timedelta(days=rng.randrange(-5, 900))])
        versions.append((v, who(), rng.choice([f, f, f, None]), t, rng.choice([None] + 4 * [datetime.combine(f, datetime.min.time()) + timedelta(hours=rng.randrange(-500, 5000, 12))]), "x", "y"))
    events = [(e, who(), rng.choice([None] + 9 * [day()]), "d", "b") for e in range(600)]
    assert run(spark, events, versions, share=0.3) == brute(events, versions)
    assert run(spark, events, versions, share=2.0) == brute(events, versions)


def test_later_knowledge_never_counts(spark):
    versions = [(1, "a", date(2020, 1, 1), None, datetime(2020, 1, 1), "x", None), (2, "a", date(2020, 1, 1), None, datetime(2020, 6, 1, 0, 0, 1), "y", None)]
    events = [(1, "a", date(2020, 6, 1), None, None), (2, "a", date(2020, 6, 2), None, None)]
    assert run(spark, events, versions) == {1: 1, 2: 2}


def test_ties_repeats_and_far_days(spark):
    d, r = date(2020, 1, 1), datetime(2020, 1, 1)
    versions = [(1, "a", d, None, r, "x", None), (2, "A ", d, None, r, "y", None), (2, "a", d, None, r, "y", None)]
    events = [(1, "a", date(9999, 12, 31), None, None), (2, "a", date(1, 1, 1), None, None), (3, "a", d, None, None), (3, "a", d, None, None)]
    got = versions_in_force(spark.createDataFrame(events, EVENTS), spark.createDataFrame(versions, VERSIONS), "event", **ARGS).collect()
    assert sorted((x["event"], x["version"]) for x in got if x["event"] != 2) == [(1, 2), (3, 2), (3, 2)]
    assert [x["version"] for x in got if x["event"] == 2] == [None]


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a", date(2020, 1, 1), None, datetime(2020, 1, 1), "x", None)]) == {}
    assert run(spark, [(1, "a", date(2020, 1, 1), None, None)], []) == {1: None}


def test_every_event_stays(spark):
    events = spark.createDataFrame([(1, "a", date(2020, 2, 1), "d", "b"), (2, None, None, "d", "b")], EVENTS)
    versions = spark.createDataFrame([(7, "a", date(2020, 1, 1), None, datetime(2020, 1, 1), "x", "y")], VERSIONS)
    got = with_attributes(events, versions, "event", "version", ["party"], event_entity="who", event_date="on", version_entity="who").orderBy("event").collect()
    assert [(r["event"], r["bucket"], r["asof_version"], r["asof_party"]) for r in got] == [(1, "b", 7, "x"), (2, "b", None, None)]


def test_states_of_overlapping_periods():
    rows = [(0, 10, 0, 0, 1), (3, 6, 3, 0, 2), (5, 2**31 - 1, 1, 0, 3)]
    assert list(current_states(rows)) == [(0, 1), (3, 2), (6, 3)]

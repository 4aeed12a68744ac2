"""Running states of hosts, put together from days, against one pass by hand over each host's runs."""

import datetime as dt
import random
from collections import Counter

from pricetide.functions.scalars import PERMANENT
from pricetide.operators import ops

SCHEMA = "id long, host string, product_id long, status string, reason_code string, challenge_type string, duration_ms long, started_at timestamp_ntz"
REASONS = {"found": ["found"], "not_found": ["not_found"], "blocked": ["captcha", "rate_limited"], "unavailable": ["timeout", "http_server_error"], "needs_review": ["low_confidence", "price_missing"], "error": ["timeout", None]}


def made(n=900):
    rng = random.Random(3)
    out = []
    for k in range(n):
        status = rng.choices(list(REASONS), [1, 1, 4, 4, 3, 1])[0]
        at = None if rng.random() < 0.01 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 12), minutes=30 * rng.randrange(2))
        out.append((k, rng.choice(["hot"] * 4 + ["a.example", None]), k % 7, status, rng.choice(REASONS[status]), rng.choice([None, None, "captcha", "js"]), rng.choice([None, 5, 70]), at))
    return out


def ordered(rows):
    hosts = {}
    for r in sorted(rows, key=lambda r: (r[7] is not None, r[7] or dt.datetime.min, r[0])):
        hosts.setdefault(r[1], []).append(r)
    return hosts


def test_streaks_and_counters(spark):
    rows = made()
    runs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    streaks, states = {}, {}
    for runs_of in ordered(rows).values():
        streak, total, found, blocked, spent, challenge, at = 0, 0, 0, 0, 0, None, None
        for r in runs_of:
            streak = streak + 1 if r[3] in ops.FAILED else 0
            total, found, blocked, spent, challenge = total + 1, found + (r[3] == "found"), blocked + (r[3] == "blocked"), spent + (r[6] or 0), r[5] or challenge
            at = max(filter(None, (at, r[7] if r[3] == "found" else None)), default=None)
            streaks[r[0]], states[r[0]] = streak, (total, found, blocked, spent, challenge, at)
    assert {r["id"]: r["consecutive_failures"] for r in ops.failure_streaks(runs).collect()} == streaks
    assert {r["id"]: tuple(r)[2:] for r in ops.domain_state_history(runs).collect()} == states and max(streaks.values()) > 8


def test_cooldowns(spark):
    rows = made()
    got = {r["id"]: r["failures"] for r in ops.cooldowns(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for runs_of in ordered(rows).values():
        since = Counter()
        for r in runs_of:
            if r[3] == "found":
                since.clear()
            elif r[4] not in ("found", *PERMANENT):
                since[r[4]] += 1
                want[r[0]] = since[r[4]]
    assert got == want and max(want.values()) > 5


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ops.failure_streaks(none).count() == ops.domain_state_history(none).count() == ops.cooldowns(none).count() == 0

"""Composite triggers, schedules, backoff, leases and deliveries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .feed import run_id

MAX_STEPS = 10_000


def members(gate) -> set[str]:
    """Aliases that a gate tree names; a gate is an alias or (op, part, ...), op and, or, not."""
    if isinstance(gate, str):
        return {gate}
    return set().union(*[members(g) for g in gate[1:]])


def gate_column(gate, fired: Column) -> Column:
    if isinstance(gate, str):
        return F.array_contains(fired, gate)
    parts = [gate_column(g, fired) for g in gate[1:]]
    if gate[0] == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if gate[0] == "and" else out | p
    return out


def holds(gate, fired: set[str]) -> bool:
    """gate_column for a set of aliases."""
    if isinstance(gate, str):
        return gate in fired
    got = [holds(g, fired) for g in gate[1:]]
    return not got[0] if gate[0] == "not" else all(got) if gate[0] == "and" else any(got)


class Partial:
    """A key's members since its window began; an event beyond the window begins the next one."""

    def __init__(self, gate, window_ms: int, started: int | None = None, fired: str = "", done: bool = False):
        self.gate, self.window_ms = gate, window_ms
        self.started, self.seen, self.done = started, set(filter(None, fired.split(","))), done

    def add(self, alias: str, ts: int) -> bool:
        """Whether the gate holds with this event for the first time in its window."""
        if self.started is None or ts - self.started > self.window_ms:
            self.started, self.seen, self.done = ts, set(), False
        self.seen.add(alias)
        if self.done or not holds(self.gate, self.seen):
            return False
        self.done = True
        return True

    @property
    def fired(self) -> str:
        return ",".join(sorted(self.seen))


def _known(gate, known: set[str]) -> None:
    unknown = members(gate) - known
    if unknown:
        raise ValueError(f"the gate names {sorted(unknown)[0]}, which is no member")


def composite(events: DataFrame, gate, window_ms: int, known: set[str]) -> DataFrame:
    """From (key, alias, ts): (key, started, fired, last_ts) of every window in which the gate came to hold.

    Windows are folded in the order of (ts, alias): one shuffle and sort by key,
    then one small state at a time whatever a key's number of events.  A null
    key takes no part; an alias in the gate that is no member is an error.
    """
    _known(gate, known)
    e = events.filter(F.col("key").isNotNull() & F.col("alias").isin(list(known))).select("key", "alias", "ts")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for k, alias, ts in zip(batch["key"], batch["alias"], batch["ts"], strict=True):
                if state is None or k != key:
                    key, state = k, Partial(gate, window_ms)
                if state.add(alias, int(ts)):
                    out.append((k, state.started, sorted(state.seen), ts))
            yield pd.DataFrame(out, columns=["key", "started", "fired", "last_ts"])

    kind = dict(events.dtypes)["key"]
    return e.repartition("key").sortWithinPartitions("key", "ts", "alias").mapInPandas(fold, f"key {kind}, started long, fired array<string>, last_ts long")


def composite_stream(events: DataFrame, gate, window_ms: int, known: set[str]) -> DataFrame:
    """The same on a stream: one small state a key, dropped when its window has passed."""
    _known(gate, known)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, out = Partial(gate, window_ms, *(state.get if state.exists else ())), []
        for p in parts:
            for r in p.sort_values(["ts", "alias"]).itertuples():
                if at.add(r.alias, r.ts):
                    out.append((key[0], at.started, at.fired, r.ts))
        state.update((at.started, at.fired, at.done))
        state.setTimeoutTimestamp(max(at.started + window_ms, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["key", "started", "fired", "last_ts"])

    e = events.filter(F.col("key").isNotNull() & F.col("alias").isin(list(known)))
    e = e.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", f"{window_ms} milliseconds")
    return e.groupBy("key").applyInPandasWithState(step, "key string, started long, fired string, last_ts long", "started long, fired string, done boolean", "append", "EventTimeTimeout")


def occurrences(schedules: DataFrame, now_ms: int) -> DataFrame:
    """Missed occurrences of (trigger, last_run_ms, interval_ms, catchup): none, the last, or all of them (MAX_STEPS at most a run)."""
    missed = F.least(F.floor((F.lit(now_ms) - F.col("last_run_ms")) / F.col("interval_ms")), F.lit(MAX_STEPS)).cast("bigint")
    s = schedules.withColumn("missed", F.greatest(missed, F.lit(0)))
    first = F.when(F.col("catchup") == "all", F.lit(1).cast("bigint")).when(F.col("catchup") == "last", F.col("missed"))
    due = s.filter((F.col("missed") > 0) & first.isNotNull())
    steps = F.sequence(first, F.col("missed"))
    return due.select("trigger", F.explode(F.transform(steps, lambda i: F.col("last_run_ms") + i * F.col("interval_ms"))).alias("at_ms"))


def admitted(due: DataFrame, state: DataFrame, now_ms: int) -> DataFrame:
    """Due (trigger, concurrency, ...) with starts, and cancels: the holder of a running firing that gives way.

    A firing runs while its lease (trigger, holder, lease_until) lasts.  forbid,
    which also stands for none, skips the new firing then, allow starts it beside
    the other, and replace in its place.
    """
    held = state.filter(F.col("lease_until") > now_ms).select("trigger", F.col("holder").alias("_holder"))
    rows = due.join(held, "trigger", "left")
    policy, running = F.coalesce("concurrency", F.lit("forbid")), F.col("_holder").isNotNull()
    return rows.withColumns({"starts": ~running | policy.isin("allow", "replace"), "cancels": F.when(running & (policy == "replace"), F.col("_holder"))}).drop("_holder")


def claim(state: DataFrame, claims: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """The lease state (trigger, holder, lease_until, version) after claims (trigger, node, version).

    A claim holds if it names the state's present version and no other node's
    lease lasts; of several the first node by name has it.  Each success raises
    the version, so that whoever acts on an old one changes nothing.
    """
    c = claims.withColumnRenamed("version", "_seen").join(state, "trigger")
    free = F.col("lease_until").isNull() | (F.col("lease_until") <= now_ms) | F.col("holder").eqNullSafe(F.col("node"))
    won = c.filter((F.col("_seen") == F.col("version")) & free).groupBy("trigger").agg(F.min("node").alias("_node"))
    out, new = state.join(won, "trigger", "left"), F.col("_node").isNotNull()
    return out.withColumns({"holder": F.coalesce("_node", "holder"), "lease_until": F.when(new, F.lit(now_ms + ttl_ms)).otherwise(F.col("lease_until")), "version": F.col("version") + new.cast("int")}).drop("_node")


def delivered(triggers: DataFrame, deliveries: DataFrame, runs: DataFrame) -> DataFrame:
    """(delivery, trigger, run_id, outcome) of pushed deliveries (delivery, trigger, payload).

    triggers has (trigger, kind, enabled, paused, connector, pointers).  refused:
    no such trigger, none that takes deliveries (webhook, manual), or one that
    is off; unidentifiable: a pointer finds nothing, or there is none;
    duplicate: the run is known, or started by an earlier delivery here.
    """
    d = deliveries.join(triggers, "trigger", "left")
    parts = F.expr("transform(pointers, p -> get_json_object(payload, concat('$', replace(p, '/', '.'))))")
    whole = (F.size("pointers") > 0) & ~F.exists(parts, lambda x: x.isNull())
    takes = F.col("kind").isin("webhook", "manual") & F.col("enabled") & ~F.col("paused")
    d = d.withColumn("_takes", F.coalesce(takes, F.lit(False)))
    d = d.withColumn("run_id", F.when(F.col("_takes") & whole, run_id(F.col("trigger"), F.col("connector"), F.array_join(parts, "\u001f"))))
    d = d.join(runs.select("run_id", F.lit(True).alias("_known")).distinct(), "run_id", "left")
    first = d.filter("run_id is not null").groupBy("run_id").agg(F.min("delivery").alias("_first"))
    d = d.join(first, "run_id", "left")
    outcome = F.when(~F.col("_takes"), "refused").when(F.col("run_id").isNull(), "unidentifiable").when(F.col("_known") | (F.col("_first") != F.col("delivery")), "duplicate").otherwise("started")
    return d.select("delivery", "trigger", "run_id", outcome.alias("outcome"))


SPANS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
# Names of months and of days of the week in cron expressions.
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DAYS = "SUN MON TUE WED THU FRI SAT".split()


def cron_fields(cron: str) -> list[set[int]]:
    """Values of minute, hour, day of month, month and day of week (7 is Sunday) that a five-field expression names."""
    parts = cron.upper().split()
    if len(parts) != 5:
        raise ValueError(f"{cron} is no cron expression of five fields")
    for i, names, base in ((3, MONTHS, 1), (4, DAYS, 0)):
        for k, name in enumerate(names):
            parts[i] = parts[i].replace(name, str(k + base))
    fields = [_cron_values(text, *span) for text, span in zip(parts, SPANS, strict=True)]
    fields[4] = {x % 7 for x in fields[4]}
    return fields


def _either_day(cron: str) -> bool:
    """Where both day fields are restricted, one of them is enough."""
    return not any(x.startswith("*") for x in (cron.split()[2], cron.split()[4]))


def cron_matches(cron: str, at: Column) -> Column:
    """Whether a UTC timestamp column meets a five-field cron expression (*, lists, ranges, steps, names)."""
    parts = [F.minute(at), F.hour(at), F.dayofmonth(at), F.month(at), F.dayofweek(at) - 1]
    minute, hour, day, month, weekday = [c.isin(sorted(f)) for c, f in zip(parts, cron_fields(cron), strict=True)]
    return minute & hour & month & ((day | weekday) if _either_day(cron) else (day & weekday))


def _cron_values(text: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for item in text.split(","):
        item, _, every = item.partition("/")
        a, b = (low, high) if item in "*?" else (int(item.split("-")[0]), int(item.split("-")[-1]))
        if not low <= a <= b <= high:
            raise ValueError(f"{text} is not within {low} to {high}")
        out |= set(range(a, (high if every and "-" not in item and item != "*" else b) + 1, int(every or 1)))
    return out


def backoff_ms(failures: Column, interval_ms: Column) -> Column:
    """30 s doubled for each further failure, an hour at most, never under the interval."""
    wait = F.least(F.lit(30_000) * F.pow(F.lit(2), F.greatest(failures - 1, F.lit(0))), F.lit(3_600_000))
    return F.when(failures > 0, F.greatest(wait.cast("bigint"), interval_ms)).otherwise(interval_ms)


def next_due(cron: str | None, interval_ms: int | None, last_run_ms: int, now_ms: int, once_ms: int | None = None) -> int | None:
    """When a trigger fires next: an interval counts from its last run, cron from the clock (UTC), once only if still ahead.

    Cron goes day by day, so a rare date costs its days, not its minutes; None
    if no day in eight years (two leap years, across a century's end) meets it.
    """
    from datetime import datetime, timedelta, timezone

    if once_ms is not None:
        return once_ms if once_ms > now_ms else None
    if cron is None:
        return max(last_run_ms + interval_ms, now_ms)
    minutes, hours, days, months, weekdays = cron_fields(cron)
    first = datetime.fromtimestamp(now_ms // 60_000 * 60, timezone.utc) + timedelta(minutes=1)
    either = _either_day(cron)
    for n in range(366 * 8 + 1):
        day = (first + timedelta(days=n)).replace(hour=0, minute=0)
        by_day = (day.day in days, day.isoweekday() % 7 in weekdays)
        if day.month not in months or not (any(by_day) if either else all(by_day)):
            continue
        for h in sorted(hours):
            for m in sorted(minutes):
                at = day.replace(hour=h, minute=m)
                if at >= first:
                    return int(at.timestamp() * 1000)
    return None

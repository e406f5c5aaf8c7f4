"""Column builders for schedules, run windows, exit codes and state transitions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from runweave.functions.statuses import STATUS_CODES

# The allowed moves of the job state machine.
TRANSITIONS = {
    "INACTIVE": ("ACTIVATED", "STARTING", "ON_HOLD", "ON_ICE", "ON_NOEXEC"),
    "ACTIVATED": ("RUNNING", "STARTING", "INACTIVE", "ON_HOLD", "FAILURE", "ON_NOEXEC"),
    "STARTING": ("RUNNING", "FAILURE", "INACTIVE"),
    "RUNNING": ("SUCCESS", "FAILURE", "TERMINATED"),
    "SUCCESS": ("INACTIVE", "ACTIVATED", "STARTING", "ON_NOEXEC"),
    "FAILURE": ("INACTIVE", "RESTART", "ACTIVATED", "STARTING", "ON_NOEXEC"),
    "TERMINATED": ("INACTIVE", "STARTING", "ON_NOEXEC"),
    "RESTART": ("STARTING", "INACTIVE", "FAILURE"),
    "ON_HOLD": ("INACTIVE", "ACTIVATED", "ON_NOEXEC"),
    "ON_ICE": ("INACTIVE",),
    "WAIT_REPLY": ("RUNNING", "FAILURE", "INACTIVE", "STARTING"),
    "QUE_WAIT": ("STARTING", "INACTIVE"),
    "PEND_MACH": ("STARTING", "INACTIVE"),
    "RESWAIT": ("STARTING", "INACTIVE"),
    "REFRESH_DEPENDENCIES": ("INACTIVE", "STARTING", "ACTIVATED"),
    "ON_NOEXEC": ("INACTIVE", "SUCCESS"),
    "SUSPENDED": ("INACTIVE", "STARTING", "RUNNING"),
}
# Days of the week, Monday first.
DAYS = ("mo", "tu", "we", "th", "fr", "sa", "su")


def minutes_of(text: Column) -> Column:
    """Minutes since midnight of H:MM; NULL for anything else."""
    ok = text.rlike(r"^\s*([01]?\d|2[0-3]):[0-5]\d\s*$")
    return F.when(ok, F.trim(F.split_part(text, F.lit(":"), F.lit(1))).cast("int") * 60 + F.trim(F.split_part(text, F.lit(":"), F.lit(2))).cast("int"))


def in_run_window(window: Column, at: Column) -> Column:
    """Whether a time lies in H:MM-H:MM, bounds included, over midnight if the end comes first.

    A blank or NULL window holds always, a malformed one never.
    """
    text = F.regexp_replace(window, "\"", "")
    a, b = minutes_of(F.split_part(text, F.lit("-"), F.lit(1))), minutes_of(F.split_part(text, F.lit("-"), F.lit(2)))
    now = F.hour(at) * 60 + F.minute(at)
    inside = F.when(a <= b, now.between(a, b)).otherwise((now >= a) | (now <= b))
    return F.when(window.isNull() | (F.trim(window) == ""), F.lit(True)).otherwise(F.coalesce(F.when(a.isNotNull() & b.isNotNull(), inside), F.lit(False)))


def on_day(days: Column, at: Column) -> Column:
    """Whether a list of days (mo to su, or all) has the day of a time; no list has every day."""
    today = F.element_at(F.array(*[F.lit(x) for x in DAYS]), F.weekday(at) + 1)
    named = F.transform(days, lambda x: F.substring(F.lower(F.trim(x)), 1, 3))
    hit = F.array_contains(named, "all") | F.exists(named, lambda x: F.substring(x, 1, 2) == today)
    return F.coalesce(F.when(F.size(days) > 0, hit), F.lit(True))


def starts_at(times: Column, at: Column) -> Column:
    """Whether a list of H:MM has the minute of a time; quotes and missing zeros don't matter."""
    clean = F.transform(times, lambda x: F.lpad(F.trim(F.regexp_replace(x, "\"", "")), 5, "0"))
    return F.coalesce(F.array_contains(clean, F.date_format(at, "HH:mm")), F.lit(False))


def starts_at_minute(minutes: Column, at: Column) -> Column:
    """Whether a list of minutes of the hour has that of a time; what is no number is ignored."""
    return F.coalesce(F.exists(minutes, lambda x: F.trim(x).try_cast("int") == F.minute(at)), F.lit(False))


def preceding_start(times: Column, at: Column) -> Column:
    """Minutes since midnight of the last start of a list that isn't after a time; NULL if none is."""
    now = F.hour(at) * 60 + F.minute(at)
    return F.array_max(F.filter(F.transform(times, lambda x: minutes_of(F.regexp_replace(x, "\"", ""))), lambda m: m <= now))


def box_pattern(name: Column, pattern: str) -> Column:
    """Whole names by a pattern in which % is any text and nothing else is special, without case."""
    rx = ".*".join(re.escape(p) for p in pattern.lower().split("%"))
    return F.lower(name).rlike(f"^(?s:{rx})$")


def can_move(old: Column, new: Column) -> Column:
    """Whether the state machine allows a move between two status numbers."""
    moves = [STATUS_CODES[a] * 1000 + STATUS_CODES[b] for a, bs in TRANSITIONS.items() for b in bs]
    return (old * 1000 + new).isin(*moves)


def status_of_exit(code: Column, most: Column) -> Column:
    """SUCCESS up to the greatest exit code that counts as success (0 without one), else FAILURE."""
    return F.when(code <= F.coalesce(most, F.lit(0)), STATUS_CODES["SUCCESS"]).otherwise(STATUS_CODES["FAILURE"])


def must_times(text: Column) -> Column:
    """Array of (minute, after): times of the day, or minutes after a start, of a list of H:MM or +N; anything else is left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(F.regexp_replace(x, "\"", "")))
    both = F.transform(parts, lambda x: F.struct(minutes_of(x).alias("minute"), F.when(x.startswith("+"), F.substring(x, 2, 9).try_cast("int")).alias("after")))
    return F.filter(both, lambda x: x["minute"].isNotNull() | x["after"].isNotNull())


def deadline_passed(text: Column, starts: Column, at: Column) -> Column:
    """Whether some time of a must-times list has passed: of the day, or so many minutes after the preceding start."""
    now = F.hour(at) * 60 + F.minute(at)
    due = preceding_start(starts, at)
    return F.exists(must_times(text), lambda x: F.coalesce(now >= x["minute"], F.lit(False)) | F.coalesce(now >= due + x["after"], F.lit(False)))

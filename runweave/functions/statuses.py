"""Job status vocabulary and Column builders over it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the estate's status vocabulary: name, number.
STATUS_CODES = {
    "RUNNING": 1, "STARTING": 3, "SUCCESS": 4, "FAILURE": 5, "TERMINATED": 6, "ON_ICE": 7,
    "INACTIVE": 8, "ACTIVATED": 9, "RESTART": 10, "ON_HOLD": 11, "QUE_WAIT": 12, "WAIT_REPLY": 13,
    "PEND_MACH": 14, "RESWAIT": 15, "ON_NOEXEC": 16, "SUSPENDED": 17, "REFRESH_DEPENDENCIES": 99,
}
# Two-letter codes of the statuses that have one.
STATUS_ABBREVIATIONS = {
    "INACTIVE": "IN", "ACTIVATED": "AC", "STARTING": "ST", "RUNNING": "RU", "SUCCESS": "SU", "FAILURE": "FA",
    "TERMINATED": "TE", "RESTART": "RE", "WAIT_REPLY": "WR", "ON_HOLD": "OH", "ON_ICE": "OI", "QUE_WAIT": "QW",
    "PEND_MACH": "PM", "RESWAIT": "RW", "ON_NOEXEC": "NE", "SUSPENDED": "SS",
}
# Statuses that end a run and count as evidence.
COUNTED = ("SUCCESS", "FAILURE", "TERMINATED", "ON_ICE", "ON_NOEXEC")
# The state machine's end states, and those a start may leave.
TERMINAL = ("SUCCESS", "FAILURE", "TERMINATED")
STARTABLE = ("SUCCESS", "FAILURE", "TERMINATED", "INACTIVE")


def literal_map(d: dict) -> Column:
    """A constant map column of a small fixed dictionary."""
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _tokens() -> dict[str, int]:
    names = dict(STATUS_CODES)
    short = {a: STATUS_CODES[n] for n, a in STATUS_ABBREVIATIONS.items()}
    return names | short


def status_code(token: Column) -> Column:
    """INT code of a status name, two-letter code or number in any case; NULL when unknown.

    Blank and NULL tokens are unknown. Numbers may carry leading zeros.
    """
    t = F.upper(F.trim(token))
    as_int = F.when(t.rlike("^[+]?[0-9]{1,9}$"), F.regexp_replace(t, "^[+]", "").cast("int"))
    known = F.when(as_int.isin(*STATUS_CODES.values()), as_int)
    return F.coalesce(F.try_element_at(literal_map(_tokens()), t), known)


def status_name(code: Column) -> Column:
    """Status name of a code; NULL when unknown."""
    return F.try_element_at(literal_map({v: k for k, v in STATUS_CODES.items()}), code.cast("int"))


def status_abbrev(code: Column) -> Column:
    """Two-letter code of a status number; the number itself as text without one."""
    m = literal_map({STATUS_CODES[n]: a for n, a in STATUS_ABBREVIATIONS.items()})
    return F.coalesce(F.try_element_at(m, code.cast("int")), code.cast("string"))


def is_counted(code: Column) -> Column:
    return code.isin(*[STATUS_CODES[n] for n in COUNTED])

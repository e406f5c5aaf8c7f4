"""Column builders on commands, conditions and identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variables that stand for dates and times and are no business globals.
DATE_VARIABLES = ("DATE", "YEAR", "MM", "DD", "TIME", "HH", "MIN", "ODATE", "OYEAR", "OMM", "ODD", "OTIME", "TIMESTAMP", "UNIX_TIMESTAMP")
# Units of sizes in bytes.
UNITS = {"": 1024, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30}


def operator_count(condition: Column) -> Column:
    """Number of & and | characters."""
    return F.length(condition) - F.length(F.translate(condition, "&|", ""))


def has_look_back(condition: Column) -> Column:
    """Whether a test has a number of hours after a name of two characters or more."""
    return condition.rlike(r"(?U)\(\s*\w[\w_]+\s*,\s*\d+")


def variables(text: Column) -> Column:
    """Array of %%names%% in upper case, in order of appearance, once each; NULL of NULL."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("%%([A-Za-z0-9_]+)%%"), 1), F.upper))


def business_globals(command: Column) -> Column:
    """Array of %%NAMES%% that are no dates or times, repeats kept; empty of NULL."""
    found = F.regexp_extract_all(command, F.lit("%%([A-Z_][A-Z_0-9]*)%%"), 1)
    return F.coalesce(F.filter(found, lambda v: ~v.isin(*DATE_VARIABLES)), F.array().cast("array<string>"))


def substitute(text: Column, values: dict[str, str]) -> Column:
    """text with %%name%% replaced for every known name, without case; other names stay."""
    for name, value in values.items():
        text = F.regexp_replace(text, f"(?i)%%{name}%%", value.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def dialect(command: Column) -> Column:
    """Script language of a command: ksh before perl before python before bash."""
    has = lambda *xs: F.array_contains(F.array(*[command.contains(x) for x in xs]), True)
    return F.when(has(".ksh"), "ksh").when(has(".pl"), "perl").when(has(".py"), "python").when(has(".sh"), "bash").otherwise("none")


def run_key(kind: Column, *parts: Column) -> Column:
    """'imp:' and the first 40 hexadecimal digits of the SHA-256 of the parts, joined by the unit separator."""
    joined = F.concat_ws("\x1f", kind, *[p.cast("string") for p in parts])
    return F.concat(F.lit("imp:"), F.substring(F.sha2(joined, 256), 1, 40))


def size_in_bytes(text: Column) -> Column:
    """Bytes of a size such as 10MB; without a unit kilobytes; NULL for anything else."""
    rx = r"^\s*(\d+)\s*([KMG]?B?)\s*$"
    unit = F.upper(F.regexp_extract(F.upper(text), rx, 2))
    factor = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit)
    return F.when(F.upper(text).rlike(rx), F.regexp_extract(F.upper(text), rx, 1).try_cast("long") * factor)


def listed(text: Column) -> Column:
    """Parts of a comma list, trimmed, empty ones dropped; empty of NULL."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def truth(text: Column) -> Column:
    """Whether a text says yes: 1, y, yes, t or true in any case; NULL of NULL."""
    return F.lower(F.trim(text)).isin("1", "y", "yes", "t", "true")


def tolerant_int(text: Column) -> Column:
    """Integer part of a number in a text; NULL for anything else."""
    return text.try_cast("double").try_cast("int")


def clipped(text: Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something was cut off."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def pairs(text: Column) -> Column:
    """Map of k=v parts of a comma list, quotes taken off; of repeated names the last counts."""
    kv = F.transform(listed(text), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, "^[^=]*=?", "")), '^"|"$', "").alias("v")))
    last = F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, i + 2, F.size(kv)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


# Short names of job types; a blank one is CMD.
JOB_TYPES = {"C": "CMD", "B": "BOX", "F": "FILEWATCH", "FW": "FILEWATCH", "PS": "PEOPLESOFT"}
# The types that the estate's own kinds of jobs have.
BUILT_IN_TYPES = ("BOX", "CMD", "CONNECT", "FILEWATCH", "FTP", "PEOPLESOFT", "SAP", "SQL", "WEBSERVICE")


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) if isinstance(x, str) else x for kv in d.items() for x in kv])


def job_type(raw: Column) -> Column:
    """Type by its name or short name in any case; CMD without one."""
    t = F.upper(F.trim(raw))
    return F.when(t.isNull() | (t == ""), "CMD").otherwise(F.coalesce(F.try_element_at(_map(JOB_TYPES), t), t))


def like_built_in(raw: Column, least: float = 0.75) -> Column:
    """The built-in type that a name resembles most: share of characters that need no edit, at least so large; NULL of a built-in one."""
    t = F.upper(F.trim(raw))
    alike = [(1 - F.levenshtein(t, F.lit(n)) / F.greatest(F.length(t), F.lit(len(n))), n) for n in BUILT_IN_TYPES]
    best = F.array_max(F.array(*[F.struct(a.alias("a"), F.lit(n).alias("n")) for a, n in alike]))
    return F.when(~t.isin(*BUILT_IN_TYPES) & (best["a"] >= least), best["n"])


def builtins(run_date: Column, at: Column, autorun: bool = True) -> dict[str, Column]:
    """Variables of a run: its date (month, day, year), year, month, day, the time it is sent off, and whether by schedule."""
    return {
        "DATE": F.date_format(run_date, "MMddyyyy"), "YYYY": F.date_format(run_date, "yyyy"), "MM": F.date_format(run_date, "MM"), "DD": F.date_format(run_date, "dd"),
        "TIME": F.date_format(at, "HHmm"), "AUTORUN": F.lit("Y" if autorun else "N"),
    }


def expanded(text: Column, values: dict[str, Column], pattern: str = "%%([A-Za-z0-9_]+)%%", fold: bool = True) -> tuple[Column, Column]:
    """(text with every name that has a value replaced, array of the names that have none), in one pass: values aren't expanded again.

    A NULL value counts as none. Names compare without case if fold. A strict caller rejects rows whose second part isn't empty.
    """
    case = F.upper if fold else (lambda c: c)
    known = F.map_filter(_map({(k.upper() if fold else k): v for k, v in values.items()}), lambda _, v: v.isNotNull()) if values else F.create_map().cast("map<string,string>")
    names = F.regexp_extract_all(text, F.lit(pattern), 1)
    marks = F.regexp_extract_all(text, F.lit(pattern.replace("(", "(?:", 1)), 0)
    pieces = F.split(text, pattern.replace("(", "(?:", 1), -1)
    shown = F.transform(F.arrays_zip(names.alias("n"), marks.alias("m")), lambda x: F.coalesce(F.try_element_at(known, case(x["n"])), x["m"]))
    out = F.array_join(F.flatten(F.transform(pieces, lambda p, i: F.array(p, F.coalesce(F.get(shown, i), F.lit(""))))), "")
    return out, F.array_distinct(F.filter(names, lambda n: F.try_element_at(known, case(n)).isNull()))


GLOB, TEMPLATE = "%%GLOB:([A-Za-z0-9_]+)%%", r"\{([A-Z_]+)\}"


def limits(text: Column) -> Column:
    """Map of the parts code="soft,hard" of a limits text to "soft,hard"; a missing hard limit is the soft one; of repeated codes the last counts."""
    rx = r'([A-Za-z])\s*=\s*"([^"]*)"'
    codes, values = F.regexp_extract_all(text, F.lit(rx), 1), F.regexp_extract_all(text, F.lit(rx), 2)
    both = lambda v: F.concat_ws(",", F.trim(F.split_part(v, F.lit(","), F.lit(1))), F.coalesce(F.nullif(F.trim(F.split_part(v, F.lit(","), F.lit(2))), F.lit("")), F.trim(F.split_part(v, F.lit(","), F.lit(1)))))
    kv = F.filter(F.transform(F.arrays_zip(codes.alias("c"), values.alias("v")), lambda x: F.struct(F.lower(x["c"]).alias("c"), both(x["v"]).alias("v"))), lambda x: ~x["v"].startswith(","))
    return F.map_from_entries(F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, i + 2, F.size(kv)), lambda later: later["c"] == e["c"])))


def nul_escaped(text: Column) -> Column:
    r"""Texts with NUL characters with these as \0 and backslashes doubled; others as they are."""
    return F.when(text.contains("\0"), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\0"), F.lit("\\0"))).otherwise(text)


def nul_restored(text: Column) -> Column:
    """What nul_escaped made of a text with NUL characters, undone."""
    held = F.replace(text, F.lit("\\\\"), F.lit("﷐"))
    return F.replace(F.regexp_replace(F.replace(held, F.lit("\\0"), F.lit("\0")), r"\\(.)", "$1"), F.lit("﷐"), F.lit("\\"))


def failure_chance(retries: Column, most_exit: Column, fail_codes: Column) -> Column:
    """Chance of a simulated failure: by retries, and more where a job names codes of success or failure."""
    base = F.when(retries >= 3, 0.25).when(retries >= 1, 0.10).otherwise(0.03)
    return base + F.when(most_exit.isNotNull(), 0.05).otherwise(0.0) + F.when(F.coalesce(fail_codes, F.lit("")) != "", 0.05).otherwise(0.0)


def estimated_seconds(average: Column, most: Column) -> Column:
    """Length of a simulated run: its average minutes, else half of its longest, else one minute."""
    return F.when(average > 0, average * 60).when(most > 0, most * 30).otherwise(60)

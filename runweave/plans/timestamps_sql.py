"""What p4 says in SQL: every text of a time with its microseconds since 1970 in UTC."""

from __future__ import annotations

from runweave.operators.timestamps import ZONE_LETTERS

_CLOCK = "([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,12}))?)?"
_ZONE = "\\s*(Z|z|[+-][0-9]{2}:?[0-9]{2}|\\[?[A-Za-z][A-Za-z0-9_+-]*(?:/[A-Za-z0-9_+-]+)*\\]?)?"
# by shape: pattern, and its groups of year, month, day, hour, minute, second, fraction, half of the day, zone
_SHAPES = {
    "iso": ("([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[Tt]|\\s+)" + _CLOCK + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    "basic": ("([0-9]{4})([0-9]{2})([0-9]{2})[Tt]([0-9]{2})([0-9]{2})([0-9]{2})(?:[.,]([0-9]{1,12}))?" + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    "slash": ("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\\s+" + _CLOCK + "(?:\\s*([AaPp][Mm]))?" + _ZONE, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    "dot": ("([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})\\s+" + _CLOCK + _ZONE, (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    "named": ("(?:[A-Za-z]{3},\\s+)?([0-9]{1,2})[-\\s]([A-Za-z]{3})[-\\s]([0-9]{4})\\s+" + _CLOCK + _ZONE, (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    "compact": ("([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})", (1, 2, 3, 4, 5, 6, 0, 0, 0)),
    "epoch": ("[0-9]{10}|[0-9]{13}|[0-9]{16}", (0, 0, 0, 0, 0, 0, 0, 0, 0)),
}


def _parts(shape: str) -> str:
    rx, groups = _SHAPES[shape]
    return "[" + ", ".join(f"regexp_extract(s, '^(?:{rx})$', {g})" if g else "''" for g in groups) + "]"


_SHAPE = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{rx}') THEN '{shape}'" for shape, (rx, _) in _SHAPES.items()) + " END"
_PICK = "CASE shape " + " ".join(f"WHEN '{shape}' THEN {_parts(shape)}" for shape in _SHAPES) + " END"
_LETTERS = "CASE upper(z) WHEN 'Z' THEN 0 " + " ".join(f"WHEN '{k}' THEN {v * 60}" for k, v in ZONE_LETTERS.items()) + " END"
_MONTHS = "['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec']"
_INT = "TRY_CAST(nullif({0}, '') AS INT)"
TIMES = f"""
WITH x AS (SELECT 'start_time' AS ts_field, staged_id AS row_key, import_id, start_time AS t FROM history_staged UNION ALL SELECT 'end_time', staged_id, import_id, end_time FROM history_staged
  UNION ALL SELECT 'window_start', import_id, import_id, window_start FROM history_imports),
y AS (SELECT x.*, i.declared_timezone AS dz, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS s FROM x LEFT JOIN history_imports i USING (import_id)),
sh AS (SELECT *, {_SHAPE} AS shape FROM y), pt AS (SELECT *, {_PICK} AS p FROM sh),
nm AS (SELECT *, {_INT.format('p[1]')} AS y, CASE WHEN shape = 'named' THEN list_position({_MONTHS}, lower(p[2])) ELSE {_INT.format('p[2]')} END AS m, {_INT.format('p[3]')} AS d, {_INT.format('p[4]')} AS h, {_INT.format('p[5]')} AS mi,
  coalesce({_INT.format('p[6]')}, 0) AS se, coalesce({_INT.format("rpad(left(p[7], 6), 6, '0')")}, 0) AS us, lower(p[8]) AS half, nullif(regexp_replace(p[9], '[\\[\\]]', '', 'g'), '') AS z FROM pt),
hr AS (SELECT *, CASE WHEN coalesce(half, '') = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END END AS hh, TRY_CAST(lpad(CAST(y AS VARCHAR), 4, '0') || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) AS day FROM nm),
lc AS (SELECT *, CASE WHEN hh BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND se BETWEEN 0 AND 59 THEN epoch_us(day) + ((hh * 60 + mi) * 60 + se)::BIGINT * 1000000 + us END AS local_us,
  CASE WHEN regexp_matches(z, '^[+-]') THEN CASE WHEN CAST(regexp_extract(z, '^[+-]([0-9]{{2}}):?([0-9]{{2}})$', 1) AS INT) <= 18 AND CAST(regexp_extract(z, '^[+-]([0-9]{{2}}):?([0-9]{{2}})$', 2) AS INT) <= 59
    THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (CAST(regexp_extract(z, '^[+-]([0-9]{{2}}):?([0-9]{{2}})$', 1) AS INT) * 60 + CAST(regexp_extract(z, '^[+-]([0-9]{{2}}):?([0-9]{{2}})$', 2) AS INT)) END ELSE {_LETTERS} END AS off FROM hr),
zn AS (SELECT lc.*, n.name AS zone FROM lc LEFT JOIN pg_timezone_names() n ON n.name = coalesce(lc.z, lc.dz)),
-- of a time that occurs twice the engine takes the second: an hour earlier is the first, if it shows the same clock
ut AS (SELECT *, CASE WHEN local_us IS NOT NULL AND off IS NULL AND zone IS NOT NULL THEN timezone(zone, make_timestamp(local_us)) END AS moment FROM zn)
SELECT ts_field, row_key, CASE WHEN shape = 'epoch' THEN CAST(s AS BIGINT) * CASE length(s) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END WHEN off IS NOT NULL THEN local_us - off::BIGINT * 60000000
  WHEN moment IS NOT NULL THEN CASE WHEN timezone(zone, moment - INTERVAL 1 HOUR) = make_timestamp(local_us) THEN epoch_us(moment) - 3600000000 ELSE epoch_us(moment) END END AS utc_us, CASE WHEN shape = 'epoch' THEN TRUE ELSE local_us IS NOT NULL END AS is_time FROM ut
"""

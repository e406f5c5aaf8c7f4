"""What rejects says in SQL: every line of history_rows with the reason why it can't be loaded.

DuckDB's JSON reader allows a comma before the closing brace; strict JSON doesn't.
"""

from __future__ import annotations

from runweave.functions.statuses import COUNTED, STATUS_ABBREVIATIONS, STATUS_CODES
from runweave.operators.rejects import ALIASES

_TIME = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ]|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} )[0-9]{1,2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|z|[+-][0-9]{2}:[0-9]{2})?"
_CLOCK = "[Tt ]([0-9]+):([0-9]+):([0-9]+)"
#: Delimiter as SQL and as a pattern, by format.
_DELIMITERS = {"tsv": ("chr(9)", r"\t"), "pipe": ("'|'", r"\|"), "csv": ("','", ",")}


def _listed(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _canonical(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_replace(lower(trim({x})), '[\\s-]+', '_', 'g') IN ({_listed(names)}) THEN '{c}'" for c, names in ALIASES.items()) + " END"


def _field(rx: str) -> str:
    return f'"(?:[^"]|"")*"|[^"{rx}]*'


def _by_format(of) -> str:
    return f"CASE file_format WHEN 'tsv' THEN {of(*_DELIMITERS['tsv'])} WHEN 'pipe' THEN {of(*_DELIMITERS['pipe'])} ELSE {of(*_DELIMITERS['csv'])} END"


def _fields(delimiter: str, rx: str) -> str:
    return f"""[CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN regexp_extract_all({delimiter} || raw_line, '{rx}({_field(rx)})', 1)]"""


def _well_quoted(_: str, rx: str) -> str:
    return f"regexp_full_match(raw_line, '(?:{_field(rx)})(?:{rx}(?:{_field(rx)}))*')"


def _valid(c: str) -> str:
    part = lambda n: f"TRY_CAST(regexp_extract({c}, '{_CLOCK}', {n}) AS INT)"
    return f"""coalesce(regexp_full_match({c}, '{_TIME}') AND TRY_CAST(CASE WHEN contains({c}, '/') THEN regexp_replace({c}, '^([0-9]+)/([0-9]+)/([0-9]{{4}}) .*$', '\\3-\\1-\\2') ELSE left({c}, 10) END AS DATE) IS NOT NULL
      AND {part(1)} <= 23 AND {part(2)} <= 59 AND {part(3)} <= 59 AND (contains({c}, '/') OR regexp_matches({c}, '[Tt ][0-9]{{2}}:')), FALSE)"""


def _naive(c: str) -> str:
    return f"({_valid(c)} AND NOT regexp_matches({c}, '(Z|z|[+-][0-9]{{2}}:[0-9]{{2}})$'))"


_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"
_PICKED = ", ".join(
    f"trim(CASE WHEN js THEN (SELECT v FROM kv WHERE kv.import_id = l.import_id AND kv.line_no = l.line_no AND kv.c = '{c}') ELSE f[list_position(cols, '{c}')] END, {_BLANKS}) AS {c}" for c in ALIASES
)
_NUMBER = "coalesce(TRY_CAST(regexp_extract(upper(trim(status)), '^[+]?([0-9]{1,9})$', 1) AS INT), -1)"
_WORD = "coalesce(upper(trim(status)), '')"
_COUNTED = [*COUNTED, *[STATUS_ABBREVIATIONS[s] for s in COUNTED]]
REASONS = f"""
WITH i AS (SELECT import_id, file_format = 'jsonl' AS js, declared_timezone, file_format, [{_canonical('h')} FOR h IN string_split(header_line, CASE file_format WHEN 'tsv' THEN chr(9) WHEN 'pipe' THEN '|' ELSE ',' END)] AS cols FROM history_imports),
l AS (SELECT r.import_id, r.line_no, r.raw_line, i.* EXCLUDE (import_id), coalesce(regexp_replace(r.raw_line, '\\s', '', 'g') = '', TRUE) AS blank,
  NOT js AND (cols IS NULL OR NOT list_contains(cols, 'job_name') OR NOT list_contains(cols, 'status') OR NOT list_contains(cols, 'start_time')) AS lacks,
  js AND json_valid(raw_line) AND NOT regexp_matches(raw_line, ',\\s*}}\\s*$') AND json_type(CASE WHEN json_valid(raw_line) THEN raw_line END) = 'OBJECT' AS obj, CASE WHEN NOT js THEN {_by_format(_fields)} END AS f, js OR {_by_format(_well_quoted)} AS well
  FROM history_rows r JOIN i USING (import_id)),
kv AS (SELECT import_id, line_no, {_canonical('k')} AS c, arg_min(json_extract_string(raw_line, '$."' || k || '"'), n) AS v
  FROM (SELECT import_id, line_no, raw_line, unnest(json_keys(raw_line)) AS k, generate_subscripts(json_keys(raw_line), 1) AS n FROM l WHERE obj) GROUP BY ALL),
p AS (SELECT l.*, {_PICKED} FROM l),
q AS (SELECT *, CASE WHEN js AND NOT obj THEN 'bad_json' WHEN NOT well THEN 'bad_quoting' WHEN NOT js AND len(f) <> len(cols) THEN 'column_count' END AS split_reason FROM p),
n AS (SELECT import_id, bool_or(split_reason IS NULL AND NOT blank AND ({_naive('start_time')} OR {_naive('end_time')})) AS naive FROM q WHERE declared_timezone IS NULL GROUP BY 1),
z AS (SELECT q.import_id, line_no, CASE WHEN blank THEN NULL WHEN lacks THEN 'missing_column' WHEN n.naive THEN 'naive_no_tz' WHEN split_reason IS NOT NULL THEN split_reason WHEN coalesce(job_name, '') = '' THEN 'missing_job_name'
  WHEN {_WORD} NOT IN ({_listed([*STATUS_CODES, *STATUS_ABBREVIATIONS.values()])}) AND {_NUMBER} NOT IN ({_listed(STATUS_CODES.values())}) THEN 'unknown_status'
  WHEN {_WORD} NOT IN ({_listed(_COUNTED)}) AND {_NUMBER} NOT IN ({_listed(STATUS_CODES[s] for s in COUNTED)}) THEN 'non_terminal_status' WHEN coalesce(start_time, '') = '' THEN 'missing_start_time'
  WHEN NOT {_valid('start_time')} OR (coalesce(end_time, '') <> '' AND NOT {_valid('end_time')}) THEN 'bad_timestamp'
  WHEN (coalesce(exit_code, '') <> '' AND NOT regexp_full_match(exit_code, '[+-]?[0-9]+')) OR (coalesce(attempt, '') <> '' AND NOT regexp_full_match(attempt, '[+-]?[0-9]+')) THEN 'bad_number' END AS reason
  FROM q LEFT JOIN n ON n.import_id = q.import_id)
"""

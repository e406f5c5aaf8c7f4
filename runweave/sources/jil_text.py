"""Parser of definition files: flat stanzas of attribute: value statements.

A file is read in one pass over its lines. Comments (/* */ at a word's start,
# lines) are blanked out outside quotes, statements are cut at names of
attributes, and every line of the file belongs to exactly one stanza, so the
raw texts of the stanzas put together are the file.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The sub-commands that begin a stanza.
DIRECTIVES = frozenset(
    """delete_alert_policy delete_blob delete_box delete_calendar delete_connectionprofile delete_filter delete_glob delete_job
    delete_job_type delete_machine delete_monbro delete_resource delete_user delete_view delete_xinst insert_alert_policy insert_blob
    insert_calendar insert_connectionprofile insert_filter insert_glob insert_job insert_job_type insert_machine insert_monbro
    insert_resource insert_view insert_xinst modify_alert_policy modify_filter modify_view override_job rename_job update_blob
    update_calendar update_connectionprofile update_glob update_job update_job_type update_machine update_monbro update_resource
    update_xinst""".split()
)
# Attributes that may begin a statement within a line. Installations know more
# (one for each option of each job type): parse() takes them as a parameter, and names that
# begin a line elsewhere in the text, or stand after two blanks and have an underscore, count too.
ATTRIBUTES = frozenset(
    """agent_name alarm alarm_if_fail alarm_if_terminated alarm_type amount application auth_string auto_delete auto_hold
    avg_runtime blob_file blob_input blob_mode blob_name blob_type box_failure box_name box_success box_terminator calendar_name
    character_code chk_files command condition connect_string connectionprofile_type continuous cpu_usage date_conditions dates
    days_of_week dbtype description destination_file disk_drive disk_format disk_space elevated encryption_type end_date
    endpoint_url envvars exclude_calendar factor fail_codes filter_type ftp_local_name ftp_local_user ftp_remote_name
    ftp_server_name ftp_server_port ftp_transfer_direction ftp_transfer_type ftp_use_ssl ftp_user_type global_name group
    heartbeat_attempts heartbeat_freq heartbeat_interval i5_action i5_job_name i5_params inside_range interactive
    ip_host ip_port ip_status job_class job_criteria job_filter job_load job_name job_status job_terminator job_type job_type_name
    key_to_agent lower_boundary machine machine_method machine_name max_exit_success max_load max_run_alarm mbean_attr mbean_name
    mbean_operation min_run_alarm monbro_name monbro_type monitor_cond monitor_mode monitor_type must_complete_times
    must_start_times n_retrys new_name no_change node_name notification_alarm_types notification_emailaddress
    notification_emailaddress_on_alarm notification_emailaddress_on_failure notification_emailaddress_on_success
    notification_emailaddress_on_terminated notification_msg opsys oracle_args oracle_program owner permission ping_ports
    ping_timeout poll_interval port priority process_name process_status profile profile_name ps_args ps_process_name
    ps_process_type remove_references res_type resource_name resources results_file run_calendar run_external run_window sap_client
    sap_job_class sap_job_name sap_step_parms scp_local_name scp_local_user scp_protocol scp_remote_name
    scp_server_name scp_server_port scp_transfer_direction search_bw send_notification server service_desk service_name severity
    shell snmp_host snmp_oid sp_arg sp_name sql_command start_date start_mins start_times std_err_file std_in_file
    std_out_file status success_codes success_criteria success_pattern svcdesk_desc svcdesk_pri
    svcdesk_sev tablename term_run_time text text_file_filter text_file_name timezone trigger_cond trigger_type type ulimit
    upper_boundary url user_role watch_file watch_file_min_size watch_file_type watch_interval watch_no_change win_event_type
    win_log_name win_service_name win_service_status ws_parameter wsdl_url xcrypt_type xmachine xmanager xport xtype""".split()
)
# Common words that begin a statement at the beginning of a line only.
AMBIGUOUS = frozenset("active alarm failure filter force mode name restart running server sound starting status success suspended terminated text type view".split())
# Attributes whose text may go on in the next line.
FREE_TEXT = frozenset("box_failure box_success command condition description notification_msg resources".split())
# Attributes that hold shell text, where an escaped quote stays as it is written.
SHELL = frozenset(("command", "sql_command"))
# Attributes that add up when repeated, and what stands between; of others the last counts.
JOINED = {"envvars": ", ", "sp_arg": "\n", "sap_step_parms": "\n", "ws_parameter": "\n", "j2ee_parameter": "\n"}
# Attributes that are spelled in mixed case; all others are lower case.
MIXED_CASE = {"url": "URL", "wsdl_url": "WSDL_URL", "endpoint_url": "endpoint_URL", "ftp_use_ssl": "ftp_use_SSL"}
_DIRECTIVE = re.compile(r"^\s*([A-Za-z]+_[A-Za-z_]+)\s*:\s*(.*)$", re.DOTALL)
_START = re.compile(r"^\s*([A-Za-z][A-Za-z_0-9.\-]*)\s*:")
_INLINE = re.compile(r"(?<=\s)([A-Za-z][A-Za-z_0-9]*)\s*:")
_BLOB_OPEN, _BLOB_CLOSE = "<auto_blobt>", "</auto_blobt>"


def canonical_key(name: str) -> str:
    """An attribute's name as it is spelled: lower case but for a few."""
    n = name.lower()
    return MIXED_CASE.get(n, n)


@dataclass
class Stanza:
    """One stanza: what it does to which object, its attributes in order, and its place in the file."""

    directive: str | None
    name: str | None
    start: int
    end: int = 0
    raw: str = ""
    attrs: list[tuple[str, str]] = field(default_factory=list)
    issues: list[tuple[str, str, str, int]] = field(default_factory=list)

    def merged(self) -> dict[str, str]:
        """One value per attribute: repeated ones are joined where they add up, else the last counts."""
        out: dict[str, str] = {}
        for k, v in self.attrs:
            out[k] = out[k] + JOINED[k] + v if k in out and k in JOINED else v
        return out

    def disposition(self) -> str:
        if self.directive is None:
            return "ARCHIVE_ONLY" if not any(i[0] == "error" for i in self.issues) else "QUARANTINED"
        if any(i[0] == "error" for i in self.issues):
            return "QUARANTINED"
        return "LOADED_WITH_WARNINGS" if self.issues else "LOADED"


def _blanked(text: str) -> str:
    """The text with comments made blank, line ends kept; quotes and blobs are left alone.

    Works by jumping from one mark to the next, so it is linear in the text.
    """
    out, at, quoted = [], 0, False
    closes = True
    for m in re.finditer(r'\\.|"|\n|/\*|<auto_blobt>', text):
        if m.start() < at:
            continue
        mark = m.group()
        if mark == "\n":
            quoted = False
        elif mark == '"':
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            quoted = not quoted and (line.rstrip().endswith((":", ",", "=", "(")) or not line.strip() or line[-1:] in ' \t"')
        elif mark == _BLOB_OPEN and not quoted:
            end = text.find(_BLOB_CLOSE, m.end())
            stop = len(text) if end < 0 else end + len(_BLOB_CLOSE)
            out.append(text[at:stop])
            at = stop
        elif mark == "/*" and not quoted and closes and (m.start() == 0 or text[m.start() - 1].isspace()):
            end = re.compile(r"\*/(?=\s|$)").search(text, m.end())
            if end is None:
                closes = False
                continue
            out.append(text[at : m.start()])
            out.append(re.sub(r"[^\n]", " ", text[m.start() : end.end()]))
            at = end.end()
    out.append(text[at:])
    return "".join(out)


def _value(text: str, key: str = "") -> str:
    """A value without its quotes and escapes."""
    v = text.strip()
    if len(v) >= 2 and v[0] == '"' and v[-1] == '"' and not v.endswith('\\"'):
        v = v[1:-1]
    return re.sub(r"\\([:,])" if key.lower() in SHELL else r"\\([:,\"])", r"\1", v)


def _begins(name: str, line: str, at: int, known: frozenset[str], header: bool) -> bool:
    """Whether a name within a line begins a statement."""
    n = name.lower()
    if n in AMBIGUOUS:
        return header
    return n in known or "_" in n and line[:at].endswith("  ")


def _statements(line: str, header: bool, known: frozenset[str] = ATTRIBUTES) -> list[tuple[str, str]]:
    """name: value statements of a line; after the first, only known names begin a new one, or those set apart by two blanks."""
    first = _START.match(line)
    if not first:
        return []
    spans = [(first.group(1), first.end())]
    cuts = [first.start(1)]
    for m in _INLINE.finditer(line, first.end()):
        quotes = line.count('"', 0, m.start()) - line.count('\\"', 0, m.start())
        if quotes % 2 == 0 and _begins(m.group(1), line, m.start(), known, header):
            spans.append((m.group(1), m.end()))
            cuts.append(m.start())
    ends = [*cuts[1:], len(line)]
    return [(canonical_key(name), _value(line[a:b], name)) for (name, a), b in zip(spans, ends, strict=True)]


def _verb(word: str) -> bool:
    return word.split("_")[0] in ("insert", "update", "delete", "override", "rename", "modify")


def parse(text: str, attributes: frozenset[str] = frozenset()) -> list[Stanza]:
    """Stanzas of a file, in order; their raw texts put together are the text.

    Lines before the first stanza belong to a stanza without directive, unless
    they are blank or comments, which go to the stanza that follows. An unknown
    sub-command is quarantined and doesn't add to the stanza before it. A quoted
    text may go on over any number of lines; its closing quote must come before
    the next stanza, else only its own line is taken. attributes: names (in lower
    case) that are known beside ATTRIBUTES.
    """
    vocabulary = ATTRIBUTES | attributes
    raw = text.splitlines(keepends=True)
    code = _blanked(text.replace("\ufeff", " ", 1) if text.startswith("\ufeff") else text)
    lines = code.splitlines()
    out: list[Stanza] = []
    now: Stanza | None = None
    begin = 1
    quoted = blob = False
    firsts = [m.group(1).lower() if (m := _START.match(x)) else "" for x in lines]
    known = vocabulary | {x for x in firsts if "_" in x and not _verb(x)}
    # whether a quote comes before the next stanza, from each line on
    closes = [False] * (len(lines) + 1)
    for i in range(len(lines) - 1, -1, -1):
        closes[i] = firsts[i] not in DIRECTIVES and ('"' in lines[i] or closes[i + 1])
    for n, line in enumerate(lines, 1):
        if blob or quoted:
            key, value = now.attrs[-1]
            now.attrs[-1] = (key, value + "\n" + line)
            if blob and _BLOB_CLOSE in line:
                blob = False
            if quoted and line.count('"') % 2:
                quoted = False
                now.attrs[-1] = (key, _value(now.attrs[-1][1], key))
            continue
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _DIRECTIVE.match(line)
        word = m.group(1).lower() if m else ""
        if m and (word in DIRECTIVES or _verb(word) and word not in vocabulary):
            if now is not None:
                now.end = n - 1
                out.append(now)
                begin = n
            head = _statements(line, True, known)
            now = Stanza(word if word in DIRECTIVES else None, head[0][1] or None, begin)
            now.attrs += head[1:]
            if word not in DIRECTIVES:
                now.issues.append(("error", "unknown_directive", word, n))
            elif not head[0][1]:
                now.issues.append(("error", "missing_name", word, n))
            continue
        statements = _statements(line, False, known)
        if now is None:
            now = Stanza(None, None, begin)
        if statements:
            now.attrs += statements
            key, value = now.attrs[-1]
            if _BLOB_OPEN in value and _BLOB_CLOSE not in value:
                blob = True
            elif (value.count('"') - value.count('\\"')) % 2:
                quoted = closes[n]
                if not quoted:
                    now.issues.append(("warning", "unbalanced_quote", key, n))
            for k, _ in statements:
                if k.lower() not in vocabulary:
                    now.issues.append(("warning", "unknown_attribute", k, n))
        elif now.attrs and now.attrs[-1][0] in FREE_TEXT:
            key, value = now.attrs[-1]
            now.attrs[-1] = (key, f"{value} {line.strip()}".strip())
        else:
            now.issues.append(("warning", "stray_line", line.strip()[:80], n))
    if now is None and raw:
        now = Stanza(None, None, 1)
    if now is not None:
        now.end = len(raw)
        out.append(now)
    for s in out:
        s.raw = "".join(raw[s.start - 1 : s.end])
        names = [k for k, _ in s.attrs]
        for k in dict.fromkeys(x for x in names if names.count(x) > 1 and x not in JOINED):
            s.issues.append(("warning", "repeated_attribute", k, s.start))
    return out


def parse_calendars(text: str) -> list[tuple[str, str, list[str], dict[str, str], int]]:
    """(kind, name, dates, rules, bad lines) of each calendar of an export: ISO or month/day/year dates, times ignored."""
    out: list = []
    for line in text.splitlines():
        head = re.match(r"^\s*(calendar|extended_calendar)\s*:\s*(\S+)", line, re.IGNORECASE)
        if head:
            out.append([head.group(1).lower(), head.group(2), [], {}, 0])
        elif out and line.strip() and not line.lstrip().startswith(("#", "/*")):
            kind, _, dates, rules, _ = out[-1]
            if kind == "extended_calendar":
                k, _, v = line.partition(":")
                rules[k.strip().lower()] = v.strip()
            elif (d := calendar_date(line.split()[0])) is not None:
                dates.append(d)
            else:
                out[-1][4] += 1
    return [tuple(x) for x in out]


def calendar_date(text: str) -> str | None:
    import datetime

    m = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", text)
    parts = [int(x) for x in m.groups()] if m else None
    if not m and (m := re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", text)):
        parts = [int(m.group(3)), int(m.group(1)), int(m.group(2))]
    try:
        return datetime.date(*parts).isoformat() if parts else None
    except ValueError:
        return None


def parse_globals(text: str) -> list[tuple[str, str]]:
    """(name, value) of each global: SET_GLOBAL lines, or a table whose columns a line of underscores rules."""
    out, columns = [], []
    for line in text.splitlines():
        if re.search(r"SET_GLOBAL", line):
            m = re.search(r'-G\s+"([^"=]+)=([^"]*)"', line) or re.search(r"-G\s+([^\s=]+)=(\S*)", line)
            if m:
                out.append((m.group(1).strip(), m.group(2)))
        elif line.strip() and not line.strip().replace("_", "").replace(" ", ""):
            columns = [(x.start(), x.end()) for x in re.finditer("_+", line)]
        elif columns and line.strip():
            ends = [c[0] for c in columns[1:]] + [None]
            cells = [line[a:b].strip() for (a, _), b in zip(columns, ends, strict=True)]
            if cells[0]:
                out.append((cells[0], cells[1] if len(cells) > 1 else ""))
    return out


def kind_of(text: str) -> str:
    """calendars, globals or jil, by the first line that says anything."""
    lines = [x for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "/*"))]
    if lines and re.match(r"^\s*(extended_)?calendar\s*:", lines[0], re.IGNORECASE):
        return "calendars"
    if lines and (re.match(r"^\s*global name\s", lines[0], re.IGNORECASE) or all("SET_GLOBAL" in x for x in lines)):
        return "globals"
    return "jil"


def decode(data: bytes) -> tuple[str, str]:
    """(text, encoding) of a file's bytes: by byte order mark, zeros in every other byte, UTF-8, Windows-1252, Latin-1; never fails."""
    marks = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\0\0", "utf-32"), (b"\0\0\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    guesses = [e for m, e in marks if data.startswith(m)]
    if len(data) >= 4 and len(data) % 2 == 0:
        low, high = data[::2].count(0), data[1::2].count(0)
        if high > len(data) // 8 and not low:
            guesses.append("utf-16-le")
        if low > len(data) // 8 and not high:
            guesses.append("utf-16-be")
    for e in [*guesses, "utf-8", "cp1252"]:
        try:
            return data.decode(e), e
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1"), "latin-1"

"""Grok patterns ``%{NAME:field:type}``, expanded to one Java regular expression."""

import re
from pathlib import Path

from ..plans.rules import RuleError

#: Named building blocks. They are our own wording of the usual names; more may be given by the user.
PATTERNS: dict[str, str] = {
    "USERNAME": r"[\w.-]+", "USER": r"%{USERNAME}", "INT": r"[+-]?\d+", "BASE10NUM": r"[+-]?(?:\d+(?:\.\d+)?|\.\d+)", "NUMBER": r"%{BASE10NUM}",
    "BASE16NUM": r"[+-]?(?:0x)?[0-9A-Fa-f]+", "POSINT": r"[1-9]\d*", "NONNEGINT": r"\d+", "WORD": r"\b\w+\b", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*",
    "QUOTEDSTRING": r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'', "QS": r"%{QUOTEDSTRING}", "UUID": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", "URN": r"urn:[0-9A-Za-z][\w-]{0,31}:\S+",
    "MAC": r"[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{4}(?:\.[0-9A-Fa-f]{4}){2}", "BYTE": r"(?:25[0-5]|2[0-4]\d|1?\d?\d)", "IPV4": r"(?<!\d)%{BYTE}(?:\.%{BYTE}){3}(?!\d)",
    "IPV6": r"(?:[0-9A-Fa-f]{0,4}:){2,7}(?:%{IPV4}|[0-9A-Fa-f]{0,4})(?:%\w+)?", "IP": r"%{IPV6}|%{IPV4}", "HOSTNAME": r"\b[0-9A-Za-z][\w-]{0,62}(?:\.[0-9A-Za-z][\w-]{0,62})*\.?", "HOST": r"%{HOSTNAME}",
    "IPORHOST": r"%{IP}|%{HOSTNAME}", "HOSTPORT": r"(?:%{IPORHOST}):%{POSINT}", "UNIXPATH": r"(?:/[^\s/]*)+", "WINPATH": r"(?:[A-Za-z]+:|\\)(?:\\[^\\?*]*)+", "PATH": r"%{UNIXPATH}|%{WINPATH}", "TTY": r"/dev/(?:pts|tty\w?)/?\d*",
    "URIPROTO": r"[A-Za-z][A-Za-z0-9+.-]*", "URIHOST": r"(?:%{IPORHOST})(?::%{POSINT})?", "URIPATH": r"(?:/[^\s?#]*)+", "URIQUERY": r"[^\s#]*", "URIPARAM": r"\?%{URIQUERY}", "URIPATHPARAM": r"%{URIPATH}(?:%{URIPARAM})?",
    "URI": r"%{URIPROTO}://(?:%{USER}(?::[^@\s]*)?@)?(?:%{URIHOST})?(?:%{URIPATHPARAM})?(?:#\S*)?", "EMAILLOCALPART": r"[\w.!#$&'*+/=?^`{|}~-]+", "EMAILADDRESS": r"%{EMAILLOCALPART}@%{HOSTNAME}",
    "MONTH": r"\b(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]une?|[Jj]uly?|[Aa]ug(?:ust)?|[Ss]ept?(?:ember)?|[Oo]ct(?:ober)?|[Nn]ov(?:ember)?|[Dd]ec(?:ember)?)\b",
    "MONTHNUM": r"(?:1[0-2]|0?[1-9])", "MONTHNUM2": r"(?:1[0-2]|0[1-9])", "MONTHDAY": r"(?:3[01]|[12]\d|0?[1-9])", "DAY": r"(?:Mon|Tues?|Wed(?:nes)?|Thu(?:rs)?|Fri|Sat(?:ur)?|Sun)(?:day)?", "YEAR": r"\d{2}(?:\d{2})?", "HOUR": r"(?:2[0-3]|[01]?\d)", "MINUTE": r"[0-5]\d",
    "SECOND": r"(?:[0-5]?\d|60)(?:[:.,]\d+)?", "TIME": r"(?<!\d)%{HOUR}:%{MINUTE}(?::%{SECOND})?(?!\d)", "DATE_US": r"%{MONTHNUM}[/-]%{MONTHDAY}[/-]%{YEAR}", "DATE_EU": r"%{MONTHDAY}[./-]%{MONTHNUM}[./-]%{YEAR}", "DATE": r"%{DATE_US}|%{DATE_EU}",
    "ISO8601_TIMEZONE": r"(?:Z|[+-]%{HOUR}(?::?%{MINUTE}))", "ISO8601_SECOND": r"%{SECOND}", "TIMESTAMP_ISO8601": r"\d{4}-%{MONTHNUM}-%{MONTHDAY}[T ]%{HOUR}:?%{MINUTE}(?::?%{SECOND})?%{ISO8601_TIMEZONE}?", "DATESTAMP": r"(?:%{DATE})[- ]%{TIME}", "TZ": r"[A-Z]{3,4}",
    "DATESTAMP_RFC822": r"%{DAY} %{MONTH} %{MONTHDAY} %{YEAR} %{TIME} %{TZ}", "DATESTAMP_RFC2822": r"%{DAY}, %{MONTHDAY} %{MONTH} %{YEAR} %{TIME} %{ISO8601_TIMEZONE}", "DATESTAMP_OTHER": r"%{DAY} %{MONTH} %{MONTHDAY} %{TIME} %{TZ} %{YEAR}", "DATESTAMP_EVENTLOG": r"%{YEAR}%{MONTHNUM2}%{MONTHDAY}%{HOUR}%{MINUTE}\d{2}",
    "HTTPDATE": r"%{MONTHDAY}/%{MONTH}/%{YEAR}:%{TIME} %{INT}", "SYSLOGTIMESTAMP": r"%{MONTH} +%{MONTHDAY} %{TIME}", "PROG": r"[!-Z\\^-~]+", "SYSLOGPROG": r"%{PROG:process.name}(?:\[%{POSINT:process.pid:int}\])?", "SYSLOGHOST": r"%{IPORHOST}",
    "SYSLOGFACILITY": r"<%{NONNEGINT:log.syslog.facility.code:int}\.%{NONNEGINT:log.syslog.priority:int}>", "SYSLOGBASE": r"%{SYSLOGTIMESTAMP:timestamp} (?:%{SYSLOGFACILITY} )?%{SYSLOGHOST:host.hostname} %{SYSLOGPROG}:", "SYSLOGLINE": r"%{SYSLOGBASE} +%{GREEDYDATA:message}",
    "LOGLEVEL": r"(?i:trace|debug|info(?:rmation)?|notice|warn(?:ing)?|err(?:or)?|crit(?:ical)?|fatal|severe|alert|emerg(?:ency)?)", "HTTPDUSER": r"%{EMAILADDRESS}|%{USER}",
    "HTTPD_COMMONLOG": r'%{IPORHOST:source.address} (?:-|%{HTTPDUSER:apache.access.user.identity}) (?:-|%{HTTPDUSER:user.name}) \[%{HTTPDATE:timestamp}\] "(?:%{WORD:http.request.method} %{NOTSPACE:url.original}(?: HTTP/%{NUMBER:http.version})?|%{DATA})" (?:-|%{INT:http.response.status_code:int}) (?:-|%{INT:http.response.body.bytes:int})',
    "HTTPD_COMBINEDLOG": r'%{HTTPD_COMMONLOG} "(?:-|%{DATA:http.request.referrer})" "(?:-|%{DATA:user_agent.original})"', "COMMONAPACHELOG": r"%{HTTPD_COMMONLOG}", "COMBINEDAPACHELOG": r"%{HTTPD_COMBINEDLOG}",
    "CISCOMAC": r"(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}", "WINDOWSMAC": r"(?:[0-9A-Fa-f]{2}-){5}[0-9A-Fa-f]{2}", "COMMONMAC": r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}", "JAVACLASS": r"(?:[A-Za-z$_][\w$]*\.)*[A-Za-z$_][\w$]*", "JAVAFILE": r"[\w. -]+", "JAVAMETHOD": r"(?:<(?:cl)?init>|[A-Za-z$_][\w$]*)",
    "JAVASTACKTRACEPART": r"\s*at %{JAVACLASS:java.log.origin.class.name}\.%{JAVAMETHOD:log.origin.function}\(%{JAVAFILE:log.origin.file.name}(?::%{INT:log.origin.file.line:int})?\)", "MONGO_WORDDASH": r"\b[\w-]+\b", "REDISTIMESTAMP": r"%{MONTHDAY} %{MONTH} %{TIME}", "RUBY_LOGLEVEL": r"DEBUG|FATAL|ERROR|WARN|INFO",
    "CRON_ACTION": r"[A-Z ]+", "NAGIOSTIME": r"\[%{NUMBER:timestamp}\]", "SQUID": r"%{NUMBER:timestamp} +%{NUMBER:squid.request.duration:int} %{IP:source.ip} %{WORD:event.action}/%{NONNEGINT:http.response.status_code:int} %{INT:http.response.bytes:int} %{WORD:http.request.method} %{NOTSPACE:url.original} (?:-|%{NOTSPACE:user.name}) %{WORD:squid.hierarchy_code}/(?:-|%{IPORHOST:destination.address}) (?:-|%{NOTSPACE:http.response.mime_type})",
}


def read_folder(place: str) -> dict[str, str]:
    """The patterns of all files of a folder and those below it, in the order of their paths: lines of a name and a pattern; # begins a comment."""
    found = {}
    for path in sorted(p for p in Path(place.removeprefix("file://")).rglob("*") if p.is_file()):
        for line in path.read_text(encoding="utf-8").splitlines():
            name, _, pattern = line.strip().partition(" ")
            if name and not name.startswith("#") and pattern:
                found[name] = pattern.strip()
    return found


_USE = re.compile(r"%\{(\w+)(?::([^}:]+))?(?::(int|float))?\}")
_OWN = re.compile(r"\(\?<((?![=!])[^>]+)>")


def expand(pattern: str, extra: dict[str, str] | None = None) -> tuple[str, list[tuple[int, str, str]]]:
    """A Java regular expression and (group, field, type) of each capture, in the order of the groups."""
    known = {**PATTERNS, **(extra or {})}
    captures: list[tuple[str, str]] = []

    def replace(text: str, depth: int) -> str:
        if depth > 20:
            raise RuleError(f"the grok pattern {pattern!r} refers to itself")
        out, at = "", 0
        for m in _USE.finditer(text):
            out += own(text[at : m.start()])
            if m[1] not in known:
                raise RuleError(f"the grok pattern {m[1]!r} isn't known")
            if m[2]:
                captures.append((m[2], m[3] or ""))
                out += f"(?<c{len(captures) - 1}c>{replace(known[m[1]], depth + 1)})"
            else:
                out += f"(?:{replace(known[m[1]], depth + 1)})"
            at = m.end()
        return out + own(text[at:])

    def own(text: str) -> str:
        def name(m: re.Match) -> str:
            captures.append((m[1], ""))
            return f"(?<c{len(captures) - 1}c>"

        return _OWN.sub(name, text)

    java = replace(pattern, 0)
    groups: dict[int, int] = {}
    count, i, inside = 0, 0, False
    while i < len(java):  # numbers of the groups
        c = java[i]
        if c == "\\":
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
            if java[i + 1 : i + 2] == "]" or java[i + 1 : i + 3] == "^]":
                i += 2 if java[i + 1] == "^" else 1
        elif c == "(" and (java[i + 1 : i + 2] != "?" or re.match(r"\(\?<[A-Za-z]", java[i : i + 4])):
            count += 1
            if m := re.match(r"\(\?<c(\d+)c>", java[i:]):
                groups[int(m[1])] = count
        i += 1
    return java, [(groups[k], field, kind) for k, (field, kind) in enumerate(captures)]

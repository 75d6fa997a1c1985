"""Fields of a free-text log line as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import OPERATIONS

#: Patterns whose exact reach decides results.
TIMESTAMPS = (
    r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)",
    r"(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4})",
    r"([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})",
)
IPV4 = r"((?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?))"
USER = r"(?i)(?:user(name)?[=:]\s*|User\s+)([^\s,;\)]+)"
RESULTS = (("SUCCESS|成功", "SUCCESS"), ("FAIL|FAILED|失败|ERROR", "FAIL"))
LEVELS = (("CRITICAL|FATAL|EMERGENCY", "CRITICAL"), ("ERROR|错误", "ERROR"), ("WARN|WARNING|警告", "WARN"), ("INFO|INFORMATION|信息", "INFO"), ("DEBUG|TRACE", "DEBUG"))
SOURCE = r"(?U)(\S+\.(?:log|py|java|go|js|ts))"


def _found(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def _any(line: Column, words) -> Column:
    """Whether the line holds one of the words: what a pattern can't do without is looked for before the pattern, at far less cost."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(line, F.lit(w))
    return out


def timestamp_text(line: Column) -> Column:
    """ISO before Apache before syslog, wherever they stand. All have colons."""
    return F.when(_any(line, (":",)), F.coalesce(*[_found(line, p) for p in TIMESTAMPS]))


def typed_timestamp(text: Column, year: int = 1970) -> Column:
    """The text as timestamp_ntz, null if it has none of the three shapes. Apache offsets go to UTC; syslog takes `year`."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"(\.\d{6})\d+", "$1")
    shapes = (
        (t, "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"),
        (t, "dd/MMM/yyyy:HH:mm:ss Z"),
        (F.concat(F.lit(f"{year} "), t), "yyyy MMM d HH:mm:ss"),
    )
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)) for c, p in shapes]).cast("timestamp_ntz")


def ip_address(line: Column, pattern: str = IPV4) -> Column:
    """The first group of the first match. A pattern other than IPV4 is for logs whose addresses are not IPv4 ones."""
    return F.when(line.rlike(r"\d\.\d"), _found(line, IPV4)) if pattern == IPV4 else _found(line, pattern)


def operation(line: Column, upper: Column | None = None) -> Column:
    """The first keyword by priority that the line holds, in any case. upper: the line in capitals, where it is at hand."""
    upper = F.upper(line) if upper is None else upper
    chain = F
    for k in OPERATIONS:
        chain = chain.when(F.contains(upper, F.lit(k)), k)
    return chain.otherwise("UNKNOWN")


def operation_result(line: Column) -> Column:
    chain = F
    for pattern, label in RESULTS:  # plain words
        chain = chain.when(_any(line, pattern.split("|")), label)
    return chain.otherwise("UNKNOWN")


def severity(line: Column, upper: Column | None = None) -> Column:
    """The first level by priority that stands in the line as a word, in any case."""
    upper = F.translate(F.upper(line) if upper is None else upper, "\u0130", "I")  # the patterns take a dotted capital as I
    chain = F.when(~_any(upper, [w for p, _ in LEVELS for w in p.split("|")]), "INFO")
    for pattern, label in LEVELS:
        chain = chain.when(line.rlike(rf"(?iU)\b({pattern})\b"), label)
    return chain.otherwise("INFO")


def username(line: Column, upper: Column | None = None) -> Column:
    found = F.when(_any(F.upper(line) if upper is None else upper, ("USER",)), F.regexp_extract(line, USER, 2)).otherwise(F.when(line.isNotNull(), ""))
    return F.when(found == "", "unknown").otherwise(F.regexp_replace(found, "^[\"']+|[\"']+$", ""))


def detail(line: Column) -> Column:
    """The first text in double quotes, else in single ones; an empty one is kept."""
    chain = F
    for pattern in ('"([^"]*)"', "'([^']*)'"):
        chain = chain.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))
    return chain


def source_file(line: Column) -> Column:
    return F.when(line.rlike(r"\.(?:log|py|java|go|js|ts)"), _found(line, SOURCE))


def parse_line(line: Column, upper: Column | None = None, address: str = IPV4) -> dict[str, Column]:
    return {
        "timestamp_text": timestamp_text(line), "ip_address": ip_address(line, address), "username": username(line, upper), "operation": operation(line, upper),
        "operation_result": operation_result(line), "detail": detail(line), "severity": severity(line, upper), "source_file": source_file(line), "raw_line": line,
    }


def stripped(line: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def parse_lines(df: DataFrame, line: str, year: int = 1970, address: str = IPV4) -> DataFrame:
    """The fields of every non-blank line, after the other columns; columns of the same names give way. `address`: see ip_address()."""
    names = [*parse_line(F.col(line)), "timestamp"]
    # explode() holds the stripped line, and the line in capitals, fast: each is computed once
    rows = df.withColumn("__line", F.explode(F.array(stripped(F.col(line))))).filter(F.length("__line") > 0)
    rows = rows.withColumn("__upper", F.explode(F.array(F.upper("__line"))))
    rest = [c for c in df.columns if c not in names and c != line]
    rows = rows.select(*rest, *[c.alias(k) for k, c in parse_line(F.col("__line"), F.col("__upper"), address).items()])
    return rows.withColumn("timestamp", typed_timestamp(F.col("timestamp_text"), year))

"""Static audits of source lines: banned calls, and lines that must keep to a safe form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What no line may hold, and the safe forms of markup assignments, requests, imports and addresses.
BANS = (
    ("eval is called", r"\beval\s*\("),
    ("a function is built from text", r"new\s+Function\s*\("),
    ("the document is written into", r"document\.write\s*\("),
    ("an old request object is used", r"\bXMLHttpRequest\b"),
    ("a web socket is opened", r"new\s+WebSocket\s*\("),
    ("a beacon is sent", r"\bsendBeacon\b"),
    ("an event source is opened", r"new\s+EventSource\s*\("),
    ("markup is put beside an element", r"\binsertAdjacentHTML\b"),
    ("an element's markup is replaced", r"\.outerHTML\s*="),
)
ASSIGNED, CLEARED = r"\.innerHTML\s*=([^=]|$)", r"\.innerHTML\s*=\s*''"
REQUEST, SAFE_REQUEST = "fetch(", r"fetch\s*\(\s*('/|path\b)"
IMPORTED, SAFE_IMPORT = r"""\bimport\s*\(\s*['"`]([^'"` ]+)['"`]\s*\)""", "/vendor/"
COMMENT, ADDRESS, SAFE_HOST = r"^\s*//", r"https?://\S+", "github.com"


def findings(line: Column) -> Column:
    """The rules that a line breaks, as an array of their names; empty for a clean one."""
    imported = F.regexp_extract(line, IMPORTED, 1)
    rules = [(name, line.rlike(pattern)) for name, pattern in BANS]
    rules += [
        ("markup is only cleared", line.rlike(ASSIGNED) & ~line.rlike(CLEARED)),
        ("requests stay on the origin", line.contains(REQUEST) & ~line.rlike(SAFE_REQUEST)),
        ("imports come from the vendored files", (imported != "") & ~imported.startswith(SAFE_IMPORT)),
        ("no remote addresses", line.rlike(ADDRESS) & ~line.rlike(COMMENT) & ~line.contains(SAFE_HOST)),
    ]
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def audit(lines: DataFrame, line: str = "line", line_no: str = "line_no") -> DataFrame:
    """One row for each line (numbered from 0) and rule it breaks: its columns, rule, and the line as a report shows it."""
    found = lines.withColumn("rule", F.explode(findings(F.col(line))))
    text = F.trim(line)
    shown = F.when(F.col("rule") == "no remote addresses", F.substring(text, 1, 80)).otherwise(text)
    return found.withColumn("shown", F.concat(F.lit("line "), (F.col(line_no) + 1).cast("string"), F.lit(": "), shown))

"""Column expressions for text handling.

All of these are built-in Spark expressions, so they stay inside
whole-stage codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip()/str.split() treat as whitespace.
PY_WS = (r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
# Line boundaries of Python's str.splitlines().
PY_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(_col(c), f"^{PY_WS}+|{PY_WS}+$", "")


def normalize_url(c) -> Column:
    """Prefix ``https://`` unless the url starts with http:// or https://."""
    c = _col(c)
    return F.when(c.startswith("http://") | c.startswith("https://"), c).otherwise(
        F.concat(F.lit("https://"), c))


def clean_whitespace(c) -> Column:
    """Split lines, strip, split on two spaces, strip, drop empties, join " "."""
    lines = F.split(_col(c), PY_LINE_BREAK)
    chunks = F.flatten(F.transform(lines, lambda ln: F.split(py_strip(ln), "  ")))
    kept = F.filter(F.transform(chunks, lambda ch: py_strip(ch)), lambda ch: ch != "")
    return F.array_join(kept, " ")


def truncate(c, n: int) -> Column:
    """First ``n`` characters plus "..." when longer than ``n``."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def extractive_summary(text, title) -> Column:
    """P10: first three sentences longer than 20 characters, else a title line."""
    parts = F.transform(F.split(_col(text), r"[.!?]+"), lambda s: py_strip(s))
    kept = F.filter(parts, lambda s: F.length(s) > 20)
    joined = F.array_join(F.slice(kept, 1, 3), ". ")
    summary = F.when(joined.endswith("."), joined).otherwise(F.concat(joined, F.lit(".")))
    fallback = F.concat(_col(title), F.lit(" provides information about their services and offerings."))
    return F.when(F.size(kept) > 0, summary).otherwise(fallback)


# A cased letter (Python's str.title() capitalises after any non-cased char).
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def title_case(c) -> Column:
    """Q4: Python ``str.title()`` — upper-case the first letter of every run of
    cased letters and lower-case the rest ("san francisco's" -> "San
    Francisco'S"). Spark's ``initcap`` only capitalises after spaces."""
    tokens = F.regexp_extract_all(_col(c), F.lit(f"[{_CASED}]+|[^{_CASED}]+"), 0)
    cased = F.transform(tokens, lambda t: F.when(
        t.rlike(f"^[{_CASED}]"),
        F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30)))
    ).otherwise(t))
    return F.array_join(cased, "")


def sanitize_string(c) -> Column:
    """V2: HTML-escape (``&`` first), remove characters below U+0020, then
    collapse whitespace runs and strip."""
    c = _col(c)
    esc = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    no_ctrl = F.regexp_replace(esc, r"[\x00-\x1f]", "")
    return py_strip(F.regexp_replace(no_ctrl, f"{PY_WS}+", " "))


def supplied_text_override(supplied, extracted) -> Column:
    """The caller's text when it is non-empty, else the extracted text."""
    return F.coalesce(F.nullif(_col(supplied), F.lit("")), _col(extracted))

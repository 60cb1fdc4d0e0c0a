"""Validation and data-quality operators.

Each check is an expression returning the first failing message (or NULL),
so a request table is validated in one projection and split into good and
quarantined rows without Python.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import (
    API_KEY_REGEX, MAX_CONTENT_LENGTH, MAX_URL_LENGTH, REQUEST_LIMITS, REQUEST_MODELS, ROOT_MODEL_REGEX, SERVICE_MODEL_REGEX, URL_BAD_CHARS,
)
from ..functions.urls import url_netloc, url_scheme

# Q16: the third-party URL validator is not available; this anchored regex
# accepts scheme://[user[:pass]@]host[:port][/path?query#frag] where host is
# a dotted name with an alphabetic TLD, localhost or an IPv4 address, and
# the scheme is one of the validator's known schemes.
URL_FORMAT_REGEX = (
    r"^(?i)(?:ftp|ftps|git|http|https|irc|rtmp|rtmps|rtsp|sftp|ssh|telnet)://"
    r"(?:[^\s:@/]+(?::[^\s@/]*)?@)?"
    r"(?:localhost|(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}|\d{1,3}(?:\.\d{1,3}){3})"
    r"(?::\d{1,5})?(?:[/?#]\S*)?$"
)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _bad_chars(url: Column) -> Column:
    cond = None
    for ch in URL_BAD_CHARS:
        c = url.contains(ch)
        cond = c if cond is None else (cond | c)
    return cond


def url_error(url, blocked: Column | None = None, variant: str = "service",
              max_length: int = MAX_URL_LENGTH, schemes: Sequence[str] = ("http", "https")) -> Column:
    """V1: first failing check of a URL, NULL when valid. ``blocked`` is a
    boolean column (from J6) telling whether the lower-cased netloc is
    blocked. The service checks bad characters second, the root app last."""
    u = _c(url)
    checks = [
        (F.length(u) > max_length, f"URL length exceeds maximum of {max_length} characters"),
        (_bad_chars(u), "URL contains invalid characters"),
        (~u.rlike(URL_FORMAT_REGEX), "Invalid URL format"),
        (~url_scheme(u).isin(*schemes), f"URL scheme must be one of: {', '.join(schemes)}"),
    ]
    if blocked is not None:
        checks.append((blocked, "Access to this domain is blocked"))
    if variant == "root":
        checks = [checks[0]] + checks[2:] + [checks[1]]
    expr = None
    for cond, msg in checks:
        expr = F.when(cond, msg) if expr is None else expr.when(cond, msg)
    return expr


def blocked_flag(df: DataFrame, url: str, blocked_domains: DataFrame) -> DataFrame:
    """Flag rows whose lower-cased netloc is in ``blocked_domains(domain)``.
    A left join on the domain; AQE broadcasts the block list when its
    measured size is under the broadcast threshold and shuffles otherwise."""
    b = blocked_domains.select(F.lower("domain").alias("_domain")).distinct().withColumn("_blocked", F.lit(True))
    j = df.withColumn("_domain", F.lower(url_netloc(url))).join(b, "_domain", "left")
    return j.withColumn("blocked", F.coalesce("_blocked", F.lit(False))).drop("_domain", "_blocked")


def api_key_error(key) -> Column:
    """V3: NULL or empty is fine; otherwise ``^sk-[a-zA-Z0-9]{32,}$``."""
    k = _c(key)
    return F.when(F.coalesce(k, F.lit("")) == "", F.lit(None).cast("string")).when(
        ~k.rlike(API_KEY_REGEX), "Invalid API key format")


def content_length_error(n) -> Column:
    """V4."""
    return F.when(_c(n) > MAX_CONTENT_LENGTH,
                  f"Content length exceeds maximum of {MAX_CONTENT_LENGTH} bytes")


def request_error(url="url", model="model", api_key="openai_api_key", blocked="blocked",
                  variant: str = "service") -> Column:
    """V5: required url, V1, V3 (when a key is given), model name format."""
    model_rx = SERVICE_MODEL_REGEX if variant == "service" else ROOT_MODEL_REGEX
    m = _c(model)
    return F.coalesce(
        F.when(_c(url).isNull(), "Missing required fields: url"),
        url_error(url, _c(blocked), variant),
        F.when(_c(api_key).isNotNull(), api_key_error(api_key)),
        F.when(m.isNotNull() & ~m.rlike(model_rx), "Invalid model name format"))


def media_violations(df: DataFrame) -> Column:
    """V6: constraint violations of a media row as ``array<string>``
    (size_bytes > 0, 0 <= priority <= 100, duration > 0 when given,
    type image|video, url <= 2048)."""
    checks = [
        (F.col("size_bytes") <= 0, "size_bytes must be > 0"),
        ((F.col("priority") < 0) | (F.col("priority") > 100), "priority must be within 0..100"),
        (F.col("duration_seconds").isNotNull() & (F.col("duration_seconds") <= 0), "duration must be > 0"),
        (~F.col("type").isin("image", "video"), "type must be image or video"),
        (F.length("url") > MAX_URL_LENGTH, "url too long"),
    ]
    arr = F.array(*[F.when(c, F.lit(msg)) for c, msg in checks])
    return F.filter(arr, lambda x: x.isNotNull())


def _violations(*checks: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(msg)) for c, msg in checks]), lambda x: x.isNotNull())


def scrape_request_violations(url="url", model="model", limit="limit") -> Column:
    """V6: what breaks the constraints of a scrape request, as
    ``array<string>``: url present and at most 2048 long, model one of the
    enumeration, limit within 1..50 when given (null: the default)."""
    low, high = REQUEST_LIMITS
    return _violations(
        (_c(url).isNull(), "url is required"),
        (F.length(_c(url)) > MAX_URL_LENGTH, f"URL too long (max {MAX_URL_LENGTH} characters)"),
        (_c(model).isNull(), "model is required"),
        (~_c(model).isin(REQUEST_MODELS), "model is not supported"),
        (~_c(limit).between(low, high), f"limit must be within {low}..{high}"))


def page_meta_violations(total="total_count", remaining="remaining_count", has_more="has_more",
                         next_cursor="next_cursor") -> Column:
    """V6: what breaks the constraints of a page's meta: counts present and not negative, no more remaining than there
    are, a next cursor exactly if there is more."""
    n, r, m = _c(total), _c(remaining), _c(has_more)
    return _violations(
        (n.isNull() | (n < 0), "total_count must be >= 0"),
        (r.isNull() | (r < 0), "remaining_count must be >= 0"),
        (r > n, "remaining_count exceeds total_count"),
        (m.isNull() | (m != _c(next_cursor).isNotNull()), "next_cursor must be given exactly when has_more"))


def split_valid(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and the quarantine (with their violations)."""
    v = df.withColumn("violations", violations)
    return (v.filter(F.size("violations") == 0).drop("violations"),
            v.filter(F.size("violations") > 0))

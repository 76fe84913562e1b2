"""Scalar functions of the reference as Spark column expressions (JVM-side,
inside whole-stage codegen; no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The request-audit patterns (matched case-insensitively), in
# the reference's order: SQL injection, XSS, path traversal, command
# injection, template injection.
ATTACK_PATTERNS = [
    r"(\b(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER|EXEC)\b)",
    r"(\bunion\b.*\bselect\b)",
    r"(\bor\b.*\b1\s*=\s*1\b)",
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"on\w+\s*=",
    r"\.\./",
    r"\.\.\\",
    r"[;&|`$()]",
    r"\{\{.*\}\}",
    r"\{%.*%\}",
]
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_email(email) -> Column:
    """First and last letter of the local part kept; two letters or fewer all
    masked; no '@' -> '***'."""
    e = _c(email)
    local = F.substring_index(e, "@", 1)
    domain = e.substr(F.instr(e, "@") + 1, F.length(e))  # everything after the first '@'
    n = F.length(local)
    masked = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(local, -1, 1)))
    return F.when(e.isNull() | (F.instr(e, "@") == 0), F.lit("***")).otherwise(F.concat(masked, F.lit("@"), domain))


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def full_name(first, last, email) -> Column:
    f, l_, e = _c(first), _c(last), _c(email)
    return (F.when(_present(f) & _present(l_), F.concat(f, F.lit(" "), l_))
            .when(_present(f), f).when(_present(l_), l_)
            .otherwise(F.substring_index(e, "@", 1)))


def initials(first, last, email) -> Column:
    f, l_, e = _c(first), _c(last), _c(email)
    return (F.when(_present(f) & _present(l_), F.upper(F.concat(F.substring(f, 1, 1), F.substring(l_, 1, 1))))
            .when(_present(f), F.upper(F.substring(f, 1, 1)))
            .otherwise(F.upper(F.substring(e, 1, 1))))


def device_label(browser, os, device, has_info) -> Column:
    """'{browser} on {os} ({device})' with 'Unknown' defaults."""
    unk = F.lit("Unknown")
    label = F.format_string("%s on %s (%s)", F.coalesce(_c(browser), unk), F.coalesce(_c(os), unk),
                            F.coalesce(_c(device), unk))
    return F.when(_c(has_info), label).otherwise(F.lit("Unknown Device"))


def is_suspicious(text) -> Column:
    t = _c(text)
    hit = F.lit(False)
    for p in ATTACK_PATTERNS:
        hit = hit | t.rlike("(?i)" + p)
    return F.coalesce(hit, F.lit(False))


def matched_patterns(text) -> Column:
    """How many of the audit patterns match."""
    t = _c(text)
    return sum([F.coalesce(t.rlike("(?i)" + p), F.lit(False)).cast("int") for p in ATTACK_PATTERNS], F.lit(0))


def mask_credentials(url) -> Column:
    """scheme://user:***@host when the URL has exactly one '@' and a
    user:password part; otherwise '***'."""
    u = _c(url)
    n_at = F.size(F.split(u, "@")) - 1
    head = F.substring_index(u, "@", 1)
    host = F.substring_index(u, "@", -1)
    has_scheme = F.instr(head, "://") > 0
    scheme = F.regexp_extract(head, r"^(.*)://", 1)
    userpass = F.regexp_extract(head, r"^.*://(.*)$", 1)
    user = F.substring_index(userpass, ":", 1)
    ok = (n_at == 1) & has_scheme & (F.instr(userpass, ":") > 0)
    return F.when(ok, F.concat(scheme, F.lit("://"), user, F.lit(":***@"), host)).otherwise(F.lit("***"))


def seconds_until(ts, now) -> Column:
    return (F.unix_timestamp(_c(ts)) - F.unix_timestamp(_c(now))).cast("bigint")


def is_expired(ts, now) -> Column:
    return _c(ts) < _c(now)


def add_days(ts, days: int) -> Column:
    return _c(ts) + F.make_interval(days=F.lit(days))


def iso_text(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss")


def bytes_to_mb(b) -> Column:
    return _c(b) / F.lit(1024.0 * 1024.0)


def page_count(total, size) -> Column:
    return F.ceil(_c(total) / _c(size)).cast("bigint")


def map_to_size(v, lo, hi, min_size: float = 0.5, max_size: float = 2.0) -> Column:
    """Linear map to [min_size, max_size]; equal bounds -> midpoint."""
    v, lo, hi = _c(v), _c(lo), _c(hi)
    return F.when(hi == lo, F.lit((min_size + max_size) / 2)).otherwise(
        F.lit(min_size) + (v - lo) / (hi - lo) * F.lit(max_size - min_size))


def hsl_palette_color(i, n) -> Column:
    """hsl(i * 360 / n, 70%, 60%) (JavaScript number formatting of the hue)."""
    hue = _c(i) * 360.0 / _c(n)
    hue_txt = F.when(hue == F.floor(hue), F.floor(hue).cast("string")).otherwise(hue.cast("string"))
    return F.concat(F.lit("hsl("), hue_txt, F.lit(", 70%, 60%)"))


def _hex(h: str) -> tuple[int, int, int]:
    h = h.lstrip("#")
    return int(h[0:2], 16), int(h[2:4], 16), int(h[4:6], 16)


def interpolate_color(v, lo, hi, start: str = "#0000ff", end: str = "#ff0000") -> Column:
    """rgb(r, g, b) between two hex colours, clamped; equal bounds -> start."""
    v, lo, hi = _c(v), _c(lo), _c(hi)
    s, e = _hex(start), _hex(end)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo)))

    def ch(a, b):
        # JavaScript Math.round: half rounds up
        return F.floor(F.lit(float(a)) + F.lit(float(b - a)) * t + F.lit(0.5)).cast("int")

    rgb = F.format_string("rgb(%d, %d, %d)", ch(s[0], e[0]), ch(s[1], e[1]), ch(s[2], e[2]))
    return F.when(hi == lo, F.lit(start)).otherwise(rgb)

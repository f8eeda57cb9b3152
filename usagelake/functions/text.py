"""Scalar functions on columns: names, numbers, durations, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_model(model: Column) -> Column:
    """Model without ``claude-`` in front and a date of eight digits behind."""
    return F.regexp_replace(F.regexp_replace(model, "^claude-", ""), "^(.+)-[0-9]{8}$", "$1")


def droid_model(model: Column) -> Column:
    """Lower-cased model without ``custom:`` and ``[...]``, with single hyphens for points."""
    plain = F.regexp_replace(F.regexp_replace(model, "^custom:", ""), r"\[[^\]]*\]", "")
    hyphens = F.regexp_replace(F.replace(F.lower(plain), F.lit("."), F.lit("-")), "-{2,}", "-")
    return F.regexp_replace(hyphens, "^-+|-+$", "")


def claude_project(folder: Column) -> Column:
    """Project of a log folder named after a path with hyphens for slashes."""
    parts = F.filter(F.split(folder, "-"), lambda p: p != "")

    def after(marker: str) -> Column:
        place = F.array_position(parts, marker)
        return F.when((place > 0) & (place < F.size(parts)), F.array_join(F.slice(parts, place.cast("int") + 1, F.size(parts)), "-"))

    home = F.when((F.get(parts, F.lit(0)) == "home") & (F.size(parts) >= 3), F.array_join(F.slice(parts, 3, F.size(parts)), "-"))
    return F.coalesce(*[after(m) for m in ("git", "projects", "src", "code", "repos", "workspace")], home, F.try_element_at(parts, F.lit(-1)), F.lit("unknown"))


def claude_folder(path: Column) -> Column:
    """Folder below the deepest ``projects``."""
    return F.regexp_extract(path, "^.*/projects/([^/]+)/", 1)


def path_part(path: Column, back: int) -> Column:
    """Part of a path counted from its end: 1 is the file name, 2 its folder."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-back)), F.lit(""))


def stem(path: Column) -> Column:
    return F.regexp_replace(path_part(path, 1), r"(?<=.)\.[^.]*$", "")


def price_key(model: Column) -> tuple[Column, Column]:
    """A price list's key without its vendor prefix, and that without its version suffix."""
    bare = F.regexp_replace(model, r"^(us\.anthropic\.|eu\.anthropic\.|au\.anthropic\.|apac\.anthropic\.|global\.anthropic\.|anthropic\.|bedrock/|openai/)", "")
    return bare, F.regexp_replace(bare, r"(-v1)?:0$|-v1$", "")


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def format_duration(secs: Column) -> Column:
    hours, minutes = F.floor(secs / 3600), F.floor(secs % 3600 / 60)
    return F.when(hours > 0, F.format_string("%dh%02dm", hours, minutes)).otherwise(F.format_string("%dm", minutes))


def format_duration_short(hours: Column) -> Column:
    total = F.round(hours * 60).cast("bigint")
    d, h, m = (total / 1440).cast("bigint"), (total % 1440 / 60).cast("bigint"), total % 60  # a time that is over counts towards 0
    return (F.when((d == 0) & (h == 0), F.format_string("%dm", m)).when((d == 0) & (m == 0), F.format_string("%dh", h))
            .when(d == 0, F.format_string("%dh %dm", h, m)).when(h == 0, F.format_string("%dd", d)).otherwise(F.format_string("%dd %dh", d, h)))


#: Signs of currencies; another code stands before the amount.
SYMBOLS = {
    "USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "¥", "KRW": "₩", "INR": "₹", "BRL": "R$", "CHF": "CHF ", "CAD": "CA$",
    "AUD": "A$", "SEK": "kr ", "NOK": "kr ", "DKK": "kr ", "PLN": "zł", "CZK": "Kč ", "TRY": "₺", "THB": "฿", "MXN": "MX$", "ZAR": "R ",
}


def symbol(code: str) -> str:
    return SYMBOLS.get(code, f"{code} ")


def format_cost(cost: Column, sign: str) -> Column:
    return F.when(cost.isNull(), "N/A").otherwise(F.concat(F.lit(sign), F.format_string("%.2f", cost)))


def threshold_class(cost: Column, warn: float | None, critical: float | None) -> Column:
    out = F.lit("normal")
    if warn is not None:
        out = F.when(cost >= warn, "warning").otherwise(out)
    return F.when(cost >= critical, "critical").otherwise(out) if critical is not None else out


def tier_label(kind: Column, tier: Column) -> Column:
    plan = F.when(kind == "max", "Claude Max").when(kind == "pro", "Claude Pro").otherwise(kind)
    return F.concat(plan, F.when(tier.contains("20x"), " (20x)").when(tier.contains("5x"), " (5x)").otherwise(""))


def plan_label(plan: Column) -> Column:
    return F.when(plan == "pro", "Claude Pro").when(plan == "max5x", "Claude Max (5x)").when(plan == "max20x", "Claude Max (20x)")


def percent(pct: Column) -> Column:
    """A percentage without decimals, halves to the even number."""
    return F.concat(F.bround(pct, 0).cast("bigint").cast("string"), F.lit("%"))


def projection_text(pct: Column) -> Column:
    return F.when(pct > 100, F.concat(F.lit(">100% (~"), percent(pct), F.lit(")"))).otherwise(F.concat(F.lit("~"), percent(pct)))


def overage_text(enabled: Column, used_cents: Column, limit_cents: Column, sign: str = "$") -> Column:
    used, most = (format_cost(c.cast("double") / 100, sign) for c in (used_cents, limit_cents))
    return F.when(enabled.isNull(), "—").when(~enabled, "disabled").otherwise(F.concat_ws(" / ", used, most))


def short_org(org: Column) -> Column:
    return F.substring(org, 1, 8)

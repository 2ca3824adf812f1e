"""Column functions of one row; no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callmeter.functions import fixed

MONEY = "decimal(28,12)"


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def canonical_model(model: Column) -> Column:
    """Without what follows an @, and without a date at the end."""
    return F.regexp_replace(F.split_part(model, F.lit("@"), F.lit(1)), "-[0-9]{8}$", "")


def short_model(model: Column) -> Column:
    name = canonical_model(model)
    out = F
    for key, short in fixed.SHORT_NAMES.items():
        out = out.when(name.startswith(key), short)
    return out.otherwise(name)


def shell_commands(command: Column) -> Column:
    """Base names of the programs in a command line: parts between &&, ; and | outside quotes, without NAME=value before."""
    parts = F.regexp_extract_all(command, F.lit(r"""(?:"[^"]*"|'[^']*'|[^;|&"']++|["']|&(?!&))++|&&"""), F.lit(0))
    first = F.transform(parts, lambda p: F.regexp_extract(F.regexp_replace(p, r"^\s*(?:\w+=\S*(?:\s+|$))*", ""), r"^\s*(\S+)", 1))
    base = F.transform(first, lambda w: F.regexp_extract(w, r"([^/]+)/*$", 1))
    kept = F.filter(base, lambda b: ~b.isin("", "&&", ".", "..", "cd", "true", "false"))
    return F.coalesce(kept, F.array().cast("array<string>"))


def mcp_tools(tools: Column) -> Column:
    return F.filter(tools, lambda t: t.startswith("mcp__"))


def mcp_server(tool: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(F.split(tool, "__"), F.lit(2)), F.lit("")), tool)


def any_of(tools: Column, names: list[str]) -> Column:
    return F.arrays_overlap(tools, _literals(names))


def map_tools(tools: Column, provider: str) -> Column:
    """Display names of a provider's tools; others unchanged."""
    pairs = fixed.TOOL_MAPS.get(provider, {})
    if not pairs:
        return tools
    names = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.transform(tools, lambda t: F.coalesce(F.try_element_at(names, t), t))


def keyword_pattern(group: str) -> str:
    """A word of the group, ASCII case-insensitive, between ASCII word boundaries."""
    return "(?i)(?<![A-Za-z0-9_])(?:" + "|".join(fixed.KEYWORDS[group]) + ")(?![A-Za-z0-9_])"


def has_keyword(message: Column, group: str) -> Column:
    return message.rlike(keyword_pattern(group))


def local_day(ts_raw: Column) -> Column:
    """Day in the session's time zone: with an offset as it says, without one as UTC, else the first ten characters."""
    with_offset = F.when(ts_raw.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(ts_raw))
    plain = F.try_to_timestamp(F.concat(F.substring(ts_raw, 1, 19), F.lit("Z")))
    return F.coalesce(F.date_format(F.coalesce(with_offset, plain), "yyyy-MM-dd"), F.substring(ts_raw, 1, 10))


def instant(ts_raw: Column) -> Column:
    with_offset = F.when(ts_raw.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(ts_raw))
    return F.coalesce(with_offset, F.try_to_timestamp(F.concat(F.substring(ts_raw, 1, 19), F.lit("Z"))))


def epoch_to_ts(n: Column) -> Column:
    """Below 1e12 seconds, else milliseconds."""
    return F.timestamp_millis(F.when(n < 10**12, n * 1000).otherwise(n))


def project_path(project: Column) -> Column:
    return F.translate(project, "-", "/")


def short_project(path: Column, home: str = "") -> Column:
    """Without the home directory, the last three components."""
    inside = (path == home) | path.startswith(home.rstrip("/") + "/")
    own = F.when(inside, F.substr(path, F.lit(len(home) + 1))).otherwise(path) if home else path
    parts = F.filter(F.split(own, "/"), lambda x: x != "")
    return F.array_join(F.when(F.size(parts) > 3, F.slice(parts, -3, 3)).otherwise(parts), "/")


def sanitize_project(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, "^/+", ""), "/", "-")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


#: Names behind which projects can be hidden.
STAND_INS = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "haven", "inlet", "jasper", "krill", "lotus", "maple", "north", "onyx", "pearl", "quartz", "raven", "slate", "tundra", "umber", "vale", "willow", "xenon", "yarrow", "zephyr"]


def pseudonym(project: Column) -> Column:
    """A name that follows from the md5 of the project: one of STAND_INS by its first eight digits, then two more digits."""
    h = F.md5(project.cast("binary"))
    n = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    return F.concat(F.element_at(_literals(STAND_INS), (F.pmod(n, F.lit(len(STAND_INS))) + 1).cast("int")), F.lit("-"), F.substring(h, 9, 2))


def csv_safe(value: Column) -> Column:
    """A leading = + - @ is preceded by a quote mark; commas, quotes and line breaks lead to a quoted value."""
    safe = F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
    return F.when(safe.rlike("[,\"\n\r]"), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def format_cost(cost: Column, symbol: Column | str = "$") -> Column:
    c, s = cost.cast("double"), F.lit(symbol) if isinstance(symbol, str) else symbol
    return F.when(c >= 1, F.format_string("%s%.2f", s, c)).when(c >= 0.01, F.format_string("%s%.3f", s, c)).otherwise(F.format_string("%s%.4f", s, c))


def convert_cost(cost: Column, rate: Column) -> Column:
    return F.round(cost * rate, 2)


def cost_header(code: str) -> str:
    return f"Cost ({code})"


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def format_number(n: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(n, 0)


def valid_currency(code: Column) -> Column:
    return code.rlike("^[A-Z]{3}$")


def currency_symbol(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in fixed.SYMBOLS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, code), code)


def one_shot_pct(one_shot: Column, edit_turns: Column) -> Column:
    return F.when(edit_turns > 0, F.round(one_shot * 100.0 / edit_turns, 0).cast("int"))


def cache_hit_pct(cache_read: Column, input_tokens: Column, cache_write: Column) -> Column:
    return F.coalesce(cache_read * 100.0 / F.nullif(input_tokens + cache_read + cache_write, F.lit(0)), F.lit(0.0))

"""Scalar functions as column expressions."""

from __future__ import annotations

import html

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400

# Languages by file extension.
LANGUAGES = {
    "rs": "rust",
    "py": "python",
    "pyi": "python",
    "go": "go",
    "js": "js",
    "jsx": "js",
    "mjs": "js",
    "cjs": "js",
    "ts": "ts",
    "mts": "ts",
    "cts": "ts",
    "tsx": "tsx",
}

# Upper bounds of age buckets in days; the last bucket has none.
AGE_BOUNDS = (30, 90, 365, 730, 1825)

# Unicode white space as a trim removes it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 (UTC), rounded down; takes timestamps of either kind."""
    return F.unix_seconds(col(ts).cast("timestamp"))


def from_seconds(s: Column | str) -> Column:
    return F.timestamp_seconds(col(s))


def normalized_email(c: Column | str) -> Column:
    return F.lower(F.trim(col(c)))


def display_name(name: Column | str, email: Column | str) -> Column:
    return F.coalesce(F.nullif(col(name), F.lit("")), col(email))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def top_directory(path: Column | str) -> Column:
    """First segment of a path that has a folder; the empty text for others."""
    return F.when(F.instr(col(path), "/") > 0, F.split_part(col(path), F.lit("/"), F.lit(1))).otherwise(F.lit(""))


def language(path: Column | str) -> Column:
    """By the text after the last dot of the last segment, as it is written; null if it is none of the known."""
    extension = F.regexp_extract(basename(path), r"\.([^.]*)$", 1)
    return F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.nullif(extension, F.lit(""))]


def lines_of_code(text: Column | str) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(col(text), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")).cast("bigint")


def per_loc(value: Column | str, loc: Column | str) -> Column:
    return F.when(col(loc) > 0, col(value) / col(loc)).otherwise(F.lit(0.0))


def age_days(anchor: Column | str, committed: Column | str) -> Column:
    """Whole days from ``committed`` to ``anchor`` (seconds), none for what is later."""
    return F.floor(F.greatest(col(anchor) - col(committed), F.lit(0)) / DAY).cast("bigint")


def age_bucket(days: Column | str, inclusive: bool = False) -> Column:
    """Number of the age bucket; ``inclusive``: a bound belongs to the bucket below it (as in the interactive view), else above it (as in the page)."""
    out = F.lit(len(AGE_BOUNDS))
    for k in reversed(range(len(AGE_BOUNDS))):
        out = F.when(col(days) <= AGE_BOUNDS[k] if inclusive else col(days) < AGE_BOUNDS[k], F.lit(k)).otherwise(out)
    return out.cast("bigint")


def percent_text(ratio: Column | str) -> Column:
    """Whole percents, halves away from zero."""
    return F.concat(F.round(col(ratio) * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def two_decimals(x: Column | str) -> Column:
    return F.format_string("%.2f", col(x).cast("double"))


def shorten(text: Column | str, n: int, keep: str = "head") -> Column:
    """At most ``n`` characters, an ellipsis in place of the cut end (``head``) or beginning (``tail``)."""
    c = col(text)
    short = F.concat(F.substring(c, 1, n - 1), F.lit("…")) if keep == "head" else F.concat(F.lit("…"), F.substring(c, -(n - 1), n - 1))
    return F.when(F.length(c) > n, short).otherwise(c)


def escape_html(text: Column | str) -> Column:
    out = col(text)
    for c in "&<>\"'":
        out = F.replace(out, F.lit(c), F.lit({"'": "&#39;"}.get(c) or html.escape(c)))
    return out


def is_binary(content: Column | str) -> Column:
    """A zero byte among the first 8000."""
    return F.instr(F.decode(F.substring(col(content), 1, 8000), "ISO-8859-1"), "\0") > 0


def saturating_product(a: Column | str, b: Column | str) -> Column:
    """The product as bigint, held at the largest one."""
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    return F.least(F.coalesce(F.try_multiply(col(a).cast("decimal(19,0)"), col(b).cast("decimal(19,0)")), top), top).cast("bigint")


def min_max(x: Column | str, low: Column, high: Column) -> Column:
    """0 to 1 between the bounds; 0.5 where they are equal."""
    c = col(x)
    return F.when(high > low, (c - low) / F.nullif(high - low, F.lit(0))).otherwise(F.lit(0.5))


def risk_value(bus_factor: Column | str, top_ratio: Column | str) -> Column:
    return col(bus_factor) + (1 - col(top_ratio))


def risk_color(value: Column | str) -> Column:
    """1 for the worst, 0 for the best: falls over values from 1 to 4."""
    return 1 - F.least(F.greatest((col(value) - 1) / 3, F.lit(0.0)), F.lit(1.0))


def skip_reason(reason: Column | str, cost: Column | str, budget: Column | str) -> Column:
    """A sentence for a file that was left out."""
    over = F.format_string("over budget: about %d line-revisions, the budget is %d", col(cost), col(budget))
    return F.when(col(reason) == "over_budget", over).when(col(reason) == "failed", F.lit("line attribution failed")).otherwise(col(reason))


def short_sha(sha: Column | str) -> Column:
    return F.substring(col(sha), 1, 12)


def date_text(ts: Column | str) -> Column:
    return F.date_format(col(ts).cast("timestamp"), "MMM d, yyyy")


def recency(index: Column | str, last_touch: Column | str) -> Column:
    """1 for what was just touched, falling to 0; 1 throughout at the beginning."""
    i = col(index)
    value = 1 - (i - col(last_touch)) / F.nullif(i + 1, F.lit(0))
    return F.when(i <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))


def exclude_pattern(globs: list[str] | tuple[str, ...]) -> str:
    """A regular expression for paths that match one of the globs; ``*`` and ``?`` also cross ``/``."""
    out = []
    for glob in globs:
        own, i = "", 0
        while i < len(glob):
            c = glob[i]
            if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
                own, i = own + "(?:.*/)?", i + 3
                continue
            if c == "*":
                while i + 1 < len(glob) and glob[i + 1] == "*":
                    i += 1
                own += ".*"
            elif c == "?":
                own += "."
            elif c == "[" and (end := glob.find("]", i + 2)) > 0:
                inner = glob[i + 1 : end].replace("\\", "\\\\")
                own, i = own + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end
            elif c == "{" and (end := glob.find("}", i)) > 0:
                own, i = own + "(?:" + "|".join(exclude_pattern([x])[4:-2] for x in glob[i + 1 : end].split(",")) + ")", end
            elif c == "\\" and i + 1 < len(glob):
                own, i = own + "\\" + glob[i + 1], i + 1
            else:
                own += c if c.isalnum() or c in "/_-" else "\\" + c
            i += 1
        out.append(own)
    return "^(?:" + "|".join(out) + ")$" if out else "^(?!)"

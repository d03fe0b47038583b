"""Text functions as column expressions. Lengths are bytes; trimming is of Unicode white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import constants as K


def trim_u(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final newline opens no line, and an empty text has none."""
    parts = F.split(c, "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, r"\r$", ""))


def contains_any(c: Column, marks) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | c.contains(m)
    return hit


def starts_any(c: Column, marks) -> Column:
    hit = F.lit(False)
    for m in marks:
        hit = hit | c.startswith(m)
    return hit


def handle(c: Column) -> Column:
    """The first 16 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(c, 256), 1, K.HANDLE_CHARS)


def line_key(c: Column) -> Column:
    return handle(trim_u(c))


def strip_ansi(c: Column) -> Column:
    """Drops escape sequences up to their letter; an unfinished one swallows the rest."""
    return F.regexp_replace(c, "\u001b\\[[^A-Za-z]*([A-Za-z]|\\z)", "")


def strip_tags(c: Column) -> Column:
    """What lies outside of `<` and `>`: stray `>` go, an unclosed `<` swallows the rest."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), ">", ""), "(?s)<.*$", "")


def token_estimate(n_bytes: Column, kind: str = "mixed") -> Column:
    return F.ceil(n_bytes / F.lit(K.BYTES_PER_TOKEN[kind]))


def savings_pct(n_in: Column, n_out: Column) -> Column:
    return F.when(n_in > 0, (1 - n_out / n_in) * 100).otherwise(F.lit(0.0))


def is_meaningful(n_in: Column, n_out: Column) -> Column:
    return n_out < n_in * K.MEANINGFUL


def gains(n_in: Column, n_out: Column) -> Column:
    """Large enough, and strictly shorter."""
    return (n_in >= K.MIN_GAIN_INPUT) & (n_out < n_in)


def beats_guardrail(n_in: Column, n_out: Column) -> Column:
    return n_out < F.floor(n_in * K.MIN_REDUCTION_PCT / 100)


def shorten_command(c: Column) -> Column:
    """The first two words, 18 characters at most."""
    return F.substring(F.array_join(F.slice(F.filter(F.split(c, r"\s+"), lambda x: x != ""), 1, 2), " "), 1, 18)


def strip_assignments(c: Column) -> Column:
    """A command without the NAME=value words before it."""
    return F.regexp_replace(c, r"^\s*(?:[A-Za-z0-9_]+=\S*\s+)*", "")


def program_name(c: Column) -> Column:
    """The last path segment of a command's first word, without quotes."""
    return F.regexp_extract(F.regexp_replace(strip_assignments(c), "[\"']", ""), r"^(?:\S*/)?([^\s/]*)", 1)


def source_label(c: Column) -> Column:
    """A text's first line with runs of spaces and controls as one space, 40 characters at most."""
    return F.substring(trim_u(F.regexp_replace(F.split(c, "\n")[0], r"[\s\p{Cntrl}]+", " ")), 1, 40)


def file_paths(c: Column) -> Column:
    """Distinct words of a text that look like paths with an extension."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9_./\-]+\.(?:rs|py|js|ts|go|java))\b"), F.lit(1)))


def human_bytes(c: Column) -> Column:
    """B below 1024, then KB, MB and GB with one decimal."""
    small = F.when(c < 1024, F.format_string("%d B", c)).when(c < 1 << 20, F.format_string("%.1f KB", c / 1024.0))
    return small.when(c < 1 << 30, F.format_string("%.1f MB", c / 1048576.0)).otherwise(F.format_string("%.1f GB", c / 1073741824.0))


def age(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.lit("just now")).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago"))).otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def trim_enormous(c: Column) -> Column:
    """Texts over 2,000,000 bytes and 6,000 lines: the first 5,000 lines and the last 1,000."""
    own = lines(c)
    cut = F.array_join(F.concat(F.slice(own, 1, 5000), F.slice(own, F.greatest(F.size(own) - 999, F.lit(1)), F.lit(1000))), "\n")
    return F.when((F.octet_length(c) > 2_000_000) & (F.size(own) > 6000), cut).otherwise(c)


def safe_slice(c: Column, most: int) -> Column:
    """A text's first `most` bytes, without a character that is cut: each byte from 80 to BF belongs to the one before it."""
    raw = F.encode(c, "UTF-8")
    byte = lambda k: F.conv(F.hex(F.substring(raw, k, F.lit(1))), 16, 10).cast("int")
    inside = lambda k: (byte(k) >= 128) & (byte(k) < 192)
    # A character has three bytes after its first: the cut goes back while the byte behind it is one of those.
    end = F.when(~inside(F.lit(most + 1)), most).when(~inside(F.lit(most)), most - 1).when(~inside(F.lit(most - 1)), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(c) > most, F.decode(F.substring(raw, F.lit(1), end), "UTF-8")).otherwise(c)


#: What a file's ending says of its content.
HINTS = {
    "code": ("rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "kt", "c", "cpp", "h", "hpp", "cs", "php", "ruby", "rb"), "json": ("json", "toml", "yaml", "yml"), "build_log": ("log",), "prose": ("md", "txt"),
}


def content_hint(path: Column) -> Column:
    """What a token estimate should take a file for."""
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    out = F.when(F.lit(False), "mixed")
    for hint, endings in HINTS.items():
        out = out.when(ending.isin(*endings), hint)
    return out.otherwise("mixed")


def truncated(c: Column, most: int) -> Column:
    """A text cut to `most` bytes and three dots, or as it is."""
    return F.when(F.octet_length(c) > most, F.concat(safe_slice(c, most), F.lit("..."))).otherwise(c)


def columns_truncated(c: Column, most: int) -> Column:
    """A text cut to `most` columns of a terminal and three dots: wide letters take two, marks none."""
    wide = "\u1100-\u115f\u2e80-\u303e\u3041-\u33ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6\\x{1f300}-\\x{1f64f}\\x{1f900}-\\x{1f9ff}\\x{20000}-\\x{3fffd}"
    width = lambda x: F.when(x.rlike(r"^[\p{Mn}\p{Me}\p{Cf}\p{Cc}]$"), 0).when(x.rlike(f"^[{wide}]$"), 2).otherwise(1)
    each = F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"), F.lit(False).alias("over"))
    walked = F.aggregate(each, start, lambda s, x: F.when(s["over"] | (s["at"] + width(x) > most), F.struct(s["at"], s["kept"], F.lit(True).alias("over"))).otherwise(
        F.struct((s["at"] + width(x)).alias("at"), F.concat(s["kept"], x).alias("kept"), F.lit(False).alias("over"))))
    return F.when(walked["over"], F.concat(walked["kept"], F.lit("..."))).otherwise(c)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def bar(pct: Column, width: int = 20) -> Column:
    """A bar of so many marks, filled to a percentage."""
    full = F.least(F.round(pct / 100 * width), F.lit(width)).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full))

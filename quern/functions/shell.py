"""Shell commands as text: quote-aware splits by one regular expression each, and sensitive assignments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import strip_assignments

_QUOTED = r"'[^']*(?:'|\z)|`[^`]*(?:`|\z)|\\(?s:.)"
#: What a command between separators is made of: quotes (closed or not), escapes, other characters.
SEQUENTIAL = r'(?:"(?:\\(?s:.)|[^"\\])*(?:"|\z)|' + _QUOTED + r"|(?<!&)&(?!&)|(?<!\|)\|(?!\|)|[^\"'`\;\n&|])+"
PIPELINE = r'(?:"[^"]*(?:"|\z)|' + _QUOTED + r"|[^\"'`\\|])+"

#: Commands without output, words that open a clause, and programs that reshape or filter what they read.
SILENT = (
    "cd", "export", "set", "unset", "source", ".", "true", "false", "pushd", "popd", "umask", "alias", "shift", "local", "readonly", "exit", "return", "break", "continue", "wait", "trap",
    "shopt", "declare", "typeset", "let", "[", "[[", "test", ":", "done", "fi", "esac", "then", "else",
)
CLAUSES = ("do", "then", "else", "elif", "while", "until", "if")
HEADERS = ("for", "select", "case")
TAILS = ("grep", "rg", "ag", "jq", "yq", "cut", "tr", "awk", "base64", "wc", "column", "xargs", "uniq")


def _parts(command: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(command, F.lit(pattern), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def split_sequential(command: Column) -> Column:
    """Commands between newlines, `;`, `&&` and `||` that no quote holds."""
    return _parts(command, SEQUENTIAL)


def split_pipeline(command: Column) -> Column:
    """Stages between `|` that no quote holds."""
    return _parts(command, PIPELINE)


def _word(c: Column, k: int) -> Column:
    return F.coalesce(F.get(F.filter(F.split(c, r"\s+"), lambda x: x != ""), F.lit(k)), F.lit(""))


def is_silent(segment: Column) -> Column:
    """Assignments alone, headers of loops, and builtins, after a word that opens a clause."""
    bare = F.trim(strip_assignments(F.concat(segment, F.lit(" "))))
    own = F.when(_word(bare, 0).isin(*CLAUSES), _word(bare, 1)).otherwise(_word(bare, 0))
    return (own == "") | own.isin(*SILENT, *HEADERS)


def sole_output_command(command: Column) -> Column:
    """The one command of a line whose output is seen, or null: its last stage if that reshapes or filters."""
    segments = split_sequential(command)
    loud = F.when(F.size(segments) == 1, segments).otherwise(F.filter(segments, lambda s: ~is_silent(s)))
    producer = F.when(F.size(loud) == 1, strip_assignments(F.element_at(loud, 1)))
    last = F.element_at(split_pipeline(producer), -1)
    return F.when(F.regexp_replace(_word(last, 0), "[\"']", "").isin(*TAILS), last).otherwise(producer)


#: What makes a variable's name sensitive. A final _ asks for the first segment, an inner one for segments in a row.
SENSITIVE = (
    "SECRET", "TOKEN", "KEY", "PASSWORD", "PASSWD", "PASS", "AUTH", "CREDS", "CREDENTIAL", "CREDENTIALS", "API_", "AWS_", "GITHUB_", "ANTHROPIC_", "DATABASE_URL", "REDIS_URL", "MONGO_URL",
    "CLIENT_SECRET", "ACCESS_KEY", "OPENAI_", "GEMINI_", "PRIVATE_KEY",
)
ASSIGNMENT = r"^\s*(?:export\s+)?([A-Za-z0-9_]+)=(.*)$"
MASK = "[redacted]"


def _sensitive(name: Column, patterns) -> Column:
    """name: upper case, one _ before and after, none doubled."""
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("_"):
            hit = hit | name.startswith(f"_{p}")
        elif "_" in p:
            hit = hit | name.contains(f"_{p}_")
        else:
            hit = hit | name.contains(f"{p}_")  # a segment that ends with it
    return hit


def redact_line(line: Column) -> Column:
    """An assignment to a sensitive name without its value.

    Kept: a plain lower-case identifier where only KEY made the name sensitive, a count in a
    bare PASS, and code in braces.
    """
    name, value = F.upper(F.regexp_extract(line, ASSIGNMENT, 1)), F.trim(F.regexp_extract(line, ASSIGNMENT, 2))
    padded = F.regexp_replace(F.concat(F.lit("_"), name, F.lit("_")), "_+", "_")
    bare = F.regexp_replace(value, "^[\"']+|[\"']+$", "")
    only_key = ~_sensitive(padded, [p for p in SENSITIVE if p != "KEY"])
    plain = bare.rlike(r"^[a-z0-9][a-z0-9._\-]*$") & (F.length(bare) < 40)
    kept = (only_key & plain) | ((name == "PASS") & bare.rlike(r"^\d+(/\d+)?$")) | value.startswith("{") | (value == "")
    secret = (name != "") & _sensitive(padded, SENSITIVE) & ~kept
    return F.when(secret, F.concat(F.regexp_extract(line, r"^(\s*(?:export\s+)?[A-Za-z0-9_]+=)", 1), F.lit(MASK))).otherwise(line)


def head_tail(max_bytes: int, tail_share: int = 5):
    """A long text's beginning and end at line breaks, a fifth for the end, and a marker between."""

    def one(t: str | None) -> str | None:
        if t is None or len(t) * 4 <= max_bytes:
            return t
        raw = t.encode()
        if len(raw) <= max_bytes:
            return t
        tail = max_bytes // tail_share
        head_end = raw.rfind(b"\n", 0, max_bytes - tail) + 1
        found = raw.rfind(b"\n", 0, len(raw) - tail)
        tail_start = found + 1 if found >= 0 else len(raw)
        if head_end == 0 or tail_start <= head_end:
            kept = raw[:max_bytes].decode(errors="ignore")
            return f"{kept}\n[cut: {len(kept.encode())} of {len(raw)} bytes kept]\n"
        count = lambda b: b.count(b"\n") + (not b.endswith(b"\n") and b != b"")
        total, dropped = count(raw), count(raw[head_end:tail_start])
        return raw[:head_end].decode() + f"[cut: {total - dropped} of {total} lines kept, {dropped} dropped from the middle]\n" + raw[tail_start:].decode()

    @F.pandas_udf("string")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(one)

    return cut

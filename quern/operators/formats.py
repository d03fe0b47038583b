"""What a payload is: JSON, NDJSON, YAML, TSV, CSV or plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions.text import lines, trim_u

#: Shapes of a YAML line and of a key that opens a block scalar.
YAML_LINE = r"""^\s*(?:"[^"]*"|'[^']*'|[A-Za-z_][A-Za-z0-9_.\-/]*)\s*:(?:\s.*|)$"""
BLOCK_SCALAR = r"^\s*\S+\s*:\s*[|>][0-9]*[-+]?\s*$"


def _bracketed(c: Column) -> Column:
    return (c.startswith("{") & c.endswith("}")) | (c.startswith("[") & c.endswith("]"))


def _parses(c: Column) -> Column:
    """Whether a text is one JSON value and nothing more: the parser alone would take a value with anything after it."""
    alone = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return alone.isNotNull() & F.try_variant_get(alone, "$[1]", "variant").isNull()


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _delimited(own: Column, mark: str) -> Column:
    counts = F.transform(own, lambda x: F.size(F.split(x, mark)) - 1)
    return (F.size(own) >= K.MIN_DELIMITED) & (F.element_at(counts, 1) > 0) & (F.size(F.array_distinct(counts)) == 1)


def _yaml(own: Column) -> Column:
    first = F.regexp_replace(F.element_at(own, 1), r"\s+$", "")

    def shaped(x: Column) -> Column:
        t = trim_u(x)
        return t.startswith("#") | t.isin("---", "...", "-") | t.startswith("- ") | x.rlike(YAML_LINE)

    def indent(x: Column) -> Column:
        return F.length(x) - F.length(F.regexp_replace(x, r"^\s+", ""))

    # The lines of a block scalar are deeper than the key that opens it; `inside` holds its indent.
    start = F.struct(F.lit(True).alias("ok"), F.lit(None).cast("int").alias("inside"))
    walked = F.aggregate(own, start, lambda s, x: F.when(s["inside"].isNotNull() & (indent(x) > s["inside"]), s).otherwise(
        F.struct((s["ok"] & shaped(x)).alias("ok"), F.when(x.rlike(BLOCK_SCALAR), indent(x)).alias("inside"))))
    structured = F.exists(own, lambda x: x.startswith(" ") | F.regexp_replace(x, r"^\s+", "").startswith("- "))
    # The first line can't be inside a scalar; that and the indents, which are cheap, are asked before all lines are walked.
    return (first == "---") | first.startswith("--- ") | ((F.size(own) >= 2) & shaped(F.element_at(own, 1)) & structured & walked["ok"])


def sniff(text: Column) -> Column:
    """The format of a payload, or null: the first that fits."""

    def judge(v: Column) -> Column:
        c, own = v["c"], v["own"]
        ndjson = (F.size(own) >= 2) & F.forall(own, lambda x: x.startswith("{") | x.startswith("[")) & F.forall(F.slice(own, 1, K.NDJSON_SAMPLE), _parses)
        return (
            F.when(c == "", None).when(_bracketed(c) & ((F.octet_length(c) > K.MAX_PARSE_BYTES) | ((F.size(own) < 2) | ~ndjson) & _parses(c)), "json")
            .when(ndjson, "ndjson").when(_bracketed(c) & c.rlike(r'"[^"]*"\s*:'), "json").when(_yaml(v["full"]), "yaml")
            .when(_delimited(own, "\t"), "tsv").when(_delimited(own, ","), "csv")
        )

    def with_lines(c: Column) -> Column:
        full = F.filter(lines(c), lambda x: x.rlike(r"(?U)\S"))
        return _let(full, lambda f: F.struct(c.alias("c"), f.alias("full"), F.transform(f, lambda x: trim_u(x)).alias("own")))

    return _let(_let(trim_u(text), with_lines), judge)

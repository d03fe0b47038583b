"""What may be done with a payload: which program made it, whether it must stay as it is, which form is delivered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import rules, shell, text
from quern.operators import routing
from quern.operators.lines import fidelity

#: A word of a shell command: quoted parts, escapes and other characters without a gap; and such a part alone.
_PART = r"""'[^']*(?:'|\z)|"(?:\\(?s:.)|[^"\\])*(?:"|\z)|`(?:\\(?s:.)|[^`\\])*(?:`|\z)|\\(?s:.)|[^\s'"`\\]+"""
WORD = f"(?:{_PART})+"
MAX_WORDS = 8

#: Programs whose output is a listing, a file's content, another program's, or data for a next step.
VERBATIM = ("ls", "tree", "find", "ps", "df", "du", "stat", "wc", "python", "python3", "ruby", "make", "cat", "head", "tail", "sed", "awk", "grep", "rg", "ag")
RESHAPING = ("jq", "yq", "cut", "tr", "awk", "base64", "wc", "column", "xargs", "uniq")
#: Output formats that a next step parses.
FORMATS = "tsv|json|jsonc|yaml|name|jsonpath|go-template|custom-columns"
#: How much a program says of a chain's output.
TEST_RUNNERS = ("pytest", "jest", "vitest", "rspec", "phpunit", "playwright")
BUILDERS = ("cargo", "make", "cmake", "go", "mvn", "gradle")
CLOUD = ("docker", "kubectl", "terraform", "helm")
FILTERS = ("grep", "rg", "awk", "sed")
MOVES = ("cd", "ls", "cat", "echo", "true", "false")


def split_words(command: Column, most: int = MAX_WORDS) -> Column:
    """The first words of a command as a shell sees them, without quotes and escapes."""

    def bare(word: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(word, F.lit(_PART), F.lit(0)), lambda p: F.when(p.startswith("'"), F.regexp_replace(p, r"^'|'\z", "")).otherwise(
            F.regexp_replace(F.regexp_replace(p, r"""^["`]|(?<!\\)["`]\z""", ""), r"\\((?s:.))", "$1")))
        return F.array_join(parts, "")

    return F.slice(F.filter(F.transform(F.regexp_extract_all(command, F.lit(WORD), F.lit(0)), bare), lambda x: x != ""), 1, most)


def base_executable(command: Column) -> Column:
    """The file name of the first word that is no assignment and no wrapper; empty if there is none."""
    own = F.filter(split_words(command), lambda w: ~w.isin("env", "command") & ~w.rlike("^[A-Za-z0-9_]+="))
    return F.regexp_extract(F.coalesce(F.get(own, F.lit(0)), F.lit("")), "([^/]*)$", 1)


def cargo_subcommand(command: Column) -> Column:
    """The word after `cargo` that is no flag and no toolchain, or null."""
    m = F.regexp_extract(command, r"""(?:^|\s)["'`]?(?:[^\s"'`]*/)?cargo(?:\.exe)?["'`]?((?:\s+[-+]\S*)*)\s+([^\s+-]\S*)""", 2)
    return F.when(m != "", m)


def producer_label(command: Column) -> Column:
    """The program that an output is booked under: of the one command that shows it, else of the first that isn't silent."""
    first = F.get(F.filter(shell.split_sequential(command), lambda s: ~shell.is_silent(s)), F.lit(0))
    return text.program_name(F.coalesce(shell.sole_output_command(command), first, command))


def specificity(command: Column) -> Column:
    bare = text.strip_assignments(command)
    base = F.regexp_extract(F.regexp_replace(F.get(F.split(bare, r"\s+"), F.lit(0)), "^[\"']+|[\"']+$", ""), "([^/]*)$", 1)
    tests = base.isin("cargo", "go", "npm") & F.lower(bare).contains("test")
    return F.when(base.isin(*TEST_RUNNERS), 100).when(tests, 95).when(base.isin(*BUILDERS), 80).when(base.isin(*CLOUD), 75).when(base.isin(*FILTERS), 60).when(base.isin(*MOVES), 10).otherwise(50)


def most_specific(command: Column) -> Column:
    """The command of a chain that says most of its output; the last of equal ones."""
    parts = F.filter(F.transform(F.split(command, "[|&;]"), lambda s: F.trim(s)), lambda s: s != "")
    scored = F.transform(parts, lambda s, k: F.struct(specificity(s).alias("score"), k.alias("k"), text.strip_assignments(s).alias("said")))
    return F.coalesce(F.array_max(scored)["said"], F.lit(""))


def chain_profile(command: Column) -> Column:
    """(segmentation, collapse) of a chain's most specific command."""
    said = most_specific(command)
    return F.struct(rules.segmentation(said).alias("segmentation"), rules.collapse_mode(said).alias("collapse"))


def _words(command: Column) -> Column:
    return F.filter(F.split(command, r"\s+"), lambda w: w != "")


def names_format(command: Column) -> Column:
    """Whether a command asks for output that a next step parses."""
    return command.rlike(rf"""(?:^|\s)(?:-o|--output)(?:=|\s+)["']*(?:{FORMATS})(?:["']*(?:\s|$)|=)""")


def git_enumerates(command: Column) -> Column:
    return command.rlike(r"(?:^|\s)--(?:stat|numstat|shortstat|name-only|name-status)(?:\s|$)")


def _first(command: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.coalesce(F.get(_words(command), F.lit(0)), F.lit("")), '^"+|"+$', ""), "([^/]*)$", 1)


def lists_containers(command: Column) -> Column:
    return _first(command).isin("docker", "podman") & command.rlike(r'^\s*\S+\s+"?(?:ps"?(?:\s|$)|container"?\s+"?(?:ls|ps)"?(?:\s|$))')


def lists_names(command: Column) -> Column:
    """Listings of a cluster that have no columns."""
    by_flag = command.rlike(r"(?:^|\s)(?:(?:-o|--output)\s+name|-oname|--output=name)(?:\s|$)")
    by_verb = command.rlike(r"^\s*\S+\s+(?:api-resources|api-versions|config\s+(?:get-contexts|get-clusters|get-users))(?:\s|$)")
    return (_first(command) == "kubectl") & (by_flag | by_verb)


def wraps_another(command: Column) -> Column:
    """Whether the output belongs to a program that runs inside."""
    base = _first(command)
    inside = base.isin("kubectl", "docker", "podman") & command.rlike(r"(?:^|\s)(?:exec|run)(?:\s|$)")
    return (base == "ssh") | inside | ((base == "az") & command.contains("command invoke"))


def passes_verbatim(command: Column) -> Column:
    base = base_executable(command)
    bare_env = (base == "") & F.exists(_words(command), lambda w: w == "env")
    return (
        base.isin(*VERBATIM, *RESHAPING) | names_format(command) | bare_env | ((base == "git") & git_enumerates(command)) | lists_containers(command) | lists_names(command) | wraps_another(command)
    )


#: The name under which this engine's own commands run.
OWN = "quern"


def own_recovery(command: Column) -> Column:
    """Whether a command hands archived bytes back: this engine's `retrieve` or `diff`, after any flags."""
    return command.rlike(rf"(?:^|\s)(?:\S*[/\\])?{OWN}(?:\.exe)?(?:\s+-\S*)*\s+(?:retrieve|diff)(?:\s|$)")


def already_processed(content: Column) -> Column:
    """Whether a text has a marker of this engine on a line of its own."""
    return F.exists(text.lines(content), lambda x: F.regexp_replace(x, r"(?U)^\s+", "").startswith(K.MARKER.rstrip()))


def has_json_line(content: Column) -> Column:
    """Whether a whole line is a JSON object or array."""

    def whole(line: Column) -> Column:
        t = text.trim_u(line)
        bracketed = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
        value = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return bracketed & value.isNotNull() & F.try_variant_get(value, "$[1]", "variant").isNull()

    return F.exists(text.lines(content), whole)


def reason(payloads: DataFrame) -> DataFrame:
    """payloads (agent_id, command, content, stdout, failed, format) with `passed` and `reason`: why one stays as it is, null if it doesn't.

    A failed command stays as it is without a reason on record.
    """
    capped = (F.col("agent_id") == "claude_code") & (F.octet_length("stdout") >= K.HOST_OUTPUT_CAP)
    why = routing.passthrough_reason(own_recovery(F.col("command")), F.col("format"), F.coalesce(capped, F.lit(False)), F.lit(True), F.lit(True))
    return payloads.withColumn("reason", F.when(~F.col("failed"), why)).withColumn("passed", F.col("failed") | F.col("reason").isNotNull())


def with_fallback(distilled: Column, collapsed: Column, content: Column, command: Column) -> Column:
    """The distilled form, or the collapsed one if that misses the guardrail and the command isn't verbatim."""
    short = text.beats_guardrail(F.octet_length(content), F.octet_length(distilled))
    return F.when(~short & ~passes_verbatim(command), collapsed).otherwise(distilled)


def delivered(payloads: DataFrame, keep: float, soft: float) -> DataFrame:
    """payloads (content, final, archived) with `route`, `out`, `reason`: what a reader gets.

    A form that lost the failure, or that saves less than a tenth without having masked
    anything, gives way to the content. A shorter form that stays gets a marker with the handle
    of the archived content, if it is shorter with it; archived says whether that worked.
    """
    n = lambda c: F.octet_length(c)
    content = F.col("content")
    rows = payloads.withColumn("_true", fidelity(content, F.col("final"))).withColumn("_out", F.when(F.col("_true"), F.col("final")).otherwise(content))
    share = 1 - n(F.col("_out")) / F.greatest(n(content), F.lit(1))
    rows = rows.withColumn("_route", F.when(share >= keep, "Keep").when(share >= soft, "Soft").otherwise("Passthrough"))
    partial = (F.col("_route") == "Soft") & (F.size(text.lines(F.col("final"))) <= F.size(text.lines(content)))
    rows = rows.withColumn("_out", F.when(partial, F.concat("_out", F.lit("\n[Partial signal]\n"))).otherwise(F.col("_out")))
    masked = F.col("_out").contains(shell.MASK) & ~content.contains(shell.MASK)
    rows = rows.withColumn("_below", ~masked & (n(F.col("_out")) >= F.floor(n(content) * 9 / 10)))
    rows = rows.withColumn("_route", F.when(F.col("_below"), "Passthrough").otherwise(F.col("_route"))).withColumn("_out", F.when(F.col("_below"), content).otherwise(F.col("_out")))
    mark = F.concat(F.lit(f"\n{K.MARKER}"), n(content).cast("string"), F.lit(" bytes, see "), text.handle(content), F.lit("]"))
    marked = (F.col("_route") != "Passthrough") & (n(F.col("final")) < n(content))
    fits = n(F.col("_out")) + n(mark) < n(content)
    rows = rows.withColumn("_mark", mark).withColumn("_marked", marked).withColumn("_fits", fits)
    return rows.withColumns({
        "route": F.when(F.col("_marked") & ~F.col("_fits"), "Passthrough").when(F.col("_marked") & F.col("archived"), "Rewind").otherwise(F.col("_route")),
        "out": F.when(F.col("_marked"), F.when(F.col("_fits"), F.concat("_out", "_mark")).otherwise(content)).otherwise(F.col("_out")),
        "reason": F.when(~F.col("_true"), "would have dropped the failure").when(F.col("_below"), "below guardrail"),
    }).drop("_true", "_out", "_route", "_below", "_mark", "_marked", "_fits")


def host_reply(raw: Column, out: Column, bump: Column) -> Column:
    """The JSON that a host reads: a file's reply with its content and first line, a shell's with its output, or a plain result."""
    entries = F.from_json(raw, "map<string,string>")
    file = F.from_json(F.get_json_object(raw, "$.file"), "map<string,string>")
    is_file, is_shell = F.get_json_object(raw, "$.file.content").isNotNull(), F.get_json_object(raw, "$.stdout").isNotNull()

    def echoed(source: Column, changed: dict[str, Column]) -> Column:
        """The members of an object as they were, in their order by name, but for those changed."""
        kept = F.map_filter(source, lambda k, _: ~k.isin(*changed))
        said = F.transform(F.map_entries(kept), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
        new = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in changed.items()])
        quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
        plain = lambda s: F.when(F.try_parse_json(s).isNotNull(), s).otherwise(quoted(s))
        old = F.transform(said, lambda e: F.struct(e["key"].alias("key"), plain(e["value"]).alias("value")))
        every = F.array_sort(F.concat(old, new))
        return F.concat(F.lit("{"), F.array_join(F.transform(every, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))

    quoted = F.regexp_extract(F.to_json(F.struct(out.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    start = F.coalesce(F.get_json_object(raw, "$.file.startLine").cast("long"), F.lit(1)) + bump
    inner = echoed(file, {"content": quoted, "numLines": F.size(text.lines(out)).cast("string")})
    moved = echoed(file, {"content": quoted, "numLines": F.size(text.lines(out)).cast("string"), "startLine": start.cast("string")})
    return (
        F.when(is_file, echoed(entries, {"file": F.when(bump > 0, moved).otherwise(inner)})).when(is_shell, echoed(entries, {"stderr": F.lit('""'), "stdout": quoted}))
        .otherwise(F.to_json(F.struct(F.lit("success").alias("status"), out.alias("result"))))
    )

"""Events of several hosts as one row: agent, tool, command, content, failed, session.

An event that its host's rules find no content in has a null content, and null in what else
is read from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import trim_u

#: Names that hosts use for a tool, in any case; and those of single hosts.
TOOLS = {
    "bash": "Bash", "shell": "Bash", "exec": "Bash", "run_command": "Bash", "execute": "Bash",
    "read": "Read", "read_file": "Read", "readfile": "Read", "view_file": "Read", "cat": "Read",
    "grep": "Grep", "search": "Grep", "search_files": "Grep", "find_in_files": "Grep",
    "web_fetch": "WebFetch", "fetch": "WebFetch", "http_get": "WebFetch", "browse": "WebFetch",
    "write": "Write", "write_file": "Write", "create_file": "Write", "edit": "Edit", "edit_file": "Edit", "str_replace": "Edit",
}
OPENCODE_TOOLS = {"shell": "Bash", "bash": "Bash", "exec": "Bash", "read": "Read", "read_file": "Read", "search": "Grep", "grep": "Grep", "fetch": "WebFetch", "web_fetch": "WebFetch"}
HERMES_TOOLS = {"terminal": "Bash", "read_file": "Read", "search_files": "Grep", "web_extract": "WebFetch", "write_file": "Write", "patch": "Edit"}
#: Under which keys a camel-case host puts what a tool was asked, by tool.
PI_KEYS = {"Bash": ("command", "cmd", "script"), "Read": ("path", "file_path", "filePath"), "LS": ("path", "dir", "directory"), "Grep": ("pattern", "query", "path"), "WebFetch": ("url",)}
PI_OTHER = ("command", "path")
#: What an agent is called in the history.
AGENT_IDS = {
    "claude": "claude_code", "opencode": "opencode", "continue": "vscode_continue", "codex": "codex_cli", "cursor": "cursor", "aider": "aider", "jsonrpc": "mcp_generic", "pi": "pi", "hermes": "hermes", "unknown": "unknown",
}


def _parsed(raw: Column) -> Column:
    """A text's JSON value as the first of an array; null if the text is anything but one value."""
    own = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    return F.when(F.try_variant_get(own, "$[1]", "variant").isNull() & F.try_variant_get(own, "$[0]", "variant").isNotNull(), own)


class _Event:
    """Typed access to the keys of an event, which are null where a key has another type."""

    def __init__(self, value: Column, root: str = "$[0]"):
        self.value, self.root = value, root

    def any(self, path: str) -> Column:
        return F.try_variant_get(self.value, f"{self.root}{path}", "variant")

    def kind(self, path: str) -> Column:
        return F.schema_of_variant(self.any(path))

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", F.try_variant_get(self.value, f"{self.root}{path}", "string"))

    def full(self, path: str) -> Column:
        """A text that isn't empty."""
        return F.when(self.text(path) != "", self.text(path))

    def parts(self, path: str) -> Column:
        """A text, or the texts of an array's text parts, a line each; null if there is none."""
        each = F.try_variant_get(self.value, f"{self.root}{path}", "array<variant>")
        of = lambda x, key: F.when(F.schema_of_variant(F.try_variant_get(x, key, "variant")) == "STRING", F.try_variant_get(x, key, "string"))
        texts = F.filter(F.transform(each, lambda x: F.when(of(x, "$.type") == "text", of(x, "$.text"))), lambda t: t.isNotNull())
        joined = F.when(F.size(texts) > 0, F.regexp_replace(F.array_join(texts, "\n"), r"(?U)\s+$", ""))
        return F.when(self.kind(path).startswith("ARRAY"), joined).otherwise(self.text(path))


def _with_errors(out: Column, err: Column) -> Column:
    return F.concat(out, F.when(err != "", F.concat(F.lit("\n[stderr]\n"), err)).otherwise(""))


def _format(e: _Event) -> Column:
    """Which host wrote an event, by its keys; the first that fits."""
    has = lambda *paths: F.lit(True) if not paths else e.any(paths[0]).isNotNull() & has(*paths[1:])
    return (
        F.when(e.any("").isNull(), "aider").when(~e.kind("").startswith("OBJECT"), "unknown")
        .when(has(".toolName", ".toolResponse"), "pi").when(e.text(".agent") == "hermes", "hermes")
        .when(has(".tool_name", ".tool_response"), F.when(e.kind(".tool_response.content").startswith("ARRAY"), "cursor").otherwise("claude"))
        .when(e.text(".type") == "tool_result", "opencode").when(e.text(".action") == "run", "codex").when(e.text(".role") == "tool", "continue")
        .when(has(".jsonrpc", ".result"), "jsonrpc").otherwise("unknown")
    )


def host_format(raw: Column) -> Column:
    return _format(_Event(_parsed(raw)))


def _named(name: Column, names: dict[str, str]) -> Column:
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), name)


def tool_name(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TOOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(name)), name)


def _pi_command(e: _Event, tool: Column) -> Column:
    by_tool = F.coalesce(*[e.full(f".toolInput.{k}") for k in PI_OTHER])
    for name, keys in PI_KEYS.items():
        by_tool = F.when(tool == name, F.coalesce(*[e.full(f".toolInput.{k}") for k in keys])).otherwise(by_tool)
    return F.coalesce(e.text(".command"), e.text(".toolInput"), by_tool)


def normalized(events: DataFrame, raw: str = "raw", env_command: str = "") -> DataFrame:
    """events with agent, agent_id, tool, command, content, failed, session_id, host_agent.

    `env_command` is the command of hosts that send none.
    """
    rows = events.withColumn("_event", _parsed(F.col(raw)))
    e = _Event(F.col("_event"))
    nested = _Event(_parsed(e.text(".tool_call.function.arguments")))
    rows = rows.withColumn("agent", _format(e))
    agent = F.col("agent")
    failing = F.coalesce(F.try_variant_get(e.value, "$[0].exit_code", "bigint") != 0, F.lit(False))
    flag = lambda path: F.coalesce(F.try_variant_get(e.value, f"$[0]{path}", "boolean"), F.lit(False))

    response = (
        F.when(e.any(".tool_response.content").isNotNull(), e.parts(".tool_response.content"))
        .when(e.text(".tool_response.file.content").isNotNull(), e.full(".tool_response.file.content"))
        .otherwise(_with_errors(e.full(".tool_response.stdout"), F.coalesce(e.text(".tool_response.stderr"), F.lit(""))))
    )
    streams = _with_errors(F.coalesce(e.text(".stdout"), F.lit("")), F.coalesce(e.text(".stderr"), F.lit("")))
    claude = (agent.isin("claude", "cursor"), F.when(e.text(".tool_name").isNotNull(), response), tool_name(e.text(".tool_name")), F.coalesce(e.text(".tool_input.command"), e.text(".tool_input.path"), e.text(".tool_input.file_path")), F.lit(False))
    full = lambda c: F.when(c != "", c)
    pi_tool = tool_name(e.text(".toolName"))
    rules = [
        claude,
        (agent == "pi", F.when(pi_tool.isNotNull(), full(e.parts(".toolResponse.result"))), pi_tool, _pi_command(e, pi_tool), flag(".toolResponse.isError")),
        (agent == "opencode", full(F.coalesce(e.text(".output"), e.text(".result"))), _named(F.coalesce(e.text(".tool"), F.lit("shell")), OPENCODE_TOOLS), e.text(".command"), F.lit(False)),
        (agent == "continue", full(e.parts(".content")), tool_name(F.coalesce(e.text(".name"), e.text(".tool_call.function.name"), F.lit("bash"))), nested.text(".command"), F.lit(False)),
        (agent == "codex", full(F.coalesce(e.text(".result"), e.text(".output"), streams)), F.lit("Bash"), e.text(".command"), failing),
        (agent == "hermes", e.full(".output"), _named(F.coalesce(e.text(".tool_name"), F.lit("terminal")), HERMES_TOOLS), e.text(".command"), failing),
        (agent == "aider", F.when(trim_u(F.col(raw)) != "", F.col(raw)), F.lit("Bash"), F.lit(env_command), F.lit(False)),
        (agent == "jsonrpc", full(e.parts(".result.content")), F.lit("Bash"), F.lit(env_command), flag(".result.isError")),
    ]

    def chosen(k: int) -> Column:
        out = F.when(rules[0][0], rules[0][k])
        for rule in rules[1:]:
            out = out.when(rule[0], rule[k])
        return out

    blank = lambda c: full(trim_u(c))
    either = lambda snake, camel: blank(F.when(e.any(f".{snake}").isNotNull(), e.text(f".{snake}")).otherwise(e.text(f".{camel}")))
    known = F.create_map(*[F.lit(x) for pair in AGENT_IDS.items() for x in pair])
    rows = rows.withColumns({"agent_id": F.element_at(known, agent), "content": chosen(1)})
    there = F.col("content").isNotNull()
    return rows.withColumns({
        "tool": F.when(there, chosen(2)), "command": F.when(there, F.coalesce(chosen(3), F.lit(""))), "failed": F.when(there, chosen(4)),
        "session_id": either("session_id", "sessionId"), "host_agent": either("agent_id", "agentId"),
    }).drop("_event")

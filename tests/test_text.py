import json

import pytest
from pyspark.sql import functions as F

from quern.functions import classify, rules, shell, text
from quern.operators import formats, routing
from quern.operators import lines as L
from quern.plans.language import Query, parse
from quern.sources import envelopes


@pytest.fixture(scope="module")
def say(spark):
    """A column expression's value for each text."""

    def run(make, texts):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        return [r.v for r in df.select("k", make(F.col("t")).alias("v")).orderBy("k").collect()]

    return run


FAILURES = {
    "3 failed": True, "0 failed": False, "10 failed": True, "# fail 0": False, "# fail 2": True, "tests failed": True, "test keeps_failed_lines ... ok": False, "failed_to_parse": False,
    "failedé": False, "✓ queue > retries a failed job": False, "✗ router > returns 404": True, "  ❌ x": True, "ERROR: bad": True, "error at start": True, "an error in words": False,
    "build failed": True, "--- FAIL: TestX": True, "test result: ok. 479 passed; 0 failed": False, "panic: x": True, "": False,
}


def test_failures(say):
    assert dict(zip(FAILURES, say(classify.carries_failure, FAILURES), strict=True)) == FAILURES


TIERS = {
    "error[E1]: x": "Critical", "FAIL\tpkg 0.1s": "Critical", "Compiling a v1": "Noise", "DEBUG x": "Noise", "Compiling ok (": "Noise", "warning[x]": "Important", "ok": "Important", " ok ": "Important",
    "ok then": "Context", "✓ yes": "Important", "plain": "Context", "Error: in Compiling x": "Critical",
}


def test_tiers(say):
    assert dict(zip(TIERS, say(classify.line_tier, TIERS), strict=True)) == TIERS


BLOCKS = {
    "compiling x": "Progress", "########### ===": "Progress", "50% | done": "Progress", "a | b": "Context", "----": "Noise", "": "Noise", "=_*-": "Noise", "fatal: x": "Critical", "warning: y": "Diagnostic",
    " 7 pass": "Diagnostic", "7 passengers": "Context", "Ran 3 tests": "Diagnostic", "src/a.rs:10:5": "Context", "  at f (x)": "Context", "{a}": "Data", "[1]": "Data", "ok": "Diagnostic",
}


def test_blocks(say):
    assert dict(zip(BLOCKS, say(lambda c: classify.block_class(c)["class"], BLOCKS), strict=True)) == BLOCKS


def test_tool_markers(say):
    assert say(lambda c: classify.carries_failure(c, "cargo"), ["thread panicked at x"]) == [True]
    assert say(lambda c: classify.carries_failure(c), ["thread panicked at x"]) == [False]
    assert say(lambda c: classify.is_diagnostic(c, "npm"), ["some warning here"]) == [True]


FORMATS = {
    '{"a": 1}': "json", "[1, 2]": "json", '{"a":1}\n{"b":2}': "ndjson", '{"a": 1, // no\n"b": }': "json", "{not json}": None, "---\nx: 1": "yaml", "a: 1\nb:\n  - 2": "yaml", "a: 1\nb: 2": None,
    "[1] foo [2]": None, "[3] done in 4 s [ok]": None, '{"a": 1} {"b": 2}': "json", "[1]\n[2] x": None, '[1], [2]': None,
    "k: |\n  any thing\n  at all\nl:\n  m: 1": "yaml", "a,b\n1,2\n3,4": "csv", "a\tb\n1\t2\n3\t4": "tsv", "a,b\n1,2": None, "plain words": None, "": None, "  ": None, "a,b\n1,2,3\n4,5": None,
}


def test_formats(say):
    assert dict(zip(FORMATS, say(formats.sniff, FORMATS), strict=True)) == FORMATS


def test_lines(say):
    assert say(text.lines, ["a\r\nb\n", "", "\n", "a", "a\n\nb"]) == [["a", "b"], [], [""], ["a"], ["a", "", "b"]]


def test_strips(say):
    assert say(text.strip_ansi, ["\x1b[1;31mred\x1b[0m x", "cut \x1b[12"]) == ["red x", "cut "]
    assert say(text.strip_tags, ["<b>x</b> > y", "a <b", "no"]) == ["x  y", "a ", "no"]
    assert say(text.trim_u, ["  x \xa0\n"]) == ["x"]


def test_commands(say):
    said = ["A=1 B=2 /usr/bin/git diff x", "git commit -m x", "'npm' test", "", "cargo +nightly test"]
    assert say(text.program_name, said) == ["git", "git", "npm", "", "cargo"]
    assert say(text.shorten_command, ["git diff --stat x", "averyveryverylongname second"]) == ["git diff", "averyveryverylongn"]
    assert say(rules.command_family, ["git diff -- x", "git commit", "X=1 cargo test", "", "python a.py"]) == ["git diff", "git", "cargo test", "unknown", "python"]
    assert say(rules.segmentation, ["git diff", "git diff --stat", "cargo nextest run", "cargo build", "ls"]) == ["hunk", "line", "test", "line", "line"]
    assert say(rules.summariser, ["git ls-files", "cargo +nightly test", "cargo tree", "kubectl get pods -o json", "kubectl get pods"]) == ["passthrough", "test", "passthrough", "passthrough", "cloud"]


def test_sizes(spark):
    row = spark.range(1).select(
        text.token_estimate(F.lit(100)).alias("t"), text.savings_pct(F.lit(200), F.lit(50)).alias("p"), text.savings_pct(F.lit(0), F.lit(0)).alias("z"), text.gains(F.lit(199), F.lit(1)).alias("g"),
        text.beats_guardrail(F.lit(101), F.lit(95)).alias("b"), text.human_bytes(F.lit(2048)).alias("h"), text.age(F.lit(7200)).alias("a"),
    ).first()
    assert (row.t, row.p, row.z, row.g, row.b, row.h, row.a) == (28, 75.0, 0.0, False, False, "2.0 KB", "2h ago")


def test_fidelity(say):
    assert say(lambda c: L.fidelity(F.lit("x\nerror: y"), c), ["short", "error: y"]) == [False, True]


def test_reasons(spark):
    row = spark.range(1).select(*[routing.passthrough_reason(F.lit(a), F.lit(b).cast("string"), F.lit(c), F.lit(d), F.lit(e)).alias(f"c{k}") for k, (a, b, c, d, e) in enumerate([
        (True, "json", False, True, True), (False, "json", False, True, True), (False, None, True, True, True), (False, None, False, False, True), (False, None, False, True, False), (False, None, False, True, True)])]).first()
    assert list(row) == ["own recovery command", "structured:json", "host output cap", "below guardrail", "would have dropped the failure", None]


def test_language():
    assert parse("Errors in LAST 5 commands") == Query("errors", "5")
    assert parse(" warnings from Cargo ") == Query("warnings", "cargo")
    assert parse("context for src/Main.rs") == Query("context", "src/Main.rs")
    assert parse("TIMELINE today") == Query("timeline", "")
    assert parse("errors in last x") is None and parse("anything else") is None


#: What each host sends, and (agent, tool, command, content, failed) that come of it.
ENVELOPES = [
    ({"hook_event_name": "PostToolUse", "session_id": " s1 ", "tool_name": "bash", "tool_input": {"command": "ls"}, "tool_response": {"stdout": "out", "stderr": "bad"}}, ("claude", "Bash", "ls", "out\n[stderr]\nbad", False)),
    ({"tool_name": "Read", "tool_input": {"file_path": "a.py"}, "tool_response": {"file": {"content": "body\n", "startLine": 3}}}, ("claude", "Read", "a.py", "body\n", False)),
    ({"tool_name": "Read", "tool_input": {"path": "a.py"}, "tool_response": {"content": "[not a list]"}}, ("claude", "Read", "a.py", "[not a list]", False)),
    ({"tool_name": "Bash", "tool_response": "Error: Exit code 1"}, ("claude", None, None, None, None)),
    ({"tool_name": "Read", "tool_response": {"content": [{"type": "text", "text": "l1"}, {"type": "image", "text": "no"}, {"type": "text", "text": "l2 \n"}]}}, ("cursor", "Read", "", "l1\nl2", False)),
    ({"toolName": "Bash", "toolInput": {"cmd": "ls -l"}, "toolResponse": {"result": "r", "isError": True}}, ("pi", "Bash", "ls -l", "r", True)),
    ({"toolName": "webfetch", "toolInput": {"path": "p"}, "toolResponse": {"result": "r"}}, ("pi", "webfetch", "p", "r", False)),
    ({"toolName": "Bash", "isError": False, "content": "c"}, ("unknown", None, None, None, None)),
    ({"agent": "hermes", "tool_name": "terminal", "tool_response": {}, "command": "cargo test", "output": "o", "exit_code": 1}, ("hermes", "Bash", "cargo test", "o", True)),
    ({"type": "tool_result", "tool": "shell", "output": "o", "command": "make"}, ("opencode", "Bash", "make", "o", False)),
    ({"type": "tool_result", "tool": "other", "result": "r"}, ("opencode", "other", "", "r", False)),
    ({"tool": "shell", "output": "o"}, ("unknown", None, None, None, None)),
    ({"action": "run", "command": "make", "stdout": "a", "stderr": "b", "exit_code": 2}, ("codex", "Bash", "make", "a\n[stderr]\nb", True)),
    ({"call_id": "1", "command": "make", "output": "no", "exit_code": 2}, ("unknown", None, None, None, None)),
    ({"role": "tool", "content": "c", "tool_call": {"function": {"name": "read_file", "arguments": '{"command": "cat x"}'}}}, ("continue", "Read", "cat x", "c", False)),
    ({"role": "tool", "content": [{"type": "text", "text": "t"}], "tool_call": {"function": {"arguments": "no json"}}}, ("continue", "Bash", "", "t", False)),
    ({"jsonrpc": "2.0", "result": {"content": [{"type": "text", "text": "r  "}], "isError": True}}, ("jsonrpc", "Bash", "env", "r", True)),
    ({"jsonrpc": "2.0", "id": 1}, ("unknown", None, None, None, None)),
    ("plain text", ("aider", "Bash", "env", "plain text", False)),
    (" ", ("aider", None, None, None, None)),
    ("[1, 2]", ("unknown", None, None, None, None)),
    ('{"a": 1} and more', ("aider", "Bash", "env", '{"a": 1} and more', False)),
    ("{}", ("unknown", None, None, None, None)),
]


def test_envelopes(spark):
    raws = [x if isinstance(x, str) else json.dumps(x) for x, _ in ENVELOPES]
    rows = envelopes.normalized(spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string"), env_command="env").orderBy("k").collect()
    for (said, want), r in zip(ENVELOPES, rows, strict=True):
        assert (r.agent, r.tool, r.command, r.content, r.failed) == want, said
    assert rows[0].session_id == "s1" and rows[0].agent_id == "claude_code" and rows[8].agent_id == "hermes"


def test_splits(say):
    said = ["a && b; c", "echo 'x; y' && z", 'a "b \\" ; c" ; d', "a | b || c", "a & b", "x \\; y", "one\ntwo", "", 'open "never; closed']
    assert say(shell.split_sequential, said)[:9] == [["a", "b", "c"], ["echo 'x; y'", "z"], ['a "b \\" ; c"', "d"], ["a | b", "c"], ["a & b"], ["x \\; y"], ["one", "two"], [], ['open "never; closed']]
    assert say(shell.split_pipeline, ["a | b 'c | d' | e", "x"]) == [["a", "b 'c | d'", "e"], ["x"]]
    assert say(shell.sole_output_command, ["cd x && A=1 make", "ls; cat y", "export A=1", "cat f | jq .x", "for f in *; do", ""]) == ["make", None, "export A=1", "jq .x", None, None]


def test_redaction(say):
    lines = ["API_KEY=abc", "SORT_KEY=abc", "SORT_KEY=ABC", "PASS=3/4", "PASS=hunter", "passwd=x", "export MY_TOKEN='t'", "MONKEY=Zoo", "a = b", "SECRET={x}", "COMPASS=1", "DATABASE_URL=pg://"]
    masked = ["API_KEY=[redacted]", "SORT_KEY=abc", "SORT_KEY=[redacted]", "PASS=3/4", "PASS=[redacted]", "passwd=[redacted]", "export MY_TOKEN=[redacted]", "MONKEY=[redacted]", "a = b", "SECRET={x}", "COMPASS=[redacted]", "DATABASE_URL=[redacted]"]
    assert say(shell.redact_line, lines) == masked


def test_cuts(say):
    body = "".join(f"line {k}\n" for k in range(100))
    out = say(shell.head_tail(200), [body, "short", "é" * 300, None])
    assert out[0].startswith("line 0\n") and out[0].endswith("line 99\n") and "lines kept" in out[0] and out[1] == "short" and "200 of 600 bytes" in out[2] and out[3] is None
    assert say(lambda c: text.safe_slice(c, 5), ["ééé", "abc", "abcdefgh"]) == ["éé", "abc", "abcde"]

import json

import pytest
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import checks, shell, text
from quern.functions.stem import stem, stem_counts
from quern.operators import gates, history, memory, reports, search
from quern.plans import language


@pytest.fixture(scope="module")
def say(spark):
    """A column expression's value for each text."""

    def run(make, texts):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        return [r.v for r in df.select("k", make(F.col("t")).alias("v")).orderBy("k").collect()]

    return run


def test_stems():
    """Pairs of the published algorithm's own examples."""
    pairs = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit operator oper feudalism feudal hopefulness hope triplicate triplic formative form electrical electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt communism commun effective effect probate probat rate rate cease ceas controll control roll roll generalizations gener oscillators oscil".split()
    for word, want in zip(pairs[::2], pairs[1::2], strict=True):
        assert stem(word) == want, word


def test_search_wants_all_stems_in_scope(spark):
    corpus = spark.createDataFrame([(1, "a", "tests are running"), (2, "a", "a test ran"), (3, "b", "running tests"), (4, "a", "running only")], "doc_id long, scope string, text string")
    asked = spark.createDataFrame([(7, "a", "Test run"), (8, None, "TESTS running"), (9, "a", "absent running")], "query_id long, scope string, text string")
    got = {(r.query_id, r.doc_id) for r in search.matching(corpus, asked, 9).collect()}
    assert got == {(7, 1), (8, 1), (8, 3)}


def _rows_of_joins(node):
    """Rows that came out of each join of an executed plan."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
        return _rows_of_joins(node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan())
    under = [node.children().apply(k) for k in range(node.children().size())]
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in kind else []
    return own + [n for x in under for n in _rows_of_joins(x)]


def test_search_stays_in_scope(spark):
    """Words that every scope asks for meet the documents of that scope alone; a scope's terms may come in any number of parts."""
    n = 200
    corpus = spark.createDataFrame([(10 * k + j, f"s{k}", f"common words of number{k} " + "common " * j) for k in range(n) for j in range(2)], "doc_id long, scope string, text string")
    asked = spark.createDataFrame([(k, f"s{k}", f"Common word {'' if k % 2 else f'number{k}'}") for k in range(n)], "query_id long, scope string, text string")
    found = search.matching(corpus, asked, 9)
    rows = {(r.query_id, r.doc_id, r.score, r.place) for r in found.collect()}
    assert {(q, d) for q, d, _, _ in rows} == {(k, 10 * k + j) for k in range(n) for j in range(2)}
    assert max(_rows_of_joins(found._jdf.queryExecution().executedPlan())) <= 3 * 2 * n
    assert {tuple(r) for r in search.matching(corpus, asked, 9, most_terms=1).collect()} == rows


def test_stems_are_counted(spark):
    df = spark.createDataFrame([(1, ["tests", "run", "test", "testing"]), (2, []), (3, None), (4, ["run"])], "k int, words array<string>")
    got = {r.k: dict(zip(r.held.terms, r.held.counts, strict=True)) for r in df.select("k", stem_counts("words").alias("held")).collect()}
    assert got == {1: {"test": 3, "run": 1}, 2: {}, 3: {}, 4: {"run": 1}}

def test_search_scores(spark):
    """The weight of words that most documents hold is next to nothing; a rare one decides."""
    corpus = spark.createDataFrame([(k, "s", "common word " + ("rare " * (k % 3 == 0)) + "pad " * k) for k in range(8)], "doc_id long, scope string, text string")
    asked = spark.createDataFrame([(1, "s", "rare")], "query_id long, scope string, text string")
    rows = search.matching(corpus, asked, 9).orderBy("place").collect()
    assert [r.doc_id for r in rows] == [0, 3, 6]
    import math

    size = {k: 2 + (k % 3 == 0) + k for k in range(8)}
    mean = sum(size.values()) / 8
    for r in rows:
        want = math.log((8 - 3 + 0.5) / 3.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size[r.doc_id] / mean))
        assert abs(r.score - want) < 1e-6


def test_words_of_a_shell(say):
    said = ["a 'b c' \"d \\\" e\" f", "x\\ y z", "''  q", "a`b c`d"]
    assert say(gates.split_words, said) == [["a", "b c", 'd " e', "f"], ["x y", "z"], ["q"], ["ab cd"]]
    assert say(gates.base_executable, ["env A=1 /usr/bin/git x", "command ls", "env", "A=1", "'my tool' x", ""]) == ["git", "ls", "", "", "my tool", ""]
    assert say(gates.cargo_subcommand, ["cargo test", "X=1 /bin/cargo +nightly --offline tree", "cargo", "go test"]) == ["test", "tree", None, None]


VERBATIM = {
    "ls -la": True, "make check": True, "sed -n 1p f": True, "az x -o tsv": True, "kubectl get p --output=json": True, "kubectl get p -o wide": False, "kubectl get p -o jsonpath={.a}": True, "env": True,
    "git diff --stat": True, "git diff": False, "docker ps": True, "docker container ls": True, "docker images": False, "kubectl api-resources": True, "kubectl config get-contexts": True, "kubectl config view": False,
    "kubectl run x --rm": True, "ssh h 'ls'": True, "az aks command invoke -c x": True, "cargo build": False, "jq .": True, "kubectl get pods -oname": True,
}


def test_verbatim(say):
    assert dict(zip(VERBATIM, say(gates.passes_verbatim, VERBATIM), strict=True)) == VERBATIM


def test_most_specific(say):
    said = ["cd a && cargo build && pytest -x", "ls; cat f", "grep x | awk y", "cargo test && go test", ""]
    assert say(gates.most_specific, said) == ["pytest -x", "cat f", "awk y", "go test", ""]


def test_payload_guards(say):
    assert say(gates.own_recovery, ["quern retrieve abc", "/bin/quern -q diff", "grep retrieve", "quern stats", "x && quern retrieve a"]) == [True, True, False, False, True]
    assert say(gates.already_processed, [f"a\n  {K.MARKER}3 lines, see x]", "a [fold", "plain"]) == [True, False, False]
    assert say(gates.has_json_line, ['x\n {"a": 1} \ny', '{"a": 1} x', "[1] [2]", "{a}", "[]", "a"]) == [True, False, False, False, True, False]


def test_delivered(spark):
    content = "error: x\n" + "plain words here\n" * 100
    rows = [(0, "error: x", True), (1, "lost", True), (2, content + "z", True), (3, "error: x\n" + "plain words here\n" * 60, True), (4, "error: x", False), (5, content[:-60] + f"A={shell.MASK}", True)]
    df = spark.createDataFrame([(k, content, f, a) for k, f, a in rows], "k int, content string, final string, archived boolean")
    got = {r.k: r for r in gates.delivered(df, 0.7, 0.3).collect()}
    assert got[0].route == "Rewind" and got[0].out.startswith("error: x\n[fold: ") and got[0].reason is None
    assert (got[1].route, got[1].out, got[1].reason) == ("Passthrough", content, "would have dropped the failure")
    assert (got[2].route, got[2].out, got[2].reason) == ("Passthrough", content, "below guardrail")
    assert got[3].route == "Rewind" and "[Partial signal]" in got[3].out
    assert got[4].route == "Keep" and got[5].reason is None and shell.MASK in got[5].out


def test_fallback(spark):
    df = spark.createDataFrame([("make", "c" * 100, "d" * 99, "x"), ("cargo build", "c" * 100, "d" * 99, "x"), ("cargo build", "c" * 100, "d" * 9, "x")], "command string, content string, d string, c string")
    assert [r[0] for r in df.select(gates.with_fallback(F.col("d"), F.col("c"), F.col("content"), F.col("command"))).collect()] == ["d" * 99, "x", "d" * 9]


def test_host_replies(say):
    raws = [json.dumps({"file": {"content": "a", "startLine": 3, "numLines": 9, "path": "p"}, "type": "text"}), json.dumps({"stdout": "a", "stderr": "b", "interrupted": False}), "{}"]
    for bump, start in ((0, 3), (2, 5)):
        got = [json.loads(x) for x in say(lambda c, b=bump: gates.host_reply(c, F.lit('l1\nl2 "q"'), F.lit(b)), raws)]
        assert got[0] == {"file": {"content": 'l1\nl2 "q"', "startLine": start, "numLines": 2, "path": "p"}, "type": "text"}
        assert got[1] == {"stdout": 'l1\nl2 "q"', "stderr": "", "interrupted": False} and got[2] == {"status": "success", "result": 'l1\nl2 "q"'}


def test_small_checks(spark, say):
    assert say(lambda c: checks.is_newer(c, F.lit("0.5.4")), ["0.5.5", "0.5.4", "0.5.4-rc1", "0.6", "0.5.4.1", "0.5.x"]) == [True, False, False, True, True, False]
    assert say(lambda c: checks.is_newer(F.lit("0.5.4"), c), ["0.5.4-rc1"]) == [True] and say(lambda c: checks.is_newer(c, F.lit("0.5.4-rc1")), ["0.5.4-rc2"]) == [True]
    assert say(checks.target_file, ["cat f g", "grep -r x dir", "rg -n", "ls"]) == ["f", "dir", None, None]
    flags = spark.createDataFrame([("--wek",), ("--quarter",), ("--mnth",)], "flag string")
    assert [r.nearest for r in checks.nearest_flag(flags, ["--week", "--month", "-w"]).collect()] == ["--week", None, "--month"]
    names = spark.createDataFrame([("path",), ("ld_preload",), ("PAGER",), ("HOME",)], "name string")
    assert {r.name for r in checks.allowed_variables(names).collect()} == {"path", "HOME"}


def test_cuts_by_columns_and_bytes(say):
    assert say(lambda c: text.columns_truncated(c, 5), ["abcdef", "中文字", "abc", "e\u0301abcdef"]) == ["abcde...", "中文...", "abc", "e\u0301abcd..."]
    for n in range(0, 9):
        for t in ("ééé", "a中b", "\U0001f600x", "abc"):
            assert say(lambda c, n=n: text.safe_slice(c, n), [t]) == [t.encode()[:n].decode(errors="ignore")], (t, n)


def test_reports_of_time_and_settings():
    assert reports.time_scope(["-H"], 10_000) == ("last hour", 6400) and reports.time_scope(["--today"], 90_000) == ("today", 86400) and reports.time_scope([], 30 * 86400)[1] == 0
    body = '[global]\naggressiveness = "Efficient"\n[agents.pi]\nmode = "debug"\npinned = ["a"]\n'
    assert reports.config_of(body, "x") == {"mode": "efficient"} and reports.config_of(body, "pi") == {"mode": "debug", "pinned": ["a"]} and reports.config_of("= no", "x") == {"mode": "balanced"}


def test_warnings_pause(spark):
    pressed = [(k, "s", k, "Normal" if k < 2 or k == 9 else "Warning" if k < 12 else "Critical") for k in range(30)]
    last, want = None, []
    for k, _, n, p in pressed:
        if p != "Normal" and (last is None or n - last >= 5):
            want.append(k)
            last = n
    got = reports.pressure_warnings(spark.createDataFrame(pressed, "id long, session_id string, n long, pressure string")).collect()
    assert sorted(r.id for r in got) == want


def test_domains(spark):
    rows = [("a", "/p/src/app/x.rs"), ("a", "/p/src/lib/y.rs"), ("b", "only/one.py"), ("c", "main.rs"), ("d", "/x.rs"), ("e", "/p/abc/x"), ("e", "/p/abd/x")]
    got = {r.session_id: r.domain for r in memory.infer_domain(spark.createDataFrame(rows, "session_id string, path string")).collect()}
    assert got == {"a": "src", "b": "only", "c": "main", "d": "x", "e": "ab"}


def test_tasks(spark):
    rows = [("a", ["ls", "cargo test"], ["e"]), ("b", ["npm run build"], []), ("c", ["git diff", "x"], ["e"]), ("d", ["git diff"], []), ("e", [], []), ("f", ["y" * 60], [])]
    got = {r.session_id: r.task for r in memory.infer_task(spark.createDataFrame(rows, "session_id string, commands array<string>, errors array<string>")).collect()}
    assert got == {"a": "fixing rust tests", "b": "building npm", "c": "debugging active errors", "d": "running: git diff", "e": None, "f": "running: " + "y" * 38 + "..."}


def test_loop_status(spark):
    rows = [(91, 100, "Normal"), (90, 100, "Critical"), (90, 100, "Warning"), (50, 0, "Normal")]
    df = spark.createDataFrame(rows, "u long, b long, p string")
    assert [r[0] for r in df.select(memory.loop_status(F.col("u"), F.col("b"), F.col("p"))).collect()] == ["ESCALATE", "COMPACT_OR_ESCALATE", "CONTINUE", "CONTINUE"]
    assert [r[0] for r in spark.createDataFrame([(59,), (60,), (80,)], "p int").select(history.budget_status(F.col("p"))).collect()] == ["PROCEED", "CAUTION", "STOP"]


def test_answers_of_the_language(spark):
    cols = "id long, ts long, command string, filter_name string, route string, input_bytes long, output_bytes long, rewind_hash string"
    h = spark.createDataFrame([(1, 10, "cargo build", "build", "Keep", 100, 50, "h1"), (2, 20, "npm test", "js", "Error", 100, 100, "h2"), (3, 86_500, "ls", "sys", "Keep", 0, 0, "")], cols)
    archive = spark.createDataFrame([("h1", 10, "error[E1]: a\nx src/Main.rs:1\nwarning: b"), ("h2", 20, "error: c\nsrc/main.rs")], "hash string, ts long, content string")
    ask = lambda q: language.planned(language.parse(q), h, archive).collect()
    assert [(r.id, r.line) for r in ask("errors in last 1 commands")] == [(2, "error: c")]
    assert {(r.id, r.line) for r in ask("errors in last 9 commands")} == {(1, "error[E1]: a"), (2, "error: c")}
    assert {(r.id, r.line) for r in ask("warnings from CARGO")} == {(1, "x src/Main.rs:1"), (1, "warning: b")}
    assert [(r.command, r.lines) for r in ask("context for src/Main.rs")] == [("cargo build", "x src/Main.rs:1")]
    assert [(r.id, r.saved_pct) for r in ask("timeline today")] == [(3, 0.0)]


def test_imports_mean_files(spark):
    files = [("src/a.rs", "use crate::b::C;\npub mod c;\n"), ("src/b/mod.rs", ""), ("c.rs", ""), ("web/x.ts", "import { a,\n b } from './y'\nimport '../z'\nconst q = require( 'no' )"), ("web/y.tsx", ""), ("z/index.js", ""), ("p/q.py", "import p.r\nfrom .s import t"), ("p/r.py", ""), ("m.go", 'import "g"\n\t"h"\n'), ("h.go", "")]
    df = spark.createDataFrame(files, "path string, text string")
    got = {(r.source, r.target) for r in memory.resolved_imports(memory.import_edges(df), df).collect()}
    assert got == {("src/a.rs", "c.rs"), ("web/x.ts", "web/y.tsx"), ("web/x.ts", "z/index.js"), ("p/q.py", "p/r.py"), ("m.go", "h.go")}

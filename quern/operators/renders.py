"""Rendered summaries: a payload's text in, a shorter text or null out. Null leaves the payload as it is.

Each summary is one column expression over the payload's own lines: nothing is shuffled, and
whole tables of payloads go through one projection. Rows of lines that belong together (a
block, a file's matches) are cut out by their positions; an array of lines is bound once
however often its expression names it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import classify, rules, shell, text
from quern.operators.gates import has_json_line, passes_verbatim

Text = Callable[[Column], Column]


def _let(value: Column, body: Text) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _say(*parts: Column | str | int) -> Column:
    """The parts as one text; a null part makes it null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.lit(str(p)) if isinstance(p, int) else p.cast("string") for p in parts])


def _trim(c: Column) -> Column:
    return text.trim_u(c)


def _ended(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def _words(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda w: w != "")


def _joined(rows: Column, sep: str = "\n") -> Column:
    return F.array_join(rows, sep)


def _first(rows: Column, n: int) -> Column:
    return F.slice(rows, 1, n)


def _with_more(rows: Column, n: int, note: Text, sep: str = "\n") -> Column:
    """The first n rows, and a note on how many more there are."""
    return F.concat(_joined(_first(rows, n), sep), F.when(F.size(rows) > n, note(F.size(rows) - n)).otherwise(""))


def _any(rows: Column, rule: Text) -> Column:
    return F.exists(rows, rule)


def _groups(rows: Column, opens: Callable[[Column, Column], Column]) -> Column:
    """rows cut where `opens(row before, row)` holds."""

    def cut(r: Column) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.size(r)), lambda i: (i == 1) | opens(F.element_at(r, F.greatest(i - 1, F.lit(1))), F.element_at(r, i)))
        ends = lambda p: F.transform(p, lambda a, k: F.slice(r, a, F.coalesce(F.get(p, k + 1), F.size(r) + 1) - a))
        return F.when(F.size(r) > 0, _let(places, ends)).otherwise(F.filter(F.array(r), lambda x: F.size(x) > 0))

    return _let(rows, cut)


def _tiers(rows: Column, tool: str | None = None) -> Column:
    """The tier of each line, with those after a critical one lifted."""
    own = F.transform(rows, lambda x: classify.tier_of(classify.block_class(x, tool)["class"]))
    lifted = lambda t: F.transform(t, lambda x, i: F.when(x.isin("Context", "Noise") & F.exists(F.slice(t, F.greatest(i - K.BOOST_LINES, F.lit(0)) + 1, F.least(i, F.lit(K.BOOST_LINES))), lambda y: y == "Critical"), "Important").otherwise(x))
    return _let(own, lifted)


def _fails(line: Column) -> Column:
    return classify.carries_failure(line)


def _numbers(line: Column, pattern: str) -> Column:
    return F.regexp_extract(line, pattern, 1).try_cast("bigint")


def _last(values: Column) -> Column:
    """The last value that isn't null, or 0."""
    return F.coalesce(F.try_element_at(F.filter(values, lambda x: x.isNotNull()), F.lit(-1)), F.lit(0))


# ------------------------------------------------------------------ version control


def git_status(c: Column) -> Column:
    def body(own: Column) -> Column:
        headers = {"staged": "Changes to be committed", "modified": "Changes not staged for commit", "untracked": "Untracked files:"}
        heads = F.filter(F.transform(own, lambda x, i: F.when(text.contains_any(x, headers.values()), i)), lambda i: i.isNotNull())
        kinds = lambda h: F.transform(own, lambda x, i: F.struct(x.alias("line"), F.try_element_at(own, F.array_max(F.filter(h, lambda p: p <= i)) + 1).alias("header")))

        def files(lines: Column, mark: str) -> Column:
            rows = F.filter(lines, lambda r: r["header"].contains(mark) & (r["line"].startswith("\t") | r["line"].startswith("  ")))
            names = F.transform(rows, lambda r: _trim(F.regexp_replace(_trim(r["line"]), "^(modified|new file|deleted|renamed):", "")))
            return F.filter(names, lambda n: (n != "") & ~n.startswith("(use"))

        branch = F.coalesce(F.try_element_at(F.filter(own, lambda x: x.startswith("On branch ")), F.lit(-1)), F.lit(""))
        found = _let(_let(heads, kinds), lambda lines: F.struct(*[files(lines, mark).alias(name) for name, mark in headers.items()]))

        def said(f: Column) -> Column:
            head = _say("git: on ", _trim(F.replace(branch, F.lit("On branch "), F.lit(""))), " | staged:", F.size(f["staged"]), " mod:", F.size(f["modified"]), " untracked:", F.size(f["untracked"]))
            named = [F.when(F.size(f[k]) > 0, _say(f"\n{title}: ", _joined(_first(f[k], 5), ", "))).otherwise("") for k, title in (("staged", "Staged"), ("modified", "Modified"))]
            return F.concat(head, *named)

        return _let(found, said)

    return _let(text.lines(c), body)


def git_log(c: Column) -> Column:
    """A line for each commit; a log without commits is left as it is."""

    def body(own: Column) -> Column:
        full = F.filter(F.transform(own, _trim), lambda x: x != "")
        groups = _groups(full, lambda _, x: x.startswith("commit ") | x.rlike("^[a-f0-9]{7,40} "))

        def entry(g: Column) -> Column:
            head = F.element_at(g, 1)
            subject = F.filter(F.slice(g, F.lit(2), F.size(g)), lambda x: ~x.rlike("^(Author|Date|Merge):"))
            return F.when(head.startswith("commit "), _say(F.substring(F.replace(head, F.lit("commit "), F.lit("")), 1, 7), " ", F.coalesce(F.get(subject, F.lit(0)), F.lit("")))).when(head.rlike("^[a-f0-9]{7,40} "), head)

        rows = F.filter(F.transform(groups, entry), lambda x: x.isNotNull())
        # a subject that itself begins with a hash stands alone in the next group
        merged = F.regexp_replace(_joined(rows), r"(?m)^([0-9a-f]{7}) \n(?=[a-f0-9]{7,40} )", "$1 ")
        return F.when(F.size(rows) > 0, _trim(merged))

    return _let(text.lines(c), body)


def git_diff(c: Column) -> Column:
    """Files and changed lines. A hunk is what stands between its header and the next header or file; its length is what the header declares."""

    def body(own: Column) -> Column:
        groups = _groups(own, lambda _, x: x.startswith("@@ ") | x.startswith("diff --git"))

        def hunk(g: Column) -> Column:
            head = F.element_at(g, 1)
            declared = [F.coalesce(_numbers(head, rf"^@@ {p} @@"), F.lit(1)) for p in (r"-\d+,(\d+) \+\S+", r"-\S+ \+\d+,(\d+)")]
            rest = F.slice(g, F.lit(2), F.size(g))
            start = F.struct(declared[0].alias("old"), declared[1].alias("new"), F.lit(0).cast("bigint").alias("n"))
            left = lambda s: (s["old"] > 0) | (s["new"] > 0)
            less = lambda x: F.greatest(x - 1, F.lit(0))
            step = lambda s, x: F.when(~left(s), s).otherwise(
                F.when(x.startswith("+"), F.struct(s["old"].alias("old"), less(s["new"]).alias("new"), (s["n"] + 1).alias("n")))
                .when(x.startswith("-"), F.struct(less(s["old"]).alias("old"), s["new"].alias("new"), (s["n"] + 1).alias("n")))
                .when(x.startswith("\\"), F.struct(s["old"].alias("old"), s["new"].alias("new"), (s["n"] + 1).alias("n")))
                .when(x.startswith(" ") | (x == ""), F.struct(less(s["old"]).alias("old"), less(s["new"]).alias("new"), (s["n"] + 1).alias("n")))
                .otherwise(F.struct(F.lit(0).cast("bigint").alias("old"), F.lit(0).cast("bigint").alias("new"), s["n"].alias("n")))
            )
            inside = F.aggregate(rest, start, step, lambda s: s["n"]).cast("int")
            critical = _any(g, _fails)
            lines_in = F.filter(F.slice(rest, F.lit(1), inside), lambda x: x.rlike("^[-+]") | critical)
            after = F.filter(F.slice(rest, inside + 1, F.size(rest)), lambda x: critical & ~x.rlike(r"^(\+\+\+|---|index)"))
            return F.struct(F.concat(F.array(head), lines_in, after).alias("kept"), F.slice(rest, F.lit(1), inside).alias("inside"))

        made = F.transform(groups, lambda g: F.struct(
            F.when(F.element_at(g, 1).startswith("diff --git"), F.element_at(F.split(F.element_at(g, 1), " "), -1)).alias("file"),
            F.when(F.element_at(g, 1).startswith("@@ "), hunk(g)).alias("hunk")))

        def said(m: Column) -> Column:
            files = F.array_distinct(F.filter(F.transform(m, lambda x: x["file"]), lambda x: x.isNotNull()))
            inside = F.flatten(F.filter(F.transform(m, lambda x: x["hunk"]["inside"]), lambda x: x.isNotNull()))
            rows = F.flatten(F.transform(m, lambda x: F.coalesce(x["hunk"]["kept"], F.filter(F.array(x["file"]), lambda y: y.isNotNull()))))
            count = lambda mark: F.size(F.filter(inside, lambda x: x.startswith(mark)))
            return _say("git diff: ", F.size(files), " files changed, ", count("+"), "+, ", count("-"), "-\n", _trim(_joined(rows)))

        return _let(made, said)

    return _let(text.lines(c), body)


def git(c: Column) -> Column:
    return F.when(c.contains("diff --git"), git_diff(c)).when(c.contains("On branch") | c.contains("HEAD detached"), git_status(c)).otherwise(git_log(c))


def vcs_list(c: Column) -> Column:
    full = F.filter(text.lines(c), lambda x: _trim(x) != "")
    return _let(full, lambda f: F.when(F.size(f) > 10, _with_more(f, 10, lambda n: _say("\n... [", n, " more items, use --limit to see more]"))))


# ------------------------------------------------------------------ builds and tests

_BUILT = r"^\s*(Compiling |Finished |Building |Built target |Successfully built |Successfully installed |BUILD SUCCESS|Build succeeded)"


def build(c: Column) -> Column:
    def body(own: Column) -> Column:
        single = lambda x: ~_trim(x).rlike(r"^(-->|\||=)") & _trim(x).rlike(r"^[^\s:]*[./][^\s:]*\s*:\s*\d+\s*:")
        tiers = _tiers(own)

        def kinds(t: Column) -> Column:
            # E, W: a diagnostic of one line; C, I: a line of a block; n: any other
            kind = lambda x, i: F.when(single(x), F.when((F.element_at(t, i + 1) == "Critical") | x.contains(": error:") | x.contains("ERROR:"), "E").otherwise("W")).when(F.element_at(t, i + 1) == "Critical", "C").when(F.element_at(t, i + 1) == "Important", "I").otherwise("n")
            return F.transform(own, lambda x, i: F.struct(kind(x, i).alias("kind"), x.alias("line")))

        def blocks(rows: Column) -> Column:
            runs = _groups(rows, lambda a, b: ~(a["kind"].isin("C", "I") & b["kind"].isin("C", "I")))

            def halves(run: Column) -> Column:
                at = F.array_position(F.transform(run, lambda r: r["kind"]), "C").cast("int")
                return F.when((F.element_at(run, 1)["kind"] == "I") & (at > 1), F.array(F.slice(run, F.lit(1), at - 1), F.slice(run, at, F.size(run)))).otherwise(F.array(run))

            each = F.flatten(F.transform(runs, halves))
            return F.transform(F.filter(each, lambda b: F.element_at(b, 1)["kind"] != "n"), lambda b: F.struct(F.element_at(b, 1)["kind"].isin("E", "C").alias("error"), _joined(F.transform(b, lambda r: r["line"])).alias("said")))

        def said(b: Column) -> Column:
            errors = F.transform(F.filter(b, lambda x: x["error"]), lambda x: x["said"])
            warnings = F.transform(F.filter(b, lambda x: ~x["error"]), lambda x: x["said"])
            shown = F.concat(errors, _first(warnings, 5), F.when(F.size(warnings) > 5, F.array(_say("... ", F.size(warnings) - 5, " more warnings"))).otherwise(F.array().cast("array<string>")))
            return F.when(F.size(b) > 0, _trim(_say("Build: ", F.size(errors), " errors, ", F.size(warnings), " warnings\n", _joined(shown)))).when(_any(own, lambda x: x.rlike(_BUILT)), "Build: ok")

        return _let(_let(_let(tiers, kinds), blocks), said)

    return _let(text.lines(c), body)


def tests(c: Column) -> Column:
    summary = lambda x: x.startswith("test result:") | x.startswith("Tests:") | (x.contains(" passed") & x.contains(" in "))
    passing = lambda x: x.startswith("test ") & x.rlike(r" \.\.\. (ok|ignored)$")
    detail = lambda x: ~summary(_trim(x)) & ~passing(_trim(x)) & F.lower(_trim(x)).rlike("failed|error:|err ")
    opens = lambda x: x.startswith("test ") | x.startswith("--- FAIL") | x.startswith("--- PASS") | x.rlike("^[✓✔✗✘]") | x.contains("test result:")

    def body(own: Column) -> Column:
        segments = _groups(own, lambda _, x: opens(x))
        tier = lambda s: F.when(_any(s, _fails), "Critical").when(_any(s, lambda x: classify.is_diagnostic(x)), "Important").otherwise("Context")
        made = F.transform(segments, lambda s: F.struct(s.alias("rows"), _joined(s).alias("said"), tier(s).alias("tier")))

        def judged(m: Column) -> Column:
            lifted = lambda x, i: F.when((x["tier"] == "Context") & F.exists(F.slice(m, F.greatest(i - K.BOOST_LINES, F.lit(0)) + 1, F.least(i, F.lit(K.BOOST_LINES))), lambda y: y["tier"] == "Critical"), "Important").otherwise(x["tier"])
            fails = lambda x: ((x["tier"] == "Critical") | x["said"].contains("FAIL") | x["said"].contains("✗")) & _any(x["rows"], detail)
            good = lambda x, i: (lifted(x, i) == "Important") | x["said"].contains("PASS") | x["said"].contains("✓") | _any(x["rows"], lambda y: passing(_trim(y)))
            return F.transform(m, lambda x, i: F.struct(x["rows"].alias("rows"), x["said"].alias("said"), fails(x).alias("fails"), (~fails(x) & good(x, i)).alias("passes")))

        def said(m: Column) -> Column:
            failing = F.filter(m, lambda x: x["fails"])
            shown = F.filter(failing, lambda x: ~F.lower(x["said"]).contains("failed tests/") & ~x["said"].contains("==="))
            told = F.transform(shown, lambda x: F.when(F.size(x["rows"]) > 12, _say(_joined(_first(x["rows"], 12)), "\n       ... [stack trace truncated]")).otherwise(x["said"]))
            details = F.concat(told, F.array_except(F.filter(own, detail), told))
            sums = F.filter(F.transform(own, _trim), summary)
            passed = F.size(F.filter(m, lambda x: x["passes"]))
            headline = F.coalesce(F.get(sums, F.lit(0)), _say("Tests: ", passed, " passed, ", F.size(failing), " failed"))
            clean = (F.size(failing) == 0) & (F.size(details) == 0)
            return (
                F.when(clean & (F.size(sums) == 0) & (passed == 0), None).when(clean & (F.size(sums) > 1), _joined(sums)).when(clean, headline)
                .otherwise(_trim(_say(headline, "\n", _with_more(details, 10, lambda n: _say("\n... ", n, " more failures")))))
            )

        return _let(_let(made, judged), said)

    return _let(text.lines(c), body)


def generic(c: Column, most: int = 100) -> Column:
    """The lines that matter most, in order, with what was left out between them."""

    def body(own: Column) -> Column:
        def said(tiers: Column) -> Column:
            places = lambda *kinds: F.filter(F.sequence(F.lit(1), F.size(tiers)), lambda i: F.element_at(tiers, i).isin(*kinds))
            strong = _first(places("Critical", "Important"), most)
            picked = F.array_sort(F.concat(strong, F.slice(places("Context"), F.lit(1), F.greatest(most - F.size(strong), F.lit(0)))))
            chosen = F.when(F.size(picked) > 0, picked).otherwise(F.sequence(F.lit(1), F.least(F.size(tiers), F.lit(20))))

            def shown(p: Column) -> Column:
                gap = lambda x, k: x - F.when(k > 0, F.element_at(p, F.greatest(k, F.lit(1)))).otherwise(x - 1) - 1
                rows = F.transform(p, lambda x, k: F.concat(F.when(gap(x, k) > 0, _say("... [", gap(x, k), " lines omitted]\n")).otherwise(""), F.element_at(own, x)))
                noise = F.size(F.filter(F.sequence(F.lit(1), F.size(tiers)), lambda i: (F.element_at(tiers, i) == "Noise") & ~F.array_contains(p, i)))
                left = F.size(tiers) - F.element_at(p, -1)
                return _trim(F.concat(_joined(rows), F.when(noise > 0, _say("\n[", noise, " noise lines omitted]")).otherwise(""), F.when(left > 0, _say("\n... [", left, " more lines]")).otherwise("")))

            return F.when(F.size(tiers) > 0, _let(chosen, shown))

        return _let(_tiers(own), said)

    return _let(text.lines(c), body)


# ------------------------------------------------------------------ findings and results


def security(c: Column) -> Column:
    def body(own: Column) -> Column:
        level = lambda x: F.when(x.rlike("CRITICAL|critical"), 4).when(x.rlike("HIGH|high"), 3).when(x.rlike("MEDIUM|medium"), 2).when(x.rlike("LOW|low"), 1)
        of = lambda n: F.filter(own, lambda x: level(x) == n)
        found = F.struct(*[of(n).alias(k) for k, n in (("critical", 4), ("high", 3), ("medium", 2), ("low", 1))])

        def said(f: Column) -> Column:
            n = {k: F.size(f[k]) for k in ("critical", "high", "medium", "low")}
            worst = n["critical"] + n["high"]
            rows = F.concat(F.transform(_first(f["critical"], 5), lambda x: _say("  🔴 ", x)), F.transform(_first(f["high"], 3), lambda x: _say("  🟠 ", x)), F.when(worst > 8, F.array(_say("  ... [", worst - 8, " more findings]"))).otherwise(F.array().cast("array<string>")))
            head = _say("Security scan: ", n["critical"], " CRITICAL, ", n["high"], " HIGH, ", n["medium"], " MEDIUM, ", n["low"], " LOW\n", _joined(rows))
            return F.when(worst + n["medium"] > 0, _trim(head)).when(n["low"] > 0, "Security scan: no issues found ✓")

        return _let(found, said)

    return _let(F.transform(text.lines(c), _trim), body)


def database(c: Column) -> Column:
    def failure(own: Column) -> Column:
        bad = lambda x: F.lower(x).rlike("error:|fatal:|error ")
        hint = lambda x: ~bad(x) & F.lower(x).rlike("hint:|detail:")
        place = lambda x: ~bad(x) & ~hint(x) & F.lower(x).rlike("line |position:")
        errors = F.filter(own, bad)
        last = lambda rule: F.filter(F.array(F.try_element_at(F.filter(own, rule), F.lit(-1))), lambda x: x.isNotNull())
        return _trim(_say("DB Error (", F.size(errors), " found):\n", _joined(F.concat(_first(errors, 3), last(place), last(hint)))))

    def result(own: Column) -> Column:
        data = F.filter(own, lambda x: (_trim(x) != "") & ~_trim(x).contains("---") & ~_trim(x).contains("(") & ~_trim(x).contains("rows"))
        tail = F.reverse(F.slice(own, F.greatest(F.size(own) - 4, F.lit(1)), F.lit(5)))
        total = F.get(F.filter(tail, lambda x: x.contains("row") & x.contains("(")), F.lit(0))
        head = F.when(F.size(data) > 0, _say("Query result columns: ", _trim(F.element_at(data, 1)), "\n")).otherwise("")
        rows = F.slice(data, 2, 3)
        sample = F.when(F.size(rows) > 0, _say("Sample rows:\n", _joined(rows), F.when(F.size(own) > F.size(rows) + 2, _say("\n  ... [", F.size(own) - F.size(rows) - 2, " more rows]")).otherwise(""))).otherwise("")
        return _trim(F.concat(head, F.when(total.isNotNull(), _say("Result: ", _trim(total), "\n")).otherwise(_say("Result: ", F.size(own), " lines output\n")), sample))

    def other(own: Column) -> Column:
        errors = F.filter(own, _fails)
        return F.when(F.size(errors) > 0, _say("DB errors: ", F.size(errors), "\n", _joined(_first(errors, 5))))

    own = text.lines(c)
    table = _any(_first(own, 5), lambda x: x.contains(" | ") | x.contains("---") | x.contains("+--"))
    return F.when(c.rlike("ERROR:|FATAL:|error:"), _let(F.transform(own, _trim), failure)).when(c.contains("rows)") | c.contains("row)") | table, _let(own, result)).otherwise(_let(own, other))


# ------------------------------------------------------------------ containers and clouds

#: What makes a line of a cloud tool critical, and what makes it noise.
CLOUD_CRITICAL = ("error", "Error", "ERROR", "failed", "FAILED", "CrashLoopBackOff", "OOMKilled", "ImagePullBackOff", "Terminating", "Evicted", "panic", "fatal", "FATAL", "exception", "Exception", "BackOff")
CLOUD_NOISE = ("Pulling from", "Pull complete", "Extracting", "Waiting", "Polling", ".......", "Downloading", "Verifying Checksum", "Download complete", "Already exists", "Using cache", " --->", " ---> ")


def _critical(x: Column) -> Column:
    return text.contains_any(x, CLOUD_CRITICAL)


def _noise(x: Column) -> Column:
    return text.contains_any(x, CLOUD_NOISE)


def docker_ps(c: Column) -> Column:
    def body(own: Column) -> Column:
        low = lambda x: F.lower(x)
        up, gone = (lambda x: low(x).contains("up ")), (lambda x: ~low(x).contains("up ") & low(x).contains("exited"))
        names = F.transform(F.filter(own, gone), lambda x: F.element_at(_words(x), -1))
        running = F.size(F.filter(own, up))
        rest = F.size(own) - running - F.size(names)
        head = _say("docker: ", F.size(own), " containers | ", running, " running, ", F.size(names), " exited", F.when(rest > 0, _say(", ", rest, " other")).otherwise(""))
        return F.concat(head, F.when(F.size(names) > 0, _say("\nExited: ", _with_more(names, 5, lambda n: _say(" +", n, " more"), ", "))).otherwise(""))

    return _let(F.filter(F.transform(F.slice(text.lines(c), F.lit(2), F.greatest(F.size(text.lines(c)), F.lit(1))), _trim), lambda x: x != ""), body)


def docker_build(c: Column) -> Column:
    def body(own: Column) -> Column:
        steps = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: F.lower(F.element_at(own, i)).contains("step "))
        cached = F.size(F.filter(own, lambda x: x.contains("Using cache")))
        bad = F.array_max(F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: _critical(F.element_at(own, i)) & ~F.element_at(own, i).contains("Successfully")))
        done = _any(own, lambda x: x.rlike("Successfully (built|tagged)"))
        failed = _say("docker build: ✗ failed at step ", F.size(F.filter(steps, lambda i: i <= bad)), "/", F.size(steps), ", ", _trim(F.element_at(own, bad)))
        good = _say("docker build: ✓ complete (", F.size(steps), " layers", F.when(cached > 0, _say(", ", cached, " cached")).otherwise(""), ")")
        return F.when(bad.isNotNull(), failed).when(done, good).otherwise(_say("docker build: ", F.size(steps), " steps, ", cached, " cached"))

    return _let(text.lines(c), body)


def _is_docker_logs(own: Column) -> Column:
    return F.size(F.filter(_first(own, 20), lambda x: (F.octet_length(x) > 20) & x.rlike(r"^[0-9\[]"))) >= 5


def docker_logs(c: Column) -> Column:
    def body(own: Column) -> Column:
        bad = F.transform(F.filter(own, lambda x: _critical(x) & ~_noise(x)), _trim)
        found = _trim(_say("docker logs: ", F.size(bad), " errors/warnings found\n", _with_more(bad, 10, lambda n: _say("\n... +", n, " more"))))
        return F.when(_is_docker_logs(own), F.when(F.size(bad) > 0, found).otherwise(_say("docker logs: ", F.size(own), " lines, no errors detected")))

    return _let(text.lines(c), body)


def docker(c: Column) -> Column:
    return F.when(c.contains("CONTAINER ID"), docker_ps(c)).when(c.contains("Step ") & c.contains(" : "), docker_build(c)).otherwise(docker_logs(c))


def cloud_fallback(c: Column) -> Column:
    """Twenty lines that matter, or else the first ten."""

    def body(own: Column) -> Column:
        strong = lambda t: F.filter(own, lambda x, i: F.element_at(t, i + 1).isin("Critical", "Important"))
        said = lambda rows: _trim(_joined(F.when(_trim(_joined(rows)) != "", _first(rows, 20)).otherwise(_first(own, 10))))
        return F.nullif(_let(_let(_tiers(own), strong), said), F.lit(""))

    return _let(text.lines(c), body)


def is_resource_table(own: Column) -> Column:
    heads = lambda x: (F.size(_words(x)) >= 3) & F.array_contains(_words(x), "NAME") & F.forall(_words(x), lambda w: w.rlike("^[A-Z_-]*$"))
    return _any(_first(own, 5), heads)


def kubectl(c: Column) -> Column:
    def body(own: Column) -> Column:
        full = F.filter(F.transform(own, _trim), lambda x: x != "")
        rows = F.concat(_first(F.filter(full, _critical), 10), _first(F.filter(full, lambda x: ~_critical(x) & x.rlike("configured|created|unchanged|deleted")), 10))
        return F.when(~is_resource_table(own), F.when(F.size(rows) > 0, _joined(rows)).otherwise(cloud_fallback(c)))

    return _let(text.lines(c), body)


def aws(c: Column) -> Column:
    def body(full: Column) -> Column:
        told = lambda x: ~_critical(x) & ~_noise(x) & x.rlike("arn:|i-|sg-|vpc-|subnet-|Successfully|completed")
        rows = F.concat(_first(F.filter(full, _critical), 5), _first(F.filter(full, told), 10))
        return F.when(F.size(rows) > 0, _joined(rows)).otherwise(cloud_fallback(c))

    return _let(F.filter(F.transform(text.lines(c), _trim), lambda x: x != ""), body)


def terraform(c: Column) -> Column:
    def body(own: Column) -> Column:
        plan = lambda x: F.when(x.startswith("# "), F.substring(x, 3, 1 << 30)).otherwise("")
        mark = lambda x: F.when(plan(x).contains("will be created"), "+").when(plan(x).rlike("will be updated|must be replaced"), "~").when(plan(x).contains("will be destroyed"), "-")
        named = F.filter(F.transform(own, lambda x: F.struct(mark(x).alias("mark"), F.get(_words(F.regexp_replace(x, "^#+", "")), F.lit(0)).alias("name"))), lambda r: r["mark"].isNotNull())
        planned = F.filter(own, lambda x: F.lower(x).startswith("plan:"))
        applied = F.exists(own, lambda x: F.lower(x).startswith("apply complete!"))

        def said(r: Column) -> Column:
            def number(m: str, word: str) -> Column:
                counted = F.size(F.filter(r, lambda x: x["mark"] == m))
                from_plan = _last(F.transform(planned, lambda x: _numbers(x, rf"(?:^|[ ,])(\d+) to {word}")))
                return F.when(counted > 0, counted).otherwise(from_plan).cast("string")

            a, b, d = number("+", "add"), number("~", "change"), number("-", "destroy")
            rows = F.transform(r, lambda x: F.concat(x["mark"], F.lit(" "), x["name"]))
            listed = F.when(F.size(rows) > 0, _say("\n", _with_more(rows, 5, lambda n: _say("\n... +", n, " more")))).otherwise("")
            return F.when(applied, _say("terraform: apply complete +", a, " ~", b, " -", d)).when((F.size(r) > 0) | (F.size(planned) > 0), _say("terraform: +", a, " ~", b, " -", d, " resources", listed))

        return _let(named, said)

    return _let(F.transform(text.lines(c), _trim), body)


def helm(c: Column) -> Column:
    def body(own: Column) -> Column:
        header = _any(own, lambda x: x.contains("REVISION") & x.contains("CHART") & x.contains("STATUS"))
        split = F.filter(F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own), F.lit(1))), lambda x: _words(_trim(x))), lambda w: F.size(w) >= 4)
        rows = F.transform(split, lambda w: F.struct(F.element_at(w, 1).alias("name"), F.lower(F.coalesce(F.get(w, F.lit(4)), F.get(w, F.lit(3)))).alias("status"), F.coalesce(F.get(w, F.lit(4)), F.get(w, F.lit(3))).alias("said")))

        def said(r: Column) -> Column:
            count = lambda *names: F.size(F.filter(r, lambda x: x["status"].isin(*names)))
            waits = ("pending-install", "pending-upgrade")
            other = F.size(r) - count("deployed", "failed", *waits)
            bad = F.transform(F.filter(r, lambda x: x["status"].isin("failed", *waits)), lambda x: _say(x["name"], " (", F.when(x["status"] == "failed", "failed").otherwise(x["said"]), ")"))
            head = _say("helm: ", count("deployed"), " deployed, ", count("failed"), " failed, ", count(*waits), " pending", F.when(other > 0, _say(", ", other, " other")).otherwise(""))
            return F.when(header, F.concat(head, F.when(F.size(bad) > 0, _say("\nIssues: ", _joined(bad, ", "))).otherwise("")))

        return _let(rows, said)

    return _let(text.lines(c), body)


# ------------------------------------------------------------------ JavaScript tools


def vitest(c: Column) -> Column:
    def body(own: Column) -> Column:
        trimmed = F.transform(own, _trim)
        none = _any(trimmed, lambda x: F.lower(x).startswith("tests") & F.lower(x).contains("no test"))
        sums = F.filter(trimmed, lambda x: F.lower(x).contains("tests ") & F.lower(x).rlike("failed|passed"))
        number = lambda word: _last(F.transform(sums, lambda x: _numbers(x, rf"(\d+)[^|\d]*{word}")))
        marks = lambda mark: F.size(F.filter(own, lambda x: x.contains(f" {mark} ") & ~x.contains("failed |"))).cast("bigint")
        has = F.size(sums) > 0
        passed, failed = F.when(has, number("passed")).otherwise(marks("✓")), F.when(has, number("failed")).otherwise(marks("✗"))
        counted = _last(F.transform(sums, lambda x: _numbers(x, r"\(\s*(\d+)\s*\)")))
        places = F.array_distinct(F.filter(F.transform(trimmed, lambda x: F.regexp_extract(x, r"❯\s*(?:[^:]*/)?([^/:]+:[^:\s]+)", 1)), lambda x: x != ""))

        def said(v: Column) -> Column:
            total = F.when(v["counted"] > 0, v["counted"]).otherwise(v["passed"] + v["failed"])
            bad = F.when(v["failed"] > 0, v["failed"]).otherwise(F.size(v["places"]))
            clean = (v["failed"] == 0) & (F.size(v["places"]) == 0)
            shown = F.when(F.size(v["places"]) > 0, _say(" [", _joined(_first(v["places"], 5), ", "), "]")).otherwise("")
            return F.when(none, None).when(clean, F.when(has | (v["passed"] > 0), _say("vitest: ✓ ", v["passed"], "/", total, " passed"))).otherwise(_say("vitest: ✓ ", v["passed"], "/", total, " | ✗ ", bad, shown))

        return _let(F.struct(passed.alias("passed"), failed.alias("failed"), counted.alias("counted"), places.alias("places")), said)

    return _let(text.lines(c), body)


def tsc(c: Column) -> Column:
    def body(own: Column) -> Column:
        rows = F.filter(own, lambda x: x.contains("error TS"))
        code = lambda x: F.regexp_extract(x, r"error (TS[^:]*)", 1)
        placed = lambda x: F.regexp_extract(x, r"^(.*?)\): .*?error TS", 1)
        base = lambda p: F.regexp_extract(p, r"([^/]*)$", 1)
        file = lambda x: F.when(placed(x) != "", base(_trim(F.regexp_extract(placed(x), r"^([^(]*)\(", 1)))).when(x.contains(" in '"), base(F.regexp_extract(x, r".* in '(.*?)'*$", 1))).otherwise("unknown")
        issue = lambda x: F.when(placed(x) != "", _say(code(x), ":l", F.regexp_extract(placed(x), r"\(([^,]*)", 1))).otherwise(code(x))
        found = F.array_sort(F.filter(F.transform(rows, lambda x, i: F.struct(file(x).alias("file"), i.alias("i"), issue(x).alias("issue"))), lambda r: r["file"] != ""))
        groups = F.transform(_groups(found, lambda a, b: a["file"] != b["file"]), lambda g: F.struct((-F.size(g)).alias("n"), F.element_at(g, 1)["file"].alias("file"), _joined(F.transform(g, lambda r: r["issue"]), ", ").alias("said")))
        sums = F.filter(own, lambda x: ~x.contains("error TS") & F.lower(x).contains("found ") & F.lower(x).contains(" error"))
        total = F.when(F.size(rows) > 0, F.size(rows).cast("bigint")).otherwise(_last(F.transform(sums, lambda x: F.get(_words(x), F.lit(1)).try_cast("bigint"))))

        def said(g: Column) -> Column:
            each = F.transform(_first(g, 5), lambda r: _say("\n  ", r["file"], ": ", -r["n"], " errors [", text.columns_truncated(r["said"], 57), "]"))
            more = F.when(F.size(g) > 5, _say("\n  +", F.size(g) - 5, " more files")).otherwise("")
            clean = F.when(F.size(sums) > 0, "tsc: no errors")
            return F.when(total == 0, clean).when(F.size(g) > 0, _say("tsc: ", total, " errors in ", F.size(g), " files", _joined(each, ""), more))

        return _let(F.array_sort(groups), said)

    return _let(F.transform(text.lines(c), _trim), body)


def playwright(c: Column) -> Column:
    def body(own: Column) -> Column:
        number = lambda word: _last(F.transform(F.filter(own, lambda x: x.endswith(word) | (x.contains(f"{word} (") & x.endswith(")"))), lambda x: F.get(_words(x), F.lit(0)).try_cast("bigint")))
        parts = F.filter(F.transform(F.filter(own, lambda x: x.contains("✗") & x.contains(" › ")), lambda x: F.split(x, " › ")), lambda p: F.size(p) >= 3)
        place = lambda p: F.regexp_replace(F.regexp_extract(F.element_at(p, 2), r"([^/]*)$", 1), r"^([^:]*:[^:]*):[^:]*$", "$1")
        bad = F.transform(parts, lambda p: _say(F.get(F.split(F.element_at(p, 3), r" \("), F.lit(0)), ":", place(p)))
        marks = lambda mark: F.size(F.filter(own, lambda x: F.concat(F.lit(" "), x).contains(f" {mark} "))).cast("bigint")
        told = number("passed") + number("failed") > 0

        def said(v: Column) -> Column:
            head = _say("playwright: ✓ ", v["passed"], "/", v["passed"] + v["failed"])
            shown = F.when(F.size(bad) > 0, _say(" [", _joined(_first(bad, 3), ", "), "]")).otherwise("")
            return F.when(v["failed"] == 0, F.when(v["passed"] > 0, _say(head, " passed"))).otherwise(_say(head, " | ✗ ", v["failed"], shown))

        return _let(F.struct(F.when(told, number("passed")).otherwise(marks("✓")).alias("passed"), F.when(told, number("failed")).otherwise(marks("✗")).alias("failed")), said)

    return _let(F.transform(text.lines(c), _trim), body)


_FINDING = r"^\s*\d+:\d+\s+(error|warning)(\s|$)"


def eslint(c: Column) -> Column:
    def body(own: Column) -> Column:
        silent = lambda x: (x == "") | x.contains("✖") | F.lower(x).contains("checking")
        sums = F.filter(own, lambda x: silent(x) & x.contains("problems ("))
        said_of = lambda pattern: _last(F.transform(sums, lambda x: _numbers(x, pattern)))
        errors, warnings = said_of(r"[( ](\d+) errors?"), said_of(r"[ ](\d+) warnings?")
        rows = F.filter(own, lambda x: ~silent(x))
        path = lambda x: ~x.contains(" error ") & ~x.contains(" warning ") & x.rlike(r"[/\\]") & ~x.contains(" ")
        finds = lambda x: x.contains(" error ") | x.contains(" warning ")

        def found(r: Column) -> Column:
            heads = F.filter(F.transform(r, lambda x, i: F.when(path(x), i)), lambda i: i.isNotNull())
            inline = lambda x: F.regexp_extract(x, r"^([^:]*[/.\\][^:]*):", 1)
            above = lambda h, i: F.try_element_at(r, F.array_max(F.filter(h, lambda p: p <= i)) + 1)
            one = lambda h, x, i: F.when(finds(x) & (inline(x) != ""), F.struct(inline(x).alias("file"), F.get(_words(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), F.lit(0)).alias("at"), x.contains(" error ").alias("error"))).when(
                x.rlike(_FINDING), F.struct(above(h, i).alias("file"), F.get(_words(x), F.lit(0)).alias("at"), x.contains(" error ").alias("error")))
            each = _let(heads, lambda h: F.transform(r, lambda x, i: one(h, x, i)))
            return F.filter(each, lambda p: p["file"].isNotNull() & p["at"].isNotNull())

        def said(v: Column) -> Column:
            files = F.size(F.array_distinct(F.concat(F.filter(rows, path), F.filter(F.transform(rows, lambda x: F.when(finds(x), F.regexp_extract(x, r"^([^:]*[/.\\][^:]*):", 1))), lambda x: x != ""))))
            ordered = _first(F.concat(F.filter(v, lambda p: p["error"]), F.filter(v, lambda p: ~p["error"])), 20)
            names = F.array_distinct(F.transform(ordered, lambda p: p["file"]))
            listed = F.transform(names, lambda n: _say("\n  ", n, ": ", _joined(F.transform(F.filter(ordered, lambda p: p["file"] == n), lambda p: p["at"]), ", ")))
            more = F.when(F.size(v) > 20, _say("\n  [", F.size(v) - 20, " more locations omitted]")).otherwise("")
            rules_said = F.filter(F.transform(F.filter(rows, finds), lambda x: F.element_at(_words(x), -1)), lambda w: w.rlike("[/-]"))
            counts = F.array_sort(F.transform(F.array_distinct(rules_said), lambda w: F.struct((-F.size(F.filter(rules_said, lambda y: y == w))).alias("n"), w.alias("rule"))))
            top = F.when(F.size(counts) > 0, _say("\n  top rules: ", _joined(F.transform(_first(counts, 3), lambda k: _say(k["rule"], ": ", -k["n"])), ", "))).otherwise("")
            signal = (F.size(sums) > 0) | _any(rows, finds)
            return F.when((errors == 0) & (warnings == 0), F.when(signal, "eslint: no problems found")).otherwise(_say("eslint: ", errors, " errors, ", warnings, " warnings in ", files, " files", _joined(listed, ""), more, top))

        return _let(_let(rows, found), said)

    return _let(F.transform(text.lines(c), _trim), body)


#: A file that was written: a path with an ending, how long it took, and perhaps that it is unchanged.
_WRITTEN = r"^\s*[^\s\[:][^\s:]*\.[^\s:./]+\s+\d+ms(\s+\(unchanged\))?\s*$"


def prettier(c: Column) -> Column:
    capped = lambda rows: _joined(F.concat(F.transform(_first(rows, 20), lambda x: _say("  ", x)), F.when(F.size(rows) > 20, F.array(_say("  … and ", F.size(rows) - 20, " more"))).otherwise(F.array().cast("array<string>"))))

    def body(own: Column) -> Column:
        check = _any(own, lambda x: x.contains("Checking formatting") | x.contains("[warn]"))
        unformed = F.filter(F.transform(F.filter(own, lambda x: _trim(x).startswith("[warn] ")), lambda x: F.substring(_trim(x), 8, 1 << 30)), lambda x: (x != "") & ~x.startswith("Code style issues"))
        written = F.filter(own, lambda x: x.rlike(_WRITTEN))
        changed = F.transform(F.filter(written, lambda x: ~x.contains("(unchanged)")), lambda x: F.element_at(_words(x), 1))
        checked = F.when(F.size(unformed) == 0, "prettier --check: all files formatted").otherwise(_say("prettier --check: ", F.size(unformed), " file(s) need formatting\n", capped(unformed)))
        wrote = _say("prettier --write: ", F.size(changed), " reformatted, ", F.size(written) - F.size(changed), " unchanged", F.when(F.size(changed) > 0, _say("\n", capped(changed))).otherwise(""))
        return F.when(check, checked).when(F.size(written) > 0, wrote)

    return _let(text.lines(c), body)


def folded_assets(c: Column) -> Column:
    """A composite script's output with each row of asset sizes folded to its number of lines."""
    asset = lambda x: x.contains(" kB │ gzip:")
    groups = _groups(text.lines(c), lambda a, b: ~(asset(a) & asset(b)))
    rows = F.transform(groups, lambda g: F.when(asset(F.element_at(g, 1)), _say("[", F.size(g), " asset size rows omitted]")).otherwise(F.element_at(g, 1)))
    return F.when(_any(text.lines(c), asset), F.concat(_joined(rows), F.lit("\n"))).otherwise(c)


def script(c: Column) -> Column:
    """Thirty lines that matter of a script's output, or null."""
    strong = lambda own: lambda t: F.filter(own, lambda x, i: F.element_at(t, i + 1).isin("Critical", "Important"))
    return _let(text.lines(c), lambda own: _let(_let(_tiers(own), strong(own)), lambda rows: F.when(F.size(rows) > 0, _trim(_with_more(rows, 30, lambda n: _say("\n… and ", n, " more"))))))


def javascript(c: Column) -> Column:
    def body(own: Column) -> Column:
        has = lambda rule: _any(own, rule)
        return (
            F.when(has(lambda x: x.rlike(r"^\s*>") & x.contains("&&")), folded_assets(c)).when(has(lambda x: x.rlike("vitest|VITE v|Test Files|Tests  ")), vitest(c))
            .when(has(lambda x: x.rlike("error TS|tsc --|Found errors") | (x.contains("Found ") & x.contains(" error") & x.contains(" in ") & x.contains("file"))), tsc(c))
            .when(has(lambda x: x.rlike(r"playwright|\[chromium\]|\[firefox\]") | (x.contains("Running ") & x.contains(" tests"))), playwright(c))
            .when(has(lambda x: x.contains(" problems (") | x.contains("@typescript-eslint/") | x.rlike(_FINDING)), eslint(c))
            .when(has(lambda x: x.contains("Checking formatting") | x.contains("[warn]") | x.contains("Code style issues") | F.lower(x).contains("prettier") | x.rlike(_WRITTEN)), prettier(c)).otherwise(script(c))
        )

    return _let(text.lines(c), body)


# ------------------------------------------------------------------ files, searches, listings


def redacted(c: Column) -> Column:
    """A text with its sensitive assignments masked and their number told, or null if it has none."""

    def body(own: Column) -> Column:
        masked = F.transform(own, lambda x: shell.redact_line(_ended(x)))
        n = F.size(F.filter(F.zip_with(own, masked, lambda a, b: _ended(a) != b), lambda x: x))
        return F.when(n > 0, _say("[", n, " sensitive value(s) redacted]\n", _joined(masked), "\n"))

    return F.when(c.contains("="), _let(text.lines(c), body))


def env_dump(c: Column) -> Column:
    tidy = _say(_joined(F.transform(text.lines(c), _ended)), "\n")
    return F.coalesce(redacted(c), F.when(c.contains("="), tidy))


def ls(c: Column) -> Column:
    def body(rows: Column) -> Column:
        count = lambda mark: F.size(F.filter(rows, lambda x: x.startswith(mark)))
        names = F.filter(F.transform(rows, lambda x: F.when(F.size(_words(x)) >= 9, _joined(F.slice(_words(x), 9, 1000), " "))), lambda n: n.isNotNull() & (n != "."))
        head = _say("ls: ", F.size(rows), " items | ", count("-"), " files, ", count("d"), " dirs, ", count("l"), " links")
        return F.concat(head, F.when(F.size(names) > 0, _say(" | last: ", F.element_at(names, -1))).otherwise(""))

    return _let(F.filter(F.transform(F.slice(text.lines(c), F.lit(2), F.greatest(F.size(text.lines(c)), F.lit(1))), _trim), lambda x: x != ""), body)


def find(c: Column) -> Column:
    """Paths without the folder that all share, if that is shorter; the prefix of all is that of the least and the greatest."""

    def body(paths: Column) -> Column:
        low, high = F.array_min(paths), F.array_max(paths)
        most = F.least(F.length(low), F.length(high))
        same = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0), lambda n, k: F.when((n == k - 1) & (F.substring(low, F.lit(1), k) == F.substring(high, F.lit(1), k)), k).otherwise(n))
        prefix = F.regexp_extract(F.substring(low, F.lit(1), same), "(?s)^(.*/)", 1)
        said = lambda p: _say("find: ", F.size(paths), " paths under ", p, "\n", _joined(F.transform(paths, lambda x: F.substring(x, F.length(p) + 1, F.lit(1 << 30)))), "\n")
        out = _let(prefix, lambda p: F.when(p != "", said(p)))
        return F.when(F.octet_length(out) < F.octet_length(c), out)

    return _let(F.filter(F.transform(text.lines(c), _trim), lambda x: (x != "") & (x != ".")), lambda p: F.when(F.size(p) > 0, body(p)))


def tree(c: Column) -> Column:
    def body(own: Column) -> Column:
        total = F.get(F.filter(own, lambda x: x.contains("director") & x.contains("file")), F.lit(0))
        top = F.filter(own, lambda x: x.rlike(r"(?U)^\s*[├└]── ") & ~x.startswith("│") & ~x.startswith("    "))
        names = F.filter(F.transform(top, lambda x: F.regexp_replace(x, r"(?U)^\s*([├└]── )+", "")), lambda x: x != "")
        head = F.coalesce(_say("tree: ", _trim(total)), _say("tree: ", F.size(own), " entries"))
        return F.concat(head, F.when(F.size(names) > 0, _say("\n  top: ", _with_more(names, 8, lambda n: _say(" +", n, " more"), ", "))).otherwise(""))

    return _let(text.lines(c), body)


def grep_sections(c: Column) -> Column:
    """Matches with each file named once where they follow each other, if that is shorter."""

    def body(own: Column) -> Column:
        path = lambda x: F.regexp_extract(_ended(x), r"(?s)^([^:]+):", 1)
        is_match = lambda x: path(x).rlike("[/.]")
        rows = F.transform(own, lambda x: F.struct(F.when(is_match(x), path(x)).alias("file"), x.alias("line")))
        sections = _groups(rows, lambda a, b: a["file"].isNull() | b["file"].isNull())

        def said(s: Column) -> Column:
            files = _groups(s, lambda a, b: a["file"] != b["file"])
            each = F.transform(files, lambda g: F.concat(F.element_at(g, 1)["file"], F.lit("\n"), _joined(F.transform(g, lambda r: _say("  ", F.substring(_ended(r["line"]), F.length(r["file"]) + 2, F.lit(1 << 30)))))))
            return _say("grep: ", F.size(s), " matches in ", F.size(files), " files\n", _joined(each))

        out = _say(_joined(F.transform(sections, lambda s: F.when(F.element_at(s, 1)["file"].isNull(), F.element_at(s, 1)["line"]).otherwise(said(s)))), "\n")
        return F.when(_any(own, is_match) & (F.octet_length(out) < F.octet_length(c)), out)

    return _let(text.lines(c), body)


#: What makes a match worth showing first.
PRIORITY = "error|panic|todo|fixme|unsafe|secret|password|token"


def grep_tool(c: Column) -> Column:
    """The ten files of most matches, three lines each; at least 20 matches and a fifth shorter."""

    def body(own: Column) -> Column:
        rows = F.array_sort(F.filter(F.transform(own, lambda x, i: F.struct(F.get(F.split(x, ":"), F.lit(0)).alias("file"), (~F.lower(x).rlike(PRIORITY)).cast("int").alias("later"), i.alias("i"), x.alias("line"))), lambda r: r["file"] != ""))
        files = F.array_sort(F.transform(_groups(rows, lambda a, b: a["file"] != b["file"]), lambda g: F.struct((-F.size(g)).alias("n"), F.element_at(g, 1)["file"].alias("file"), F.transform(_first(g, 3), lambda r: r["line"]).alias("shown"))))

        def said(f: Column) -> Column:
            each = F.transform(_first(f, 10), lambda r: _say("\n--- ", r["file"], " (", -r["n"], " matches) ---\n", _joined(r["shown"]), F.when(-r["n"] > F.size(r["shown"]), _say("\n  ... [", -r["n"] - F.size(r["shown"]), " more matches in this file]")).otherwise(""), "\n"))
            rest = F.slice(f, 11, 1 << 30)
            more = F.when(F.size(f) > 10, _say("\n--- ", F.size(f) - 10, " more files with matches ---\n", _joined(F.transform(rest, lambda r: _say("  ", r["file"], " (", -r["n"], " matches)"))), "\n")).otherwise("")
            return _trim(_say("[Grep: ", F.size(own), " matches in ", F.size(f), " files]\n", _joined(each, ""), more))

        out = F.when((F.size(own) >= 20) & (F.size(files) > 0), _let(files, said))
        return F.when(F.octet_length(out) < F.floor(F.octet_length(c) * 8 / 10), out)

    return _let(text.lines(c), body)


def user_filtered(c: Column) -> Column:
    return F.when(_is_env(text.lines(c)), env_dump(c)).otherwise(grep_sections(c))


def _is_env(own: Column) -> Column:
    return F.size(F.filter(own, lambda x: _trim(x).rlike(r"^\p{Lu}[\p{L}\p{N}_]*="))) >= 5


def system(c: Column) -> Column:
    """Listings, found paths, trees, searches and environments, told apart by their lines."""

    def body(own: Column) -> Column:
        is_ls = F.coalesce(_trim(F.get(own, F.lit(0))), F.lit("")).startswith("total ") & _any(own, lambda x: _trim(x).rlike("^(drwx|-rw|lrwx|d---|----|drw-|-r-)"))
        joints = F.size(F.filter(own, lambda x: x.contains("├── ") | x.contains("└── ")))
        report = _any(F.slice(own, F.greatest(F.size(own) - 2, F.lit(1)), F.lit(3)), lambda x: _trim(x).rlike("^[0-9].*director") & x.contains("file"))
        is_tree = report | ((joints >= 3) & (joints * 2 > F.size(F.filter(own, lambda x: _trim(x) != ""))))
        is_find = F.size(F.filter(own, lambda x: _trim(x).rlike(r"^(\./|/[^:]*$)"))) >= 3
        full = F.filter(own, lambda x: _ended(x) != "")
        numbered = (F.size(full) >= 3) & F.forall(full, lambda x: x.rlike("^[0-9]+:"))
        is_grep = numbered | (F.size(F.filter(own, lambda x: _trim(x).rlike(r"^[^:=]*[/.\\][^:=]*:"))) >= 3)
        return F.when(_is_env(own), env_dump(c)).when(is_ls, ls(c)).when(is_tree, tree(c)).when(is_grep, grep_sections(c)).when(is_find, find(c)).otherwise(generic(c))

    return _let(text.lines(c), body)


#: Sections of a source file by its endings: (title, pattern of the trimmed line).
SECTIONS = {
    ("rs",): (("Imports", r"^(use |pub mod )"), ("Public API / Structure", r"^(pub fn |pub async fn |pub struct |pub enum |pub trait |impl )"), ("Risk Markers (TODOs, panics)", r"todo!|unimplemented!|panic!|FIXME|TODO")),
    ("py",): (("Imports", r"^(import |from )"), ("Public API / Structure", r"^(def |async def |class |@)"), ("Risk Markers", r"TODO|FIXME|NotImplementedError")),
    ("ts", "tsx", "js", "jsx"): (("Imports", r"^import "), ("Public API / Structure", r"^(export |function |class |interface |type |const .*=>)"), ("Risk Markers", r"TODO|FIXME|console\.error")),
}
STRUCTURE = {("go",): r"^(func |type |var |const |package |import)", ("java", "kt"): r"^(?!//)(import |package |.*(class |interface |public |private |protected ))"}
MIN_FILE_TOKENS = 2000


def _numbered(own: Column, rule: Text) -> Column:
    rows = F.transform(own, lambda x, i: F.when(rule(_trim(x)), _say(i + 1, " | ", x)))
    return F.filter(rows, lambda x: x.isNotNull())


def _omitted(total: Column, kept: Column) -> Column:
    return F.when(total > kept, _say("\n\n... [", total - kept, " of ", total, " file lines not rendered here: bodies and comments] ...")).otherwise("")


def head_and_tail(c: Column) -> Column:
    def body(own: Column) -> Column:
        each = F.transform(own, lambda x, i: _say(i + 1, " | ", x))
        long = _say("--- HEAD (", F.size(own), " total lines) ---\n", _joined(_first(each, 15)), "\n... [", F.size(own) - 20, " lines omitted] ...\n--- TAIL ---\n", _joined(F.slice(each, F.greatest(F.size(own) - 4, F.lit(1)), F.lit(5))))
        return F.when(F.size(own) > 30, long).otherwise(_trim(c))

    return _let(text.lines(c), body)


def _outline(c: Column, sections) -> Column:
    def body(own: Column) -> Column:
        rows = []
        for k, (_, pattern) in enumerate(sections):
            before = "|".join(f"(?:{p})" for _, p in sections[:k]) or "(?!)"
            rows.append(_numbered(own, lambda x, p=pattern, b=before: x.rlike(p) & ~x.rlike(b)))
        said = F.concat(*[F.concat(F.lit(f"{'' if k == 0 else chr(10)}--- {title} ---\n"), F.when(F.size(r) > 0, F.concat(_joined(r), F.lit("\n"))).otherwise("None in the full file\n")) for k, ((title, _), r) in enumerate(zip(sections, rows, strict=True))])
        kept = sum((F.size(r) for r in rows[1:]), F.size(rows[0]))
        return _trim(F.concat(said, _omitted(F.size(own), kept)))

    return _let(text.lines(c), body)


def _structure(c: Column, pattern: str) -> Column:
    def body(own: Column) -> Column:
        return _let(_numbered(own, lambda x: (x != "") & x.rlike(pattern)), lambda r: F.when(F.size(r) > 0, _trim(F.concat(_joined(r), F.lit("\n"), _omitted(F.size(own), F.size(r))))).otherwise(head_and_tail(c)))

    return _let(text.lines(c), body)


def json_view(c: Column) -> Column:
    return _let(text.lines(c), lambda own: F.when(F.size(own) > 30, _say(_joined(_first(own, 15)), "\n... [", F.size(own) - 15, " more lines, full JSON omitted]")).otherwise(_trim(c)))


def config_view(c: Column, toml: bool) -> Column:
    rule = (lambda x: x.startswith("[") | (~x.startswith("#") & x.contains("="))) if toml else (lambda x: ~x.startswith("#") & x.endswith(":"))

    def body(own: Column) -> Column:
        told = lambda r: F.when(F.size(r) > 0, _say("[Config structure, ", F.size(own), " lines total]\n", _trim(_joined(r)), _omitted(F.size(own), F.size(r)))).otherwise(head_and_tail(c))
        return F.when(F.size(own) > 40, _let(_numbered(own, rule), told)).otherwise(_trim(c))

    return _let(text.lines(c), body)


def log_view(c: Column) -> Column:
    def body(own: Column) -> Column:
        bad = lambda x: F.lower(x).rlike("error|fatal|panic")
        warned = F.size(F.filter(own, lambda x: ~bad(x) & F.lower(x).contains("warn")))
        rows = F.filter(F.transform(own, lambda x, i: F.when(bad(x), _say(i + 1, " | ", x))), lambda x: x.isNotNull())
        head = _say("Log: ", F.size(rows), " errors, ", warned, " warnings (", F.size(own), " total lines)\n", _with_more(rows, 10, lambda n: _say("\n... [", n, " more error lines]")))
        return _trim(F.concat(head, _omitted(F.size(own), F.least(F.size(rows), F.lit(10)))))

    return _let(text.lines(c), body)


def read_file(c: Column, path: Column, importers: Column) -> Column:
    """An outline of a long file by its ending, with a warning where more than three others import it; a fifth shorter."""
    ending = F.regexp_extract(path, r"\.([^./]+)$", 1)
    view = F.lit(None).cast("string")
    for endings, sections in SECTIONS.items():
        view = F.when(ending.isin(*endings), _outline(c, sections)).otherwise(view)
    for endings, pattern in STRUCTURE.items():
        view = F.when(ending.isin(*endings), _structure(c, pattern)).otherwise(view)
    view = F.when(ending == "json", json_view(c)).when(ending == "toml", config_view(c, True)).when(ending.isin("yaml", "yml"), config_view(c, False)).when(ending == "log", log_view(c)).otherwise(view)
    tokens = F.lit(0)
    for hint in K.BYTES_PER_TOKEN:
        tokens = F.when(text.content_hint(path) == hint, text.token_estimate(F.octet_length(c), hint)).otherwise(tokens)
    wide = F.when(importers > 3, _say("\n[", path, " is imported by ", importers, " files, changes here may have wide impact.]")).otherwise("")
    said = lambda v: F.when(F.octet_length(v) < F.floor(F.octet_length(c) * 8 / 10), _say("[File: ", path, " → distilled (", F.size(text.lines(c)), " lines)]\n", v, wide))
    return F.when(tokens >= MIN_FILE_TOKENS, _let(view, said))


def web_page(c: Column) -> Column:
    """The first 40 lines of a page that say something, without its tags; a long page, and three tenths shorter."""

    def body(full: Column) -> Column:
        rows = _first(F.filter(full, lambda x: F.octet_length(_trim(x)) > 20), 40)
        out = _say("[Web: ", F.size(text.lines(c)), " lines → ", F.size(full), " relevant]\n", _joined(rows), F.when(F.size(full) > 40, _say("\n... [", F.size(full) - 40, " more lines]")).otherwise(""))
        return F.when((F.size(text.lines(c)) >= 30) & (F.octet_length(out) < F.floor(F.octet_length(c) * 7 / 10)), out)

    return _let(F.filter(text.lines(text.strip_tags(c)), lambda x: _trim(x) != ""), body)


def other_tool(c: Column, tool: Column) -> Column:
    """The first 30 lines of what a tool without a summary said; edits of several places from 200 bytes and a fifth shorter, others over 2,000 bytes."""
    own = text.lines(c)
    out = _say("[", tool, ": ", F.size(own), " lines]\n", _joined(_first(own, 30)))
    edits = (F.octet_length(c) >= 200) & (F.octet_length(out) < F.floor(F.octet_length(c) * 8 / 10))
    return F.when(F.when(tool == "MultiEdit", edits).otherwise(F.octet_length(c) > 2000), out)


# ------------------------------------------------------------------ which summary

ROUTES: dict[str, Text] = {
    "git": git, "database": database, "security": security, "vcs": vcs_list, "test": tests, "build": build, "js": javascript, "filtered": user_filtered, "system": system, "generic": generic,
}


def cloud(c: Column, command: Column) -> Column:
    program = text.program_name(F.trim(command))
    return F.when(program.isin("docker", "podman"), docker(c)).when(program == "kubectl", kubectl(c)).when(program == "helm", helm(c)).when(program.isin("terraform", "tofu"), terraform(c)).when(program == "aws", aws(c)).otherwise(cloud_fallback(c))


def distilled(payloads: DataFrame, content: str = "content", command: str = "command") -> DataFrame:
    """payloads with `distilled`: a payload with a JSON line is left as it is, one with secrets only loses these, others go to their command's summary."""
    c, said = F.col(content), F.col(command)
    rows = payloads.withColumn("_route", rules.summariser(said)).withColumn("_hidden", redacted(c))
    # What a search printed is grouped all the same; other verbatim commands have no summary.
    rows = rows.withColumn("_route", F.when((F.col("_route") != "filtered") & passes_verbatim(said), "passthrough").otherwise(F.col("_route")))
    view = F.when(F.col("_route") == "cloud", cloud(c, said))
    for name, render in ROUTES.items():
        view = view.when(F.col("_route") == name, render(c))
    return rows.withColumn("distilled", F.when(has_json_line(c), c).otherwise(F.coalesce("_hidden", view, c))).drop("_route", "_hidden")


def distilled_by_tool(payloads: DataFrame, tool: str = "tool", content: str = "content", command: str = "command", importers: str = "importers") -> DataFrame:
    """payloads with `distilled` for tools other than the shell: file reads, searches, web pages, edits and any other; null where one is left as it is."""
    c, t = F.col(content), F.col(tool)
    view = F.when(t == "Read", read_file(c, F.col(command), F.col(importers))).when(t == "Grep", grep_tool(c)).when(t == "WebFetch", web_page(c)).when(t != "Bash", other_tool(c, t))
    return payloads.withColumn("distilled", view)

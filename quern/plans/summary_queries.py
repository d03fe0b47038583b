"""Queries of the summaries over made outputs of tools, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import lines as L
from quern.operators import renders
from quern.operators import summaries as S
from quern.plans.catalog import query
from quern.plans.line_queries import _TIERED
from quern.sources.views import log_lines, table

#: Lines of each tool's made output; an event picks one by its number, which stands for %d.
MADE = {
    "test": ("test a_%d ... ok", "test b_%d ... FAILED", "test c_%d ... ignored", "running %d tests", "✓ works %d"),
    "security": ("CRITICAL CVE-%d", "HIGH CVE-%d", "MEDIUM CVE-%d", "LOW CVE-%d", "Total: %d", "HIGH then CRITICAL %d"),
    "docker_ps": ("%d img cmd Up 2 hours web", "%d img cmd Exited (0) old", "CONTAINER ID IMAGE", "%d img cmd Created x"),
    "docker_build": ("Step 1/%d : RUN x", " ---> Using cache", "Successfully built %d", "plain %d"),
    "helm": ("a%d default 1 now deployed chart", "b%d default 1 now failed chart", "c%d default 1 now pending-install chart"),
    "terraform": ("  # r.a%d will be created", "  # r.b%d will be updated in-place", "  # r.c%d will be destroyed", "Plan: %d to add"),
    "tsc": ("src/a.ts(%d,1): error TS2307: no", "src/b/c.ts(%d,2): error TS1: no", "error TS%d: bare", "ok %d"),
    "prettier": ("[warn] f%d.js", "f%d.js 12ms (unchanged)", "g%d.js 15ms"),
    "ls": ("total %d", "-rw-r--r-- 1 a a %d f", "drwxr-xr-x 2 a a %d d", "lrwxrwxrwx 1 a a %d l"),
    "database": ("ERROR: no column %d", "HINT: try %d", "(%d rows)", "a | %d", "FATAL: down %d"),
    "log": ("Error at %d", "warn: %d", "info %d"),
    "git_status": ("On branch b%d", "Changes to be committed:", "\tnew file: f%d", "Changes not staged for commit:", "    modified: g%d", "Untracked files:", "\th%d"),
    "git_log": ("commit abcdef0%d", "Author: a%d", "    subject %d", "    body %d"),
    "git_diff": ("diff --git a/f%d b/f", "--- a/f%d", "+++ b/f%d", "@@ -1 +1 @@ %d", "+new %d", "-old %d", " same %d"),
    "eslint": ("/src/a%d.js", "  1:2  error  bad %d  rule", "  3:4  warning  meh %d  rule", "%d problems"),
    "grep": ("src/a.py:%d:import os", "src/b.py:%d:x = 1", "Binary file %d matches", "src/a.py:%d:def f"),
    "find": ("./src/app/f%d.py", "./src/lib/g%d.py", "./src/h%d.py"),
    "outline": ("import os%d", "def f_%d():", "    x = %d", "# TODO %d", "class C%d:"),
}


def made_lines(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    own = MADE[tool]
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    template = F.element_at(F.array(*[F.lit(t) for t in own]), ((F.col("event_id") * 7 + F.col("user_id")) % len(own)).cast("int") + 1)
    return e.select(F.col("user_id").alias("doc_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("i"), F.replace(template, F.lit("%d"), F.col("event_id").cast("string")).alias("line"))


def _lines_sql(tool: str) -> str:
    own = MADE[tool]
    listed = ", ".join("'" + t.replace("'", "''").replace("\t", "' || chr(9) || '") + "'" for t in own)
    return f"lines AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, replace([{listed}][(event_id * 7 + user_id) % {len(own)} + 1], '%d', event_id::VARCHAR) AS line FROM events)"


def _first_sql(condition: str, n: int) -> str:
    return f"coalesce(array_to_string((list(line ORDER BY i) FILTER (WHERE {condition}))[:{n}], chr(10)), '')"


#: The same counts and lists in SQL.
_COUNT_SQL = {
    "test": {"passed": r"regexp_matches(line, '\.\.\. ok$|^--- PASS|^[✓✔]')", "failed": r"regexp_matches(line, '\.\.\. FAILED$|^--- FAIL|^FAILED |^[✗✘]')", "ignored": r"regexp_matches(line, '\.\.\. ignored$')"},
    "security": {"critical": "contains(line, 'CRITICAL')", "high": "contains(line, 'HIGH') AND NOT contains(line, 'CRITICAL')", "medium": "contains(line, 'MEDIUM')", "low": "contains(line, 'LOW')"},
    "docker_ps": {"total": "NOT starts_with(line, 'CONTAINER ID')", "running": "contains(line, ' Up ')", "exited": "contains(line, ' Exited ')"},
    "docker_build": {"steps": r"regexp_matches(line, '^Step \d+/\d+')", "cached": "line ILIKE '%using cache%'", "built": "contains(line, 'Successfully built')"},
    "helm": {"deployed": "contains(line, ' deployed ')", "failed": "contains(line, ' failed ')", "pending": "contains(line, ' pending')"},
    "terraform": {"add": "contains(line, 'will be created')", "change": "contains(line, 'will be updated')", "destroy": "contains(line, 'will be destroyed')"},
    "tsc": {"errors": r"regexp_matches(line, 'error TS\d+:')", "located": "contains(line, '): error TS')"},
    "prettier": {"unformatted": "starts_with(line, '[warn] ')", "unchanged": "contains(line, '(unchanged)')", "reformatted": r"regexp_matches(line, ' \d+ms$')"},
    "ls": {"items": "NOT starts_with(line, 'total ')", "files": "starts_with(line, '-')", "dirs": "starts_with(line, 'd')", "links": "starts_with(line, 'l')"},
    "log": {"errors": "line ILIKE '%error%'", "warnings": "line ILIKE '%warn%'"},
    "database": {"errors": "regexp_matches(line, '^(ERROR|FATAL|PANIC):')", "hints": "starts_with(line, 'HINT:')", "rows": r"regexp_matches(line, '^\(\d+ rows?\)$')"},
}
_LIST_SQL = {
    "test": {"failures": (_COUNT_SQL["test"]["failed"], 10)}, "security": {"worst": (_COUNT_SQL["security"]["critical"], 5)}, "docker_ps": {"names": (_COUNT_SQL["docker_ps"]["exited"], 5)},
    "terraform": {"resources": ("contains(line, ' will be ')", 5)}, "database": {"first_errors": (_COUNT_SQL["database"]["errors"], 3)}, "log": {"first_errors": (_COUNT_SQL["log"]["errors"], 10)},
}


def _register(tool: str) -> None:
    counts = "".join(f', count(*) FILTER (WHERE {c}) AS "{n}"' for n, c in _COUNT_SQL[tool].items())
    lists = "".join(f', {_first_sql(c, n)} AS "{name}"' for name, (c, n) in _LIST_SQL.get(tool, {}).items())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.summary(made_lines(spark, sf_dir, tool), tool)

    run.__name__ = f"sum_{tool}"
    query(f"WITH {_lines_sql(tool)} SELECT doc_id, count(*) AS n_lines{counts}{lists} FROM lines GROUP BY doc_id")(run)


for _tool in _COUNT_SQL:
    _register(_tool)


@query(f"""WITH {_lines_sql("git_status")}, h AS (SELECT *, CASE WHEN starts_with(line, 'Changes to be') THEN 'staged' WHEN starts_with(line, 'Changes not') THEN 'modified' WHEN starts_with(line, 'Untracked') THEN 'untracked' END AS h FROM lines),
s AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS section, regexp_matches(line, '^(\\t|    )\\S') AS entry FROM h)
SELECT doc_id, max(line[11:]) FILTER (WHERE starts_with(line, 'On branch ')) AS branch, count(*) FILTER (WHERE entry AND section = 'staged') AS staged, count(*) FILTER (WHERE entry AND section = 'modified') AS modified, count(*) FILTER (WHERE entry AND section = 'untracked') AS untracked FROM s GROUP BY 1""")
def sum_git_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.git_status(made_lines(spark, sf_dir, "git_status"))


@query(f"""WITH {_lines_sql("git_log")}, c AS (SELECT *, sum(regexp_matches(line, '^commit [0-9a-f]{{7,40}}')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM lines)
SELECT doc_id, min(i) AS i, concat_ws(' ', min(line[8:14]) FILTER (WHERE starts_with(line, 'commit ')), trim(arg_min(line, i) FILTER (WHERE starts_with(line, '    ')))) AS entry FROM c WHERE c > 0 GROUP BY doc_id, c""")
def sum_git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.git_log(made_lines(spark, sf_dir, "git_log"))


@query(f"""WITH {_lines_sql("git_diff")}, w AS (SELECT *, last_value(CASE WHEN starts_with(line, 'diff --git') THEN 'head' WHEN starts_with(line, '@@ ') THEN 'hunk' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS w FROM lines)
SELECT doc_id, count(*) FILTER (WHERE starts_with(line, 'diff --git')) AS files, count(*) FILTER (WHERE w = 'hunk' AND starts_with(line, '+')) AS added, count(*) FILTER (WHERE w = 'hunk' AND starts_with(line, '-')) AS removed FROM w GROUP BY 1""")
def sum_git_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.git_diff(made_lines(spark, sf_dir, "git_diff"))


@query(f"""WITH {_lines_sql("eslint")}, f AS (SELECT *, last_value(CASE WHEN starts_with(line, '/') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS file FROM lines)
SELECT doc_id, file, count(*) FILTER (WHERE contains(line, '  error  ')) AS errors, count(*) FILTER (WHERE contains(line, '  warning  ')) AS warnings FROM f WHERE file IS NOT NULL AND starts_with(line, '  ') GROUP BY 1, 2""")
def sum_eslint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.eslint(made_lines(spark, sf_dir, "eslint"))


@query(f"""WITH {_lines_sql("grep")}, m AS (SELECT doc_id, i, line, regexp_extract(line, '^([^:\\s]+):\\d+:', 1) AS file FROM lines), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, file ORDER BY i) AS k FROM m WHERE file <> ''),
c AS (SELECT doc_id, file, count(*) AS matches, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k <= 3) AS shown FROM k GROUP BY 1, 2)
SELECT * FROM (SELECT doc_id, file, matches, row_number() OVER (PARTITION BY doc_id ORDER BY matches DESC, file) AS place, shown FROM c) WHERE place <= 10""")
def sum_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grep_files(made_lines(spark, sf_dir, "grep"))


@query(f"""WITH {_lines_sql("tsc")}, m AS (SELECT doc_id, regexp_extract(line, '^(?:\\S*/)?([^/\\s(]+)\\(\\d+,\\d+\\): error TS', 1) AS file FROM lines), c AS (SELECT doc_id, file, count(*) AS errors FROM m WHERE file <> '' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY errors DESC, file) AS place FROM c) WHERE place <= 5""")
def sum_tsc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tsc_files(made_lines(spark, sf_dir, "tsc"))


@query(f"""WITH {_lines_sql("find")} SELECT doc_id, CASE WHEN count(DISTINCT split_part(line, '/', 3)) = 1 AND min(line) LIKE './src/%/%' THEN './src/' || min(split_part(line, '/', 3)) || '/' ELSE './src/' END AS prefix, count(*) AS n_paths FROM lines GROUP BY 1""")
def sum_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.find_prefix(made_lines(spark, sf_dir, "find"))


@query(f"""WITH {_lines_sql("outline")}, k AS (SELECT *, CASE WHEN starts_with(line, 'import ') THEN 'import' WHEN starts_with(line, 'def ') OR starts_with(line, 'class ') THEN 'api' WHEN contains(line, 'TODO') THEN 'risk' END AS kind FROM lines)
SELECT doc_id, kind, count(*) AS n, arg_min(line, i) AS first FROM k WHERE kind IS NOT NULL GROUP BY 1, 2""")
def sum_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.outline(made_lines(spark, sf_dir, "outline"))


@query(f"""WITH {_TIERED}, r AS (SELECT *, CASE WHEN tier IN ('Critical', 'Important') THEN 0 WHEN tier = 'Context' THEN 1 END AS rank FROM lifted), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, i) AS place FROM r WHERE rank IS NOT NULL)
SELECT doc_id, i, line, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), 0) - 1 AS gap FROM p WHERE place <= 20""")
def sum_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.generic(L.boosted(L.classified(log_lines(spark, sf_dir))), 20)


def _made_texts(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """doc_id, text: a tool's made lines put together."""
    own = made_lines(spark, sf_dir, tool).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("rows"))
    return own.select("doc_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"))


def _rendered(name: str, tool: str, render, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _made_texts(spark, sf_dir, tool).select("doc_id", render(F.col("text")).alias("summary"))

    run.__name__ = name
    query(f"WITH {_lines_sql(tool)}, {sql}")(run)


_rendered("render_security", "security", renders.security, """n AS (SELECT *, CASE WHEN contains(line, 'CRITICAL') THEN 4 WHEN contains(line, 'HIGH') THEN 3 WHEN contains(line, 'MEDIUM') THEN 2 WHEN contains(line, 'LOW') THEN 1 END AS l FROM lines),
a AS (SELECT doc_id, count(*) FILTER (WHERE l = 4) AS c, count(*) FILTER (WHERE l = 3) AS h, count(*) FILTER (WHERE l = 2) AS m, count(*) FILTER (WHERE l = 1) AS w, list('  🔴 ' || line ORDER BY i) FILTER (WHERE l = 4) AS cs, list('  🟠 ' || line ORDER BY i) FILTER (WHERE l = 3) AS hs FROM n GROUP BY 1)
SELECT doc_id, CASE WHEN c + h + m > 0 THEN trim('Security scan: ' || c || ' CRITICAL, ' || h || ' HIGH, ' || m || ' MEDIUM, ' || w || ' LOW' || chr(10) || array_to_string(list_concat(coalesce(cs, [])[:5], coalesce(hs, [])[:3], CASE WHEN c + h > 8 THEN ['  ... [' || (c + h - 8) || ' more findings]'] ELSE [] END), chr(10)), ' ' || chr(10))
  WHEN w > 0 THEN 'Security scan: no issues found ✓' END AS summary FROM a""")  # fmt: skip

_rendered("render_docker_ps", "docker_ps", renders.docker_ps, """r AS (SELECT * FROM lines WHERE i > 1), k AS (SELECT *, CASE WHEN contains(lower(line), 'up ') THEN 'u' WHEN contains(lower(line), 'exited') THEN 'e' ELSE 'o' END AS k FROM r),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE k = 'u') AS u, count(*) FILTER (WHERE k = 'e') AS e, count(*) FILTER (WHERE k = 'o') AS o, list(split_part(line, ' ', -1) ORDER BY i) FILTER (WHERE k = 'e') AS names FROM k GROUP BY 1)
SELECT d.doc_id, 'docker: ' || coalesce(n, 0) || ' containers | ' || coalesce(u, 0) || ' running, ' || coalesce(e, 0) || ' exited' || CASE WHEN o > 0 THEN ', ' || o || ' other' ELSE '' END || CASE WHEN e > 0 THEN chr(10) || 'Exited: ' || array_to_string(names[:5], ', ') || CASE WHEN e > 5 THEN ' +' || (e - 5) || ' more' ELSE '' END ELSE '' END AS summary
FROM (SELECT DISTINCT doc_id FROM lines) d LEFT JOIN a ON a.doc_id = d.doc_id""")  # fmt: skip

_rendered("render_terraform", "terraform", renders.terraform, """r AS (SELECT *, CASE WHEN contains(line, 'will be created') THEN '+' WHEN contains(line, 'will be updated') THEN '~' WHEN contains(line, 'will be destroyed') THEN '-' END AS m FROM lines),
a AS (SELECT doc_id, count(*) FILTER (WHERE m = '+') AS x, count(*) FILTER (WHERE m = '~') AS y, count(*) FILTER (WHERE m = '-') AS z, arg_max(regexp_extract(line, 'Plan: (\\d+)', 1), i) FILTER (WHERE starts_with(line, 'Plan:')) AS p, list(m || ' ' || split_part(trim(line), ' ', 2) ORDER BY i) FILTER (WHERE m IS NOT NULL) AS rs FROM r GROUP BY 1)
SELECT doc_id, 'terraform: +' || CASE WHEN x > 0 THEN x::VARCHAR ELSE coalesce(p, '0') END || ' ~' || y || ' -' || z || ' resources' || CASE WHEN len(rs) > 0 THEN chr(10) || array_to_string(rs[:5], chr(10)) || CASE WHEN len(rs) > 5 THEN chr(10) || '... +' || (len(rs) - 5) || ' more' ELSE '' END ELSE '' END AS summary FROM a""")  # fmt: skip

_rendered("render_vcs_list", "find", renders.vcs_list, """a AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM lines GROUP BY 1)
SELECT doc_id, CASE WHEN len(ls) > 10 THEN array_to_string(ls[:10], chr(10)) || chr(10) || '... [' || (len(ls) - 10) || ' more items, use --limit to see more]' END AS summary FROM a""")  # fmt: skip

_rendered("render_prettier", "prettier", renders.prettier, """a AS (SELECT doc_id, list('  ' || line[8:] ORDER BY i) FILTER (WHERE starts_with(line, '[warn] ')) AS w, count(*) FILTER (WHERE contains(line, '(unchanged)')) AS u, list('  ' || split_part(line, ' ', 1) ORDER BY i) FILTER (WHERE line LIKE 'g%') AS g FROM lines GROUP BY 1)
SELECT doc_id, CASE WHEN len(w) > 0 THEN 'prettier --check: ' || len(w) || ' file(s) need formatting' || chr(10) || array_to_string(w[:20], chr(10)) || CASE WHEN len(w) > 20 THEN chr(10) || '  … and ' || (len(w) - 20) || ' more' ELSE '' END
  ELSE 'prettier --write: ' || coalesce(len(g), 0) || ' reformatted, ' || u || ' unchanged' || CASE WHEN len(g) > 0 THEN chr(10) || array_to_string(g[:20], chr(10)) || CASE WHEN len(g) > 20 THEN chr(10) || '  … and ' || (len(g) - 20) || ' more' ELSE '' END ELSE '' END END AS summary FROM a""")  # fmt: skip

#: The command whose output a tool's made lines stand for.
COMMANDS = {
    "git_status": "git status", "git_diff": "git diff", "git_log": "git log", "test": "cargo test", "security": "trivy image x", "docker_build": "docker build .", "helm": "helm list", "terraform": "terraform plan",
    "tsc": "npx tsc", "eslint": "npx eslint .", "prettier": "npx prettier -w .", "database": "psql -c x", "grep": "grep -rn x .", "log": "journalctl",
}


@query()
def distilled_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each tool's made outputs before and after its rendered summary; tested against authored outputs."""
    own = None
    for tool, command in COMMANDS.items():
        rows = _made_texts(spark, sf_dir, tool).select(F.lit(tool).alias("tool"), F.lit(command).alias("command"), F.col("text").alias("content"))
        own = rows if own is None else own.unionByName(rows)
    n = F.octet_length
    return renders.distilled(own).groupBy("tool").agg(F.count("*").alias("payloads"), F.sum(n("content")).alias("bytes_before"), F.sum(n("distilled")).alias("bytes_after"))

"""Secret scans with a random forest against false positives, with DataFrame functions only.

A candidate is a run of at least 16 letters, digits and `+/_=-` that holds a digit or an
upper-case letter after its first character. The forest judges its length, the characters
and their changes of kind, how much of it dictionary words cover, the path it was found in
and the words before it (of the text, other candidates included). The forest is trained here, on the driver, from labelled findings
(by default those that labelled_findings() makes by rule; a caller may pass others), and its
trees become one expression. A text is scanned in its own row: nothing is shuffled.

Defined cases: a null text has no candidates and stays null. Runs are found from left to
right and never overlap; very long ones are one candidate. A null path counts as none. Ties
of the vote (half the trees) count as a secret. Rows stay as many as they are, repeated ones
too. An empty table gives an empty table. Columns keep their names and order.
"""

from __future__ import annotations

import functools
import random
import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = "[A-Za-z0-9+/_=-]{16,}"
LIVELY = "[0-9]|.[A-Z]"
BEFORE = 60
MASK = "[SECRET]"
TREES = 15
DEPTH = 6

#: Words whose letters don't speak for a random string.
DICTIONARY = (
    "password", "passwd", "secret", "token", "example", "sample", "default", "placeholder", "changeme", "your", "here", "test", "user",
    "admin", "access", "api", "key", "name", "value", "config", "data", "file", "path", "local", "share", "home", "usr", "lib", "src",
    "http", "www", "com", "org", "index", "page", "image", "version", "release", "update", "create", "delete", "select", "table",
    "string", "number", "service", "client", "server", "request", "response", "handler", "manager", "factory", "controller", "tion",
    "ment", "ing", "the", "and", "for", "with", "from", "that", "this",
)
_DICT = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
_SECRET_WORDS = "pass|pwd|secret|token|api.?key|credential|auth|bearer|private|access.?key|signing"
_OTHER_WORDS = "commit|sha|hash|digest|checksum|etag|uuid|guid|isbn|card|order|phone|invoice|version|revision|build|image|example|sample|placeholder|url|href|path"
_TEST_PATH = "test|example|sample|fixture|mock|docs|demo"
_PREFIX = "^(AKIA|ASIA|ghp_|gho_|sk_live_|sk-|xox[bp]-|AIza|eyJ|glpat-)"

FEATURES = ("length", "digits", "uppers", "lowers", "changes", "distinct", "covered", "hex", "prefix", "assigned", "secret_words", "other_words", "test_path")


class Finding(NamedTuple):
    candidate: str
    before: str
    path: str
    secret: int


def features_of(candidate: str, before: str | None, path: str | None) -> list[int]:
    """The numbers that the forest sees; feature_columns() and feature_sql() give the same."""
    n, near = len(candidate), (before or "").lower()
    kinds = candidate
    for pattern, mark in (("[0-9]+", "9"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0-9A-Za-z]+", "-")):
        kinds = re.sub(pattern, mark, kinds)
    return [
        n, len(re.findall("[0-9]", candidate)), len(re.findall("[A-Z]", candidate)), len(re.findall("[a-z]", candidate)), len(kinds) - 1,
        len(set(candidate)), 100 * (n - len(re.sub(_DICT, "", candidate.lower()))) // n, int(bool(re.search("^([0-9a-f]+|[0-9A-F]+)$", candidate))),
        int(bool(re.search(_PREFIX, candidate))), int(bool(re.search("[=:]\\s*[\"']?$", near)) or "=" in candidate[:-2]), int(bool(re.search(_SECRET_WORDS, near + candidate.lower()))),
        int(bool(re.search(_OTHER_WORDS, near))), int(bool(re.search(_TEST_PATH, (path or "").lower()))),
    ]


def labelled_findings(n: int = 2400, seed: int = 11) -> list[Finding]:
    """Findings made by rule: real-looking secrets in their usual places, and what is mistaken for them."""
    rng = random.Random(seed)
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def some(alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high or low)))

    def word(low: int = 3, high: int = 9) -> str:
        return "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(low, high) // 2 + 1))

    def prose() -> str:
        return " ".join(word() for _ in range(rng.randint(1, 5))) + " "

    def where(tests: float) -> str:
        return rng.choice(("tests/fixtures/", "docs/", "examples/")) + word() if rng.random() < tests else rng.choice(("src", "app/", "web", "etc/")) + str(rng.randint(0, 30))

    found = []
    for _ in range(n // 2):
        name = rng.choice(("password", "passwd", "secret", "token", "api_key", "auth_token", "client_secret", "access_key"))
        sep = rng.choice(("=", " = ", ": ", "=\"", " = \"", ": '"))
        body = rng.choice((lambda: some(hexa, 16, 64), lambda: some(hexa, 18), lambda: some(hexa, 40), lambda: some(mixed, 20, 48), lambda: some(mixed + "+/", 40) + "="))()
        kind = rng.random()
        if kind < 0.3:
            found.append(Finding(rng.choice(("AKIA", "ASIA")) + some(upper, 16), prose(), where(0.05), 1))
        elif kind < 0.4:
            found.append(Finding(rng.choice(("ghp_", "sk_live_", "glpat-", "AIza")) + some(mixed, 24, 36), prose(), where(0.05), 1))
        elif kind < 0.7:
            found.append(Finding(f"{name}={body}", prose(), where(0.05), 1))
        else:
            found.append(Finding(body, prose() + name + sep, where(0.05), 1))
    for _ in range(n - n // 2):
        kind = rng.randrange(12)
        if kind == 0:
            found.append(Finding(some("0123456789", 16, 19), prose() + rng.choice(("", "card ", "order ", "invoice no. ")), where(0.1), 0))
        elif kind == 1:
            found.append(Finding(some(hexa, 40 if rng.random() < 0.7 else 32), prose() + rng.choice(("commit ", "sha1: ", "checksum ", "digest=", "etag: \"")), where(0.1), 0))
        elif kind == 2:
            found.append(Finding("-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), prose() + rng.choice(("uuid ", "guid: ", "")), where(0.1), 0))
        elif kind == 3:
            found.append(Finding(rng.choice(("password", "token", "api_key", "secret")) + "=" + rng.choice(("your_password_here", "example_token_value", "changeme_changeme1", "PLACEHOLDER_SECRET", "default_password_1")), prose(), where(0.3), 0))
        elif kind == 4:
            found.append(Finding("".join(word().capitalize() for _ in range(4))[:60].ljust(16, "a"), prose(), where(0.1), 0))
        elif kind == 5:
            found.append(Finding("".join(word(5, 9) for _ in range(3)).upper().ljust(16, "E"), prose(), where(0.1), 0))
        elif kind == 6:
            found.append(Finding("/" + "/".join(word() for _ in range(5)) + str(rng.randint(1, 99)), prose() + rng.choice(("path ", "see ", "")), where(0.1), 0))
        elif kind == 7:
            found.append(Finding("_".join(word() for _ in range(3)).ljust(14, "a") + f"_{rng.randint(10, 9999)}", prose(), where(0.1), 0))
        elif kind == 8:
            found.append(Finding(f"20{rng.randint(10, 29)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}0000-{some('0123456789', 4)}", prose(), where(0.1), 0))
        elif kind == 9:
            found.append(Finding("xX"[rng.randrange(2)] * rng.randint(15, 40) + "X1", prose() + rng.choice(("token=", "password: ", "")), where(0.3), 0))
        elif kind == 10:
            found.append(Finding(some(mixed, 20, 40), prose() + rng.choice(("token=", "secret: ")), rng.choice(("tests/fixtures/", "docs/", "examples/")) + word(), 0))
        else:
            found.append(Finding("-" * rng.randint(15, 60) + "A=" * rng.randint(1, 4), prose(), where(0.1), 0))
    return found


def train(findings: list[Finding], trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list:
    """Trees as (feature, most on the left, left, right) or a leaf's vote of 0 or 1."""
    x = np.array([features_of(f.candidate, f.before, f.path) for f in findings], np.int64).reshape(-1, len(FEATURES))
    y = np.array([f.secret for f in findings], np.int64)
    rng = np.random.default_rng(seed)

    def grown(rows: np.ndarray, left: int):
        hits = int(y[rows].sum())
        if left == 0 or hits in (0, len(rows)):
            return int(2 * hits >= len(rows))
        best = (2 * hits * (1 - hits / len(rows)) - 1e-9, None, None)
        for f in rng.choice(len(FEATURES), 5, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values = x[order, f]
            cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
            if not len(cuts):
                continue
            ones = np.cumsum(y[order])[cuts - 1]
            far = len(rows) - cuts
            impurity = 2 * ones * (1 - ones / cuts) + 2 * (hits - ones) * (1 - (hits - ones) / far)
            k = int(impurity.argmin())
            if impurity[k] < best[0]:
                best = (float(impurity[k]), int(f), int(values[cuts[k] - 1]))
        if best[1] is None:
            return int(2 * hits >= len(rows))
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], grown(rows[low], left - 1), grown(rows[~low], left - 1)

    return [grown(np.sort(rng.integers(0, len(y), len(y))), depth) for _ in range(trees)] if len(y) else []


@functools.lru_cache(maxsize=1)
def default_forest() -> list:
    return train(labelled_findings())


def votes_of(forest: list, values: list[int]) -> int:
    total = 0
    for tree in forest:
        while not isinstance(tree, int):
            tree = tree[2] if values[tree[0]] <= tree[1] else tree[3]
        total += tree
    return total


def feature_columns(candidate: Column, before: Column, path: Column) -> dict[str, Column]:
    n, low, near = F.length(candidate), F.lower(candidate), F.lower(before)

    def without(col: Column, pattern: str) -> Column:
        return F.length(F.regexp_replace(col, pattern, ""))

    kinds = candidate
    for pattern, mark in (("[0-9]+", "9"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0-9A-Za-z]+", "-")):
        kinds = F.regexp_replace(kinds, pattern, mark)
    flags = {
        "hex": candidate.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "prefix": candidate.rlike(_PREFIX),
        "assigned": near.rlike("[=:]\\s*[\"']?$") | (F.instr(F.substring(candidate, F.lit(1), n - 2), "=") > 0),
        "secret_words": F.concat(near, low).rlike(_SECRET_WORDS),
        "other_words": near.rlike(_OTHER_WORDS),
        "test_path": F.lower(path).rlike(_TEST_PATH),
    }
    return {
        "length": n, "digits": n - without(candidate, "[0-9]"), "uppers": n - without(candidate, "[A-Z]"), "lowers": n - without(candidate, "[a-z]"),
        "changes": F.length(kinds) - 1, "distinct": F.size(F.array_distinct(F.regexp_extract_all(candidate, F.lit("."), F.lit(0)))), "covered": F.floor((n - without(low, _DICT)) * 100 / n).cast("int"),
    } | {k: v.cast("int") for k, v in flags.items()}


def _vote(tree, value) -> Column:
    if isinstance(tree, int):
        return F.lit(tree)
    return F.when(value(FEATURES[tree[0]]) <= tree[1], _vote(tree[2], value)).otherwise(_vote(tree[3], value))


def candidates(text: Column, path: Column, forest: list) -> Column:
    """An array with a row for each run of a text: run, whether lively, votes of the trees.

    The words before a run are the last BEFORE characters of the text, other runs included, so
    that a long name before a value is seen. A text is split once, however many runs it has.
    """
    most = -(-BEFORE // 16)  # runs have 16 characters at least

    def voted(x: Column) -> Column:
        total = F.lit(0)
        for tree in forest:
            total = total + _vote(tree, lambda name: x["f"][name])
        return F.struct(x["run"].alias("run"), x["lively"].alias("lively"), F.when(x["lively"], total).otherwise(0).alias("votes"))

    def judged(own: Column) -> Column:
        def seen(run: Column, k: Column) -> Column:
            near = F.array_join(F.slice(own["pieces"], F.greatest(k - most + 1, F.lit(1)), F.least(k, F.lit(most))), "")
            before = F.right(F.concat(near, F.element_at(own["gaps"], k + 1)), F.lit(BEFORE))
            lively = run.rlike(LIVELY)
            return F.struct(run.alias("run"), lively.alias("lively"), F.when(lively, F.struct(*[v.alias(c) for c, v in feature_columns(run, before, path).items()])).alias("f"))

        return F.transform(F.transform(own["runs"], seen), voted)

    def pieced(own: Column) -> Column:
        pieces = F.zip_with(own["gaps"], own["runs"], lambda gap, run: F.concat(gap, F.coalesce(run, F.lit(""))))
        return F.transform(F.array(F.struct(own["gaps"].alias("gaps"), own["runs"].alias("runs"), pieces.alias("pieces"))), judged)[0]

    split = F.struct(F.split(text, RUN).alias("gaps"), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("runs"))
    return F.transform(F.array(split), pieced)[0]


def scan(docs: DataFrame, forest: list | None = None, text: str = "text", path: str = "source", found: str = "_found") -> DataFrame:
    """docs and a column `found`: runs of each text with their votes. The name must be free."""
    if found.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs have a column {found}")
    forest = default_forest() if forest is None else forest
    return docs.withColumn(found, candidates(F.col(text), F.coalesce(F.col(path), F.lit("")), forest))


def _is_secret(x: Column, trees: int) -> Column:
    return x["lively"] & (2 * x["votes"] >= trees) & (F.lit(trees) > 0)


def redacted(text: Column, found: Column, trees: int) -> Column:
    """text with every secret masked: the gaps between runs and the runs, in turn."""
    gaps = F.split(text, RUN)
    parts = F.transform(gaps, lambda gap, k: F.concat(gap, F.when(k < F.size(found), F.when(_is_secret(F.element_at(found, k.cast("int") + 1), trees), F.lit(MASK)).otherwise(F.element_at(found, k.cast("int") + 1)["run"])).otherwise("")))
    return F.when(F.exists(found, lambda x: _is_secret(x, trees)), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame, forest: list | None = None, text: str = "text", path: str = "source") -> DataFrame:
    """docs with the secrets of `text` masked; the words before a candidate are those of the text, runs included."""
    forest = default_forest() if forest is None else forest
    columns = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(path), F.lit("")).alias("path"))
    rows = rows.withColumn("found", candidates(F.col("text"), F.col("path"), forest))
    return rows.select(*[redacted(F.col("text"), F.col("found"), len(forest)).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in columns])


def digest(docs: DataFrame, forest: list | None = None) -> DataFrame:
    """doc_id, n_candidates, n_secrets, redacted_sha256."""
    forest = default_forest() if forest is None else forest
    rows = scan(docs.select("doc_id", "text", "source"), forest)
    return rows.select(
        "doc_id",
        F.coalesce(F.size(F.filter(F.col("_found"), lambda x: x["lively"])), F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce(F.size(F.filter(F.col("_found"), lambda x: _is_secret(x, len(forest)))), F.lit(0)).cast("long").alias("n_secrets"),
        F.sha2(redacted(F.col("text"), F.col("_found"), len(forest)), 256).alias("redacted_sha256"),
    )


def _vote_sql(tree) -> str:
    if isinstance(tree, int):
        return str(tree)
    return f"CASE WHEN {FEATURES[tree[0]]} <= {tree[1]} THEN {_vote_sql(tree[2])} ELSE {_vote_sql(tree[3])} END"


def oracle_sql() -> str:
    forest = default_forest()
    kinds = "run"
    for pattern, mark in (("[0-9]+", "9"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0-9A-Za-z]+", "-")):
        kinds = f"regexp_replace({kinds}, '{pattern}', '{mark}', 'g')"
    left = lambda col, pattern: f"length(regexp_replace({col}, '{pattern}', '', 'g'))"
    votes = " + ".join(_vote_sql(t) for t in forest) or "0"
    return f"""
WITH split AS (
  SELECT doc_id, text, coalesce(source, '') AS path, string_split_regex(text, '{RUN}') AS gaps, regexp_extract_all(text, '{RUN}') AS runs
  FROM documents
), each AS (
  SELECT doc_id, path, gaps, runs, unnest(range(1, len(gaps) + 1)) AS k FROM split
), found AS (
  SELECT doc_id, k, gaps[k] AS gap, runs[k] AS run, path, lower(right(array_to_string(list_transform(range(greatest(1, k - {-(-BEFORE // 16)}), k), lambda j: gaps[j] || runs[j]), '') || gaps[k], {BEFORE})) AS near FROM each
), features AS (
  SELECT doc_id, k, gap, run, regexp_matches(run, '{LIVELY}') AS lively, length(run) AS length,
    length(run) - {left("run", "[0-9]")} AS digits, length(run) - {left("run", "[A-Z]")} AS uppers, length(run) - {left("run", "[a-z]")} AS lowers,
    length({kinds}) - 1 AS changes, len(list_distinct(regexp_extract_all(run, '.'))) AS "distinct",
    (100 * (length(run) - {left("lower(run)", _DICT)})) // length(run) AS covered,
    regexp_matches(run, '^([0-9a-f]+|[0-9A-F]+)$')::INT AS hex, regexp_matches(run, '{_PREFIX}')::INT AS prefix,
    (regexp_matches(near, '[=:]\\s*["'']?$') OR contains(run[:-3], '='))::INT AS assigned,
    regexp_matches(near || lower(run), '{_SECRET_WORDS}')::INT AS secret_words, regexp_matches(near, '{_OTHER_WORDS}')::INT AS other_words,
    regexp_matches(lower(path), '{_TEST_PATH}')::INT AS test_path
  FROM found
), voted AS (
  SELECT doc_id, k, gap, run, lively, lively AND 2 * ({votes.replace("distinct <=", '"distinct" <=')}) >= {len(forest)} AS secret FROM features
), whole AS (
  SELECT doc_id, count(*) FILTER (WHERE lively) AS n_candidates, count(*) FILTER (WHERE secret) AS n_secrets,
    string_agg(gap || CASE WHEN run IS NULL THEN '' WHEN secret THEN '{MASK}' ELSE run END, '' ORDER BY k) AS text
  FROM voted GROUP BY doc_id
)
SELECT d.doc_id, coalesce(w.n_candidates, 0)::BIGINT AS n_candidates, coalesce(w.n_secrets, 0)::BIGINT AS n_secrets, sha256(w.text) AS redacted_sha256
FROM documents d LEFT JOIN whole w ON d.doc_id = w.doc_id
"""

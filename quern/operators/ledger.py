"""Line dedup across payloads: which lines has a reader been shown already?

A payload is (scope, seq, reader, text); its reader is the command that showed it. With one
scope, a line's first eligible showing is never seen and always delivered, so a line is seen
if the least seq of its hash in the scope is smaller than its own: one aggregate by (scope,
hash), summed before it is shuffled, and a join; no scope is ever gathered in one task. Only
keys go through the join; the lines' texts are read where a run is put together.

With the project as a second scope, what was folded as the project's is not recorded for the
session, so payloads of a project depend on each other in order: two_scopes() walks them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import constants as K
from quern.functions import classify, text
from quern.operators.formats import sniff


def eligible(payloads: DataFrame) -> DataFrame:
    """Plain payloads that are long enough."""
    return payloads.where((F.octet_length("text") >= K.MIN_LEDGER_INPUT) & sniff(F.col("text")).isNull())


def hashed_lines(payloads: DataFrame) -> DataFrame:
    """scope, seq, payload_bytes, reader, i, line, bytes (with its newline), line_hash, failing."""
    own = payloads.select("scope", "seq", "reader", F.octet_length("text").alias("payload_bytes"), F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))
    return own.select("scope", "seq", "payload_bytes", "reader", (F.col("pos") + 1).cast("long").alias("i"), "line", (F.octet_length("line") + 1).cast("long").alias("bytes"), text.line_key(F.col("line")).alias("line_hash"), classify.carries_failure(F.col("line")).alias("failing"))


def first_writer(lines: DataFrame) -> DataFrame:
    """scope, line_hash, first_seq, first_reader: a later showing never changes them."""
    return lines.groupBy("scope", "line_hash").agg(F.min("seq").alias("first_seq"), F.min_by("reader", F.struct("seq", "i")).alias("first_reader"))


def seen_lines(payloads: DataFrame) -> DataFrame:
    """hashed_lines of eligible payloads with first_seq, seen and source; lines that state a failure are never seen.

    source: the command that showed a seen line first, if it isn't the one that shows it now.
    """
    own = hashed_lines(eligible(payloads))
    seen = (F.col("first_seq") < F.col("seq")) & ~F.col("failing")
    other = F.col("seen") & (F.col("first_reader") != "") & (F.col("first_reader") != F.col("reader"))
    return own.join(first_writer(own), ["scope", "line_hash"]).withColumn("seen", seen).withColumn("source", F.when(other, F.col("first_reader"))).drop("first_reader")


def runs(seen: DataFrame) -> DataFrame:
    """Maximal rows of seen lines with one source: scope, seq, run, source, first_line, last_line, n_lines, run_bytes, payload_bytes, seen_bytes, body."""
    along = Window.partitionBy("scope", "seq").orderBy("i")
    # What lag() gives for a payload's first line is no line: it opens run 0, whatever its source.
    differs = (F.col("i") > 1) & ((F.col("seen") != F.lag("seen").over(along)) | ~F.col("source").eqNullSafe(F.lag("source").over(along)))
    marked = seen.withColumn("change", differs.cast("long"))
    marked = marked.withColumn("run", F.sum("change").over(along)).withColumn("seen_bytes", F.sum(F.when(F.col("seen"), F.col("bytes")).otherwise(0)).over(Window.partitionBy("scope", "seq")))
    rows = marked.where("seen").groupBy("scope", "seq", "run").agg(
        F.first("source").alias("source"), F.min("i").alias("first_line"), F.max("i").alias("last_line"), F.count("*").alias("n_lines"), F.sum("bytes").alias("run_bytes"),
        F.first("payload_bytes").cast("long").alias("payload_bytes"), F.first("seen_bytes").alias("seen_bytes"), F.sort_array(F.collect_list(F.struct("i", "line"))).alias("rows"),
    )
    return rows.withColumn("body", F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).drop("rows")


def marker(n_lines: Column, n_bytes: Column, key: Column, source: Column) -> Column:
    came = F.when(source.isNotNull(), F.concat(F.lit(" first in "), text.source_label(source))).otherwise("")
    return F.concat(F.lit(K.MARKER), n_lines.cast("string"), F.lit(" lines, "), n_bytes.cast("string"), F.lit(" bytes"), came, F.lit(", see "), key, F.lit("]"))


def folds(seen: DataFrame, gain: int = K.RUN_GAIN) -> DataFrame:
    """runs that are worth a marker, with handle and marker.

    A short payload of which four fifths were seen is left whole.
    """
    own = runs(seen).withColumn("handle", text.handle(F.col("body")))
    own = own.withColumn("marker", marker(F.col("n_lines"), F.col("run_bytes"), F.col("handle"), F.col("source")))
    whole = (F.col("payload_bytes") < K.WHOLE_OUTPUT) & (F.col("seen_bytes") * 5 >= F.col("payload_bytes") * 4)
    return own.where(~whole & (F.col("run_bytes") >= F.octet_length("marker") + 1 + gain))


def savings(fold: DataFrame) -> DataFrame:
    """By scope: payloads folded, runs, lines and bytes folded, bytes of markers."""
    return fold.groupBy("scope").agg(F.count_distinct("seq").alias("payloads"), F.count("*").alias("runs"), F.sum("n_lines").alias("lines"), F.sum("run_bytes").alias("bytes"), F.sum(F.octet_length("marker") + 1).alias("marker_bytes"))


def archive(texts: DataFrame) -> DataFrame:
    """hash, copies, original_len, content of (ts, text): one row for each content."""
    own = texts.select(text.handle(F.col("text")).alias("hash"), "ts", F.octet_length("text").cast("long").alias("original_len"), "text")
    return own.groupBy("hash").agg(F.count("*").alias("copies"), F.max("ts").alias("ts"), F.max("original_len").alias("original_len"), F.first("text").alias("content"))


def repetition_share(payloads: DataFrame, least: int = 12) -> DataFrame:
    """By scope: bytes of lines of at least `least` bytes, and of those shown before in the scope."""
    own = hashed_lines(payloads).where(F.col("bytes") - 1 >= least)
    counts = own.groupBy("scope", "line_hash").agg(F.sum("bytes").alias("bytes"), F.min(F.struct("seq", "i", "bytes")).alias("first"))
    return counts.groupBy("scope").agg(F.sum("bytes").alias("bytes"), F.sum(F.col("bytes") - F.col("first.bytes")).alias("repeated_bytes"))


def run_size_whatif(seen: DataFrame, gains=(100, 150, 200)) -> DataFrame:
    """Runs and bytes that would be folded at each gain."""
    own = runs(seen).withColumn("cost", F.octet_length(marker(F.col("n_lines"), F.col("run_bytes"), text.handle(F.col("body")), F.col("source"))) + 1)
    return own.withColumn("gain", F.explode(F.array(*[F.lit(g) for g in gains]))).where(F.col("run_bytes") >= F.col("cost") + F.col("gain")).groupBy("gain").agg(F.count("*").alias("runs"), F.sum("run_bytes").alias("bytes"), F.sum("cost").cast("long").alias("marker_bytes"))


class Walk:
    """One project's payloads in order: what each reader was shown, what is folded, what is owed.

    A line is (hash, bytes, failing). Both scopes keep the first writer of a hash. Decisions are
    those of one payload at a time: what is seen is read before the payload is recorded, runs
    share origin and source, a run is folded if it is worth its marker, and lines are recorded
    for both scopes only where they were delivered.
    """

    def __init__(self, ttl: int = K.WORKING_DAYS * 86400):
        self.ttl = ttl
        self.shown: dict[str, dict[str, tuple[int, str, str]]] = {}
        self.owed: dict[str, int] = {}
        self.pruned = 0

    def forget(self, scope: str) -> int:
        """At a compaction the reader holds nothing any more: how many lines it is to be shown anew."""
        return len(self.shown.pop(scope, ()))

    def pull(self, handle: str) -> None:
        """A reader asked for an archived run: its next delivery is whole."""
        self.owed[handle] = self.owed.get(handle, 0) + 1

    def prune(self, now: int) -> None:
        """Drops what was shown before the time that is kept; once a day is enough."""
        if now - self.pruned < 86400:
            return
        self.pruned = now
        for scope, lines in list(self.shown.items()):
            kept = {h: first for h, first in lines.items() if first[0] >= now - self.ttl}
            if kept:
                self.shown[scope] = kept
            else:
                del self.shown[scope]

    def _origins(self, scope: str, project: str | None, command: str, lines: list[tuple]) -> list[tuple | None]:
        session, whole = self.shown.get(scope, {}), self.shown.get(project, {}) if project is not None else {}
        never = {h for h, _, failing in lines if failing}
        out = []
        for h, _, _ in lines:
            kind, first = ("session", session[h]) if h in session else ("project", whole.get(h))
            out.append(None if h in never or first is None else (kind, first[2] if first[2] not in ("", command) else None, first[1]))
        return out

    def payload(self, scope: str, project: str | None, ts: int, agent: str, command: str, lines: list[tuple], body: Callable[[int, int], str]) -> dict:
        """What is folded of a payload. body(a, b): the text of its lines from a to b."""
        self.prune(ts)
        origins = self._origins(scope, project, command, lines)
        cuts = [0, *(k for k in range(1, len(lines)) if (origins[k] or (None,))[:2] != (origins[k - 1] or (None,))[:2]), len(lines)]
        total = sum(n for _, n, _ in lines)
        seen = sum(n for (_, n, _), o in zip(lines, origins, strict=True) if o)
        folds, folded, above, still = [], set(), 0, True
        small = total < K.WHOLE_OUTPUT and seen * 5 >= total * 4
        for a, b in zip(cuts, cuts[1:], strict=False):
            n_bytes = sum(n for _, n, _ in lines[a:b])
            said = None
            if origins[a] is not None and not small:
                kind, source, _ = origins[a]
                said = rendered(kind, b - a, n_bytes, source, whole=(a, b) == (0, len(lines)))
                gain = K.RUN_GAIN * (K.PROJECT_MULT if kind == "project" else 1)
                said = said if n_bytes >= len(said.encode()) + gain else None
            if said is not None:
                key = handle_of(body(a, b))
                if self.owed.get(key):  # the delivery that the reader asked for
                    self.owed[key] -= 1
                else:
                    folds.append((a, b, n_bytes, kind, source, key, len(said.encode()) + 1))
                    folded.update(range(a, b))
                    above += still
                    continue
            still = False
        view = total - sum(f[2] for f in folds) + sum(f[6] for f in folds)
        if view >= total:
            folds, folded, above, view = [], set(), 0, total
        tally: dict[tuple[str, str], list[int]] = {}
        for k in folded:
            own = tally.setdefault((origins[k][0], origins[k][2]), [0, 0])
            own[0] += 1
            own[1] += lines[k][1]
        for own in (scope, project):
            if own is not None:
                known = self.shown.setdefault(own, {})
                for k, (h, _, _) in enumerate(lines):
                    if k not in folded:
                        known.setdefault(h, (ts, agent, command))
        return {
            "session_seen": sum(o is not None and o[0] == "session" for o in origins), "project_seen": sum(o is not None and o[0] == "project" for o in origins),
            "view_bytes": view, "shift": shift_of(folded, len(lines), above), "folds": folds, "facts": [(*k, *v, len(folded) == len(lines)) for k, v in sorted(tally.items())],
        }


def rendered(kind: str, n_lines: int, n_bytes: int, source: str | None, whole: bool = False) -> str:
    """A marker with a handle of zeros: what a run has to be worth."""
    what = f"{n_lines} lines, {n_bytes} bytes" + ("" if kind == "session" else " not shown here") + (" and no more" if whole else "")
    return f"{K.MARKER}{what}" + (f" first in {label_of(source)}" if source else "") + f", see {'0' * K.HANDLE_CHARS}]"


def label_of(source: str) -> str:
    """source_label() of one text: its first line, gaps as one space, 40 bytes at most."""
    first = source.split("\n")[0]
    return "".join(c if c.isprintable() else " " for c in " ".join(first.split())).encode()[:40].decode(errors="ignore").strip()


def handle_of(body: str) -> str:
    import hashlib

    return hashlib.sha256(body.encode()).hexdigest()[: K.HANDLE_CHARS]


def shift_of(folded: set[int], total: int, markers_above: int) -> int | None:
    """By how much a reader that numbers lines must count further from the first line on; null where no one number will do.

    Lines that stay are one block (its first line stands `markers_above` markers down) or are cut apart.
    """
    left = [k for k in range(total) if k not in folded]
    if not left or left[0] == 0 and left[-1] == len(left) - 1:
        return 0
    return max(left[0] - markers_above, 0) if left[-1] - left[0] + 1 == len(left) else None


_FOLD = "array<struct<first_line:long,last_line:long,bytes:long,origin:string,source:string,handle:string,marker_bytes:long>>"
_FACT = "array<struct<origin:string,source_agent:string,lines:long,bytes:long,whole_output:boolean>>"
WALK_DDL = f"project string, scope string, seq long, n_lines long, payload_bytes long, session_seen long, project_seen long, view_bytes long, shift long, forgotten long, folds {_FOLD}, facts {_FACT}"


def walked(events: DataFrame, ttl: int = K.WORKING_DAYS * 86400) -> DataFrame:
    """A row for each payload and compaction of events (project, scope, seq, ts, kind, agent, command, text), as Walk decides.

    kind: `payload`; `compact`, which forgets the scope; `pull`, whose text is a handle. Events
    of a project go through one task in the order of (seq, scope), one payload at a time; what
    is held between them are the hashes of lines of the time that is kept. Payloads that aren't
    eligible pass and are not recorded.
    """
    import pandas as pd

    plain = (F.col("kind") != "payload") | ((F.octet_length("text") >= K.MIN_LEDGER_INPUT) & sniff(F.col("text")).isNull())
    body = F.when(F.col("kind") == "payload", text.lines(F.col("text")))
    rows = events.where(plain).select(
        "project", "scope", "seq", "ts", "kind", "agent", F.coalesce("command", F.lit("")).alias("command"), F.when(F.col("kind") == "pull", F.col("text")).alias("handle"), body.alias("lines"),
        F.transform(body, lambda x: text.line_key(x)).alias("hashes"), F.transform(body, lambda x: classify.carries_failure(x)).alias("failing"),
    )
    ordered = rows.repartition("project").sortWithinPartitions("project", "seq", "scope")

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, walk = None, Walk(ttl)
        for pdf in source:
            out = []
            for r in pdf.itertuples(index=False):
                if r.project != project:
                    project, walk = r.project, Walk(ttl)
                if r.kind == "pull":
                    walk.pull(r.handle)
                elif r.kind == "compact":
                    out.append((project, r.scope, r.seq, 0, 0, 0, 0, 0, 0, walk.forget(r.scope), [], []))
                else:
                    own = list(r.lines)
                    lines = [(h, len(line.encode()) + 1, bool(f)) for h, line, f in zip(r.hashes, own, r.failing, strict=True)]
                    # pandas has no null for a project: a payload without one has its session only
                    d = walk.payload(r.scope, None if pd.isna(project) else f"project {project}", int(r.ts), r.agent, r.command, lines, lambda a, b, own=own: "\n".join(own[a:b]))
                    folds = [{"first_line": a + 1, "last_line": b, "bytes": n, "origin": k, "source": s, "handle": h, "marker_bytes": m} for a, b, n, k, s, h, m in d["folds"]]
                    facts = [dict(zip(("origin", "source_agent", "lines", "bytes", "whole_output"), f, strict=True)) for f in d["facts"]]
                    out.append((project, r.scope, r.seq, len(lines), sum(x[1] for x in lines), d["session_seen"], d["project_seen"], d["view_bytes"], d["shift"], 0, folds, facts))
            names = [c.split()[0] for c in WALK_DDL.split(", ")]
            pdf = pd.DataFrame(out, columns=names)
            pdf["shift"] = pdf["shift"].astype("Int64")
            yield pdf

    return ordered.mapInPandas(run, WALK_DDL)


def two_scopes(payloads: DataFrame, project: Column) -> DataFrame:
    """walked() over payloads (scope, seq, reader, text) alone: seq is their time, reader their command."""
    return walked(payloads.select(project.alias("project"), "scope", "seq", F.col("seq").alias("ts"), F.lit("payload").alias("kind"), F.lit("unknown").alias("agent"), F.col("reader").alias("command"), "text"))


def fold_facts(walk: DataFrame) -> DataFrame:
    """A row for each origin and agent that a payload's folds drew on."""
    return walk.select("project", "scope", "seq", "payload_bytes", F.inline("facts"))

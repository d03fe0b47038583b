"""The ledger and session counters on streams. Arrival order is truth; ties go by sequence number.

State is kept by (scope, bucket of the line's hash), so a busy scope is many keys, and each
key's first showings are what later lines are compared with. They expire, and a compaction
of the scope clears them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern import constants as K
from quern.operators.ledger import eligible, hashed_lines

#: Buckets of a scope's lines, each a key with its own state.
BUCKETS = 16

_OUT = "scope string, seq long, i long, line_hash string, seen boolean"
_STATE = "hashes array<string>, seqs array<long>, times array<long>"


def _walk(ttl: int) -> Callable:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = int(time.time())
        hashes, seqs, times = state.get if state.exists else ([], [], [])
        known = {h: (seq, at) for h, seq, at in zip(hashes, seqs, times, strict=True) if at >= now - ttl}
        rows = pd.concat(list(batches)).sort_values(["seq", "i"])
        failing = set(zip(rows.seq[rows.failing], rows.line_hash[rows.failing], strict=True))
        out = []
        for seq, i, h in zip(rows.seq, rows.i, rows.line_hash, strict=True):
            if i == 0:  # a compaction
                known.clear()
                continue
            first, _ = known.setdefault(h, (seq, now))
            out.append((key[0], seq, i, h, first < seq and (seq, h) not in failing))
        state.update((list(known), [seq for seq, _ in known.values()], [at for _, at in known.values()]))
        yield pd.DataFrame(out, columns=["scope", "seq", "i", "line_hash", "seen"])

    return run


def seen_stream(payloads: DataFrame, ttl: int = K.WORKING_DAYS * 86400) -> DataFrame:
    """scope, seq, i, line_hash, seen of a stream of payloads (scope, seq, reader, text); a null text is a compaction of the scope.

    What was first shown more than `ttl` seconds ago counts no longer.
    """
    lines = hashed_lines(eligible(payloads.where("text IS NOT NULL"))).withColumn("bucket", F.pmod(F.xxhash64("line_hash"), F.lit(BUCKETS)))
    columns = ("scope", "bucket", "seq", "i", "line_hash", "failing")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long")))
    forgets = payloads.where("text IS NULL").select("scope", each.alias("bucket"), "seq", F.lit(0).cast("long").alias("i"), F.lit("").alias("line_hash"), F.lit(False).alias("failing"))
    return lines.select(*columns).unionByName(forgets).groupBy("scope", "bucket").applyInPandasWithState(_walk(ttl), _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def counters_stream(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their value by type and window; late rows within the delay count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions_stream(events: DataFrame, delay: str = "10 minutes", gap: str = "14399 seconds") -> DataFrame:
    """Sessions of each user that a gap ends; the gap is just below the batch rule's, which wants strictly less."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("started_at"), "n")


#: Events that a host sends, and the names they are known by.
EVENT_NAMES = {
    "SessionStart": "session_start", "BeforeAgentStart": "session_start", "SessionEnd": "session_end", "PreCompact": "pre_compact", "PostToolUse": "post_tool",
    "ToolResult": "post_tool", "PostToolUseFailure": "post_tool_failure", "FileChanged": "file_changed",
}


def dispatched(events: DataFrame, name: str = "hook_event_name") -> DataFrame:
    """Events with `handler`; those that no name knows are dropped."""
    known = F.create_map(*[F.lit(x) for pair in EVENT_NAMES.items() for x in pair])
    return events.withColumn("handler", F.try_element_at(known, F.col(name))).where("handler IS NOT NULL")

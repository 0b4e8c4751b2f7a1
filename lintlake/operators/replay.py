"""Replay of cache decisions over a request log.

A request is a hit while the last *miss* of its repository is younger than the TTL; a hit does not
prolong it. That is a sequential rule, but a chunk of a repository's requests is a step function from "time until
which a result is valid on entry" to the same on leaving it. All chunks' functions are made in parallel. Every step
ends at the step that the next miss falls on, in whichever later chunk, which one look along the time order finds for all
steps at once. Following these pointers from each repository's first step gives the chunks that are entered with a new validity;
squaring the pointers each round needs a number of rounds logarithmic in the chunks of a repository, each an equality join in
which no key is a whole repository. Then all chunks are flagged in parallel.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintlake.operators.ordered import carry_last, sorted_chunks
from lintlake.session import written

REPO_KEY = ("repo_url", "commit_sha")
NONE_YET = -(1 << 62)
#: A chunk is one group in a Python worker, which holds it several times over: as Arrow, as pandas and as arrays.
PYTHON_BITS = 15


def _summary_fn(ttl: int):
    def summarise(pdf):
        """Steps of the chunk's function: entered with a validity up to ``until``, it is left with ``leave``.

        ``until`` is the time of the request that would be the first miss. On entry a result is valid for
        at most a TTL after the chunk's first request, so only requests up to there and the next one
        can be it; neighbours that lead to the same end are merged.
        """
        import numpy as np
        import pandas as pd

        ts = np.sort(pdf["us"].to_numpy(dtype="int64"))
        after = np.searchsorted(ts, ts + ttl, side="left")
        # From miss to miss up to the last one of the chunk, for all requests at once.
        end = np.where(after < len(ts), after, np.arange(len(ts)))
        while True:
            further = end[end]
            if (further == end).all():
                break
            end = further
        starts = int(np.searchsorted(ts, ts[0] + ttl, side="right")) + 1
        firsts, ends = ts[:starts], ts[end][:starts]
        keep = np.append(ends[1:] != ends[:-1], True)
        return pd.DataFrame({
            "repo_url": pdf["repo_url"].iloc[0], "commit_sha": pdf["commit_sha"].iloc[0], "chunk": pdf["chunk"].iloc[0],
            "until": firsts[keep], "leave": ends[keep] + ttl,
        })

    return summarise


def _flag_fn(ttl: int):
    def flag(pdf):
        """Mark the hits of one chunk, all its repositories at once: from miss to miss by pointers that double."""
        import numpy as np

        pdf = pdf.sort_values("pos")
        n = len(pdf)
        ts, valid = pdf["us"].to_numpy(dtype="int64"), pdf["valid"].to_numpy(dtype="int64")
        repo, sha = pdf["repo_url"].to_numpy(), pdf["commit_sha"].to_numpy()
        opens = np.append(True, (repo[1:] != repo[:-1]) | (sha[1:] != sha[:-1]))
        group = np.cumsum(opens) - 1
        begin = np.flatnonzero(opens)
        # Times become ranks, so that (group, time) is one number.
        ranks = np.unique(np.concatenate((ts, ts + ttl, valid[begin])))
        place = lambda g, t: g * (len(ranks) + 1) + np.searchsorted(ranks, t)
        own = place(group, ts)
        size = np.diff(np.append(begin, n))
        after = np.searchsorted(own, place(group, ts + ttl), side="left")
        jump = np.where(after < (begin + size)[group], after, n)
        first = np.searchsorted(own, place(np.arange(len(begin)), valid[begin]), side="left")
        miss = np.zeros(n + 1, dtype=bool)
        miss[first[first < begin + size]] = True
        jump = np.append(jump, n)
        while (jump < n).any():
            miss[jump[np.flatnonzero(miss)]] = True
            jump = jump[jump]
        return pdf[["repo_url", "commit_sha", "request_id", "ts"]].assign(cached=~miss[:n])

    return flag


def _entries(steps: DataFrame, chunks_of: DataFrame) -> DataFrame:
    """(repository, chunk, valid): until when a result is valid as the requests of each chunk begin. ``chunks_of`` has all (repository, chunk)."""
    node = F.struct(F.col("chunk"), F.col("until"))
    both = steps.select(*REPO_KEY, F.col("until").alias("t"), F.lit(0).alias("kind"), F.col("chunk").alias("c"), node.alias("seen"), F.lit(None).cast("struct<chunk:bigint,until:bigint>").alias("node")).unionByName(
        steps.select(*REPO_KEY, F.col("leave").alias("t"), F.lit(1).alias("kind"), F.col("chunk").alias("c"), F.lit(None).cast("struct<chunk:bigint,until:bigint>").alias("seen"), node.alias("node")))
    # Backwards in time, the last step seen before a probe is the first one not earlier than it; of steps at one time the first chunk's.
    ordered = sorted_chunks(both, REPO_KEY, [F.desc("t"), F.asc("kind"), F.desc("c")], "replay-next")
    jump = carry_last(ordered, REPO_KEY, "seen", "next").filter("kind = 1 AND next IS NOT NULL").select(
        *REPO_KEY, "node", F.col("next").alias("to"))
    jump = written(jump, "replay-jump")
    reached = written(steps.groupBy(*REPO_KEY).agg(F.min(node).alias("node")), "replay-reached")
    while not jump.isEmpty():
        further = reached.join(jump, [*REPO_KEY, "node"]).select(*REPO_KEY, F.col("to").alias("node"))
        reached = written(reached.unionByName(further).distinct(), "replay-reached")
        step = jump.select(*REPO_KEY, F.col("node").alias("to"), F.col("to").alias("_to"))
        jump = written(jump.join(step, [*REPO_KEY, "to"]).select(*REPO_KEY, "node", F.col("_to").alias("to")), "replay-jump")
    left = steps.withColumn("node", node).join(reached, [*REPO_KEY, "node"], "left_semi").groupBy(*REPO_KEY, "chunk").agg(F.max("leave").alias("leave"))
    # A chunk is entered with what the last reached step before it leaves; validities only grow. One small row per (repository, chunk).
    before = Window.partitionBy(*REPO_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks_of.join(left, [*REPO_KEY, "chunk"], "left").select(*REPO_KEY, "chunk", F.coalesce(F.max("leave").over(before), F.lit(NONE_YET)).alias("valid"))


def replay(requests: DataFrame, ttl_seconds: int) -> DataFrame:
    """``requests`` with ``cached``. A scan is taken to finish at once.

    Tasks work on chunks of the sorted log, bounded however hot a repository is.
    """
    ttl = ttl_seconds * 1_000_000
    log = requests.select(*REPO_KEY, "request_id", "ts", F.unix_micros("ts").alias("us"))
    chunks = sorted_chunks(log, REPO_KEY, [F.asc("ts"), F.asc("request_id")], "replay", PYTHON_BITS)
    # Only repositories that reach over a chunk border need their functions.
    chunks_of = written(chunks.groupBy(*REPO_KEY, "chunk").agg(F.count("*").alias("n")), "replay-chunks")
    spread = chunks_of.groupBy(*REPO_KEY).agg(F.count("*").alias("n")).filter("n > 1").select(*REPO_KEY)
    key = "repo_url string, commit_sha string"
    steps = written(
        chunks.select(*REPO_KEY, "chunk", "us").join(spread, list(REPO_KEY), "left_semi").groupBy(*REPO_KEY, "chunk").applyInPandas(
            _summary_fn(ttl), f"{key}, chunk bigint, until bigint, leave bigint"), "replay-steps")
    entries = _entries(steps, chunks_of.join(spread, list(REPO_KEY), "left_semi").select(*REPO_KEY, "chunk"))
    known = chunks.join(entries, [*REPO_KEY, "chunk"], "left").withColumn("valid", F.coalesce("valid", F.lit(NONE_YET)))
    return known.groupBy("chunk").applyInPandas(_flag_fn(ttl), f"{key}, request_id bigint, ts timestamp, cached boolean")

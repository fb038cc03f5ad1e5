"""Copied text as a stream: the latest earlier sighting of each word run of user messages.

Per word-run hash the state store holds the runs that the watermark hasn't passed yet, and two references: where the run was last seen in
an agent's reply and in a user's message. Runs are replayed in time order once the watermark has passed their second, so arrivals in any
order within the delay give what a batch over the same rows gives. A timer drops the references when they are too old to be
found, so the state holds the runs of the look-back hours and no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerfold.functions import text as T
from ledgerfold.operators.authorship import LOOKBACK_HOURS, RUN_WORDS
from ledgerfold.streaming.transcripts import ROCKS

RUN = "who string, secs long, conversation_id string, id string, pos int"
REF = "secs long, conversation_id string, id string"
SEEN = "hash long, id string, pos int, secs long, agent_secs long, agent_conversation string, agent_id string, user_secs long, user_conversation string, user_id string"
WHO = ("agent", "user")


class LatestSighting(StatefulProcessor):
    """Per hash: runs that wait for the watermark, and the latest reference of each side."""

    def __init__(self, lookback: int) -> None:
        self.lookback = lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", RUN)
        self.refs = {who: handle.getValueState(who, REF) for who in WHO}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows), ignore_index=True)
        self.waiting.appendList([(r.who, int(r.secs), r.conversation_id, r.id, int(r.pos)) for r in df.itertuples()])
        self.handle.registerTimer((int(df["secs"].min()) + 1) * 1000)
        yield _table([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() // 1000  # seconds before this one are complete
        runs = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[1]) if self.waiting.exists() else []
        ready, later = [r for r in runs if r[1] < passed], [r for r in runs if r[1] >= passed]
        refs = {who: tuple(state.get()) if state.exists() else None for who, state in self.refs.items()}
        out, fresh = [], dict(refs)
        at = None
        for who, secs, conversation, id_, pos in ready:
            if secs != at:  # runs of one second don't see each other
                refs, at = dict(fresh), secs
            if who == "user":
                found = [refs[w] if refs[w] and refs[w][0] >= secs - self.lookback else (None, None, None) for w in WHO]
                out.append((key[0], id_, pos, secs, *found[0], *found[1]))
            fresh[who] = max(fresh[who] or (), (secs, conversation, id_))
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        for who, ref in fresh.items():
            if ref and ref[0] < passed - self.lookback:
                self.refs[who].clear()
            elif ref:
                self.refs[who].update(ref)
        kept = [r[0] for r in fresh.values() if r and r[0] >= passed - self.lookback]
        if later:
            self.handle.registerTimer((later[0][1] + 1) * 1000)
        elif kept:
            self.handle.registerTimer((max(kept) + self.lookback + 1) * 1000)
        yield _table(out)

    def close(self) -> None:
        pass


def _table(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in SEEN.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("agent_secs", "user_secs")} | {c: "int64" for c in ("hash", "secs")} | {"pos": "int32"})


def copied_stream(user: DataFrame, agent: DataFrame, hours: int = LOOKBACK_HOURS, delay: str = "1 hour") -> DataFrame:
    """The stream form of ``authorship.copied_shingles``: (id, pos, hash, secs, agent_ref, user_ref) per word run of a user message.

    Both streams: id, conversation_id, text, sent_at; ids and conversations as text. A run is given out once the watermark, ``delay`` behind the newest
    ``sent_at``, has passed its second; runs that arrive later than that are dropped. References are structs (secs, conversation_id, id), null without a
    sighting within ``hours`` before.
    """
    user.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    said = lambda df, who: df.select("sent_at", F.lit(who).alias("who"), *(F.col(c).cast("string").alias(c) for c in ("conversation_id", "id", "text")))
    # texts without a run move the watermark too
    both = said(user, "user").unionByName(said(agent, "agent")).withWatermark("sent_at", delay)
    runs = T.shingles(T.word_tokens(F.col("text")), RUN_WORDS)
    both = both.select("sent_at", "who", F.unix_seconds("sent_at").alias("secs"), "conversation_id", "id", F.posexplode(runs).alias("pos", "hash"))
    seen = both.groupBy("hash").transformWithStateInPandas(LatestSighting(hours * 3600), SEEN, outputMode="Append", timeMode="EventTime")
    ref = lambda who: F.when(F.col(f"{who}_secs").isNotNull(), F.struct(F.col(f"{who}_secs").alias("secs"), F.col(f"{who}_conversation").alias("conversation_id"), F.col(f"{who}_id").alias("id"))).alias(f"{who}_ref")
    return seen.select("id", "pos", "hash", "secs", ref("agent"), ref("user"))

"""Conversation memory as a stream: the state of a conversation is its memory, turns bring it up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DEFAULTS
from ..functions.text import topic_of
from ..functions.words import DEFAULT_TOPIC

MEMORY = "turn long, turns array<struct<turn:long,role:string,text:string>>, active string, history array<string>, found array<struct<kind:string,value:string>>"


def remembered(turns: DataFrame, lists: dict[str, tuple[str, ...]], found: Column, n: int = 2 * DEFAULTS.short_term_turns, minutes: float | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text) -> conv_id, turn, turns, active, history, found, expired.

    A conversation with new turns gives one row in each batch: its last n turns, the active
    topic, the topics it has left in the order of leaving, and every entity as (kind, value),
    as ``operators.memory`` has them after its last turn. Topics and entities are found by columns; the
    state only joins them to what it holds, so it grows with n and the entities. Blank
    turns are not remembered; a turn that comes after a later one of an earlier batch is too late
    and is left out. With ``minutes``, a conversation without turns for so long gives a last
    row with expired true, and is forgotten; such a stream runs on, as the clock may end a
    conversation at any time, so it is no stream for ``availableNow``.
    """
    pairs = F.flatten(F.transform(F.map_entries(found), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("kind"), v.alias("value")))))
    rows = turns.where("conv_id is not null and trim(text) <> ''").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", topic_of(F.col("text"), lists).alias("topic"), pairs.alias("pairs"))
    plain = lambda xs: tuple(tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in xs)

    def row(key: tuple, held: tuple, expired: bool) -> pd.DataFrame:
        turn, last, active, history, entities = held
        shown = [{"turn": t, "role": r, "text": x} for t, r, x in last], [{"kind": k, "value": v} for k, v in entities]
        return pd.DataFrame({"conv_id": [key[0]], "turn": [turn], "turns": [shown[0]], "active": [active], "history": [list(history)], "found": [shown[1]], "expired": [expired]})

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            held = state.get
            state.remove()
            yield row(key, (held[0], plain(held[1]), held[2], held[3], plain(held[4])), True)
            return
        turn, last, active, history, entities = state.get if state.exists else (-1, (), DEFAULT_TOPIC, (), ())
        last, history, entities = list(plain(last)), list(history), set(plain(entities))
        new = pd.concat(list(batches)).sort_values("turn", kind="stable")
        for t in new[new["turn"] > turn].itertuples():
            topic = t.topic if isinstance(t.topic, str) else active
            if topic != active and active not in history:
                history.append(active)
            active, turn = topic, int(t.turn)
            last.append((turn, t.role, t.text))
            entities |= set(plain(t.pairs))
        held = (turn, tuple(last[-n:]), active, tuple(history), tuple(sorted(entities)))
        state.update(held)
        if minutes is not None:
            state.setTimeoutDuration(int(minutes * 60_000))
        yield row(key, held, False)

    shape = f"conv_id {dict(turns.dtypes)['conv_id']}, {MEMORY}, expired boolean"
    return rows.groupBy("conv_id").applyInPandasWithState(step, shape, MEMORY, "append", GroupStateTimeout.NoTimeout if minutes is None else GroupStateTimeout.ProcessingTimeTimeout)

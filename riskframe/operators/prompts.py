"""Prompt datasets (RA9-RA13): request summaries, context blocks, system
prompts, history trimming and message lists - all column expressions over
tables (requests, scores, retrieval hits, conversation turns).

Nothing here knows a request's fields or a language: summaries render any
validation schema, and every text around the data is part of a ``Wording``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.exprs import col, literal_map, py_fixed
from ..functions.rules import Field
from ..functions.sizing import broadcast_if_small


@dataclass(frozen=True)
class Wording:
    """Texts around the data. ``values`` replaces values of a field by their
    text form, ``captions`` names fields (a field without one keeps its column
    name); ``modes``, ``decisions`` and ``risks`` label the values of a score."""

    system: str = ("Mode {mode}. Score {decision}, probability {probability}, level {risk}.\n"
                   "Request:\n{summary}\n{context}\n"
                   "Explain the score from the request, in plain words. It is an estimate and no finding.\n")
    line: str = "{caption}: {value}"
    captions: Mapping[str, str] = field(default_factory=dict)
    values: Mapping[str, str] = field(default_factory=lambda: {"true": "yes", "false": "no"})
    absent: str = "not given"
    context_title: str = "Notes:"
    context_entry: str = "({heading}) {text}"
    modes: Mapping[str, str] = field(default_factory=dict)
    decisions: Mapping[int, str] = field(default_factory=dict)
    risks: Mapping[str, str] = field(default_factory=dict)


PLAIN = Wording()


def _label(labels: Mapping, value: Column) -> Column:
    """The label of a value, else the value itself as text."""
    text = value.cast("string")
    return F.coalesce(literal_map(list(labels.items()))[value], text) if labels else text


def summary(schema: Sequence[Field], wording: Wording = PLAIN) -> Column:
    """RA10: one line per field of a request schema, in the schema's order."""
    return F.concat_ws("\n", *[render(wording.line, {
        "caption": F.lit(wording.captions.get(f.name, f.name)),
        "value": F.coalesce(_label(wording.values, col(f.name).cast("string")), F.lit(wording.absent))}) for f in schema])


def context_block(hits: Column, wording: Wording = PLAIN) -> Column:
    """RA9: '' without hits, else the title and one entry per hit in rank order, by lines."""
    entries = F.transform(hits, lambda h: render(wording.context_entry, {"heading": h["heading"], "text": h["text"]}))
    return F.when(F.size(hits) == 0, F.lit("")).otherwise(
        F.concat_ws("\n", F.concat(F.array(F.lit(wording.context_title)), entries)))


def render(template: str, values: Mapping[str, Column]) -> Column:
    """Fill ``{name}`` placeholders of a text template with columns."""
    pieces: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(F.coalesce(values[m.group(1)].cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)


def system_prompt(mode: Column, summary: Column, prediction: Column, probability: Column,
                  risk: Column, context: Column, wording: Wording = PLAIN) -> Column:
    """RA11: the system template filled with labels, the request's summary, the
    probability as ``x.y%`` (Python ``.1%``) and the context block."""
    return render(wording.system, {
        "mode": _label(wording.modes, mode), "summary": summary, "decision": _label(wording.decisions, prediction),
        "probability": F.concat(py_fixed(probability * F.lit(100.0), 1), F.lit("%")),
        "risk": _label(wording.risks, risk), "context": context})


# ---------------------------------------------------------------- history

def conversation_index(conversations: DataFrame) -> DataFrame:
    """One row per conversation ``(conv_id, _new_turn)``: the latest user
    turn (the new message), NULL when there is none. One partial
    aggregation; also serves as the list of conversations."""
    return conversations.groupBy("conv_id").agg(
        F.max(F.when(col("role") == "user", col("turn"))).alias("_new_turn"))


def recent_turns(conversations: DataFrame, n: int = K.HISTORY_KEEP, index: DataFrame | None = None,
                 roles: Sequence[str] = K.CHAT_ROLES, upto_new: bool = True) -> DataFrame:
    """The new message and the newest ``n`` earlier user/assistant turns per
    conversation: ``(conv_id, turn, role, text, is_new)``.

    With ``upto_new`` (the default) a prompt ends with the newest user
    message, so turns after it are not part of the prompt; without, they
    count as history. The per-conversation index is broadcast after a size
    check and ONE ``row_number()`` window keeps the rows; its literal bound
    lets Spark trim each partition before the shuffle (window group limit)."""
    idx = index if index is not None else conversation_index(conversations)
    turns = (conversations.filter(col("role").isin(*roles))
             .join(broadcast_if_small(idx), on="conv_id", how="left")
             .filter(F.lit(not upto_new) | col("_new_turn").isNull() | (col("turn") <= col("_new_turn"))))
    is_new = F.coalesce(col("turn") == col("_new_turn"), F.lit(False))
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    keep = col("_r") <= F.lit(n) + F.when(col("_new_turn").isNotNull(), 1).otherwise(0)
    if not upto_new:     # the new message may have any rank
        rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("is_new"), F.desc("turn")))
    return (turns.withColumn("is_new", is_new).withColumn("_r", rank).filter(col("_r") <= n + 1).filter(keep)
            .select("conv_id", "turn", "role", "text", "is_new"))


def split_turns(conversations: DataFrame, n: int = K.HISTORY_KEEP) -> tuple[DataFrame, DataFrame]:
    """(new message, kept history) - RA12 as two views of ``recent_turns``."""
    r = recent_turns(conversations, n)
    return r.filter(col("is_new")).drop("is_new"), r.filter(~col("is_new")).drop("is_new")


def messages(system: DataFrame, recent: DataFrame) -> DataFrame:
    """RA13: rows ``(conv_id, position, role, content)``: position 0 = the
    system prompt, then the kept history in turn order, then the new user
    message (it has the largest turn, so it is numbered last)."""
    sys_rows = system.select("conv_id", F.lit(0).alias("position"), F.lit("system").alias("role"),
                             col("system_prompt").alias("content"))
    w = W.partitionBy("conv_id").orderBy("turn")
    rest = recent.select("conv_id", F.row_number().over(w).alias("position"),
                         F.when(col("is_new"), F.lit("user")).otherwise(col("role")).alias("role"),
                         col("text").alias("content"))
    return sys_rows.unionByName(rest)

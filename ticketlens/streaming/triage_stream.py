"""Streaming triage (D15): the single-ticket entry point re-aimed as a stream.

The rule columns (guardrails, escalation intent, canned reply, leak check)
are stateless, so the same Column functions run on ``readStream`` input as a
plain projection. The retrieval + model half needs joins with a static KB
and a Python call, so it runs per micro-batch through ``foreachBatch`` with
the batch triage operator. The KB is stored and indexed once, before the stream starts
(``kb_snapshot``), and every batch joins that snapshot. Tickets that come twice within the
watermark are answered once: the stream keeps the ids it has seen as state. The sink write is idempotent per epoch (overwrite
of the epoch's folder), so a retried batch after an executor loss does not
duplicate rows.

A stream's checkpoint is named by the caller's ``key``: two streams need two keys, and a stream started again
under its key goes on where it ended.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import guardrails as G
from ticketlens.functions import language as Lf
from ticketlens.functions.replies import constrain_reply
from ticketlens.operators.decisions import KbSnapshot, ModelFn, kb_snapshot, triage
from ticketlens.operators.guardrail_ops import with_guardrails
from ticketlens.session import checkpoint_dir
from ticketlens.sources.adapters import spread


def triage_columns(stream: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """Stateless per-ticket rule output; works on batch and streaming frames alike. Each pattern
    and keyword is looked for once a row."""
    d, low, flags = with_guardrails(stream.select(id_col, text_col, lang_col), text_col)
    t, lang, hits = F.col(text_col), F.col(lang_col), flags["kw"]
    d = d.withColumn("_g_found", G.check_escalation(t, low=low, flags=flags, hits=hits))
    flag = F.col("_g_found.flag")
    return d.select(
        id_col, text_col, lang_col, flag.alias("flag"), F.col("_g_found.reason").alias("reason"),
        F.when(flag, G.escalation_intent(t, low=low, hits=hits)).alias("escalation_intent"),
        F.when(flag, constrain_reply(Lf.canned_reply(lang), lang, F.col(id_col)))
        .alias("escalation_reply"),
        G.pii_leak(t, flags=flags).alias("text_has_pii"))


def _started(stream: DataFrame, handle, kind: str, key: str, trigger_once: bool):
    ckpt = os.path.join(checkpoint_dir(stream.sparkSession), f"stream-{kind}-{key}")
    w = stream.writeStream.queryName(f"{kind}_{key}").option("checkpointLocation", ckpt).foreachBatch(handle)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()


def start_rule_stream(stream: DataFrame, id_col: str, text_col: str, lang_col: str, out_dir: str,
                      key: str, trigger_once: bool = False):
    """Run the stateless rule columns on every micro-batch and write each epoch to
    ``out_dir/epoch=N`` (overwritten, so a retried batch does not duplicate rows).
    A batch read from too few files is spread over the cores first (no shuffle
    when the batch already has enough partitions)."""
    def handle(batch: DataFrame, epoch: int) -> None:
        triage_columns(spread(batch), id_col, text_col, lang_col).write.mode("overwrite") \
            .parquet(os.path.join(out_dir, f"epoch={epoch}"))

    return _started(stream, handle, "rules", key, trigger_once)


def start_triage_stream(stream: DataFrame, kb: DataFrame | KbSnapshot, model_fn: ModelFn, id_col: str,
                        text_col: str, lang_col: str, out_dir: str, key: str, time_col: str | None = None,
                        delay: str = "1 hour", profiles: DataFrame | None = None, trigger_once: bool = False):
    """Run full triage on every micro-batch and write each epoch to ``out_dir/epoch=N``.

    With ``time_col`` (event time) a ticket id that comes again within ``delay`` is not answered again; ids are
    forgotten once the watermark has passed them, so the state does not grow with the stream. With
    ``profiles`` the language is detected and written to ``lang_col``."""
    snapshot = kb if isinstance(kb, KbSnapshot) else kb_snapshot(kb)
    if time_col is not None:
        stream = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])

    def handle(batch: DataFrame, epoch: int) -> None:
        out = triage(batch, snapshot, model_fn, id_col, text_col, lang_col, profiles=profiles)
        out.write.mode("overwrite").parquet(os.path.join(out_dir, f"epoch={epoch}"))

    return _started(stream, handle, "triage", key, trigger_once)

"""Prompt and chat-message rows.

Messages are kept long -- one row per (conversation, message index) -- so no
conversation is ever gathered into one value; order is carried in ``msg_idx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmap.functions import text as T
from gridmap.plans import defaults as D

MSG_COLUMNS = ["conv_id", "msg_idx", "role", "content"]


def turn_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, user_text, assistant_text): a user turn and the assistant reply at turn + 1 (an equi-join)."""
    u = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("user_text"))
    a = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_text"))
    return u.join(a, ["conv_id", "turn"])


def example_pairs(turns: DataFrame, k: int | None = None) -> DataFrame:
    """(conv_id, turn, user_text, assistant_text, pair_no): a user turn and the assistant reply at turn + 1.

    Skew-safe: pairs come from an equi-join on (conv_id, turn), so one huge
    conversation is spread over many tasks.  With a small ``k`` only the first
    ``k`` pairs are kept, found by ``k`` rounds of a per-conversation ``min``
    (partial aggregation, no ordered window over a conversation); with
    ``k=None`` every pair is numbered with a window.
    """
    pairs = turn_pairs(turns)
    if k is None:
        wp = Window.partitionBy("conv_id").orderBy("turn")
        return pairs.withColumn("pair_no", F.row_number().over(wp))
    picked, last = None, None
    for i in range(1, k + 1):
        cand = pairs if last is None else pairs.join(last, "conv_id").where(F.col("turn") > F.col("_prev"))
        nxt = cand.groupBy("conv_id").agg(F.min("turn").alias("_t"))
        sel = nxt.select("conv_id", F.col("_t").alias("turn"), F.lit(i).alias("pair_no"))
        picked = sel if picked is None else picked.unionByName(sel)
        last = nxt.select("conv_id", F.col("_t").alias("_prev"))
    return pairs.join(picked, ["conv_id", "turn"]).select("conv_id", "turn", "user_text", "assistant_text",
                                                          "pair_no")


def system_messages(turns: DataFrame, default: str = D.DEFAULT_SYSTEM_MESSAGE) -> DataFrame:
    """One system message per conversation: its own first system turn, else the default (aggregates only)."""
    own = (turns.where(F.col("role") == "system").groupBy("conv_id")
                .agg(F.min_by("text", "turn").alias("_s")))
    convs = turns.select("conv_id").distinct()
    return convs.join(own, "conv_id", "left").select(
        "conv_id", F.lit(0).alias("msg_idx"), F.lit("system").alias("role"),
        F.coalesce(F.col("_s"), F.lit(default)).alias("content"))


def few_shot_messages(turns: DataFrame, k: int | None = 2) -> DataFrame:
    """[system] + ('# Example i' user message, assistant answer) for the first ``k`` pairs (all when None)."""
    p = example_pairs(turns, k)
    user = p.select("conv_id", (F.col("pair_no") * 2 - 1).alias("msg_idx"), F.lit("user").alias("role"),
                    F.concat(F.lit("# Example "), F.col("pair_no").cast("string"), F.lit("\n"),
                             F.col("user_text")).alias("content"))
    asst = p.select("conv_id", (F.col("pair_no") * 2).alias("msg_idx"), F.lit("assistant").alias("role"),
                    F.col("assistant_text").alias("content"))
    return system_messages(turns).unionByName(user).unionByName(asst).select(*MSG_COLUMNS)


def chat_assembly(turns: DataFrame, k: int | None = 2) -> DataFrame:
    """system + few-shot examples + the conversation's last user turn as the human message."""
    shots = few_shot_messages(turns, k)
    last = (turns.where(F.col("role") == "user").groupBy("conv_id")
                 .agg(F.max_by("text", "turn").alias("_h")))
    n = shots.groupBy("conv_id").agg(F.max("msg_idx").alias("_m"))
    human = last.join(n, "conv_id").select("conv_id", (F.col("_m") + 1).alias("msg_idx"),
                                           F.lit("human").alias("role"), F.col("_h").alias("content"))
    return shots.unionByName(human).select(*MSG_COLUMNS)


def tool_call_id(*cols) -> F.Column:
    """Deterministic call id: first 16 hex digits of SHA-256 over the key columns."""
    return F.substr(F.sha2(F.concat_ws(":", *[c.cast("string") for c in cols]), 256), F.lit(1), F.lit(16))


def tool_messages(turns: DataFrame, output_text: str = D.TOOL_OUTPUT_TEXT) -> DataFrame:
    """Per example pair: human input, an ai message calling a tool (id), and the tool's output."""
    p = turn_pairs(turns)
    cid = tool_call_id(F.col("conv_id"), F.col("turn"))
    base = p.select("conv_id", "turn", "user_text", cid.alias("tool_call_id"))
    human = base.select("conv_id", "turn", F.lit(0).alias("msg_idx"), F.lit("human").alias("role"),
                        F.col("user_text").alias("content"), F.lit(None).cast("string").alias("tool_call_id"))
    ai = base.select("conv_id", "turn", F.lit(1).alias("msg_idx"), F.lit("ai").alias("role"),
                     F.lit("").alias("content"), "tool_call_id")
    tool = base.select("conv_id", "turn", F.lit(2).alias("msg_idx"), F.lit("tool").alias("role"),
                       F.lit(output_text).alias("content"), "tool_call_id")
    return human.unionByName(ai).unionByName(tool)


def token_usage(turns: DataFrame) -> DataFrame:
    """Estimated tokens by role and phase with roll-up totals (null = all)."""
    phase = F.when(F.col("turn") < 2, F.lit("opening")).otherwise(F.lit("follow-up"))
    return (turns.select("role", phase.alias("phase"), T.token_estimate("text").alias("_t"))
                 .rollup("role", "phase")
                 .agg(F.count(F.lit(1)).alias("n_calls"), F.sum("_t").cast("bigint").alias("input_tokens")))


def render_validation_input(focus: DataFrame, ctx: DataFrame) -> DataFrame:
    """'# Original Table' + focused text + '# Detected Headers' JSON block per document."""
    j = focus.join(ctx, "doc_id")
    payload = F.to_json(F.struct(F.col("header_start").alias("HeaderStartLine"),
                                 F.col("header_end").alias("HeaderEndLine"),
                                 F.col("content_start").alias("ContentStartLine")))
    return j.select("doc_id", F.concat(F.lit("# Original Table\n"), F.col("focus"),
                                       F.lit("\n\n# Detected Headers\n```json\n"), payload,
                                       F.lit("\n```")).alias("validation_input"))


def field_example_block(vocab: DataFrame) -> DataFrame:
    """Per section: '- **`field`**: description' lines, each with ' - _e.g._: a, b' when examples exist.

    ``vocab``: section, section_ord, field, field_ord, description, examples (text, may be null).
    """
    line = F.concat(F.lit("- **`"), F.col("field"), F.lit("`**: "), F.col("description"),
                    F.when(F.col("examples").isNotNull() & (F.col("examples") != ""),
                           F.concat(F.lit(" - _e.g._: "), F.col("examples"))).otherwise(F.lit("")))
    arr = F.array_sort(F.collect_list(F.struct("field_ord", "field", line.alias("l"))))
    return (vocab.groupBy("section", "section_ord")
                 .agg(F.array_join(F.transform(arr, lambda x: x["l"]), "\n").alias("block"),
                      F.max(F.when(F.col("examples").isNotNull() & (F.col("examples") != ""), 1).otherwise(0))
                      .cast("boolean").alias("has_examples")))


def field_description(description, examples, with_aliases: bool = True) -> F.Column:
    """Description, plus '. Possible headers values: a, b' when enabled and examples exist."""
    d, e = T.col_(description), T.col_(examples)
    if not with_aliases:
        return d
    return F.when(e.isNotNull() & (e != ""), F.concat(d, F.lit(". Possible headers values: "), e)).otherwise(d)


def render_conflict_input(focus: DataFrame, mapping: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Conflict-resolution input per document: table, extracted mapping JSON, conflicts JSON.

    Only documents with at least one conflict get an input (no call is needed otherwise).
    """
    m = (mapping.where(F.col("header").isNotNull())
                .groupBy("doc_id")
                .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(
                    F.struct(F.concat_ws(".", "section", "field").alias("k"), F.col("header").alias("v"))))))
                     .alias("extracted")))
    c = conflicts.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(
        F.struct("header", F.split("members", ", ").alias("conflicts"))))).alias("conflicts"))
    j = c.join(m, "doc_id").join(focus, "doc_id")
    return j.select("doc_id", F.concat(F.lit("# Original Table\n"), F.col("focus"),
                                       F.lit("\n\n# Extracted Data\n```json\n"), F.col("extracted"),
                                       F.lit("\n```\n\n# Conflicts\n```json\n"), F.col("conflicts"),
                                       F.lit("\n```")).alias("conflict_input"))

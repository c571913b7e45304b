"""Conversation logs: context, history, logged salary requests."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offermarket.functions.dialogue import extract_salary_request, strip_think, tag_source
from offermarket.functions.numbers import format_salary
from offermarket.operators.model import score_salary
from offermarket.skew import BLOCK, blocked_row_number, hot_join
from offermarket.vocabulary import CONTEXT_MESSAGES, INTENT_PREDICTION, PREDICTION_FAILED


def context_window(
    conv: DataFrame, n: int = CONTEXT_MESSAGES, block: int = BLOCK
) -> DataFrame:
    """Each message with the ``n`` messages before it, oldest first.

    A conversation is cut into blocks of turns, so a very long one is shared
    out. A block needs from the earlier ones their last ``n`` messages only, and
    since no block is empty those lie in the ``n`` blocks before it.
    """
    message = F.struct("turn", "role", "text")
    blocks = conv.withColumn("_block", F.floor(F.col("turn") / F.lit(block)))
    # Messages of one turn are settled by role and text.
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn", "role", "text")
    latest = Window.partitionBy("conv_id", "_block").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))
    tails = (
        blocks.withColumn("_place", F.row_number().over(latest))
        .filter(F.col("_place") <= n)
        .groupBy("conv_id", "_block")
        .agg(F.array_sort(F.collect_list(message)).alias("_tail"))
    )
    before = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(-n, -1)
    carried = tails.select(
        "conv_id", "_block", F.flatten(F.collect_list("_tail").over(before)).alias("_carried")
    )
    own = F.collect_list(message).over(inside.rowsBetween(-n, -1))
    return (
        blocks.withColumn("_own", own)
        .join(carried, ["conv_id", "_block"])
        .withColumn("_all", F.concat("_carried", "_own"))
        .withColumn(
            "context",
            F.transform(
                F.slice("_all", F.greatest(F.size("_all") - n + 1, F.lit(1)), F.lit(n)),
                lambda item: F.struct(item["role"].alias("role"), item["text"].alias("text")),
            ),
        )
        .select("conv_id", "turn", "role", "text", "context")
    )


def append_turns(conv: DataFrame, new: DataFrame, block: int = BLOCK) -> DataFrame:
    """The log with new exchanges ``(conv_id, seq, question, answer)`` at its end.

    Exchanges of one conversation follow each other by the whole number ``seq``.
    """
    columns = ["conv_id", "turn", "role", "text"]
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    counts = new.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_rows"))
    placed = hot_join(
        blocked_row_number(new, ["conv_id"], "seq", "_place", block), last, counts, ["conv_id"], ["seq"], how="left"
    )
    start = F.coalesce(F.col("_last"), F.lit(-1)) + 2 * F.col("_place") - 1
    messages = F.array(
        F.struct(start.alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct(
            (start + 1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text")
        ),
    )
    added = placed.select("conv_id", F.inline(messages))
    return conv.select(*columns).unionByName(added.select(*columns))


def score_requests(conv: DataFrame, model: PipelineModel) -> DataFrame:
    """Answers to logged salary requests.

    Every assistant message is searched for a request once its reasoning
    passages are gone; without readable parameters the fixed failure text is
    the answer.
    """
    request = extract_salary_request(strip_think(F.col("text")))
    parsed = conv.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", request.alias("_asked")
    )
    # Only messages that hold a request meet the model; the others get the failure text.
    asked = parsed.filter(F.col("_asked").isNotNull()).select("conv_id", "turn", "_asked.*")
    scored = score_salary(asked, model, digits=None).select(
        "conv_id",
        "turn",
        F.lit(True).alias("is_request"),
        F.bround("predicted_salary", 2).alias("predicted_salary"),
        # The words show the prediction itself, not one that was rounded before.
        format_salary(F.col("predicted_salary")).alias("answer"),
    )
    failed = parsed.filter(F.col("_asked").isNull()).select(
        "conv_id",
        "turn",
        F.lit(False).alias("is_request"),
        F.lit(None).cast("double").alias("predicted_salary"),
        F.lit(PREDICTION_FAILED).alias("answer"),
    )
    return scored.unionByName(failed).withColumn(
        "answer", tag_source(F.col("answer"), F.lit(INTENT_PREDICTION))
    )

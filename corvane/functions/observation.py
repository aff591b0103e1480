"""Texts and prompts of observations, and the budget of a model's context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.json_text import labelled, listed, message, observation_json, quoted

CONTEXT_TOKENS = 4096
# What is said of each category and issue, and where there is no issue.
SUMMARIES = {
    "message": "This is a message or email.",
    "alert": "This is a notification or popup.",
    "wifi": "This describes an iPhone Wi-Fi connection.",
    "unknown": "There is not enough information to identify the situation reliably.",
}
ISSUE_TEXT = {
    "unsupported": "V1 supports English messages, alerts and iPhone Wi-Fi descriptions.",
    "insufficient_context": "Please include the message text or describe the current situation.",
    "contradictory_input": "The descriptions of the current state contradict each other.",
    "invalid_model_output": "The model output did not pass validation.",
    "incomplete_model_output": "The model did not finish its response.",
}
NO_ISSUE = "This analysis describes the text you entered. It does not verify the sender or the actual connection. No detected warning signs does not guarantee safety."


def mapped(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(*[F.when(key == k, v) for k, v in table.items()])


def summary(category: Column) -> Column:
    return mapped(SUMMARIES, category)


def uncertainty(issues: Column) -> Column:
    """The texts of the distinct issues in order, or that nothing was verified."""
    return F.when(F.size(issues) > 0, F.array_join(F.transform(F.array_distinct(issues), lambda i: mapped(ISSUE_TEXT, i)), " ")).otherwise(NO_ISSUE)


def training_target(observation: Column) -> Column:
    return F.struct(observation["category"].alias("category"), observation["signals"].alias("signals"), observation["issues"].alias("issues"))


def unknown(reason: str) -> Column:
    """The observation that says only why nothing can be said."""
    signals = F.array().cast("array<struct<signal:string,evidence:string>>")
    return F.struct(F.lit("unknown").alias("category"), signals.alias("signals"), F.array(F.lit(reason)).alias("issues"))


def selection_prompt(system: str, text: Column, observation: Column, source_id: Column, title: Column, source_type: Column, sentences: Column) -> Column:
    """Chat messages that offer one source's numbered sentences for a choice."""
    numbered = F.transform(sentences, lambda s, i: labelled(id=(i + 1).cast("string"), text=quoted(s)))
    source = labelled(source_id=quoted(source_id), source_type=quoted(source_type), title=quoted(title), sentences=listed(numbered))
    analysis = observation_json(observation["category"], observation["signals"], observation["issues"])
    return F.array(message("system", F.lit(system)), message("user", labelled(input_text=quoted(text), analysis=analysis, references=listed(F.array(source)))))


def fits_context(prompt_tokens: Column, new_tokens: Column, most: int = CONTEXT_TOKENS) -> Column:
    return prompt_tokens + new_tokens <= most

"""Checks of results against contracts and expectations, each a map of named booleans.

``metrics.check_counts`` turns them into counts; a check that can't be decided fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import words
from corvane.operators.metrics import changes, check_counts, summarise
from corvane.operators.policy import ACTIONS, LIMITS, PROHIBITED


def checks(**named: Column) -> Column:
    return F.create_map(*[x for name, holds in named.items() for x in (F.lit(name), F.coalesce(holds, F.lit(False)))])


def contract_checks() -> Column:
    """Of rows with actions, evidence_status, handoff_status, handoff_actions, handoff_text, explanation, quote, excerpt, text and private_markers."""
    known = [a for a, _, _, _ in ACTIONS]
    return checks(
        approved_actions_only=F.size(F.array_except("actions", words(*known))) == 0,
        no_prohibited_actions=~F.arrays_overlap("actions", words(*PROHIBITED)),
        action_evidence_verified=F.col("evidence_status").isin("verified_local_support", "policy_only"),
        citation_provenance=F.col("quote").isNull() | F.contains("excerpt", F.col("quote")),
        literal_explanation=F.col("explanation") == F.coalesce("quote", F.lit("")),
        handoff_preserves_actions=(F.col("handoff_status") == "ready") & (F.col("handoff_actions") == F.col("actions")),
        handoff_no_completion_claim=F.contains("handoff_text", F.lit(LIMITS)),
        handoff_does_not_copy_input=~F.contains("handoff_text", F.col("text")),
        private_markers_excluded=F.forall("private_markers", lambda m: ~F.contains(F.col("handoff_text"), m)),
    )


def challenge_checks() -> Column:
    """Of rows with a result (category, level, flags, actions) and expectations (expected_category, levels, required_flags, actions_any)."""
    return checks(
        category=F.col("category") == F.col("expected_category"),
        level=F.array_contains("levels", F.col("level")),
        required_flags=F.size(F.array_except("required_flags", "flags")) == 0,
        appropriate_action=F.arrays_overlap("actions_any", "actions"),
    )


def safety_checks() -> Column:
    """Of rows with level, actions and ``resolved`` (``policy.resolve``), a handoff (handoff_status, handoff_actions, handoff_text), text and expectations (levels, actions_any)."""
    templates = F.create_map(*[F.lit(x) for action, text, _, _ in ACTIONS for x in (action, text)])
    all_known = F.size("resolved") == F.size(F.array_distinct("actions"))
    told = F.forall("resolved", lambda a: F.contains(F.col("handoff_text"), a["action_text"]))
    return checks(
        expected_level=F.array_contains("levels", F.col("level")),
        appropriate_next_action=F.arrays_overlap("actions_any", "actions"),
        allowlisted_templates_only=all_known & F.forall("resolved", lambda a: a["action_text"] == templates[a["action"]]),
        no_prohibited_action=~F.arrays_overlap("actions", words(*PROHIBITED)),
        action_support_is_literal=all_known & F.forall("resolved", lambda a: a["ok"]),
        handoff_ready=F.col("handoff_status") == "ready",
        handoff_preserves_reviewed_actions=(F.col("handoff_actions") == F.col("actions")) & told,
        handoff_does_not_claim_completion=F.contains("handoff_text", F.lit(LIMITS)),
        handoff_does_not_copy_input=~F.contains("handoff_text", F.col("text")),
    )


def verification_checks() -> Column:
    """The contract and what was expected, of rows that have what both need."""
    return F.map_concat(contract_checks(), challenge_checks())


def reference_checks() -> Column:
    """Of rows with status, retrieved, cited, explanation, quote, excerpt and expectations (expected_status, documents, phrases)."""
    some = F.size("documents") > 0
    return checks(
        status_matches=F.col("status") == F.col("expected_status"),
        expected_document_retrieved=F.when(some, F.arrays_overlap("retrieved", "documents")).otherwise(F.size("retrieved") == 0),
        expected_document_cited=F.when(some, F.arrays_overlap("cited", "documents")).otherwise(F.size("cited") == 0),
        citation_provenance_valid=F.col("quote").isNull() | F.contains("excerpt", F.col("quote")),
        explanation_is_exact_selected_evidence=F.col("explanation") == F.coalesce("quote", F.lit("")),
        relevant_phrase_present=F.when(F.size("phrases") > 0, F.exists("phrases", lambda p: F.contains(F.lower(F.col("explanation")), F.lower(p)))).otherwise(F.col("explanation") == ""),
        past_present_context_preserved=F.contains("explanation", F.lit("In the past,")) == F.contains("explanation", F.lit("Today,")),
    )


def expectations(results: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Results with their expectations; a case without any keeps nulls and so fails."""
    return results.join(expected, key, "left")


def replay(before: DataFrame, after: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(measures before and after, changed cases) of the same cases with recorded and with corrected predictions."""
    both = summarise(before).withColumn("stage", F.lit("before")).unionByName(summarise(after).withColumn("stage", F.lit("after")))
    answer = F.to_json(F.struct("pred_category", "pred_signals", "pred_issues"))
    return both, changes(before.withColumn("answer", answer), after.withColumn("answer", answer), key, "answer")


def compare_runs(runs: dict[str, DataFrame], by: list[str] | None = None) -> DataFrame:
    """Measures of several runs over the same cases, in total and by each of ``by``: rows tagged with their run."""
    found = None
    for name, cases in runs.items():
        one = summarise(cases, by).withColumn("run", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


def audit(suites: dict[str, DataFrame]) -> DataFrame:
    """suite, check, passed and total of several suites of rows(checks), and of all of them together as suite ``*``."""
    found = None
    for name, rows in suites.items():
        one = rows.select(F.explode(F.array(F.lit(name), F.lit("*"))).alias("suite"), "checks")
        found = one if found is None else found.unionByName(one)
    return check_counts(found, "suite", "checks")

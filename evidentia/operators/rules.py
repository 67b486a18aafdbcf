"""Rules of a run as columns: what follows each step, which sources it reads, its verdict, and the checks of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observe(facts: Column, failed: Column, calls: Column, facts_before: Column, failed_before: Column, iterations: Column, missing: Column, repeats: Column, limit: Column) -> Column:
    """What a round without a judge's word decides: retry, give up, stop, go on for a source, or ask the judge (``judge``).

    ``missing``: number of required sources not seen; ``repeats``: how often this gap was named before; ``limit``: a used-up limit or null.
    """
    free = limit.isNull()
    none = F.when(free & (failed > 0), "retry_after_tool_error").when(free & (calls == 0), "retry_without_tool_calls").otherwise("insufficient")
    grew = (facts > facts_before) | (failed > failed_before)
    return F.when(facts == 0, none).when(~grew & (iterations >= 2), "stop_no_progress").when((missing > 0) & free & (repeats < 2), "source_missing").otherwise("judge")


def after_classify(status: Column) -> Column:
    return F.when(status == "error", "insufficient").when(status == "clarify", "clarify").otherwise("plan")


def after_observe(status: Column, enough: Column) -> Column:
    return F.when(status == "insufficient", "insufficient").when(enough, "consistency").otherwise("act")


def after_consistency(status: Column) -> Column:
    return F.when(status == "conflict", "ticket").when(status == "confirmed", "answer").otherwise("insufficient")


def after_verify(critical: Column, revisions: Column, answered: Column, ticket: Column) -> Column:
    """An answer with critical findings is written anew once; tickets are not."""
    return F.when((critical > 0) & (revisions == 0) & answered & ~ticket, "answer").otherwise("end")


def consistency(status: Column, confidence: Column, grounded: Column, least: float = 0.6) -> Column:
    """A conflict without locators on both sides is none; a confirmation below ``least`` is insufficient."""
    kept = F.when((status == "conflict") & ~grounded, "confirmed").otherwise(status)
    return F.when((kept == "confirmed") & (confidence < least), "insufficient").otherwise(kept)


def findings(claims: Column) -> Column:
    """Of a reviewer's findings (claim, severity, checked_facts) those with a claim and checked facts; unknown severity is critical."""
    told = F.filter(claims, lambda f: (F.trim(f["claim"]) != "") & (F.size(f["checked_facts"]) > 0))
    return F.transform(told, lambda f: F.struct(F.trim(f["claim"]).alias("claim"), F.when(f["severity"] == "minor", "minor").otherwise("critical").alias("severity"), f["checked_facts"].alias("checked_facts")))


def verdict(unknown: Column, found: Column, critical: Column, struck: Column, degraded: Column, revisions: Column, ticket: Column, status: Column, label: Column) -> Column:
    """(action, status, label) of a verified answer: approved, returned once, unavailable, or flagged.

    Unknown locators and struck sentences are mechanical: they, and critical findings before a revision, take a confirmation back.
    """
    mechanical = (unknown > 0) | (struck > 0)
    advisory = (critical > 0) & (revisions > 0) & ~mechanical
    hard = mechanical | (critical > 0) & ~advisory
    lower = F.when(label == "high", "mid").otherwise("low")
    action = (
        F.when(~mechanical & (found == 0) & ~degraded, "approved").when((critical > 0) & (revisions == 0) & ~ticket, "returned")
        .when(degraded, "unavailable").when(hard, "flagged").otherwise("flagged_minor")
    )
    return F.struct(
        action.alias("action"), F.when((action == "flagged") & (status == "confirmed"), "insufficient").otherwise(status).alias("status"),
        F.when(action == "flagged", "low").when(action == "flagged_minor", lower).otherwise(label).alias("label"),
    )


def hinted(texts: Column, hints: list[tuple[str, str]]) -> Column:
    """Sources whose marker (marker, source) stands in one of ``texts``, each once, in the order of the hints."""
    low = F.lower(F.array_join(texts, "\n"))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(m), F.lit(s)) for m, s in hints])))


def planned_sources(required: Column, named: Column, order: Column, gaps: Column, uncovered: Column, iterations: Column, optional: Column) -> Column:
    """Sources to read, in order and each once: required, named in the question, the task of an order, from gaps, both sides of an uncovered condition, optional ones from the second round on."""
    none = F.array().cast("array<string>")
    out = F.array_union(F.array_union(required, named), F.when(order.isNotNull() & (order != ""), F.array(F.lit("task"))).otherwise(none))
    out = F.array_union(F.array_union(out, gaps), F.when(uncovered, F.lit(["regulations", "code"])).otherwise(none))
    return F.array_union(out, F.when(iterations >= 1, optional).otherwise(none))


def case_checks(df: DataFrame, want: dict[str, str], have: dict[str, str]) -> DataFrame:
    """``df`` with the checks of a case and passed. A check is null where the case expects nothing of the kind.

    ``want`` names its columns intents, role, sources, statuses, cite, forbidden (arrays but for role) and ticket (boolean); ``have``
    those of the run: intent, role, seen, status, answer, ticket, unknown and known (arrays of locators).
    """
    w, h = {k: F.col(v) for k, v in want.items()}, {k: F.col(v) for k, v in have.items()}
    some = lambda c, check: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, check)
    low = F.lower(F.concat(F.coalesce(h["answer"], F.lit("")), F.lit(" "), F.coalesce(h["ticket"], F.lit(""))))
    told = lambda m: low.contains(F.lower(m)) | F.exists(h["known"], lambda k: F.lower(k).contains(F.lower(m)))
    checks = {
        "check_intent": some(w["intents"], F.coalesce(F.array_contains(w["intents"], h["intent"]), F.lit(False))), "check_role": F.when(w["role"] != "", h["role"].eqNullSafe(w["role"])),
        "check_sources": some(w["sources"], F.size(F.array_except(w["sources"], h["seen"])) == 0), "check_status": some(w["statuses"], F.coalesce(F.array_contains(w["statuses"], h["status"]), F.lit(False))),
        "check_known": F.size(h["unknown"]) == 0, "check_cited": some(w["cite"], F.forall(w["cite"], told)),
        "check_forbidden": ~F.exists(w["forbidden"], lambda f: low.contains(F.lower(f))), "check_ticket": F.when(w["ticket"], F.coalesce(h["ticket"] != "", F.lit(False))),
    }
    passed = F.lit(True)
    for c in checks:
        passed = passed & F.coalesce(F.col(c), F.lit(True))
    return df.withColumns(checks).withColumn("passed", passed)

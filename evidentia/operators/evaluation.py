"""Evaluation of runs and the rules that stop, grade or refuse them, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators import evidence

#: Marks of an error of the provider (fixed values), the second one in any case.
INFRA = ("ProviderUnavailable", "недоступн", "No endpoints found", "429")
#: Texts that try to change the instructions (fixed values).
INJECTIONS = (
    r"игнорируй\s+(все\s+)?(предыдущие|прошлые|系统|system)",
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"(покажи|выведи|раскрой)\s+(свой\s+)?(системн\w+\s+промпт|system\s+prompt)",
    r"(забудь|отмени)\s+(свои\s+)?(правила|инструкции|ограничения)",
    r"(ты\s+больше\s+не|отныне\s+ты)\s+",
    r"(измени|поправь|перепиши)\s+(код|нси|план|регламент)",
)


def infra_failure(status: Column, error: Column) -> Column:
    """Whether a run failed by its provider, so that its quality isn't scored."""
    e = F.coalesce(error, F.lit(""))
    return F.coalesce(status == "error", F.lit(False)) & (e.contains(INFRA[0]) | F.lower(e).contains(INFRA[1]) | e.contains(INFRA[2]) | e.contains(INFRA[3]))


def summary(df: DataFrame, infra: str, checks: list[str], duration: str, cost: str) -> DataFrame:
    """One row: runs, scored, passed, the share of each check where it is known, P50 and P95 in seconds, and the cost of all.

    Quality is that of scored runs; if none is, of all. Durations of zero or null don't count.
    """
    any_scored = df.agg(F.coalesce(F.bool_or(~F.col(infra)), F.lit(False)).alias("x")).first()["x"]
    scored = ~F.col(infra) if any_scored else F.lit(True)
    own = lambda c: F.when(scored, c)
    took = own(F.when(F.col(duration) > 0, F.col(duration)))
    fine = F.lit(True)
    for c in checks:
        fine = fine & F.coalesce(F.col(c), F.lit(True))
    whole = df.agg(F.count("*").alias("runs"), F.count_if(scored).alias("scored"), F.count_if(scored & fine).alias("passed"), *[F.round(F.avg(own(F.col(c).cast("int"))), 3).alias(f"share_{c}") for c in checks], F.round(F.sum(cost), 4).alias("cost"))
    times = evidence.p95(df.select(F.lit(1).alias("_all"), took.alias("t")), "_all", "t").select(F.round(F.col("median") / 1000, 1).alias("p50_s"), F.round(F.col("p95") / 1000, 1).alias("p95_s"))
    return whole.join(times, F.lit(True), "left")


def injections(c: Column, most: int = 3) -> Column:
    """The numbers, from 1, of the first ``most`` patterns of INJECTIONS that a text has."""
    found = F.array(*[F.when(c.rlike(f"(?iuU){p}"), F.lit(i)) for i, p in enumerate(INJECTIONS, 1)])
    return F.slice(F.filter(found, lambda x: x.isNotNull()), 1, most)


def confidence(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.45, "mid").otherwise("low")


def downgrade(label: Column) -> Column:
    """One grade less; low for anything else."""
    return F.when(label == "high", "mid").otherwise("low")


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """By prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def limit_reached(iterations: Column, calls: Column, spent: Column, most_iterations: int, most_calls: int, most_cost: float) -> Column:
    """The first limit that is used up, or null; a cost limit of 0 is none."""
    return F.when(iterations >= most_iterations, "max_iterations").when(calls >= most_calls, "max_tool_calls").when(F.lit(most_cost > 0) & (spent >= most_cost), "max_cost_usd")


def progress(df: DataFrame, run: str, round_: str, counts: list[str]) -> DataFrame:
    """``df`` with grew: whether any of ``counts`` is more than in the run's round before; true in the first round."""
    w = Window.partitionBy(run).orderBy(round_)
    grew = F.lag(F.lit(1)).over(w).isNull()
    for c in counts:
        grew = grew | F.coalesce(F.col(c) > F.lag(c).over(w), F.lit(False))
    return df.withColumn("grew", grew)


def spans(df: DataFrame, run: str, order: list[str], kind: str, ts: str, start: str, end: str) -> DataFrame:
    """(run, started, ended, micros): each start with the next event of its run, if that is an end; else without one."""
    w = Window.partitionBy(run).orderBy(*order)
    after = df.withColumns({"_k": F.lead(kind).over(w), "_t": F.lead(ts).over(w)}).where(F.col(kind) == start)
    ended = F.when(F.col("_k") == end, F.col("_t"))
    return after.select(run, F.col(ts).alias("started"), ended.alias("ended"), (F.unix_micros(ended.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))).alias("micros"))

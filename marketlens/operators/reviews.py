"""The review queue as the replay of a log of actions.

Actions are resolve (a variant is chosen by hand), dismiss and revoke (the choice no longer holds). Each gives an interval of
validity: a choice holds from its action to the next resolve or revoke of its record, a review's status to the next resolve
or dismiss. The state at any time is what holds then, so late or imported actions need no order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .predicates import first_rule

ACTIONS = ("resolve", "dismiss", "revoke")


def checked(actions: DataFrame, reviews: DataFrame, variants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions that can be applied, the others with a reason). actions: action_id, record_id, action, variant_id, reviewer, note, acted_at; reviews: record_id, tier, opened_at."""
    known = reviews.select("record_id", F.lit(True).alias("__review")).distinct()
    # only choices need their variant; the other actions, often without one, would all meet in the task of null
    asked = F.when((F.col("action") == "resolve") & (F.col("variant_id") > 0), F.col("variant_id")).otherwise(-1 - F.pmod(F.xxhash64("action_id", "record_id"), F.lit(1 << 20)))
    there = variants.select(F.col("variant_id").cast("long").alias("__asked"), F.lit(True).alias("__variant")).where("__asked > 0").distinct()
    rows = actions.join(known, "record_id", "left").withColumn("__asked", asked.cast("long")).join(there, "__asked", "left")
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    reason = first_rule([
        (F.col("__review").isNull(), "no such review"), (~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "no such action"), (~text("reviewer"), "no reviewer"), (~text("note"), "no note"), (F.col("acted_at").isNull(), "no time"),
        ((F.col("action") == "resolve") & ~F.coalesce(F.col("variant_id") > 0, F.lit(False)), "no variant"), ((F.col("action") == "resolve") & F.col("__variant").isNull(), "no such variant"),
    ])
    judged = rows.withColumn("reason", reason).select(*actions.columns, "reason")
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def intervals(actions: DataFrame, of: tuple[str, ...]) -> DataFrame:
    """The actions of some kinds with valid_from and valid_to (null: still valid); of equal times the greater action_id is the later one."""
    w = Window.partitionBy("record_id").orderBy("acted_at", "action_id")
    rows = actions.where(F.col("action").isin(*of))
    return rows.withColumns({"valid_from": F.col("acted_at"), "valid_to": F.lead("acted_at").over(w), "__next": F.lead("action_id").over(w)}).where("valid_to is null or valid_to > valid_from").drop("__next")


def _valid(at: Column) -> Column:
    return (F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))


def overrides_at(actions: DataFrame, at: Column) -> DataFrame:
    """record_id, variant_id, reviewer, since of the choices by hand that hold at a time."""
    held = intervals(actions, ("resolve", "revoke")).where(_valid(at) & (F.col("action") == "resolve"))
    return held.select("record_id", "variant_id", "reviewer", F.col("valid_from").alias("since"))


def reviews_at(reviews: DataFrame, actions: DataFrame, at: Column) -> DataFrame:
    """Each review that is open, resolved or dismissed at a time, by whom, and the variant that holds for its record then. A revoked choice leaves the review resolved."""
    # the last action of either kind until then holds, so no record's log is put in order
    kind = lambda *of: F.col("action").isin(*of)
    last = lambda c, *fields: F.max(F.when(c, F.struct("acted_at", "action_id", "action", *fields)))
    state = actions.where(F.col("acted_at") <= at).groupBy("record_id").agg(last(kind("resolve", "dismiss"), "reviewer").alias("s"), last(kind("resolve", "revoke"), "variant_id").alias("h"))
    chosen = F.col("h.action") == "resolve"
    known = state.select("record_id", F.when(F.col("s.action") == "resolve", "resolved").when(F.col("s.action") == "dismiss", "dismissed").alias("status"), F.col("s.reviewer").alias("resolved_by"), F.when(chosen, F.col("h.variant_id")).alias("variant_id"))
    rows = reviews.where(F.col("opened_at") <= at).join(known, "record_id", "left")
    return rows.select("record_id", "tier", F.coalesce("status", F.lit("open")).alias("status"), "resolved_by", "variant_id")


def revisions(actions: DataFrame) -> DataFrame:
    """The log of what was done to choices: activate, dismiss or revoke with the record's revision number, for export (and import as actions again)."""
    number = F.row_number().over(Window.partitionBy("record_id").orderBy("acted_at", "action_id"))
    return actions.select("record_id", number.cast("long").alias("revision"), F.when(F.col("action") == "resolve", "activate").otherwise(F.col("action")).alias("action"), F.when(F.col("action") == "resolve", F.col("variant_id")).alias("variant_id"), "reviewer", "note", "acted_at")

"""Walks over paged histories: resumed, incremental or a full audit, each within its budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.predicates import first_rule

MOST_PAGES, AUDIT_DAYS = 50, 30


def modes(histories: DataFrame, now: Column, audit_days: int = AUDIT_DAYS) -> DataFrame:
    """histories: history_id, cutoff (date or null), complete, pages_fetched, audited_at. Adds mode and first_page.

    A history with a cutoff, or one that is not complete, is walked on from its last page; a complete one is walked again
    from the first page: incrementally, or as an audit that takes every page for unknown once the last audit is so old.
    """
    whole, complete = F.col("cutoff").isNull(), F.coalesce("complete", F.lit(False))
    old = F.col("audited_at").isNull() | (F.col("audited_at") <= now - F.make_dt_interval(days=F.lit(audit_days)))
    mode = first_rule([(~complete & (F.coalesce("pages_fetched", F.lit(0)) > 0), "resume"), (whole & complete & ~old, "incremental"), (whole, "audit")], "cutoff")
    return histories.withColumn("mode", mode).withColumn("first_page", F.when(~complete, F.coalesce("pages_fetched", F.lit(0)) + 1).otherwise(1))


def walk(histories: DataFrame, pages: DataFrame, sales: DataFrame, known: DataFrame, now: Column, budget_seconds: float, most_pages: int = MOST_PAGES, audit_days: int = AUDIT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(how each history's walk ends, the pages that it takes).

    pages: history_id, page, seconds; sales: history_id, page, sale_id, sale_date; known: history_id, sale_id. A walk ends
    with the first page that has no sales (source_exhausted), that is the second in a row with known sales alone
    (known_overlap, incremental walks), whose oldest sale is before the cutoff (user_cutoff), that is the last one allowed
    (page_cap_reached), or by which the seconds since its first page reach the budget (time_budget). Only the first three
    make it complete; a full walk over all history renews the audit.
    """
    begun = modes(histories, now, audit_days).select("history_id", "cutoff", "mode", "first_page", "audited_at")
    marked = sales.join(known.select("history_id", "sale_id", F.lit(True).alias("was")).distinct(), ["history_id", "sale_id"], "left")
    facts = marked.groupBy("history_id", "page").agg(F.count("*").alias("sales"), F.bool_and(F.coalesce("was", F.lit(False))).alias("all_known"), F.min("sale_date").alias("oldest"))
    rows = pages.join(begun, "history_id").where((F.col("page") >= F.col("first_page")) & (F.col("page") <= most_pages)).join(facts, ["history_id", "page"], "left")
    order = Window.partitionBy("history_id").orderBy("page")
    overlap = (F.col("mode") == "incremental") & F.coalesce("all_known", F.lit(False)) & F.coalesce(F.lag("all_known").over(order), F.lit(False))
    spent = F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, 0))
    why = first_rule([
        (F.col("sales").isNull(), "source_exhausted"), (F.coalesce(F.col("oldest") < F.col("cutoff"), F.lit(False)), "user_cutoff"), (overlap, "known_overlap"), (F.col("page") == most_pages, "page_cap_reached"), (spent >= budget_seconds, "time_budget"),
    ], "")
    judged = rows.withColumns({"why": why, "spent": spent})
    ends = judged.where("why <> ''").groupBy("history_id").agg(F.min(F.struct("page", "why", "spent")).alias("e"))
    taken = judged.join(ends, "history_id", "left").where("e is null or page <= e.page")
    totals = taken.groupBy("history_id").agg(F.count("*").alias("walked"), F.sum("sales").alias("seen"), F.max("page").alias("last_page"), F.max("spent").alias("seconds"))
    done = begun.join(ends, "history_id", "left").join(totals, "history_id", "left").withColumn("complete", F.coalesce(F.col("e.why").isin("source_exhausted", "user_cutoff", "known_overlap"), F.lit(False)))
    audited = F.when((F.col("mode") != "incremental") & F.col("cutoff").isNull(), now).otherwise(F.col("audited_at"))
    result = done.select(
        "history_id", "mode", F.coalesce("walked", F.lit(0)).alias("walked"), F.coalesce("last_page", F.col("first_page") - 1).cast("long").alias("pages_fetched"), F.coalesce("seen", F.lit(0)).alias("seen"),
        F.coalesce("seconds", F.lit(0.0)).alias("seconds"), F.col("e.why").alias("evidence"), "complete", audited.alias("audited_at"))
    return result, taken.select("history_id", "page")

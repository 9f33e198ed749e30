"""Market figures of variants: population, guide prices, sales, medians.

Tables are those of schemas.py. A spec has the finish and small variant that its source names, which need not be its variant's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import gem_rate
from .latest import top_by

#: The grades shown, in order.
GRADES = ("AUTH", "1", "1.5", "2", "3", "4", "5", "6", "7", "8", "9", "10")


def ranked_sales(sales: DataFrame, keys: Sequence[str], date: str, ties: Sequence[str], now: Column, recent: Column | None = None) -> DataFrame:
    """The latest sale of each key with sale_count and sales_12m, the sales of the last 365 days that `recent` holds for.

    One aggregate, so a key with very many sales is summed before it is shuffled.
    """
    values = [c for c in sales.columns if c not in keys]
    late = F.col(date).cast("date") >= F.date_sub(now.cast("date"), 365)
    order = F.struct(F.col(date), *map(F.col, ties))
    counted = F.count_if(late if recent is None else late & recent)
    return sales.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("__row"), F.count("*").alias("sale_count"), counted.alias("sales_12m")).select(*keys, "__row.*", "sale_count", "sales_12m")


def matched(specs: DataFrame, namespace: str) -> DataFrame:
    """Specs of a namespace whose match counts."""
    return specs.where((F.col("namespace") == namespace) & F.col("match_status").isin("matched", "manual"))


def sibling_specs(specs: DataFrame, variants: DataFrame, namespace: str) -> DataFrame:
    """Each spec with every variant of its card: affinity 0 its own, 1 one of the spec's finish and small variant, 2 another one."""
    own = matched(specs, namespace).select("spec_pk", "fetched_at", F.col("variant_id").alias("own_variant"), F.col("finish").alias("spec_finish"), F.col("micro_variant").alias("spec_micro"))
    carded = own.join(variants.select(F.col("variant_id").alias("own_variant"), "card_id"), "own_variant")
    same = lambda a, b: F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    alike = same("finish", "spec_finish") & same("micro_variant", "spec_micro")
    affinity = F.when(F.col("own_variant") == F.col("variant_id"), 0).when(alike, 1).otherwise(2)
    return carded.join(variants.select("variant_id", "card_id", "finish", "micro_variant"), "card_id").select("variant_id", "spec_pk", "fetched_at", affinity.alias("affinity"))


def chosen_specs(specs: DataFrame, variants: DataFrame, rows: DataFrame, namespace: str) -> DataFrame:
    """variant_id, spec_pk: the nearest spec, one with rows first, then the newest."""
    having = rows.select("spec_pk", F.lit(True).alias("has_rows")).distinct()
    flagged = sibling_specs(specs, variants, namespace).join(having, "spec_pk", "left").withColumn("has_rows", F.coalesce("has_rows", F.lit(False)))
    return top_by(flagged, ["variant_id"], [F.asc("affinity"), F.desc("has_rows"), F.desc_nulls_last("fetched_at"), F.desc("spec_pk")]).select("variant_id", "spec_pk")


def own_specs(specs: DataFrame, rows: DataFrame, namespace: str) -> DataFrame:
    """variant_id, spec_pk: the newest of a variant's own specs; of sales specs one with rows first (Q10)."""
    having = rows.select("spec_pk", F.lit(True).alias("has_rows")).distinct()
    flagged = matched(specs, namespace).where("variant_id is not null").join(having, "spec_pk", "left")
    first = [F.desc(F.coalesce("has_rows", F.lit(False)))] if namespace == "sales" else []
    return top_by(flagged, ["variant_id"], [*first, F.desc_nulls_last("fetched_at"), F.desc("spec_pk")]).select("variant_id", "spec_pk")


def variant_metrics(variants: DataFrame, specs: DataFrame, population: DataFrame, prices: DataFrame, sales: DataFrame, now: Column) -> DataFrame:
    """One row for each variant: population10, total_population, gem_rate, guide_price, average_price, latest sale of any grade, all sales, grade ten's of a year, and whether there are specs (M2).

    The guide belongs to the spec that is chosen by its population rows; counts without rows are zero.
    """
    spec = chosen_specs(specs, variants, population, "population")
    pop = spec.join(population, "spec_pk").groupBy("variant_id").agg(F.max("total_population").alias("total"), F.sum(F.when((F.col("grade_value") == 10) & ~F.col("qualified"), F.col("population_count")).otherwise(0)).alias("tens"))
    guide = spec.join(prices.where("grade_key = '10'"), "spec_pk").groupBy("variant_id").agg(F.max("psa_price").alias("guide_price"), F.max("average_price").alias("average_price"))
    sales_spec = chosen_specs(specs, variants, sales, "sales")
    sold = ranked_sales(sales_spec.join(sales, "spec_pk"), ["variant_id"], "sale_date", ["sale_item_id"], now, F.col("grade_value") == 10).select("variant_id", F.col("sale_price").alias("latest_sale_price"), F.col("sale_date").alias("latest_sale_date"), "sale_count", "sales_12m")
    whole = variants.select("variant_id")
    for part in (pop, guide, sold, spec.select("variant_id", F.lit(True).alias("p")), sales_spec.select("variant_id", F.lit(True).alias("s"))):
        whole = whole.join(part, "variant_id", "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    return whole.select(
        "variant_id", F.coalesce("tens", zero).alias("population10"), F.coalesce("total", zero).alias("total_population"), gem_rate(F.col("tens"), F.col("total")).alias("gem_rate"), "guide_price", "average_price", "latest_sale_price", "latest_sale_date",
        F.coalesce("sale_count", zero).alias("sale_count"), F.coalesce("sales_12m", zero).alias("sales_12m"), F.coalesce("p", no).alias("population_available"), F.coalesce("s", no).alias("sales_available"))


def monthly_medians(sales: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exact median and number of sales by month."""
    return sales.groupBy(*keys, F.date_format("sale_date", "yyyy-MM").alias("month")).agg(F.median("sale_price").alias("median_price"), F.count("*").alias("sales"))


def market(specs: DataFrame, population: DataFrame, prices: DataFrame, sales: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summary, sales, months) of every variant that has a spec of its own, for one variant filter by variant_id (M5).

    All is of grade ten. sales in order of their date; months with median and number, of sales with a date and a price.
    """
    pop, own = own_specs(specs, population, "population"), own_specs(specs, sales, "sales")
    tens = population.where("grade_value = 10").groupBy("spec_pk").agg(F.sum(F.when(~F.col("qualified"), F.col("population_count")).otherwise(0)).alias("population10"), F.max("total_population").alias("total_population"))
    guide = top_by(prices.where("grade_key = '10'"), ["spec_pk"], [F.desc_nulls_last("observed_at")]).select("spec_pk", F.col("psa_price").alias("guide_price"), "average_price", F.lit(True).alias("has_guide"))
    sold = own.join(sales.where("grade_value = 10"), "spec_pk")
    counted = sold.groupBy("variant_id").agg(F.count("*").alias("sales"), F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"), F.count_if(F.col("sale_date") >= F.date_sub(now.cast("date"), 365)).alias("sales_12m"))
    left = pop.join(tens, "spec_pk", "left").join(guide, "spec_pk", "left").drop("spec_pk").withColumn("p", F.lit(True))
    whole = left.join(own.select("variant_id", F.lit(True).alias("s")), "variant_id", "full_outer").join(counted, "variant_id", "left")
    zero, no = F.lit(0).cast("long"), F.lit(False)
    summary = whole.select(
        "variant_id", F.coalesce("p", no).alias("population_available"), F.coalesce("has_guide", no).alias("guide_available"), F.coalesce("s", no).alias("sales_available"), "guide_price", "average_price", F.coalesce("population10", zero).alias("population10"),
        F.coalesce("total_population", zero).alias("total_population"), gem_rate(F.col("population10"), F.col("total_population")).alias("gem_rate"), F.coalesce("sales_12m", zero).alias("sales_12m"), F.coalesce("sales", zero).alias("sales"), "first_sale", "last_sale")
    return summary, sold.select("variant_id", "sale_date", "sale_item_id", "sale_price").orderBy("variant_id", "sale_date", "sale_item_id"), monthly_medians(sold.where("sale_date is not null and sale_price is not null"), ["variant_id"])


def population_ladder(specs: DataFrame, population: DataFrame, prices: DataFrame) -> DataFrame:
    """variant_id with each grade's plain, qualified and half-grade counts and prices, for every variant that has a population spec of its own (M6, A16). A grade that has a price alone has a row with null counts."""
    own = own_specs(specs, population, "population")
    rows = own.join(population, "spec_pk").groupBy("spec_pk", "grade_key").agg(
        F.max("grade_value").alias("grade_value"), F.sum(F.when(~F.col("qualified"), F.col("population_count")).otherwise(0)).alias("population"),
        F.sum(F.when(F.col("qualified"), F.col("population_count")).otherwise(0)).alias("qualified"), F.max("half_grade_count").alias("half_grades"), F.max("total_population").alias("total_population"))
    asked = prices.select("spec_pk", "grade_key", "most_recent_price", "average_price", "psa_price").join(own.select("spec_pk"), "spec_pk", "left_semi")
    return rows.join(asked, ["spec_pk", "grade_key"], "full_outer").join(own, "spec_pk")


def unpivot_population(wide: DataFrame, counts: str, keys: Sequence[str]) -> DataFrame:
    """A map of counts (Grade10, Grade9_5, Grade9Q …) to one row for each shown grade, and rows for qualified grades above zero."""
    def name(g: str) -> str:
        return "Auth" if g == "AUTH" else "Grade" + g.replace(".", "_")

    count = F.col(counts)
    plain = [F.struct(F.lit(g).alias("grade_key"), F.lit(i).alias("grade_order"), F.lit(None if g == "AUTH" else float(g)).cast("double").alias("grade_value"), F.lit(False).alias("qualified"), F.coalesce(F.try_element_at(count, F.lit(name(g))), F.lit(0)).cast("long").alias("population_count"), (F.try_element_at(count, F.lit(f"Grade{g}_5")) if g.isdigit() else F.lit(None)).cast("long").alias("half_grade_count")) for i, g in enumerate(GRADES)]
    marked = [F.struct(F.lit(g).alias("grade_key"), F.lit(i).alias("grade_order"), F.lit(float(g)).alias("grade_value"), F.lit(True).alias("qualified"), F.coalesce(F.try_element_at(count, F.lit(f"{name(g)}Q")), F.lit(0)).cast("long").alias("population_count"), F.lit(None).cast("long").alias("half_grade_count")) for i, g in enumerate(GRADES) if g != "AUTH"]
    return wide.select(*keys, F.inline(F.array(*plain, *marked))).where("not qualified or population_count > 0")


def price_comparison(variants: DataFrame, cards: DataFrame, sets: DataFrame, listings: DataFrame, history: DataFrame, prices: DataFrame, population: DataFrame, specs: DataFrame) -> DataFrame:
    """Asking prices of each variant's matched grade-ten listings against its guide price and population; a row for every variant."""
    newest = top_by(history, ["listing_id"], [F.desc("observed_at"), F.desc("observation_id")]).select("listing_id", "price", "observed_at")
    wanted = listings.where((F.col("grade") == 10) & F.col("match_status").isin("matched", "manual") & ~F.col("is_lot")).select("listing_id", "variant_id")
    asked = wanted.join(newest, "listing_id", "left").groupBy("variant_id").agg(F.count("listing_id").alias("listings"), F.min("price").alias("least"), F.avg("price").alias("mean"), F.max("price").alias("most"), F.max("observed_at").alias("last_observed"))
    of_variant = specs.select("spec_pk", "variant_id")

    def last(rows: DataFrame, value: str, name: str) -> DataFrame:
        return top_by(rows.join(of_variant, "spec_pk"), ["variant_id"], [F.desc_nulls_last("observed_at"), F.desc("spec_pk")]).select("variant_id", F.col(value).alias(name))

    base = variants.select("variant_id", "card_id").join(cards.select("card_id", "set_id", F.col("name").alias("card_name")), "card_id").join(sets.select("set_id", "language", F.col("name").alias("set_name")), "set_id")
    whole = base.join(last(prices.where("grade_key = '10'"), "psa_price", "guide_price"), "variant_id", "left").join(last(population.where("grade_value = 10 and not qualified"), "population_count", "population10"), "variant_id", "left")
    return whole.join(asked, "variant_id", "left").withColumn("listings", F.coalesce("listings", F.lit(0)).cast("long"))

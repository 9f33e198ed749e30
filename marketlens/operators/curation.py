"""Raw payloads to the normalised catalogue and the graded facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key, normalize_part, variant_key
from ..functions.values import grade_value, parse_money
from .latest import top_by
from .matching import micro_key
from .metrics import unpivot_population

#: German names of print runs and stamps.
SUBTYPES = {"unbegrenzt": "unlimited", "schattenlos": "shadowless", "schattenlose_rote_wange": "shadowless_red_cheek", "copyright_1999_2000": "1999_2000_copyright"}
STAMPS = {"1_auflage": "1st_edition", "vorveroffentlichung": "pre_release", "poketour_1999": "poketour_99"}
#: The source whose variants are the catalogue's own.
CATALOGUE = "catalogue"
POPULATION_JSON = "struct<Results:array<struct<Counts:array<map<string,bigint>>>>>"


def sets_of(raw: DataFrame) -> DataFrame:
    """raw: language and the set payload."""
    return raw.select("language", F.col("id").alias("source_set_id"), "name", F.col("serie.name").alias("series"), F.col("releaseDate").alias("release_date"), F.col("cardCount.total").alias("total_cards"), F.col("cardCount.official").alias("official_cards"))


def cards_of(raw_sets: DataFrame, raw_cards: DataFrame) -> DataFrame:
    """Stubs out of set payloads, filled by card payloads where there are some; hydrated never goes back to stub."""
    stubs = raw_sets.select("language", F.col("id").alias("source_set_id"), F.explode("cards").alias("c")).select("language", "source_set_id", F.col("c.id").alias("source_card_id"), F.col("c.localId").alias("local_id"), F.col("c.name").alias("stub_name"), F.col("c.image").alias("stub_image"))
    full = raw_cards.select("language", F.col("id").alias("source_card_id"), F.col("name").alias("full_name"), "category", "rarity", F.col("image").alias("full_image"), "hp", "illustrator", F.col("dexId").alias("dex_ids"), F.lit(True).alias("full"))
    rows = stubs.join(full, ["language", "source_card_id"], "left")
    return rows.select(
        "language", "source_set_id", "source_card_id", "local_id", F.coalesce("full_name", "stub_name").alias("name"), "category", "rarity", "hp", "illustrator", "dex_ids", F.coalesce("full_image", "stub_image").alias("image_url"),
        F.when(F.col("full"), "hydrated").otherwise("stub").alias("detail_status"), natural_key(F.col("local_id")).alias("local_sort_key"))


def _alias(key: Column, language: Column, aliases: dict[str, str]) -> Column:
    """A key's common name where a language has its own."""
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.when(language == "de", F.coalesce(F.try_element_at(known, key), key)).otherwise(key)


def detailed_parts(v: Column, language: Column, set_id: Column, year: Column, scoped: Column) -> Column:
    """Struct of the parts that a detailed variant proves in a language (F28); v: type, subtype, size, stamp.

    German issues that the German data do not name themselves (scoped) are no more than their edition: the first set has
    no other, shadowless is none, and what else is told of them is a translation.
    """
    none, german = F.array().cast("array<string>"), (language == "de") & ~scoped
    stamps = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(v["stamp"], none), lambda s: _alias(normalize_part(s), language, STAMPS)), lambda s: s != "")))
    first = F.arrays_overlap(stamps, F.array(F.lit("1st_edition"), F.lit("first_edition")))
    kept = F.array_except(stamps, F.array(F.lit("1st_edition"), F.lit("first_edition")))
    subtype = F.coalesce(_alias(normalize_part(v["subtype"]), language, SUBTYPES), F.lit(""))
    structural = german & ((set_id == "base1") | (subtype == "shadowless"))
    other = ~structural & ~subtype.isin("", "shadowless", "unlimited", "first_edition") & ~first
    marker = (
        F.when(structural, F.when(first, "first_edition").otherwise("unlimited")).when(subtype == "shadowless", F.when(first, "shadowless_first_edition").otherwise("shadowless"))
        .when(subtype == "unlimited", "unlimited").when((subtype == "first_edition") | first, "first_edition").when(other & (year <= 2003), "unlimited")
    )
    return F.struct(
        F.coalesce(normalize_part(v["type"]), F.lit("")).alias("finish"), F.coalesce(marker, F.lit("")).alias("print_run_marker"), F.when(other & ~german, subtype).otherwise("").alias("micro_variant"),
        F.coalesce(F.nullif(normalize_part(v["size"]), F.lit("")), F.lit("standard")).alias("size"), F.when(structural | other & german, none).otherwise(kept).alias("stamps"))


def plain_parts(flags: Column) -> Column:
    """(finish, print_run_marker) of a card with plain flags alone: its finishes, normal where it has none, each also as first edition if there is one."""
    on = F.coalesce(F.map_keys(F.map_filter(flags, lambda _, x: F.coalesce(x, F.lit(False)))), F.array().cast("array<string>"))
    finishes = F.array_distinct(F.filter(F.transform(on, normalize_part), lambda f: f.isin("normal", "holo", "reverse")))
    some = F.when(F.size(finishes) > 0, finishes).otherwise(F.array(F.lit("normal")))
    runs = F.when(F.arrays_overlap(on, F.array(F.lit("firstEdition"), F.lit("first_edition"))), F.array(F.lit(""), F.lit("first_edition"))).otherwise(F.array(F.lit("")))
    return F.flatten(F.transform(some, lambda f: F.transform(runs, lambda r: F.struct(f.alias("finish"), r.alias("print_run_marker")))))


def variants_of(raw_cards: DataFrame, years: DataFrame) -> DataFrame:
    """One row for each variant key of a card. Detailed variants first, else the plain flags; equal keys are one variant.

    years: language, source_set_id, year. Where variants have an id, the English card's of the same id says what they are.
    """
    base = raw_cards.select("language", F.col("id").alias("source_card_id"), F.col("set.id").alias("source_set_id"), "variants", "variants_detailed").join(years, ["language", "source_set_id"], "left")
    fields = {f.name for f in raw_cards.schema["variants_detailed"].dataType.elementType.fields}
    rows = base.select("language", "source_card_id", "source_set_id", "year", F.explode("variants_detailed").alias("v"))
    rows = rows.withColumn("vid", F.nullif(F.col("v.variantId"), F.lit("")) if "variantId" in fields else F.lit(None).cast("string"))
    english = rows.where("language = 'en' and vid is not null").groupBy("source_card_id", "vid").agg(F.max("v").alias("c"))
    both = rows.join(english, ["source_card_id", "vid"], "left")
    own, common = (F.col("v.languages"), F.col("c.languages")) if "languages" in fields else (F.lit(None).cast("array<string>"),) * 2
    named = lambda x: F.coalesce(F.array_contains(x, F.col("language")), F.lit(False))
    listed, scoped = F.coalesce(own, common), named(own) | named(common)
    parts = detailed_parts(F.coalesce("c", "v"), F.col("language"), F.col("source_set_id"), F.col("year"), scoped)
    here = both.where(F.coalesce(F.size(listed) <= 0, F.lit(True)) | named(listed)).withColumn("p", parts)
    detailed = here.where(~((F.col("language") == "de") & (F.col("source_set_id") == "base1") & (F.col("p.size") != "standard") & ~scoped)).select("language", "source_card_id", "p.*")
    plain = base.where("variants_detailed is null or size(variants_detailed) = 0").select("language", "source_card_id", F.inline(plain_parts(F.col("variants"))))
    flags = plain.withColumns({"micro_variant": F.lit(""), "size": F.lit("standard"), "stamps": F.array().cast("array<string>")})
    keyed = detailed.unionByName(flags).withColumn("variant_key", variant_key(F.col("finish"), F.col("print_run_marker"), F.col("micro_variant"), F.col("size"), F.col("stamps")))
    return keyed.dropDuplicates(["language", "source_card_id", "variant_key"])


def set_images(raw: DataFrame) -> DataFrame:
    """language, source_set_id, kind, url: the logo and the symbol of each set that has them (S15, M21). raw: language, id, logo, symbol."""
    clean = lambda c: F.nullif(F.regexp_replace(F.trim(c), "/$", ""), F.lit(""))
    full = lambda c: F.when(clean(c).endswith(".webp"), clean(c)).otherwise(F.concat(clean(c), F.lit(".webp")))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), full(F.col(k)).alias("url")) for k in ("logo", "symbol")))
    return raw.select("language", F.col("id").alias("source_set_id"), F.inline(kinds)).where("url is not null")


def populations(raw: DataFrame) -> DataFrame:
    """raw: population files. One row for each shown grade of a spec, with the total; a payload that is no JSON has no rows."""
    parsed = raw.select(F.col("psaSpecId").alias("spec_id"), F.from_json("populationRaw", POPULATION_JSON).alias("p")).where("p.Results is not null")
    counts = parsed.select("spec_id", F.get(F.get("p.Results", F.lit(0))["Counts"], F.lit(0)).alias("counts")).where("counts is not null")
    graded = F.map_filter("counts", lambda k, v: k.rlike("^(Grade[0-9]|Auth)") & ~k.rlike("Total"))
    total = F.coalesce(F.try_element_at("counts", F.lit("GradeTotal")), F.aggregate(F.map_values(graded), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))))
    return unpivot_population(counts.withColumn("total_population", total), "counts", ["spec_id", "total_population"])


def price_rows(raw: DataFrame) -> DataFrame:
    """Guide prices by grade out of their texts."""
    rows = raw.select(F.col("psaSpecId").alias("spec_id"), F.explode("priceRows").alias("r"))
    grade = grade_value(F.col("r.gradeText"))
    return rows.select("spec_id", F.regexp_replace(grade.cast("string"), r"\.0$", "").alias("grade_key"), parse_money(F.col("r.mostRecentText")).alias("most_recent_price"), parse_money(F.col("r.averageText")).alias("average_price"), parse_money(F.col("r.psaPriceText")).alias("psa_price")).where("grade_key is not null")


def resolve_variants(wanted: DataFrame, variants: DataFrame, exact: bool = False) -> DataFrame:
    """row_id, variant_id: the one variant of a row's card that is left; null where there is none or several are.

    wanted: row_id, card_id, finish, print_run_marker, micro_variant. variants: variant_id, card_id, the same three, and
    source where it is known (null or CATALOGUE is the catalogue's own). Forgiving, the catalogue's variants are narrowed by
    finish, print run and small variant; a wish that is empty or that none meets narrows nothing, so a lone variant is taken
    unseen. Exact, variants of any source must have the small variant (without words for languages) and the finish, if one
    is wanted; of several the catalogue's go first, and the print run decides only between those that are still tied.
    """
    key = lambda c: F.coalesce(normalize_part(F.col(c)), F.lit(""))
    small = (lambda c: F.coalesce(micro_key(F.col(c)), F.lit(""))) if exact else key
    parts = {"finish": key, "print_run_marker": key, "micro_variant": small}
    own = F.coalesce(F.col("source") == CATALOGUE, F.lit(True)) if "source" in variants.columns else F.lit(True)
    have = variants.select("card_id", "variant_id", own.alias("own"), *(f(c).alias(f"has_{c}") for c, f in parts.items()))
    rows = wanted.select("row_id", "card_id", *(f(c).alias(f"want_{c}") for c, f in parts.items())).join(have, "card_id")
    same = Window.partitionBy("row_id")
    fits = {c: (F.col(f"want_{c}") != "") & (F.col(f"want_{c}") == F.col(f"has_{c}")) for c in parts}

    def narrowed(df: DataFrame, fit: Column) -> DataFrame:
        return df.withColumn("fit", fit).withColumn("some", F.max("fit").over(same)).where("fit or not some").drop("fit", "some")

    if exact:
        rows = rows.where((F.col("want_micro_variant") == F.col("has_micro_variant")) & ((F.col("want_finish") == "") | fits["finish"]))
        steps = [F.col("own"), fits["print_run_marker"]]
    else:
        rows, steps = rows.where("own"), list(fits.values())
    for fit in steps:
        rows = narrowed(rows, fit)
    left = rows.groupBy("row_id").agg(F.when(F.count("*") == 1, F.min("variant_id")).alias("variant_id"))
    return wanted.select("row_id").join(left, "row_id", "left")


def mint_specs(listings: DataFrame, cert_specs: DataFrame, specs: DataFrame) -> DataFrame:
    """Specs that a certificate page names and no table has, for listings whose variant is known; the first listing of a certificate counts."""
    first = top_by(listings.where("cert is not null and variant_id is not null"), ["cert"], [F.asc("listing_id")]).select("cert", "variant_id")
    named = first.join(cert_specs, "cert").groupBy("spec_id").agg(F.min("variant_id").alias("variant_id"))
    return named.join(specs.select("spec_id"), "spec_id", "left_anti").select(F.lit("population").alias("namespace"), "spec_id", "variant_id", F.lit("certificate").alias("match_method"))


def paired_specs(population: DataFrame) -> DataFrame:
    """Population and sales specs that a file names together; a sales spec belongs to the first."""
    rows = population.where("salesSpecId is not null").select(F.col("psaSpecId").alias("spec_id"), F.col("salesSpecId").alias("sales_spec_id"), "fetchedAt")
    return top_by(rows, ["sales_spec_id"], [F.asc("fetchedAt"), F.asc("spec_id")]).select("spec_id", "sales_spec_id")

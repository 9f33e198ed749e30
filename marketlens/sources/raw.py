"""Raw payloads: files to typed rows, content addresses, and parsers of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_match, links
from ..functions.vocabulary import SPEC_PATTERNS
from ..operators.latest import top_by
from ..operators.merge import insert_or_ignore
from .shared import settled

IMAGE_QUALITIES, IMAGE_FORMATS = ("low", "high"), ("webp", "png", "jpg")


def read_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One row for each JSON file, with its path; what cannot be parsed is in _corrupt_record."""
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.json(path).withColumn("path", F.input_file_name())


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, body: whole files as text."""
    found = spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
    return found.select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def read_bytes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def split_corrupt(df: DataFrame, name: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(good rows, rows for the quarantine): a bad payload never stops a batch."""
    return df.where(F.col(name).isNull()).drop(name), df.where(F.col(name).isNotNull())


def latest_files(files: DataFrame, key: str, fetched: str = "fetchedAt") -> DataFrame:
    """The newest file of each key; of equal times the first path."""
    return top_by(files, [key], [F.desc_nulls_last(fetched), F.asc("path")])


def latest_observations(observations: DataFrame) -> DataFrame:
    """The last arrival of each key; arrival order, not event time, decides."""
    return top_by(observations, ["entity_type", "scope_key"], [F.desc("observation_id")])


def store_objects(bodies: DataFrame, known: DataFrame) -> DataFrame:
    """hash, byte_size, body of contents not known yet, each once; the first observation wins."""
    hashed = bodies.withColumn("hash", F.sha2(F.col("body").cast("binary"), 256)).withColumn("byte_size", F.octet_length("body").cast("long"))
    return insert_or_ignore(known, hashed, ["hash"], [F.asc("observed_at"), F.asc("path")])


def object_path(source: Column, kind: Column, digest: Column, extension: Column) -> Column:
    """source/kind/ab/cd/hash.ext"""
    return F.concat_ws("/", source, kind, F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat_ws(".", digest, extension))


def import_backfill(files: DataFrame, attempts: DataFrame) -> DataFrame:
    """Files whose content their work item has not seen."""
    hashed = files.withColumn("hash", F.sha2(F.col("body").cast("binary"), 256))
    return insert_or_ignore(attempts, hashed, ["work_item_id", "hash"], [F.asc("path")])


def aliases(entries: DataFrame) -> DataFrame:
    """alias_text, language, source_set_id from entries whose alias is one text or a JSON array of them; entries with a comment alone go.

    entries: aliases (text, as get_json_object gives it, or array), language, source_set_id.
    """
    text = F.col("aliases") if dict(entries.dtypes)["aliases"] != "string" else F.when(F.ltrim("aliases").startswith("["), F.from_json("aliases", "array<string>")).otherwise(F.array("aliases"))
    return entries.where("source_set_id is not null and aliases is not null").select(F.explode(text).alias("alias_text"), "language", "source_set_id").where("alias_text <> ''").distinct()


def exchange_rate(xml: Column) -> Column:
    """Struct (rate_date, rate) of the daily XML; null without a date or a positive rate."""
    day = F.regexp_extract(xml, r"time=['\"](\d{4}-\d{2}-\d{2})['\"]", 1).try_cast("date")
    rate = F.regexp_extract(xml, r"currency=['\"]USD['\"]\s+rate=['\"]([0-9.]+)['\"]", 1).try_cast("double")
    return F.when(day.isNotNull() & (rate > 0), F.struct(day.alias("rate_date"), rate.alias("rate")))


def spec_of_page(html: Column) -> Column:
    return first_match(html, SPEC_PATTERNS)


def classified_links(pages: DataFrame) -> DataFrame:
    """page_id, href, text, kind: the first text of each target; a year or a heading."""
    rows = pages.select("page_id", F.posexplode(links(F.col("html"))).alias("at", "a")).select("page_id", "at", "a.href", "a.text").where("text <> ''")
    kind = F.when(F.col("text").rlike(r"^(19|20)\d{2}$"), "year").when(F.col("href").rlike(r"/\d+/?$"), "heading").otherwise("other")
    return top_by(rows, ["page_id", "href"], [F.asc("at")]).select("page_id", "href", "text", kind.alias("kind"))


def table_rows(html: Column) -> Column:
    """Array of rows, each an array of cell texts."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), 1), clean))


#: Heads of the two tables of a card's page.
PRICE_HEAD = ("Grade", "Most Recent Price", "Average Price", "PSA Price", "Population", "POP Higher")
CENSUS_HEAD = ("Pos", "Grade", "Thumbnail", "Pedigree and History")


def census_table(pages: DataFrame) -> DataFrame:
    """page_id, position, grade_label, pedigree of the census table."""
    return price_table(pages, CENSUS_HEAD).select("page_id", F.col("pos").try_cast("int").alias("position"), F.col("grade").alias("grade_label"), F.col("pedigree_and_history").alias("pedigree"))


def price_table(pages: DataFrame, headers: tuple[str, ...] = PRICE_HEAD) -> DataFrame:
    """Body rows of the table whose head is exactly these names."""
    rows = pages.withColumn("rows", table_rows(F.col("html"))).where(F.exists("rows", lambda r: r == F.array(*map(F.lit, headers))))
    cells = rows.select("page_id", F.posexplode("rows").alias("at", "cells")).where((F.size("cells") == len(headers)) & (F.col("cells") != F.array(*map(F.lit, headers))))
    return cells.select("page_id", "at", *(F.col("cells")[i].alias(h.lower().replace(" ", "_")) for i, h in enumerate(headers)))


def infobox_image(wikitext: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(wikitext, r"\|\s*bild\s*=\s*([^\n|}]+)", 1)), F.lit(""))


#: How far a chain of redirects may go; longer ones are an error.
MOST_HOPS = 1000
_CHAINS = """
    WITH RECURSIVE walk (title, at, seen, step) MAX RECURSION LEVEL {most} AS (
        SELECT title, title, array(title), 0 FROM {{titles}}
        UNION ALL SELECT /*+ MERGE(r) */ w.title, r.target, array_append(w.seen, r.target), w.step + 1 FROM walk w JOIN {{redirects}} r ON r.source = w.at WHERE NOT array_contains(slice(w.seen, 1, w.step), w.at))
    SELECT title, max_by(at, step) AS canonical, max(step) AS hops, max_by(seen, step) AS chain FROM walk GROUP BY title"""


def redirect_chains(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """title, canonical, hops, chain: redirects followed to their end, in a cycle to the first title met again.

    One recursive query; a title leaves the walk when it stands on a title that its chain has had. A source that has several
    targets goes to the smallest. Rows are bounded by titles times hops, so Spark's own limit of rows is lifted. Every hop is a
    join of its own: the redirects are written once for all of them and met by merge, as each broadcast of what looks small
    goes through the driver, and there is one for each hop.
    """
    spark = titles.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    one = settled(redirects.where("source is not null and target is not null").groupBy("source").agg(F.min("target").alias("target")), "redirects")
    return spark.sql(_CHAINS.format(most=MOST_HOPS), titles=titles.select("title").distinct(), redirects=one)


def canonical_titles(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """title, canonical: where each title's redirects end."""
    return redirect_chains(titles, redirects).select("title", "canonical")


def asset_urls(cards: DataFrame, folders: DataFrame, stems: DataFrame, base: str) -> DataFrame:
    """card_id, url, match_kind of cards of the sets that a folder is known for: special stems first, else the number in the set's width.

    cards: card_id, source_set_id, local_id; folders: source_set_id, folder, prefix, width; stems: source_set_id, local_id, stem.
    """
    numbered = cards.where(F.col("local_id").rlike("^[0-9]+$")).join(folders, "source_set_id").join(stems, ["source_set_id", "local_id"], "left")
    number = F.regexp_replace("local_id", "^0+(?=[0-9])", "")
    own = F.concat("prefix", F.when(F.length(number) < F.col("width"), F.lpad(number, F.col("width"), F.lit("0"))).otherwise(number))
    return numbered.select("card_id", F.concat_ws("/", F.lit(base.rstrip("/")), F.lit("img"), "folder", F.concat(F.coalesce("stem", own), F.lit(".png"))).alias("url"), F.when(F.col("stem").isNotNull(), "special-stem").otherwise("exact").alias("match_kind"))


def card_images(cards: DataFrame) -> DataFrame:
    """card_id, rendition, url, place: two qualities in three formats, in the order in which they are tried."""
    renditions = F.array(*(F.struct(F.lit(f"{q}:{f}").alias("rendition"), F.lit(f"/{q}.{f}").alias("tail"), F.lit(i).alias("place")) for i, (q, f) in enumerate((q, f) for q in reversed(IMAGE_QUALITIES) for f in IMAGE_FORMATS)))
    return cards.where("image is not null").select("card_id", "image", F.inline(renditions)).select("card_id", "rendition", F.concat(F.regexp_replace("image", "/$", ""), "tail").alias("url"), "place")


def first_available(images: DataFrame, stored: DataFrame) -> DataFrame:
    """The first rendition of each card that is stored."""
    return top_by(images.join(stored.select("url"), "url", "left_semi"), ["card_id"], [F.asc("place")])


def sets_and_cards(raw: DataFrame) -> DataFrame:
    """One row for each card stub of a set payload."""
    return raw.select(F.col("id").alias("source_set_id"), "name", F.posexplode("cards").alias("at", "card")).select("source_set_id", "name", "at", F.col("card.id").alias("source_card_id"), F.col("card.localId").alias("local_id"), F.col("card.name").alias("card_name"), F.col("card.image").alias("image"))


def next_pages(pages: DataFrame) -> DataFrame:
    """Search pages with where the next one starts; null ends the walk."""
    return pages.withColumn("next_offset", F.regexp_extract("next", r"[?&]offset=(\d+)", 1).try_cast("long"))


def report_rows(pages: DataFrame, counts: str = "map<string,long>") -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of population reports; a page that is no JSON is rejected, the others go on."""
    parsed = pages.withColumn("j", F.from_json("body", "recordsTotal int, data array<struct<SpecID:long,SubjectName:string,CardNumber:string>>"))
    fine = F.col("j.data").isNotNull() & ~F.col("body").rlike("(?i)<html|just a moment")
    rows = parsed.where(fine).select("path", F.explode("j.data").alias("r")).select("path", F.col("r.SpecID").alias("spec_id"), F.col("r.SubjectName").alias("name"), F.col("r.CardNumber").alias("number"))
    return rows, parsed.where(~F.coalesce(fine, F.lit(False))).select("path", "body")


def identity_rows(rows: DataFrame) -> DataFrame:
    """spec_id, number, name out of an anchor; count rows without a spec_id to see a page's drift."""
    return rows.select("*", F.regexp_extract("cell", r"/(\d+)['\"/?]", 1).try_cast("long").alias("spec_id"), F.regexp_extract("cell", r"#([A-Za-z0-9/-]+)", 1).alias("number"), F.trim(F.regexp_extract("cell", r">\s*(?:#\S+\s+)?([^<]+)<", 1)).alias("name"))


def counters(events: DataFrame) -> DataFrame:
    """Totals of appended deltas."""
    return events.groupBy("name").agg(F.sum("delta").alias("value"))


def synthetic(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("index"), F.concat_ws(":", F.lit("item"), "id").alias("scope_key"))


def scope_key(*parts: Column) -> Column:
    """Parts joined by colons."""
    return F.concat_ws(":", *parts)


#: Forms of scope keys: the pattern that takes one apart and the names of its parts.
SCOPES = {
    "item": (r"^item:([^:]+):(.+)$", ("marketplace", "item_id")), "cert": (r"^cert:(.+)$", ("cert",)), "population": (r"^population:(.+)$", ("spec_id",)),
    "sales_page": (r"^sales:([^:]+):grade=([^:]*):qualifier=([^:]*):page=(\d+)$", ("spec_id", "grade", "qualifier", "page")), "set": (r"^([a-z]{2}):set:(.+)$", ("language", "set_id")), "card": (r"^([a-z]{2}):card:(.+)$", ("language", "card_id")),
    "card_image": (r"^([^:]+):image:card:(.+):([^:]+):([^:]+)$", ("language", "card_id", "quality", "format")), "set_image": (r"^([^:]+):image:set:(.+):(logo|symbol):([^:]+):([^:]+)$", ("language", "set_id", "kind", "quality", "format")),
}


def scope_parts(key: Column, kind: str) -> Column:
    """Struct of a scope key's parts; null where it is of another kind."""
    pattern, names = SCOPES[kind]
    return F.when(key.rlike(pattern), F.struct(*(F.regexp_extract(key, pattern, i).alias(n) for i, n in enumerate(names, 1))))


def search_scope(marketplace: Column, query: Column, offset: Column, limit: int, most: int = 0, live: bool = False, day: Column | None = None, low: Column | None = None, high: Column | None = None) -> Column:
    """Key of a page of search results; a price range and the day it was made for belong to it."""
    mode = "mode=live_auctions" if live else "buying=all"
    none = F.lit(None).cast("string")
    low, high = none if low is None else low.cast("string"), none if high is None else high.cast("string")
    price = F.when(low.isNotNull() | high.isNotNull(), F.concat(F.lit("price="), F.coalesce(low, F.lit("0")), F.lit("-"), F.coalesce(high, F.lit("inf"))))
    asof = none if day is None else F.when(day.isNotNull(), F.concat(F.lit("asof="), F.date_format(day, "yyyy-MM-dd")))
    return F.concat_ws(":", F.lit("search"), marketplace, query, F.lit(mode), F.lit(f"limit={limit}"), F.lit(f"max={most or 'all'}"), F.concat(F.lit("offset="), offset.cast("string")), asof, price)


def same_set_name(page_title: Column, set_name: Column) -> Column:
    """Whether a page's title names a set: what stands in corner brackets, or before the bar, and the set's name are equal or one holds the other."""
    bracketed = F.regexp_extract(page_title, "「([^」]+)」", 1)
    core = F.when(bracketed != "", bracketed).otherwise(F.split(page_title, "｜")[0])
    plain = lambda x: F.regexp_replace(F.replace(F.regexp_replace(x, "[「」『』]", ""), F.lit("＆"), F.lit("&")), r"\s+", "")
    p, o = plain(core), plain(set_name)
    return F.coalesce(p.contains(o) | o.contains(p), F.lit(False))


def identity_drift(rows: DataFrame) -> DataFrame:
    """parsed, unparsed, drift of identity_rows(): a page none of whose rows is read has changed its form."""
    return rows.agg(F.count("spec_id").alias("parsed"), F.count_if(F.col("spec_id").isNull()).alias("unparsed"), (F.bool_and(F.col("spec_id").isNull())).alias("drift"))

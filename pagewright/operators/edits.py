"""Edits as overlays, page versions, history and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import ranked

LINE = ["doc_id", "page_no", "line_id"]


def overlay_text(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """Edited texts replace the recognised ones; an edited line has confidence 1."""
    own = edits.select(*LINE, F.col("text").alias("new_text"))
    changed = F.col("new_text").isNotNull()
    joined = lines.join(own, LINE, "left")
    return joined.select(*LINE, F.coalesce("new_text", "text").alias("text"), F.when(changed, F.lit(1.0)).otherwise(F.col("confidence").cast("double")).alias("confidence"), (changed | F.col("edited")).alias("edited"))


def current_results(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Results of the page's present version; those of earlier versions are stale."""
    return results.join(pages.select("doc_id", "page_no", "page_version"), ["doc_id", "page_no", "page_version"], "left_semi")


def remove_pages(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """Pages that stay, numbered from 1 without gaps."""
    rest = pages.join(removed.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")
    return rest.select("doc_id", "page_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page_no")).alias("new_page_no"))


def pages_to_process(pages: DataFrame, results: DataFrame) -> DataFrame:
    return pages.join(results.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")


def newest_history(history: DataFrame, keep: int = 500) -> DataFrame:
    """The newest entries. The limit is the feature; the sort is a top-k in each task, merged."""
    return history.orderBy(F.col("happened_at").desc(), F.col("entry_id").desc()).limit(keep)


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Names made valid and distinct: later ones of a name get the next number from 2 on, before the extension, that no name of the rows has already.

    In the last part of a path, characters that file systems forbid become "_".
    """
    place, last = F.regexp_extract(name, "^(.*[\\\\/])?([^\\\\/]*)$", 1), F.regexp_extract(name, "^(.*[\\\\/])?([^\\\\/]*)$", 2)
    clean = rows.withColumn("clean", F.concat(place, F.regexp_replace(last, '[<>:"|?*\\x00-\\x1f]', "_")))
    part = lambda k: F.regexp_extract("clean", "^(.*?)(\\.[A-Za-z0-9]+)?$", k)
    clean = clean.withColumn("stem", part(1)).withColumn("ext", part(2))
    numbered = clean.select(F.regexp_extract("stem", "^(.*) \\(([0-9]{1,9})\\)$", 1).alias("stem"), "ext", F.regexp_extract("stem", "^(.*) \\(([0-9]{1,9})\\)$", 2).alias("k")).where("k != ''")
    taken = numbered.groupBy("stem", "ext").agg(F.array_sort(F.collect_set(F.col("k").cast("bigint"))).alias("taken"))
    own = ranked(clean, ["clean"], [order], "n").join(taken, ["stem", "ext"], "left")
    free = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("n"), lambda k, t: F.when((t >= 2) & (t <= k), k + 1).otherwise(k))
    unique = F.when(F.col("n") == 1, F.col("clean")).otherwise(F.concat("stem", F.lit(" ("), free.cast("string"), F.lit(")"), "ext"))
    return own.withColumn("unique_name", unique)


BLOCK = ["doc_id", "page_no", "block_no"]


def restyle_blocks(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Blocks after edits (key, style): 0 paragraph, 1 to 3 heading of that level, 4 bullet, 5 numbered after the ordered items right before it. Tables and figures stay, as do blocks with another style."""
    w = W.partitionBy("doc_id", "page_no").orderBy("block_no")
    item = (F.col("kind") == "ListItem") & F.coalesce("ordered_list", F.lit(False))
    rows = blocks.select(*BLOCK, "kind", "heading_level", "list_marker", F.coalesce("ordered_list", F.lit(False)).alias("ordered_list")).withColumn("run", F.sum(F.when(item, 0).otherwise(1)).over(w)).withColumn("item", item)
    before = F.count_if("item").over(W.partitionBy("doc_id", "page_no", "run").orderBy("block_no").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("n", before).withColumn("n", F.when(F.col("item"), F.col("n")).otherwise(F.coalesce(F.lag("n").over(w), F.lit(0)) + 1))
    own = rows.join(edits.select(*BLOCK, F.col("style").alias("s")), BLOCK, "left")
    s, on = F.col("s"), F.col("s").between(0, 5) & ~F.col("kind").isin("Table", "Figure")
    pick = lambda new, old: F.when(on, new).otherwise(F.col(old))
    kind = F.when(s == 0, "Paragraph").when(s <= 3, "Heading").otherwise("ListItem")
    marker = F.when(s == 4, "•").when(s == 5, F.concat(F.col("n").cast("string"), F.lit(".")))
    return own.select(*BLOCK, pick(kind, "kind").alias("kind"), F.when(on & s.between(1, 3), s).otherwise(F.col("heading_level")).alias("heading_level"), pick(marker, "list_marker").alias("list_marker"), F.when(on & (s >= 4), s == 5).otherwise(F.col("ordered_list")).alias("ordered_list"))


def edit_styles(lines: DataFrame, blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Styles of lines after edits of a line (key, toggle_bold, toggle_italic, family, size): they hold for all lines of its block, but of a table for the line alone.

    A toggle turns the edited line's own value round and sets it on all. Sizes outside of 4 to 200 points and blank families change nothing.
    """
    style = lines.select(*LINE, F.coalesce("bold", F.lit(False)).alias("bold"), F.coalesce("italic", F.lit(False)).alias("italic"), F.col("size_pt").cast("double").alias("size_pt"), "family")
    home = blocks.where("kind not in ('Table', 'Figure')").select(*BLOCK, F.explode("line_ids").alias("line_id"))
    asked = edits.join(style.select(*LINE, "bold", "italic"), LINE).select(*LINE, *[F.when(F.col(f"toggle_{c}"), ~F.col(c)).alias(f"new_{c}") for c in ("bold", "italic")], F.when(F.col("size").between(4, 200), F.col("size")).alias("new_size"), F.when(F.col("family").rlike("\\S"), F.col("family")).alias("new_family"))
    news = ["new_bold", "new_italic", "new_size", "new_family"]
    spread = asked.join(home, LINE, "left")
    members = spread.where("block_no is not null").drop("line_id").join(home, BLOCK).select(*LINE, *news)
    every = members.unionByName(spread.where("block_no is null").select(*LINE, *news)).groupBy(*LINE).agg(*[F.max(c).alias(c) for c in news])
    out = style.join(every, LINE, "left")
    return out.select(*LINE, F.coalesce("new_bold", "bold").alias("bold"), F.coalesce("new_italic", "italic").alias("italic"), F.coalesce("new_size", "size_pt").alias("size_pt"), F.coalesce("new_family", "family").alias("family"))


def turn_and_crop(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """Pages after edits (key, turn in degrees, crop as fractions of what is seen): each change gives a new version without a result; a turn drops the crop, a crop lies in the one before."""
    key = ["doc_id", "page_no"]
    own = pages.select(*key, F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360)).alias("rotation"), "crop", "page_version").join(edits.select(*key, "turn", F.col("crop").alias("new")), key, "left")
    turned = F.coalesce(F.pmod(F.col("turn"), F.lit(360)) != 0, F.lit(False))
    base = F.when(~turned, F.col("crop"))
    part = lambda f, none: F.coalesce(base[f].cast("double"), F.lit(none))
    n = lambda f: F.col(f"new.{f}").cast("double")
    inner = F.struct((part("x", 0.0) + n("x") * part("w", 1.0)).alias("x"), (part("y", 0.0) + n("y") * part("h", 1.0)).alias("y"), (n("w") * part("w", 1.0)).alias("w"), (n("h") * part("h", 1.0)).alias("h"))
    kept = F.struct(*[base[f].cast("double").alias(f) for f in "xywh"])
    crop = F.when(F.col("new").isNotNull(), inner).when(base.isNotNull(), kept)
    changes = turned.cast("int") + F.col("new").isNotNull().cast("int")
    return own.select(*key, F.when(turned, F.pmod(F.col("rotation") + F.col("turn"), F.lit(360))).otherwise(F.col("rotation")).alias("rotation"), crop.alias("crop"), (F.col("page_version") + changes).alias("page_version"), (changes == 0).alias("result_kept"))


def document_counters(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, pages, recognised, all_recognised)."""
    done = results.select("doc_id", "page_no").distinct().withColumn("done", F.lit(True))
    own = pages.join(done, ["doc_id", "page_no"], "left")
    return own.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count("done").alias("recognised"), F.bool_and(F.col("done").isNotNull()).alias("all_recognised"))


def missing_files(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.where("path is not null").select("path").distinct().join(present.select("path"), "path", "left_anti")


def batch_totals(history: DataFrame) -> DataFrame:
    """Entries, pages and seconds of each output format; an entry counts once, negative times don't."""
    w = W.partitionBy("entry_id").orderBy("logged_at")
    one = history.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    fmt = F.regexp_replace(F.lower(F.trim("out_format")), "^\\.", "")
    ms = F.round(F.col("elapsed_s") * 100, 0).cast("bigint")
    return one.groupBy(F.coalesce(fmt, F.lit("?")).alias("format")).agg(F.count("*").alias("entries"), F.sum("page_count").cast("bigint").alias("pages"), F.sum(F.when(ms >= 0, ms)).alias("hundredths"), F.count_if(ms < 0).alias("bad_times"))

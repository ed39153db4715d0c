"""Page layout: words to lines, headings, section paths, boilerplate, section units; all as windows and joins.

Input tables: words(doc, page, text, x0, x1, top, bottom, size, bold), tables(doc, page, x0, top, x1, bottom, text).
Words may be held by page, pages(doc, page, words): they are then neither shuffled nor sorted one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values of the layout rules.
LINE_TOLERANCE, HEADING_WORDS, HEADING_RATIO, NUMBERED_RATIO, REPEAT_SHARE = 2.0, 12, 1.15, 1.05, 0.5
HEADING_NUMBER = r"^(\d+(?:\.\d+){0,5})\.?\s+\S"
DOT_LEADER = r"\.{4,}"
DECORATION = r"^[/\\|•·\s]+"
LEVELS = 6


def table_text(cells: Column) -> Column:
    """ARRAY<ARRAY<STRING>> -> rows with a filled cell, cells joined by ` | `."""
    clean = F.transform(cells, lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))))
    return F.array_join(F.transform(F.filter(clean, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")


def looks_tabular(cells: Column) -> Column:
    """Two rows and two columns at least, two rows with two filled cells, six filled cells in all."""
    filled = F.transform(cells, lambda r: F.size(F.filter(r, lambda c: strip(F.coalesce(c, F.lit(""))) != "")))
    width = F.coalesce(F.array_max(F.transform(cells, lambda r: F.size(r))), F.lit(0))
    return (F.size(cells) >= 2) & (width >= 2) & (F.size(F.filter(filled, lambda n: n >= 2)) >= 2) & (F.aggregate(filled, F.lit(0), lambda a, n: a + n) >= 6)


#: Fields of a page's words, in the order in which words are read.
WORD_FIELDS = ("top", "x0", "text", "x1", "bottom", "size", "bold")


def paged(words: DataFrame) -> DataFrame:
    """pages(doc, page, words) of words a row each; of pages as they are."""
    return words if "words" in words.columns else words.groupBy("doc", "page").agg(F.collect_list(F.struct(*WORD_FIELDS)).alias("words"))


def outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words whose centre lies in no table of their page: a range anti-join within (doc, page).

    Pages meet the boxes of their document where they are, by a hash of the boxes alone.
    """
    if "words" in words.columns:
        boxes = tables.groupBy("doc").agg(F.collect_list(F.struct("page", "x0", "x1", "top", "bottom")).alias("__boxes"))
        met = words.join(boxes.hint("shuffle_hash"), "doc", "left").withColumn("__boxes", F.filter("__boxes", lambda b: b["page"] == F.col("page")))
        inside = lambda w, b: ((w["x0"] + w["x1"]) / 2).between(b["x0"], b["x1"]) & ((w["top"] + w["bottom"]) / 2).between(b["top"], b["bottom"])
        left = F.filter("words", lambda w: ~F.coalesce(F.exists("__boxes", lambda b: F.coalesce(inside(w, b), F.lit(False))), F.lit(False)))
        return met.select("doc", "page", F.when(F.coalesce(F.size("__boxes"), F.lit(0)) > 0, left).otherwise(F.col("words")).alias("words"))
    t = tables.select(F.col("doc").alias("td"), F.col("page").alias("tp"), F.col("x0").alias("tx0"), F.col("x1").alias("tx1"), F.col("top").alias("tt"), F.col("bottom").alias("tb"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    return words.join(t, (F.col("doc") == F.col("td")) & (F.col("page") == F.col("tp")) & x.between(F.col("tx0"), F.col("tx1")) & y.between(F.col("tt"), F.col("tb")), "left_anti")


def group_lines(words: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """(doc, page, line, text, top, bottom, size, bold): a line ends where a word's top is over `tolerance` from the word before."""
    pages = paged(words).select("doc", "page", F.sort_array(F.transform("words", lambda w: F.struct(*(w[f].alias(f) for f in WORD_FIELDS)))).alias("w"))
    place = F.filter(F.transform("w", lambda w, i: i), lambda i: (i == 0) | F.coalesce(F.abs(F.get("w", i)["top"] - F.get("w", i - 1)["top"]) > tolerance, F.lit(False)))
    pages = pages.select("doc", "page", "w", place.alias("at"))
    lines = pages.select("doc", "page", F.posexplode(F.transform("at", lambda s, j: F.slice("w", s + 1, F.coalesce(F.get("at", j + 1), F.size("w")) - s))).alias("line", "l"))
    joined = F.array_join(F.transform(F.sort_array(F.transform("l", lambda w, i: F.struct(w["x0"].alias("x0"), i.alias("ord"), w["text"].alias("text")))), lambda x: x["text"]), " ")
    return lines.select("doc", "page", F.col("line").cast("long").alias("line"), joined.alias("text"), F.array_min("l.top").alias("top"), F.array_max("l.bottom").alias("bottom"), F.array_max("l.size").alias("size"), F.array_max("l.bold").alias("bold"))


def body_size(lines: DataFrame) -> DataFrame:
    """(doc, body_size): the commonest size to a tenth, the first seen of equals."""
    seen = lines.groupBy("doc", F.bround("size", 1).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "line")).alias("first"))
    w = Window.partitionBy("doc").orderBy(F.desc("n"), "first")
    return seen.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc", F.col("s").alias("body_size"))


def classify_headings(lines: DataFrame, ratio: float = HEADING_RATIO) -> DataFrame:
    """Add body_size, level (null: no heading) and title; lines are read once, the document's size by windows as body_size() has it."""
    of_size = Window.partitionBy("doc", "__s")
    df = lines.withColumn("__s", F.bround("size", 1)).withColumn("__n", F.count(F.lit(1)).over(of_size)).withColumn("__first", F.min(F.struct("page", "line")).over(of_size))
    df = df.withColumn("body_size", F.min(F.struct((-F.col("__n")).alias("n"), "__first", "__s")).over(Window.partitionBy("doc"))["__s"]).drop("__s", "__n", "__first")
    title = F.regexp_replace("text", DECORATION, "")
    short = F.size(F.filter(F.split(title, r"\s+"), lambda t: t != "")) <= HEADING_WORDS
    df = df.withColumn("__large", F.coalesce(F.col("bold") & (F.col("size") > F.col("body_size") * ratio) & short, F.lit(False)))
    df = df.withColumn("__rank", F.least(F.dense_rank().over(Window.partitionBy("doc", "__large").orderBy(F.desc("size"))), F.lit(4)))
    number = F.regexp_extract(title, HEADING_NUMBER, 1)
    numbered = (number != "") & (F.col("bold") | (F.col("size") > F.col("body_size") * NUMBERED_RATIO))
    level = F.when(F.col("text").rlike(DOT_LEADER), F.lit(None)).when(numbered, F.size(F.split(number, r"\."))).when(F.col("__large"), F.col("__rank"))
    return df.withColumn("level", level.cast("int")).withColumn("title", F.when(F.col("level").isNotNull(), strip(title))).drop("__large", "__rank")


def section_paths(lines: DataFrame, order: list[str]) -> DataFrame:
    """Add section_path and section_title: the titles of the open headings, as a stack keeps them, without a stack.

    A heading of a level is open if no heading of a lower level came after it.
    """
    w = Window.partitionBy("doc").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumn("__pos", F.row_number().over(Window.partitionBy("doc").orderBy(*order)))
    heads = [F.last(F.when(F.col("level") == k, F.struct(F.col("__pos").alias("p"), F.col("title").alias("t"))), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)]
    df = df.withColumns({f"__h{k + 1}": h for k, h in enumerate(heads)})
    opened = []
    for k in range(1, LEVELS + 1):
        lower = [F.coalesce(F.col(f"__h{j}.p"), F.lit(0)) for j in range(1, k)]
        after = F.greatest(F.lit(0), *lower) if lower else F.lit(0)
        opened.append(F.when(F.col(f"__h{k}.p") > after, F.col(f"__h{k}.t")))
    titles = F.array_compact(F.array(*opened))
    df = df.withColumn("section_path", F.array_join(titles, " > ")).withColumn("section_title", F.coalesce(F.try_element_at(titles, F.lit(-1)), F.lit("")))
    return df.drop("__pos", *(f"__h{k}" for k in range(1, LEVELS + 1)))


def signature(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\d+", "#")


def without_repeats(items: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", share: float = REPEAT_SHARE, least_pages: int = 1) -> DataFrame:
    """Rows whose digit-collapsed text isn't on max(2, round-half-even(pages * share)) pages of its document or more.

    Documents of fewer than least_pages pages keep all.
    """
    sig = items.withColumn("__sig", signature(F.col(text)))
    return sig.join(repeats(items, doc, page, text, share, least_pages).select(doc, F.col("signature").alias("__sig")), [doc, "__sig"], "left_anti").drop("__sig")


def without_repeats_within(items: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", share: float = REPEAT_SHARE, least_pages: int = 1) -> DataFrame:
    """without_repeats() where a document's rows lie together anyway, as for windows: items are read once and not shuffled by signature."""
    by_page = F.col(page).asc_nulls_last()
    own = lambda *by: F.max(F.when(F.col(page).isNotNull(), F.col("__p"))).over(Window.partitionBy(*by))
    df = items.withColumn("__sig", signature(F.col(text)))
    df = df.withColumn("__p", F.dense_rank().over(Window.partitionBy(doc, "__sig").orderBy(by_page))).withColumn("__n", own(doc, "__sig"))
    df = df.withColumn("__p", F.dense_rank().over(Window.partitionBy(doc).orderBy(by_page))).withColumn("__pages", own(doc))
    least = F.greatest(F.lit(2), F.bround(F.col("__pages") * share, 0).cast("int"))
    gone = F.col("__sig").isNotNull() & (F.col("__pages") >= least_pages) & (F.col("__n") >= least)
    return df.where(~F.coalesce(gone, F.lit(False))).drop("__sig", "__p", "__n", "__pages")


def repeats(items: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", share: float = REPEAT_SHARE, least_pages: int = 1) -> DataFrame:
    """(doc, signature, n_pages) of what without_repeats() takes out."""
    pages = items.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    seen = items.withColumn("signature", signature(F.col(text))).groupBy(doc, "signature").agg(F.countDistinct(page).alias("n_pages"))
    least = F.greatest(F.lit(2), F.bround(F.col("pages") * share, 0).cast("int"))
    return seen.join(pages, doc).where((F.col("pages") >= least_pages) & (F.col("n_pages") >= least)).select(doc, "signature", "n_pages")


def section_units(lines: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, unit, page, unit_type, text, section_path, section_title, table, table_title): prose between headings and tables, and each table.

    lines have level and title, with page, top; a heading or a table ends the prose before it. A unit's
    page is its first line's. A table's title is the last body line since a heading, or else the section's.
    """
    kind = lambda k: F.lit(k).alias("kind")  # noqa: E731  lines first where tops are equal
    both = lines.select("doc", "page", "top", kind(0), F.col("line").alias("ord"), "text", "level", "title").unionByName(
        tables.select("doc", "page", "top", kind(1), F.monotonically_increasing_id().alias("ord"), "text", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("title"))
    )
    order = ["page", "top", "kind", "ord"]
    df = section_paths(both, order)
    w = Window.partitionBy("doc").orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    is_break = F.col("level").isNotNull() | (F.col("kind") == 1)
    df = df.withColumn("unit", F.sum(is_break.cast("int")).over(so_far)).withColumn("pos", F.row_number().over(w))
    heading_at = F.max(F.when(F.col("level").isNotNull(), F.col("pos"))).over(so_far)
    body = F.last(F.when(F.col("level").isNull() & (F.col("kind") == 0), F.struct("pos", "text")), ignorenulls=True).over(so_far)
    df = df.withColumn("heading_at", F.coalesce(heading_at, F.lit(0))).withColumn("body", body)
    caption = F.when(F.col("body.pos") > F.col("heading_at"), F.col("body.text")).otherwise(F.col("section_title"))
    df = df.withColumn("table", F.sum("kind").over(so_far).cast("int"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    is_table = F.col("kind") == 1  # a table is the only one of its unit
    made = df.withColumn("caption", caption).where("kind = 1 or level is null").groupBy("doc", "unit", "kind").agg(
        F.min("pos").alias("pos"), F.min_by("page", "pos").alias("page"), joined.alias("joined"), F.min_by("text", "pos").alias("first"), F.min_by("section_path", "pos").alias("section_path"),
        F.min_by("section_title", "pos").alias("section_title"), F.min_by("table", "pos").alias("table"), F.min_by("caption", "pos").alias("caption"),
    )
    units = made.select(
        "doc", "pos", "page", F.when(is_table, "table").otherwise("section_text").alias("unit_type"), F.when(is_table, F.col("first")).otherwise(F.col("joined")).alias("text"),
        "section_path", "section_title", F.when(is_table, F.col("table")).alias("table"), F.when(is_table, F.col("caption")).alias("table_title"), "kind",
    )
    units = units.where((F.col("kind") == 1) | (strip(F.col("text")) != "")).drop("kind")
    return units.withColumn("unit", F.row_number().over(Window.partitionBy("doc").orderBy("pos"))).drop("pos")

"""Ordered segments, greedy packing into parents and children, and overlap.

Packing is a fold: whether a segment opens a group depends on all before it.  What it has to
know of them is small, though: the size of the open group, up to the target.  A book is
cut into blocks of segments; of each block it is worked out where each size on entry leads,
these tables are put together along the book, and then every block is folded on its own.
Only places and sizes of segments take part; texts are joined to the outcome once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import passing, stored
from ..functions.text import content_type, lines, normalize_search, numbered_id, sentences, sorted_pages, strip, token_count

PIECE_LIMIT = 260
PARENT_TARGET, PARENT_MAX = 700, 950
CHILD_TARGET, CHILD_MAX = 240, 320
OVERLAP = 40
#: Segments of a book that one task folds at a time.
BLOCK = 4096


def bind(rows: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    """``rows`` with computed columns that later expressions refer to without computing them again.

    A generator of one row: unlike a projection, it is not merged into what follows.
    """
    return rows.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def split_long_paragraphs(rows: DataFrame, keep: list[str], text: str, limit: int = PIECE_LIMIT) -> DataFrame:
    """(keep, piece, text): paragraphs in pieces of at most ``limit`` tokens, of whole sentences if there are several, else of words."""
    line = F.col(text)
    # so many tokens need twice as many characters: most lines need not be counted
    rows = bind(rows, [*keep, text], _parts=F.when((F.length(line) >= 2 * limit) & (token_count(line) > limit), sentences(line)))
    by_words = F.size("_parts") <= 1
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    rows = bind(rows, [*keep, text], _units=F.when(by_words, words).otherwise(F.col("_parts")), _least=F.when(by_words, 1).otherwise(0))
    weighed = F.transform("_units", lambda u: F.struct(u.alias("t"), F.greatest(token_count(u), F.col("_least")).alias("w")))
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, u: Column) -> Column:
        full = (s["n"] > 0) & (s["size"] + u["w"] > limit)
        added = F.struct(
            (s["size"] + u["w"]).alias("size"),
            (s["n"] + 1).alias("n"),
            F.when(s["n"] == 0, u["t"]).otherwise(F.concat(s["cur"], F.lit(" "), u["t"])).alias("cur"),
            s["out"].alias("out"),
        )
        opened = F.struct(u["w"].alias("size"), F.lit(1).alias("n"), u["t"].alias("cur"), F.concat(s["out"], F.array(s["cur"])).alias("out"))
        return F.when(full, opened).otherwise(added)

    def finish(s: Column) -> Column:
        return F.when(s["n"] > 0, F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"])

    pieces = F.when(F.col("_units").isNull(), F.array(line)).otherwise(F.aggregate(weighed, start, step, finish))
    return rows.select(*keep, F.posexplode(pieces).alias("piece", text))


def page_segments(pages: DataFrame) -> DataFrame:
    """Pieces of paragraphs with at least two tokens, numbered within their book from 1.

    ``pages`` has book_id, pdf_page and display_text; further columns are carried along.
    """
    keep = [c for c in pages.columns if c != "display_text"]
    paras = pages.select(*keep, F.posexplode(lines(F.col("display_text"))).alias("para", "line"))
    paras = paras.withColumn("line", strip(F.col("line"))).filter("line <> ''")
    pieces = split_long_paragraphs(paras.withColumnRenamed("line", "text"), [*keep, "para"], "text")
    pieces = stored(bind(pieces, pieces.columns, tokens=token_count(F.col("text"))).filter("tokens >= 2"), "pieces")
    # numbered within pages, whose counts are added up along the book
    before = Window.partitionBy("book_id").orderBy("pdf_page").rowsBetween(Window.unboundedPreceding, -1)
    counts = pieces.groupBy("book_id", "pdf_page").agg(F.count("*").alias("n"))
    counts = counts.select(F.col("book_id").alias("_book"), F.col("pdf_page").alias("_page"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("book_id", "pdf_page").orderBy("para", "piece")
    rows = pieces.withColumn("_in_page", F.row_number().over(order))
    rows = rows.join(counts, F.col("book_id").eqNullSafe(F.col("_book")) & F.col("pdf_page").eqNullSafe(F.col("_page")))
    return rows.withColumn("seg", (F.col("_before") + F.col("_in_page")).cast("int")).drop("_book", "_page", "_before", "_in_page")


def pack(sizes: Column, target: int, maximum: int) -> Column:
    """Group number (from 0) of each element of an array of sizes, in order."""
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("g"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        grown = s["size"] + x
        opens = (F.size(s["out"]) > 0) & (((s["size"] >= target) & (grown > target)) | (grown > maximum))
        g = F.when(opens, s["g"] + 1).otherwise(s["g"])
        return F.struct(F.when(opens, x).otherwise(grown).alias("size"), g.alias("g"), F.concat(s["out"], F.array(g)).alias("out"))

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def _leads(target: int, maximum: int):
    """Of each block and each size of the open group on entry, the size on leaving and the groups opened; sizes beyond
    the target act alike.  ``forced``: whether a group was opened by force, after which the entry doesn't matter."""

    def table(tokens, forced) -> tuple[list[int], list[int], int]:
        size, opened, since = np.arange(target + 1), np.zeros(target + 1, np.int64), -1
        for x, must in zip(tokens, forced):
            grown = size + x
            opens = np.full(len(size), must) | ((size >= target) & (grown > target)) | (grown > maximum)
            size, opened = np.where(opens, x, grown), opened + opens
            since = 1 if must else since + int(opens[0]) if since >= 0 else -1
            if len(size) > 1 and (size == size[0]).all():
                size = size[:1]  # from here on the entry makes no difference
        return np.minimum(np.broadcast_to(size, (target + 1,)), target).tolist(), opened.tolist(), since

    def run(groups):
        rows, key, tokens, forced = [], None, [], []
        for pdf in groups:
            for book, block, x, must in zip(pdf["book_id"], pdf["block"], pdf["tokens"], pdf["forced"]):
                if (book, block) != key:
                    if key is not None:
                        rows.append((*key, *table(tokens, forced)))
                    key, tokens, forced = (book, block), [], []
                tokens.append(x)
                forced.append(must)
            yield pd.DataFrame(rows, columns=["book_id", "block", "size", "opened", "since"])
            rows = []
        if key is not None:
            yield pd.DataFrame([(*key, *table(tokens, forced))], columns=["book_id", "block", "size", "opened", "since"])

    return run


def _entries(batches):
    """What a book's blocks are entered with, from the tables of its blocks in order."""
    book = None
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            if r.book_id != book:
                book, size, opened, since = r.book_id, 0, 0, 0
            rows.append((book, r.block, size, opened, since))
            # a book's first segment opens a group by force, so that size 0 on entry stands for no group as well
            opened, since = opened + r.opened[size], (r.since if r.since >= 0 else since + r.opened[size])
            size = r.size[size]
        yield pd.DataFrame(rows, columns=["book_id", "block", "in_size", "in_opened", "in_since"])


def _fold(target: int, maximum: int):
    """(book_id, seg, number, since, opens): groups opened in the book so far, and since the last one opened by force."""

    def run(batches):
        key, size, number, since = None, 0, 0, 0
        for pdf in batches:
            out = []
            for book, block, x, must, a, b, c in zip(*(pdf[k].tolist() for k in ("book_id", "block", "tokens", "forced", "in_size", "in_opened", "in_since"))):
                if (book, block) != key:
                    key, size, number, since = (book, block), a, b, c
                grown = size + x
                opens = must or (size >= target and grown > target) or grown > maximum
                if opens:
                    size, number, since = x, number + 1, 1 if must else since + 1
                else:
                    size = grown
                out.append((number, since, opens))
            got = pd.DataFrame(out, columns=["number", "since", "opens"])
            yield pd.concat([pdf[["book_id", "seg"]], got], axis=1)

    return run


def folded(sizes: DataFrame, target: int, maximum: int, block: int = BLOCK) -> DataFrame:
    """(book_id, seg, number, since, opens) of segments (book_id, seg, tokens, forced) of one token or more, numbered from 1 in each book.

    ``number`` counts the groups of the book from 1, ``since`` those since a segment that
    opens one by force.  Blocks of a book are folded by as many tasks.
    """
    rows = sizes.withColumn("block", F.floor((F.col("seg") - 1) / block).cast("int"))
    rows = stored(rows.select("book_id", "block", "seg", "tokens", (F.coalesce("forced", F.lit(False)) | (F.col("seg") == 1)).alias("forced")), "sizes")
    name = rows.schema["book_id"].dataType.simpleString()
    place = ["book_id", "block"]
    dealt = lambda df, *keys: df.repartition(*keys).sortWithinPartitions(*dict.fromkeys([*keys, *place, *(["seg"] if "seg" in df.columns else [])]))
    several = rows.filter(F.col("block") > 0).select("book_id").distinct()
    long = rows.join(several, "book_id", "left_semi")
    leads = dealt(long, *place).mapInPandas(_leads(target, maximum), f"book_id {name}, block int, size array<int>, opened array<long>, since long")
    entries = dealt(leads, "book_id").mapInPandas(_entries, f"book_id {name}, block int, in_size long, in_opened long, in_since long")
    entries = stored(entries, "entries")
    known = rows.join(entries, place, "left").fillna(0, ["in_size", "in_opened", "in_since"])
    return dealt(known, *place).mapInPandas(_fold(target, maximum), f"book_id {name}, seg int, number int, since int, opens boolean")


def _with(segments: DataFrame, more: DataFrame) -> DataFrame:
    """Segments and what is known of their places."""
    return segments.join(more, ["book_id", "seg"])


def with_parents(segments: DataFrame, target: int = PARENT_TARGET, maximum: int = PARENT_MAX, block: int = BLOCK) -> DataFrame:
    """Segments with ``parent_no``, counted from 1 in each book; a change of chapter opens a parent."""
    sizes = segments.select("book_id", "seg", "tokens", F.xxhash64(F.coalesce("chapter_id", F.lit("")), F.col("chapter_id").isNull()).alias("chapter"))
    sizes = sizes.withColumn("block", F.floor((F.col("seg") - 1) / block))
    last = sizes.filter(F.col("seg") % block == 0).select("book_id", (F.col("block") + 1).alias("block"), F.col("chapter").alias("last"))
    before = F.coalesce(F.lag("chapter").over(Window.partitionBy("book_id", "block").orderBy("seg")), F.col("last"))
    sizes = sizes.join(last, ["book_id", "block"], "left").withColumn("forced", F.col("chapter") != before)
    return _with(segments, folded(sizes, target, maximum, block).select("book_id", "seg", F.col("number").alias("parent_no")))


def with_children(segments: DataFrame, target: int = CHILD_TARGET, maximum: int = CHILD_MAX, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """Segments of parents with ``child_group`` (from 0 in each parent), ``child_no`` (from 1 in each book) and whether the
    next child of the parent ``repeats`` them.

    A child repeats whole segments from the end of the one before while their tokens fit into
    ``overlap``: a running sum from the end that only grows, so that it ends where the
    first does not fit.
    """
    sizes = segments.select("book_id", "seg", "tokens", "parent_no")
    top = sizes.groupBy("book_id", "parent_no").agg(F.min("seg").alias("seg")).withColumn("forced", F.lit(True))
    sizes = stored(sizes.join(top, ["book_id", "parent_no", "seg"], "left"), "parent-sizes")
    placed = folded(sizes, target, maximum, block).select("book_id", "seg", F.col("number").alias("child_no"), (F.col("since") - 1).alias("child_group"))
    placed = _with(sizes.select("book_id", "seg", "parent_no", "tokens"), placed)
    parent = Window.partitionBy("book_id", "parent_no")
    back = Window.partitionBy("book_id", "parent_no", "child_no").orderBy(F.col("seg").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_last", F.max("child_no").over(parent)).withColumn("_sum", F.sum("tokens").over(back))
    repeats = (F.col("_sum") <= overlap) & (F.col("child_no") < F.col("_last"))
    return _with(segments, placed.select("book_id", "seg", "child_no", "child_group", repeats.alias("repeats")))


def overlap_tails(children: DataFrame) -> DataFrame:
    """Segments that the next child of the same parent repeats, with that child's group."""
    return children.filter("repeats").withColumn("child_group", F.col("child_group") + 1)


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    first = lambda c: F.min_by(c, "seg").alias(c)
    heading = F.min_by("section_heading", F.when(F.coalesce(F.col("section_heading"), F.lit("")) != "", F.col("seg")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy(*keys).agg(
        *[first(c) for c in ("chapter_id", "chapter_title", "book_title", "source_file")],
        heading.alias("section_heading"),
        sorted_pages(F.collect_set("pdf_page")).alias("pdf_pages"),
        sorted_pages(F.collect_set("book_page")).alias("book_pages"),
        text.alias("text"),
        F.sum("tokens").cast("int").alias("token_count"),
    )


def parents(segments: DataFrame) -> DataFrame:
    """Parent rows of segments that carry ``parent_no``."""
    rows = _joined(segments, ["book_id", "parent_no"]).withColumn("parent_id", numbered_id(F.col("book_id"), "parent", F.col("parent_no")))
    return rows.withColumn("search_text", normalize_search(F.col("text"))).drop("section_heading")


def children(grouped: DataFrame) -> DataFrame:
    """Child rows of segments from ``with_children``: each child's own and those that it repeats."""
    members = F.when(F.col("repeats"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = grouped.withColumn("_later", F.explode(members)).withColumn("child_no", F.col("child_no") + F.col("_later"))
    rows = _joined(each, ["book_id", "parent_no", "child_no"])
    return rows.select(
        numbered_id(F.col("book_id"), "chunk", F.col("child_no")).alias("chunk_id"),
        numbered_id(F.col("book_id"), "parent", F.col("parent_no")).alias("parent_id"),
        "chapter_id", "chapter_title", "section_heading", "pdf_pages", "book_pages",
        content_type(F.col("text")).alias("content_type"),
        "text", normalize_search(F.col("text")).alias("search_text"), "token_count", "book_id", "book_title", "source_file",
    )


def build_chunks(
    pages: DataFrame, parent_target: int = PARENT_TARGET, parent_max: int = PARENT_MAX,
    child_target: int = CHILD_TARGET, child_max: int = CHILD_MAX, overlap: int = OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """Parents and children of ``pages``."""
    return chunks_of(stored_segments(pages, parent_target, parent_max), child_target, child_max, overlap)


def stored_segments(pages: DataFrame, parent_target: int = PARENT_TARGET, parent_max: int = PARENT_MAX) -> DataFrame:
    """Segments with ``parent_no``, stored: parents, children and their overlap all read them."""
    spark = pages.sparkSession
    with passing(spark) as keep:
        with passing(spark) as keep_segments:  # its pieces are not read again
            segments = keep_segments(stored(page_segments(pages), "segments"))
        return keep(stored(with_parents(segments, parent_target, parent_max), "grouped"))


def chunks_of(segments: DataFrame, child_target: int = CHILD_TARGET, child_max: int = CHILD_MAX, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """Parents and children of segments that carry ``parent_no``."""
    return parents(segments), children(with_children(segments, child_target, child_max, overlap))

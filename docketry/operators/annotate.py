"""Annotations: where citations and propositions stand on the pages, and their underlines.

words: brief_id, page_num, x0, y0, x1, y1, word, block_no, line_no, word_no.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions import text as T
from docketry.functions.constants import COLOURS


def locate_citations(blocks: DataFrame, cites: DataFrame) -> DataFrame:
    """brief_id, seq, page_num, rects: the first page, then the most specific term, that
    has the citation; all places of that hit. cites: brief_id, seq, text."""
    terms = cites.select("brief_id", "seq", F.posexplode(T.search_terms(F.col("text"))).alias("rank", "term"))
    hits = blocks.join(terms, "brief_id").where(F.contains(T.collapse(F.col("text")), F.col("term")))
    rect = F.struct("block_no", "x0", "y0", "x1", "y1")
    by = hits.groupBy("brief_id", "seq", "page_num", "rank").agg(F.array_sort(F.collect_list(rect)).alias("rects"))
    return by.groupBy("brief_id", "seq").agg(F.min(F.struct("page_num", "rank", "rects")).alias("hit")).select("brief_id", "seq", "hit.page_num", "hit.rects")


def preceding_words(words: DataFrame, places: DataFrame, gap: float = 2.0, line: float = 10.0) -> DataFrame:
    """Words of the sentence before a citation on its page, in reading order.
    places: brief_id, seq, page_num, cx, cy (left edge and top of the citation)."""
    met = words.join(places, ["brief_id", "page_num"]).where((F.col("y1") < F.col("cy") - gap) | ((F.abs(F.col("y0") - F.col("cy")) < line) & (F.col("x1") < F.col("cx"))))
    order = Window.partitionBy("brief_id", "seq").orderBy("y0", "x0", "word_no")
    ended = met.withColumn("_end", T.ends_sentence(F.col("word"), F.lead("word").over(order)) & F.lead("word").over(order).isNotNull())
    after = F.max(F.col("_end").cast("int")).over(order.rowsBetween(0, Window.unboundedFollowing))
    return ended.withColumn("_after", after).where("_after = 0").drop("_end", "_after")


def locate_chunks(blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """First block for each search chunk of a text: brief_id, text_id, chunk_no, page_num,
    x0, y0, x1, y1. texts: brief_id, text_id, text, start_page, end_page."""
    chunks = texts.select("brief_id", "text_id", "start_page", "end_page", F.posexplode(T.search_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    hits = blocks.join(chunks, "brief_id").where(F.col("page_num").between(F.col("start_page"), F.col("end_page")) & F.contains(T.collapse(F.col("text")), F.col("chunk")))
    first = F.min(F.struct("page_num", "block_no", "x0", "y0", "x1", "y1")).alias("hit")
    return hits.groupBy("brief_id", "text_id", "chunk_no").agg(first).select("brief_id", "text_id", "chunk_no", "hit.page_num", "hit.x0", "hit.y0", "hit.x1", "hit.y1")


def underlines(rects: DataFrame, width: float = 1.0) -> DataFrame:
    """One line below each rectangle, and a second one if it is signalled.
    rects: brief_id, page_num, x0, x1, y1, kind, signalled."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, c in COLOURS.items() for x in (k, c[i])]), F.col("kind"))
    offsets = F.when(F.col("signalled"), F.array(F.lit(1.0), F.lit(4.0))).otherwise(F.array(F.lit(1.0)))
    lines = rects.withColumn("_offset", F.explode(offsets))
    return lines.select("brief_id", "page_num", "x0", "x1", (F.col("y1") + F.col("_offset")).alias("y"), pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"), F.lit(width).alias("width"), "kind")


def write_annotated(files: DataFrame, lines: DataFrame, rewrite: Callable[[bytes, list[dict]], bytes], keep: tuple[int, int] | None = None) -> DataFrame:
    """brief_id, content: each file with its underlines drawn by a plug-in.

    files: brief_id, content. lines: as from `underlines`. The plug-in gets a file's bytes
    and its lines in page order. keep: first and last page whose lines are drawn.
    """
    if keep is not None:
        lines = lines.where(F.col("page_num").between(*keep))
    mark = F.struct("page_num", "y", "x0", "x1", "r", "g", "b", "width", "kind")
    held = lines.groupBy("brief_id").agg(F.array_sort(F.collect_list(mark)).alias("_lines"))
    both = files.select("brief_id", "content").join(held, "brief_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [rewrite(c, [dict(x) for x in (own if own is not None else [])]) for c, own in zip(batch["content"], batch["_lines"], strict=True)]
            yield pd.DataFrame({"brief_id": batch["brief_id"], "content": made})

    return both.mapInPandas(run, "brief_id string, content binary")

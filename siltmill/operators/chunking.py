"""Pages to sections, sections to overlapping word windows, duplicates folded, hits expanded to their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.functions.text import bound, norm_text, split_words

#: Fixed value: a heading line.
HEADING = r"^(#{1,4})\s+(.*)$"
#: What ends a line of a page text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def sections(text: Column) -> Column:
    """The sections of a page as an array of (s, heading_path, body), in order.

    A heading of level n replaces the path from its n-th place on; a skipped level leaves no gap, so headings of one
    level may nest. Sections with a blank body are left out, their headings stay on the path. Everything happens
    within the row, without a shuffle: only the headings are folded, bodies are slices of the lines between them.
    """
    return bound(F.split(F.coalesce(text, F.lit("")), LINE_END), _sections)


def _sections(lines: Column) -> Column:
    marks = F.transform(lines, lambda x, i: F.when(x.rlike(HEADING), F.struct(i.alias("at"), x.alias("line"))))
    heads = F.filter(marks, lambda x: x.isNotNull())
    paths = "array<struct<at:int,path:array<string>>>"
    start = F.array(F.struct(F.lit(-1).alias("at"), F.array().cast("array<string>").alias("path"))).cast(paths)

    def step(acc: Column, h: Column) -> Column:
        before = F.element_at(acc, -1)["path"]
        level = F.length(F.regexp_extract(h["line"], HEADING, 1))
        path = F.concat(F.slice(before, F.lit(1), F.least(F.size(before), level - 1)), F.array(F.trim(F.regexp_extract(h["line"], HEADING, 2))))
        return F.concat(acc, F.array(F.struct(h["at"].alias("at"), path.alias("path")))).cast(paths)

    def cut(opened: Column) -> Column:
        def body(x: Column, i: Column) -> Column:
            end = F.coalesce(F.get(opened, i + 1)["at"], F.size(lines))
            own = F.slice(lines, x["at"] + 2, end - x["at"] - 1)
            return F.struct(F.array_join(x["path"], " > ").alias("heading_path"), F.trim(F.array_join(own, "\n")).alias("body"))

        return F.transform(opened, body)

    kept = F.filter(bound(F.aggregate(heads, start, step), cut), lambda x: x["body"].rlike(r"[^\s\p{Z}]"))
    return F.transform(kept, lambda x, i: F.struct(i.alias("s"), x["heading_path"].alias("heading_path"), x["body"].alias("body")))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """The first word (from 0) of each window over n words: a window starts where the one before didn't reach the end."""
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be less than the window size")
    all_ = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1, F.lit(step))
    return F.filter(all_, lambda st: (st < n) & ((st == 0) | (st - step + size < n)))


def windows(words: Column, size: int = 180, overlap: int = 30) -> Column:
    """An array of (start, piece)."""

    def cut(w: Column) -> Column:
        piece = lambda st: F.array_join(F.slice(w, st + 1, F.lit(size)), " ")
        return F.transform(window_starts(F.size(w), size, overlap), lambda st: F.struct(st.alias("start"), piece(st).alias("piece")))

    return bound(words, cut)


def page_sections(pages: DataFrame, key: str, text: str) -> DataFrame:
    """All columns but the text, and s, heading_path, body: a row for each section."""
    return pages.select("*", F.explode(sections(F.col(text))).alias("_s")).drop(text).select("*", "_s.*").drop("_s")


def page_chunks(
    pages: DataFrame, key: str, content_hash: str, title: str, text: str, size: int = 180, overlap: int = 30, add_heading_path: bool = True
) -> DataFrame:
    """Chunks of pages: id, text, n (place in the page), s, start, n_words, heading_path and the page's other columns.

    ``id`` is ``{key}_{content hash}_{n}``; the text begins with ``title | heading`` where headings are added. The
    numbering is done on the page's own array, so pages are not shuffled.
    """
    per_section = F.transform(
        sections(F.col(text)),
        lambda x: F.transform(
            windows(split_words(x["body"]), size, overlap),
            lambda w: F.struct(x["s"].alias("s"), x["heading_path"].alias("heading_path"), w["start"].alias("start"), w["piece"].alias("piece")),
        ),
    )
    rows = pages.select("*", F.posexplode(F.flatten(per_section)).alias("n", "_c")).drop(text)
    head = F.concat(F.coalesce(F.col(title), F.lit("")), F.when(F.col("_c.heading_path") != "", F.concat(F.lit(" | "), F.col("_c.heading_path"))).otherwise(""))
    body = F.concat(head, F.lit("\n"), F.col("_c.piece")) if add_heading_path else F.col("_c.piece")
    return rows.select(
        "*",
        F.concat_ws("_", F.col(key), F.col(content_hash), F.col("n").cast("string")).alias("id"),
        body.alias("text"),
        F.col("_c.s").alias("s"),
        F.col("_c.start").alias("start"),
        F.col("_c.heading_path").alias("heading_path"),
        F.size(F.split(F.col("_c.piece"), " ")).alias("n_words"),
    ).drop("_c")


def section_index(pages: DataFrame, key: str, content_hash: str, title: str, text: str, url: str, size: int = 180, overlap: int = 30) -> DataFrame:
    """(id, section, head, words, start, n_words): the section that each chunk was cut from, and where it starts in it."""
    at = page_chunks(pages.select(key, content_hash, title, url, text), key, content_hash, title, text, size, overlap).select(
        "id", key, content_hash, "s", "start", "n_words", F.concat_ws("#", F.col(url), F.col("s").cast("string")).alias("section"),
        F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" | "), F.col("heading_path")).alias("head"),
    )
    bodies = page_sections(pages.select(key, content_hash, text), key, text).select(key, content_hash, "s", split_words(F.col("body")).alias("words"))
    return at.join(bodies, [key, content_hash, "s"]).select("id", "section", "head", "words", "start", "n_words").dropDuplicates(["id"])


def fold_copies(chunks: DataFrame, text: str, url: str, order: list[str]) -> DataFrame:
    """The first chunk, by ``order``, of each normal text, with n_copies and also_urls (the others' urls, sorted).

    Copies meet on a hash of their text and are folded map-side. The urls of one text are gathered in its row, as the
    column asks for; ``copy_members`` has the same as a table, where a text has very many copies.
    """
    cols = [c for c in chunks.columns if c not in ("n_copies", "also_urls")]
    keyed = chunks.select(*cols).withColumn("_k", F.sha2(norm_text(F.col(text)), 256))
    best = keyed.groupBy("_k").agg(
        F.min_by(F.struct(*cols), F.struct(*order)).alias("_b"),
        F.count(F.lit(1)).cast("int").alias("n_copies"),
        F.collect_set(url).alias("_u"),
    )
    return best.select("_b.*", "n_copies", F.array_sort(F.array_except("_u", F.array(F.col(f"_b.{url}")))).alias("also_urls"))


def copy_members(chunks: DataFrame, text: str, id_: str, order: list[str]) -> DataFrame:
    """(id, first_id): each chunk with the first one, by ``order``, of its normal text. Nothing is gathered."""
    keyed = chunks.select(F.sha2(norm_text(F.col(text)), 256).alias("_k"), F.col(id_).alias("id"), F.struct(*order, id_).alias("_o"))
    first = keyed.groupBy("_k").agg(F.min_by("id", "_o").alias("first_id"))
    return keyed.select("_k", "id").distinct().join(first, "_k").select("id", "first_id")


def expanded_span(n_section: Column, start: Column, n_chunk: Column, cap: int) -> tuple[Column, Column]:
    """(first word, words) of a chunk's unit: the whole section up to ``cap`` words, else a window around the chunk."""
    first = start - F.floor((F.lit(cap) - n_chunk) / 2)
    inside = F.greatest(F.lit(0), F.least(first, n_section - cap))
    whole = n_section <= cap
    return F.when(whole, F.lit(0)).otherwise(inside).cast("int"), F.least(n_section, F.lit(cap)).cast("int")


def collapse_units(hits: DataFrame, question: str, unit: list[str], rank: str) -> DataFrame:
    """The best ranked hit of each unit and question, ranked anew; the old rank stays as chunk_rank."""
    best = Window.partitionBy(question, *unit).orderBy(rank)
    kept = hits.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n").withColumnRenamed(rank, "chunk_rank")
    return kept.withColumn(rank, F.row_number().over(Window.partitionBy(question).orderBy("chunk_rank")))

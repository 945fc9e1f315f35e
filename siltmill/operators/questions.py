"""Questions to searches, and the retrieval plan for a whole set of questions."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmill.functions.text import is_vague, question_parts
from siltmill.functions.urls import match_url, page_url
from siltmill.operators import ann, chunking, ranking, responses
from siltmill.runtime import cut

RERANKERS: dict[str, Callable[[Column, Column], Column]] = {"overlap": ranking.overlap_score}
#: The names that settings files use. Those that no run can do without; those of a run, and where they go; those of a collection.
REQUIRED = ("embedding_model", "chunk_size", "chunk_overlap")
RUN_SETTINGS = {
    "top_k_retrieve": "k", "bm25_k": "bm25_k", "reranker": "reranker", "dedupe_chunks": "dedupe", "split_queries": "split_queries", "subquery_filter": "subquery_filter", "fusion": "fusion",
    "expand_section": "expand", "expand_max_words": "expand_words", "search": "search", "chain_hops": "chain_hops", "chain_context_k": "chain_context_k", "query_prefix": "query_prefix",
    "split_method": "split_method", "route": "route", "chain_categories": "chain_categories", "llm_model": "model", "decompose_prompt": "decompose_prompt",
}
COLLECTION_SETTINGS = ("collection", "embedding_model", "chunking_method", "chunk_size", "chunk_overlap", "add_heading_path")


@dataclass(frozen=True)
class Settings:
    """What a retrieval run is configured by; the defaults are the plain ranking. ``k`` is the depth of each list."""

    k: int = 50
    bm25_k: int = 0
    reranker: str | None = None
    dedupe: bool = False
    split_queries: bool = False
    subquery_filter: bool = False
    fusion: str = "rrf"
    expand: bool = False
    expand_words: int = 450
    search: str = "hnsw"
    chain_hops: int = 1
    chain_context_k: int = 3
    collapse_pages: bool = False
    query_prefix: str = ""
    split_method: str = "rules"
    decompose_prompt: str = "v1"
    route: str = "none"
    chain_categories: tuple[str, ...] = ("multi-hop",)
    model: str = "gpt-5-mini"

    def __post_init__(self) -> None:
        if self.fusion not in ("rrf", "round_robin"):
            raise ValueError(f"unknown fusion {self.fusion}")
        if self.search not in ("hnsw", "exact"):
            raise ValueError(f"unknown search {self.search}")
        if self.split_method not in ("rules", "llm"):
            raise ValueError(f"unknown split {self.split_method}")
        if self.route not in ("none", "llm"):
            raise ValueError(f"unknown route {self.route}")
        if self.chain_hops not in (1, 2):
            raise ValueError("a chain has one or two hops")
        if self.bm25_k and self.search != "exact":
            raise ValueError("lexical candidates need the exact search")


def _value(text: str) -> object:
    """A value of a settings file: JSON where it reads as such, a list in brackets, else text."""
    word = text.strip()
    if word.lower() in ("null", "~", ""):
        return None
    try:
        return json.loads(word.lower() if word.lower() in ("true", "false") else word)
    except ValueError:
        if word.startswith("[") and word.endswith("]"):
            return [_value(x) for x in word[1:-1].split(",") if x.strip()]
        return word.strip("'\"")


def load_settings(path: str) -> tuple[str, dict, Settings]:
    """(collection, settings of the collection, settings of the run) of a file of ``name: value`` lines.

    The collection is named by the file unless it says otherwise. A missing required setting and an unknown one raise.
    """
    found: dict[str, object] = {}
    last = ""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        if bare.lstrip().startswith("- ") and last:
            found[last] = [*(found[last] or []), _value(bare.lstrip()[2:])]  # type: ignore[misc]
            continue
        name, _, value = bare.partition(":")
        last = name.strip()
        found[last] = _value(value)
    if lacking := [n for n in REQUIRED if n not in found]:
        raise ValueError(f"{path}: missing required settings {lacking}")
    if unknown := [n for n in found if n not in RUN_SETTINGS and n not in COLLECTION_SETTINGS]:
        raise ValueError(f"{path}: unknown settings {unknown}")
    run = {RUN_SETTINGS[n]: tuple(v) if isinstance(v, list) else v for n, v in found.items() if n in RUN_SETTINGS}
    own = {n: v for n, v in found.items() if n in COLLECTION_SETTINGS and n != "collection"} | {"dedupe_chunks": bool(found.get("dedupe_chunks", False))}
    return str(found.get("collection") or Path(path).stem), own, Settings(**run)  # type: ignore[arg-type]


def model_searches(items: DataFrame, item: str, question: str, cache: DataFrame, s: Settings) -> DataFrame:
    """(item, list_no, query): what a model's responses say is to be searched, one to four searches."""
    asked = items.withColumn("key", responses.request_key(s.model, "decompose", s.decompose_prompt, F.col(question)))
    return responses.answered(asked, cache).select(item, F.posexplode(responses.decomposed(F.col(question), F.col("response"))).alias("list_no", "query"))


def searches(items: DataFrame, item: str, question: str, split: bool = True, drop_vague: bool = False) -> DataFrame:
    """(item, list_no, query): what is searched for each question.

    A question that isn't compound is searched as it is. Without ``drop_vague`` the whole question comes first, then
    its parts; with it only the parts that say enough, or the question again if fewer than two do.
    """
    q = F.col(question)
    parts = question_parts(q) if split else F.array().cast("array<string>")
    if drop_vague:
        clear = F.filter(parts, lambda p: ~is_vague(p))
        chosen = F.when(F.size(clear) >= 2, clear).otherwise(F.array(q))
    else:
        chosen = F.concat(F.array(q), parts)
    return items.select(item, F.posexplode(chosen).alias("list_no", "query"))


def _ranked(q: DataFrame, item: str, chunks: DataFrame, s: Settings, tools: Tools) -> DataFrame:
    """(item, list_no, id, rank): the candidates of each search, reranked where the settings say so."""
    q = q.withColumn("q", F.concat_ws("\x1f", item, F.col("list_no").cast("string")))
    asked = q.select("q", tools.embed(F.concat(F.lit(s.query_prefix), "query")).alias("v")).filter(F.exists("v", lambda x: x != 0))
    vectors = chunks.select("id", tools.embed(F.col("text")).alias("v")) if tools.vectors is None else tools.vectors
    if s.search == "exact":
        found = ranking.exact_search(asked, "q", "v", vectors, "id", "v", s.k)
    else:
        found = ann.search(ann.build(vectors, "id", "v"), asked, "q", "v", s.k)
    found = found.withColumnRenamed("sim", "score")
    if s.bm25_k:
        found = ranking.pool(found, ranking.bm25(q, "q", "query", chunks, "id", "text", s.bm25_k), ["q"], "id")
    make, score = ranking.prepared(tools.scorer(s)) if s.reranker else (lambda text: text, None)
    found = found.join(q.select("q", item, "list_no", make(F.col("query")).alias("_query")), "q")
    if score:
        found = ranking.rerank(found.join(chunks.select("id", make(F.col("text")).alias("_text")), "id"), ["q"], score(F.col("_query"), F.col("_text")))
    return found.select(item, "list_no", "id", "rank")


def dated(hits: DataFrame, dates: DataFrame, url: str = "url") -> DataFrame:
    """Hits with ``date_modified_int`` of their page, null where it has none; ``dates`` is ``corpus.modified_dates``."""
    known = dates.select(F.col("url").alias("_m"), F.col("modified_int").alias("date_modified_int"))
    return hits.withColumn("_m", match_url(F.col(url))).join(known, "_m", "left").drop("_m")


def expanded(hits: DataFrame, item: str, chunks: DataFrame, sections: DataFrame, expand_words: int) -> DataFrame:
    """Hits with the text of their section, at most ``expand_words`` of it, one for each unit. A chunk without section stays."""
    rows = hits.join(chunks.select("id", F.col("text").alias("_t")), "id").join(sections.select("id", "section", "head", "words", "start", "n_words"), "id", "left")
    first, n = chunking.expanded_span(F.size("words"), F.col("start"), F.col("n_words"), expand_words)
    rows = rows.withColumns({"_f": first, "expanded_words": F.when(F.col("section").isNotNull(), n)})
    body = F.array_join(F.slice("words", F.col("_f") + 1, F.col("expanded_words")), " ")
    text = F.coalesce(F.trim(F.concat("head", F.lit("\n"), body)), F.col("_t"))
    unit = F.coalesce(F.concat("section", F.lit("["), F.col("_f").cast("string"), F.lit(":"), (F.col("_f") + F.col("expanded_words")).cast("string"), F.lit("]")), F.col("id"))
    return chunking.collapse_units(rows.select(item, "id", "rank", unit.alias("unit"), "expanded_words", text.alias("text")), item, ["unit"], "rank")


def chain_requests(items: DataFrame, item: str, question: str, hits: DataFrame, chunks: DataFrame, s: Settings, sections: DataFrame | None, model: str) -> DataFrame:
    """(item, user, key): what the model is asked for the second hop, from the first passages as it would see them."""
    if s.expand:
        seen = expanded(hits.filter(F.col("rank") <= 3 * s.chain_context_k), item, chunks, sections, s.expand_words)
    else:
        seen = hits.join(chunks.select("id", "text"), "id")
    context = responses.passages(seen, item, "rank", "text", s.chain_context_k)
    user = F.concat(F.lit("QUESTION:\n"), F.col(question), F.lit("\n\nPASSAGES FOUND SO FAR:\n"), F.coalesce("context", F.lit("")))
    return items.join(context, item, "left").select(item, user.alias("user")).withColumn("key", responses.request_key(model, "chain", "v1", F.col("user")))


def first_hop(items: DataFrame, item: str, question: str, chunks: DataFrame, s: Settings, tools: Tools | None = None, cache: DataFrame | None = None) -> DataFrame:
    """(item, id, rank): the fused lists of a question's searches; the list of a single search as it is."""
    if s.split_queries and s.split_method == "llm":
        q = cut(model_searches(items, item, question, cache, s))
    else:
        q = cut(searches(items, item, question, s.split_queries, s.subquery_filter))
    fuse = ranking.round_robin if s.fusion == "round_robin" else ranking.rrf
    out = fuse(_ranked(q, item, chunks, s, tools or Tools()), item, "list_no", "rank", "id", s.k + s.bm25_k)
    if s.fusion == "round_robin":
        out = out.withColumnRenamed("fused_rank", "rank")
    many = q.groupBy(item).agg((F.max("list_no") > 0).alias("_many"))
    return out.join(many, item).filter(~F.col("_many") | (F.col("rank") <= s.k)).select(item, "id", "rank")


@dataclass(frozen=True)
class Tools:
    """What a run works with: an embedder (``ranking.embedder`` makes one of any function), rerankers by name, and the
    vectors (id, v) of the chunks if they are there already. A stand-in without a model is the default."""

    embed: Callable[[Column], Column] = ranking.hashed_vector
    rerankers: dict[str, Callable[[Column, Column], Column]] | None = None
    vectors: DataFrame | None = None

    def scorer(self, s: Settings) -> Callable[[Column, Column], Column]:
        known = RERANKERS | (self.rerankers or {})
        if s.reranker not in known:
            raise ValueError(f"unknown reranker {s.reranker}")
        return known[s.reranker]


def routed(items: DataFrame, item: str, question: str, cache: DataFrame, s: Settings) -> DataFrame:
    """(item, category): where a router's responses send each question."""
    asked = items.withColumn("key", responses.request_key(s.model, "route", "v1", F.col(question)))
    return responses.answered(asked, cache).select(item, responses.route(F.col("response")).alias("category"))


def retrieve(
    items: DataFrame, item: str, question: str, chunks: DataFrame, k: int = 50, settings: Settings | None = None,
    sections: DataFrame | None = None, cache: DataFrame | None = None, tools: Tools | None = None,
) -> DataFrame:
    """(item, id, url, rank), and with ``expand`` unit, expanded_words, text: one plan for all questions; chunks has id, text, url.

    Copies folded, searches by rules or by a model's responses, a pool of dense and lexical candidates for each,
    reranking of the pool, fusion over a question's searches, a second hop for the questions that the route sends there,
    expansion to sections, collapse to pages: each as the settings say, with the embedder and rerankers of ``tools``. ``k`` hits of each question are left at the end, after hits of one unit or page have been collapsed.
    ``sections`` (``chunking.section_index``) is needed to expand, ``cache`` (key, response, seq) wherever a model is asked.
    """
    tools = tools or Tools()
    s = settings or Settings(split_queries=True, subquery_filter=True, fusion="round_robin", search="exact", bm25_k=50, reranker="overlap", collapse_pages=True)
    if s.expand and sections is None:
        raise ValueError("expansion needs the sections")
    if (s.chain_hops > 1 or (s.split_queries and s.split_method == "llm")) and cache is None:
        raise ValueError("a second hop and a model's split need a response table")
    if s.reranker:
        tools.scorer(s)
    chunks = chunks.select("id", "text", "url")
    if s.dedupe:
        chunks = cut(chunking.fold_copies(chunks, "text", "url", ["id"]).select("id", "text", "url"))
    hits = first_hop(items, item, question, chunks, s, tools, cache)
    if s.chain_hops > 1:
        hits = cut(hits)
        sent = items
        if s.route == "llm":
            way = routed(items, item, question, cache, s)
            sent = items.join(way.filter(responses.chains(F.col("category"), s.chain_hops, s.chain_categories)).select(item), item, "left_semi")
        asked = responses.answered(chain_requests(sent, item, question, hits, chunks, s, sections, s.model), cache)
        more = cut(asked.select(item, F.posexplode(responses.follow_up(F.col("response"))["queries"]).alias("list_no", "query")))
        led = more.select(item).distinct()
        chained = responses.chain_hop(hits.join(led, item, "left_semi"), _ranked(more, item, chunks, s, tools), item, "rank", "id", s.k)
        hits = chained.unionByName(hits.join(led, item, "left_anti"))
    extra = ["unit", "expanded_words", "text"] if s.expand else []
    if s.expand:
        hits = expanded(hits, item, chunks, sections, s.expand_words).drop("chunk_rank")
    page = F.when(F.col("url").isNull(), F.col("id")).otherwise(page_url(F.col("url")))
    hits = hits.join(chunks.select("id", "url", *([page.alias("_page")] if s.collapse_pages else [])), "id")  # a page is named once for each chunk
    if s.collapse_pages:
        hits = chunking.collapse_units(hits, item, ["_page"], "rank")
    return hits.filter(F.col("rank") <= k).select(item, "id", "url", "rank", *extra)

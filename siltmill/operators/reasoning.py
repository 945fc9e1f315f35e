"""Answering by a tree of sub-questions: leaves are searched and answered, parents combine their children's answers.

All trees are worked on at once, level by level from below, and within a level sibling by sibling, as a later sibling
may name the answers of earlier ones. The number of steps is that of levels, siblings and attempts, whatever the number
of trees; steps without open nodes are passed over. Answers come from a table of responses.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.operators import responses
from siltmill.operators.ranking import round_robin
from siltmill.runtime import cut

_NODE = ["tree", "node_id"]


@dataclass(frozen=True)
class Traversal:
    """``hits``: tree, id, rank, fused from all searches by turns. ``steps``: tree, list_no, query: the searches in order.

    ``answers``: tree, node_id, answer (null where there is none).
    """

    hits: DataFrame
    steps: DataFrame
    answers: DataFrame


def _answered(requests: DataFrame, cache: DataFrame, model: str, prompt: str, samples: int) -> DataFrame:
    """(tree, node_id, answer): the majority of the samples for each request (tree, node_id, user)."""
    asked = requests.select(*_NODE, "user", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    asked = asked.withColumn("key", responses.request_key(model, prompt, "v1", F.col("user"), F.col("sample")))
    said = responses.answered(asked, cache).select(*_NODE, "sample", F.get_json_object("response", "$.answer").alias("answer"))
    return responses.majority(said, _NODE, "answer", "sample")


def _with_siblings(nodes: DataFrame, solved: DataFrame | None, no: int) -> DataFrame:
    """Nodes with ``query``: their question, with the answers of earlier siblings put in where the parent is sequential."""
    if solved is None or no == 0:
        return nodes.withColumn("query", F.col("question"))
    told = solved.groupBy("tree", "parent_id").agg(F.map_from_entries(F.collect_list(F.struct("sibling_no", F.coalesce("answer", F.lit("unknown")).alias("a")))).alias("_told"))
    joined = nodes.join(told, ["tree", "parent_id"], "left")
    put: Column = F.col("question")
    for i in range(no):
        put = F.replace(put, F.lit(f"[answer {i + 1}]"), F.coalesce(F.element_at("_told", F.lit(i)), F.lit("unknown")))
    return joined.withColumn("query", F.when(F.col("sequential"), put).otherwise(F.col("question"))).drop("_told")


def traverse(
    nodes: DataFrame, search: Callable[[DataFrame], DataFrame], cache: DataFrame, model: str, k: int, answer_k: int = 3, rewrites: int = 3, samples: int = 1,
    context: Callable[[DataFrame], DataFrame] = lambda hits: hits,
) -> Traversal:
    """Solves all trees of ``nodes`` (``responses.tree_nodes``).

    ``search`` takes (tree, node_id, query) and gives (tree, node_id, id, rank, text). A leaf is answered from its first
    ``answer_k`` passages, as ``context`` shows them; without an answer its query is reworded, up to ``rewrites`` times.
    A parent with an unanswered child is searched like a leaf itself, else its children's answers are combined.
    """
    parents = nodes.select("tree", F.col("node_id").alias("parent_id"), (F.col("pattern") == "sequential").alias("sequential"))
    nodes = cut(nodes.join(parents, ["tree", "parent_id"], "left"))
    solved: list[DataFrame] = []
    lists: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in (2, 1, 0):
        level: list[DataFrame] = []
        for no in range(4 if depth else 1):
            own = _with_siblings(nodes.filter((F.col("depth") == depth) & (F.col("sibling_no") == no)), reduce(DataFrame.unionByName, level) if level else None, no)
            if below is not None:
                subs = F.array_sort(F.collect_list(F.struct("sibling_no", F.concat(F.lit("- "), "question", F.lit(": "), F.coalesce("answer", F.lit(""))).alias("line"))))  # four at most
                kids = below.groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.bool_and(F.col("answer").isNotNull()).alias("all"), F.array_join(F.transform(subs, lambda x: x["line"]), "\n").alias("subs"))
                own = own.join(kids, _NODE, "left")
            else:
                own = own.withColumns({"all": F.lit(None).cast("boolean"), "subs": F.lit(None).cast("string")})
            own = cut(own)
            if own.isEmpty():
                continue
            combine = own.filter("all").select(*_NODE, F.concat(F.lit("QUESTION:\n"), "query", F.lit("\n\nSUB-ANSWERS:\n"), "subs").alias("user"))
            answers = [_answered(combine, cache, model, "rt_combine", samples)]
            open_ = own.filter("all is null or not all").select(*_NODE, "query")
            for attempt in range(rewrites + 1):
                open_ = cut(open_)
                if open_.isEmpty():
                    break
                hits = cut(search(open_))
                lists.append(hits.select(*_NODE, F.lit(attempt).alias("attempt"), "id", "rank").join(open_, _NODE))
                seen = responses.passages(context(hits).withColumn("node", F.struct(*_NODE)), "node", "rank", "text", answer_k).select("node.*", "context")
                user = F.concat(F.lit("QUESTION:\n"), "query", F.lit("\n\nPASSAGES:\n"), F.coalesce("context", F.lit("")))
                said = cut(_answered(open_.join(seen, _NODE, "left").select(*_NODE, user.alias("user")), cache, model, "rt_answer", samples))
                answers.append(said if attempt == rewrites else said.filter("answer is not null"))
                if attempt < rewrites:
                    failed = open_.join(said.filter("answer is null").select(*_NODE), _NODE)
                    reword = F.concat("query", F.lit(f"\n(rewrite #{attempt + 1})"))
                    asked = responses.answered(failed.withColumn("key", responses.request_key(model, "rt_rewrite", "v1", reword)), cache)
                    open_ = asked.select(*_NODE, F.trim(F.coalesce(F.nullif(F.get_json_object("response", "$.query"), F.lit("")), "query")).alias("query"))
            found = reduce(DataFrame.unionByName, answers)
            level.append(cut(own.join(found, _NODE, "left").select(*_NODE, "parent_id", "sibling_no", F.col("query").alias("question"), "answer")))
        if level:
            below = reduce(DataFrame.unionByName, level)
            solved.append(below)
    searched = cut(reduce(DataFrame.unionByName, lists))
    # From below, children before their parent: a dot sorts before a tilde.
    turn = Window.partitionBy("tree").orderBy(F.concat("node_id", F.lit("~")), "attempt")
    numbered = searched.withColumn("list_no", F.dense_rank().over(turn) - 1)
    fused = round_robin(numbered, "tree", "list_no", "rank", "id", k).select("tree", "id", F.col("fused_rank").alias("rank"))
    answers_ = reduce(DataFrame.unionByName, solved).select(*_NODE, "answer")
    return Traversal(fused, numbered.select("tree", "list_no", "query").distinct(), answers_)

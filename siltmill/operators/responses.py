"""Steps answered by an outside model, driven by a table of its responses.

A request's key is a hash of model, prompt name, prompt version, text and sample. Requests meet the response table in
a join; where one is missing the job fails before anything is written, as a run without it would be wrong. Calls
themselves are outside: ``missing`` gives what has to be asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.operators.categories import CATEGORIES
from siltmill.operators.ranking import round_robin

ROUTES = CATEGORIES
VERDICTS = ("correct", "partial", "incorrect")


def request_key(model: str, prompt: str, version: str, user: Column, sample: Column | int = 0) -> Column:
    sample = F.lit(sample) if isinstance(sample, int) else sample
    return F.sha2(F.to_json(F.array(F.lit(model), F.lit(prompt), F.lit(version), user, sample.cast("string"))), 256)


def latest_responses(cache: DataFrame) -> DataFrame:
    """(key, response): the last response of each key, by ``seq``."""
    return cache.groupBy("key").agg(F.max_by("response", "seq").alias("response"))


def missing(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct requests (key, user) without a response."""
    return requests.select("key", "user").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def answered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their response; the job fails where one has none."""
    joined = requests.join(latest_responses(cache), "key", "left")
    lost = F.raise_error(F.concat(F.lit("no response for request "), F.col("key"))).cast("string")
    return joined.withColumn("response", F.when(F.col("response").isNull(), lost).otherwise(F.col("response")))


def captured(requests: DataFrame, cache: DataFrame, stage: str) -> DataFrame:
    """Requests with their response, or with ``error`` (stage, message) where there is none: such rows are kept as failed."""
    joined = requests.join(latest_responses(cache), "key", "left")
    error = F.struct(F.lit(stage).alias("stage"), F.concat(F.lit("no response for request "), F.col("key")).alias("message"))
    return joined.withColumn("error", F.when(F.col("response").isNull(), error))


def follow_up(response: Column, limit: int = 2) -> Column:
    """(missing, queries): what a response says the passages lack, and at most ``limit`` searches for it."""
    return F.struct(F.coalesce(F.get_json_object(response, "$.missing"), F.lit("")).alias("missing"), clean_queries(response, limit=limit).alias("queries"))


def clean_queries(response: Column, field: str = "queries", limit: int = 4) -> Column:
    """The first searches that a response names: strings that aren't blank, trimmed. Anything else gives none."""
    values = F.from_json(F.get_json_object(response, f"$.{field}"), "array<variant>")
    texts = F.transform(F.filter(values, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.variant_get(x, "$", "string")))
    kept = F.filter(F.coalesce(texts, F.array().cast("array<string>")), lambda x: F.coalesce(x != "", F.lit(False)))
    return F.slice(kept, 1, limit)


def decomposed(question: Column, response: Column, limit: int = 4) -> Column:
    """A question's searches, the question itself if the response has none."""
    found = clean_queries(response, limit=limit)
    return F.when(F.size(found) > 0, found).otherwise(F.array(question))


def route(response: Column) -> Column:
    said = F.lower(F.trim(F.get_json_object(response, "$.category")))
    return F.when(said.isin(*ROUTES), said).otherwise("unknown")


def chains(category: Column, hops: int, chained: tuple[str, ...] | None) -> Column:
    """Whether a question takes a second hop: when hops allow it and, with routing, its category does."""
    if hops < 2:
        return F.lit(False)
    return F.lit(True) if chained is None else F.coalesce(category.isin(*chained), F.lit(False))


def passages(hits: DataFrame, question: str, rank: str, text: str, most: int) -> DataFrame:
    """(question, context): the first hits' texts, numbered, in order of rank. At most ``most`` for each question."""
    rows = hits.filter(F.col(rank) <= most)
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t"))))
    return rows.groupBy(question).agg(F.array_join(F.transform(listed, lambda x: F.concat(F.lit("["), x["r"].cast("string"), F.lit("] "), x["t"])), "\n\n").alias("context"))


def chain_hop(first: DataFrame, second: DataFrame, question: str, rank: str, id_: str, k: int) -> DataFrame:
    """The first hop's list and those of the follow-ups, by turns, the first hop leading. No follow-up: as it was."""
    lists = first.select(question, F.lit(0).alias("list_no"), rank, id_).unionByName(second.select(question, (F.col("list_no") + 1).alias("list_no"), rank, id_))
    return round_robin(lists, question, "list_no", rank, id_, k).select(question, id_, F.col("fused_rank").alias(rank))


def verdict(response: Column) -> Column:
    """The judge's verdict; the job fails on any other answer."""
    said = F.get_json_object(response, "$.verdict")
    return F.when(said.isin(*VERDICTS), said).otherwise(F.raise_error(F.concat(F.lit("no verdict in "), F.coalesce(response, F.lit("nothing")))).cast("string"))


def grounding(response: Column) -> Column:
    """(grounded, unsupported_claims) of a judge's answer."""
    return F.struct(
        F.get_json_object(response, "$.grounded").cast("boolean").alias("grounded"),
        F.coalesce(F.from_json(F.get_json_object(response, "$.unsupported_claims"), "array<string>"), F.array().cast("array<string>")).alias("unsupported_claims"),
    )


#: What a judge is told about a category, besides the general instruction.
JUDGE_RULES = {
    "conditional": "The conditions under which the answer holds belong to it; without them it is partial at best.",
    "unanswerable": "The sources have no answer. Declining, or pointing to who knows, is correct; invented details are incorrect.",
    "ambiguous": "The ambiguity has to be named or every case covered; choosing one case in silence is partial at best.",
    "temporal": "The rule in force now is what counts, not an earlier one.",
    "multi-hop": "All required facts have to be there; if one is missing, the answer is partial.",
}


def judge_request(category: Column, question: Column, gold: Column, quotes: Column, answer: Column, rules: dict[str, str] | None = None) -> Column:
    """What the judge of correctness is asked, with the rule of the item's category if it has one."""
    rule = F.lit(None).cast("string")
    for name, text in (JUDGE_RULES if rules is None else rules).items():
        rule = F.when(category == name, F.lit(f"\nCATEGORY RULE: {text}")).otherwise(rule)
    listed = F.array_join(F.transform(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: F.concat(F.lit("- "), F.coalesce(q, F.lit("")))), "\n")
    shown = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("CATEGORY: "), shown(category), shown(rule), F.lit("\n\nQUESTION: "), shown(question), F.lit("\n\nGOLD ANSWER: "), shown(gold),
        F.lit("\n\nGOLD QUOTES:\n"), F.when(listed == "", "(none)").otherwise(listed), F.lit("\n\nMODEL ANSWER:\n"), shown(answer),
    )


def sources(hits: DataFrame, question: str, rank: str, url: str, text: str, modified: str | None = None, most: int = 5) -> DataFrame:
    """(question, context): the first ``most`` hits as numbered sources for an answer, with url and date of change."""
    rows = hits.filter(F.col(rank) <= most)
    date = F.coalesce(F.col(modified).cast("string"), F.lit("unknown")) if modified else F.lit("unknown")
    block = F.concat(F.lit("["), F.col(rank).cast("string"), F.lit("] "), F.coalesce(url, F.lit("")), F.lit(" (modified "), date, F.lit(")\n"), F.coalesce(text, F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), block.alias("b"))))  # at most ``most``
    return rows.groupBy(question).agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("context"))


def majority(answers: DataFrame, by: list[str], answer: str, order: str) -> DataFrame:
    """(by, answer): the answer given most often, the earliest of equals, compared in lower case without outer dots and blanks.

    No answer, null or blank, counts as 'none'; where that is most often given, the result is null.
    """
    said = F.coalesce(F.nullif(F.trim(answer), F.lit("")), F.lit("None"))
    form = F.regexp_replace(F.lower(said), r"^[ .]+|[ .]+$", "")
    counted = answers.select(*by, form.alias("_n"), F.struct(F.col(order), said.alias("a")).alias("_f")).groupBy(*by, "_n").agg(F.count(F.lit(1)).alias("_c"), F.min("_f").alias("_f"))
    best = Window.partitionBy(*by).orderBy(F.desc("_c"), F.col("_f"))
    won = counted.withColumn("_r", F.row_number().over(best)).filter("_r = 1")
    return won.select(*by, F.when(F.col("_n") != "none", F.col("_f.a")).alias("answer"))


def tree_nodes(trees: DataFrame, tree: str, response: str, most_children: int = 4) -> DataFrame:
    """(tree, node_id, parent_id, sibling_no, depth, question, pattern): a reasoning tree's nodes, two levels below the root.

    Trees are JSON objects with ``question``, ``pattern`` and ``children``. Of a node's children the first
    ``most_children`` count, and of those the ones with a question; deeper levels are cut. A root without a question is
    no tree. ``pattern`` is direct for a node without children, and for one that names neither parallel nor sequential.
    """
    leaf = "struct<question:string>"
    kind = f"struct<question:string,pattern:string,children:array<struct<question:string,pattern:string,children:array<{leaf}>>>>"
    asked = lambda x: F.coalesce(F.trim(x["question"]) != "", F.lit(False))
    kept = lambda c, empty: F.filter(F.slice(F.coalesce(c, F.array().cast(empty)), 1, most_children), asked)
    root = trees.select(F.col(tree).alias("tree"), F.from_json(F.col(response), kind).alias("t")).filter(F.coalesce(F.trim("t.question") != "", F.lit(False)))
    inner = "array<struct<question:string,pattern:string,children:array<struct<question:string>>>>"
    clean = F.transform(kept(F.col("t.children"), inner), lambda x: F.struct(F.trim(x["question"]).alias("question"), x["pattern"].alias("pattern"), kept(x["children"], f"array<{leaf}>").alias("children")))
    root = root.select("tree", F.trim("t.question").alias("question"), F.col("t.pattern").alias("p"), clean.alias("c"))
    named = lambda p, n: F.when(p.isin("parallel", "sequential") & (n > 0), p).otherwise("direct").alias("pattern")
    node = lambda at, parent, no, depth, question, pattern: (at.alias("node_id"), parent.cast("string").alias("parent_id"), no.alias("sibling_no"), F.lit(depth).alias("depth"), question.alias("question"), pattern)
    own = root.select("tree", *node(F.lit("0"), F.lit(None), F.lit(0), 0, F.col("question"), named(F.col("p"), F.size("c"))))
    first = root.select("tree", F.posexplode("c").alias("i", "x"))
    at = F.concat(F.lit("0."), F.col("i").cast("string"))
    one = first.select("tree", *node(at, F.lit("0"), F.col("i"), 1, F.col("x.question"), named(F.col("x.pattern"), F.size("x.children"))))
    second = first.select("tree", "i", F.posexplode("x.children").alias("j", "y"))
    two = second.select("tree", *node(F.concat_ws(".", F.lit("0"), F.col("i").cast("string"), F.col("j").cast("string")), at, F.col("j"), 2, F.trim("y.question"), F.lit("direct").alias("pattern")))
    return own.unionByName(one).unionByName(two)


def tree_shapes(nodes: DataFrame) -> DataFrame:
    """(tree, depth, n_nodes, n_leaves)."""
    parents = nodes.filter("parent_id is not null").select("tree", F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(1))
    return nodes.join(parents, ["tree", "node_id"], "left").groupBy("tree").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("inner").isNull()).alias("n_leaves"))


def modal_tree(shapes: DataFrame, question: str, sample: str, most_leaves: int = 4) -> DataFrame:
    """(question, sample): among the trees with few enough leaves, the earliest of the most common shape.

    ``shapes`` carries the question and sample of each tree. A question without a valid tree has no row.
    """
    ok = shapes.filter(F.col("n_leaves") <= most_leaves)
    counted = ok.groupBy(question, "depth", "n_nodes").agg(F.count(F.lit(1)).alias("_c"), F.min(sample).alias(sample))
    best = Window.partitionBy(question).orderBy(F.desc("_c"), sample)
    return counted.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select(question, sample)

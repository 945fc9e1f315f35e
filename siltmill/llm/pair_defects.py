"""Defective question-answer pairs.

``defects`` gives each pair at most one defect: empty, copy, refusal, truncated, other_language, tried in this order.

Shortened answers are found by sorting all distinct answers by text, range-partitioned, and comparing neighbours: if
one answer begins with another, so does everything that sorts between them, so it is enough to compare each answer
with the next. A histogram of the lengths of all answers shows length limits as spikes. Either marks an answer as
truncated unless it closes with a sentence: a short answer with which a longer one begins is whole. An answer that
breaks off within a sentence is truncated even if nothing longer exists: its end is looked at last, by itself.

Another language is told by trigram profiles fitted on labelled texts; a language without labelled texts can't be told,
nor can that of a very short text.

Defined results: a null answer is empty; a null question cannot be copied and has no language; a null category is
answerable. Rows repeated in all used columns count once. Rows with the same key but other texts are judged each by
itself and may give a key several rows. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmill.llm import languages
from siltmill.runtime import cut

#: The closing notice of the pipeline, by its first words in each language, to the end of the line.
NOTICE = r"(?:^|\n)\s*(?:General guidance only|À titre indicatif|Solo orientativo|Nur zur Orientierung)[^\n]*\s*$"
CITATION = r"\s*\[\d+\]"
#: An ellipsis at the end, citations and closing marks aside.
ELLIPSIS = rf"""(?:…|\.{{3,}})(?:{CITATION}|[\s\p{{Pe}}\p{{Pf}}\p{{Pi}}"'*_`])*$"""
PLACEHOLDERS = ("n a", "na", "null", "none", "nil", "nan", "tbd", "todo", "undefined")
#: What a sentence says that declines.
REFUSAL = (
    r"(?i)\b(?:can(?:no|')t help|cannot help|(?:am|'m) (?:un|not )able to (?:answer|help|comment|assist)|must decline|decline to answer"
    r"|do(?:n't| not) have enough information|could(?:n't| not) find any(?:thing)?\b|none of the (?:passages|sources|excerpts)"
    r"|no mention of|won't guess|i do(?:n't| not) know|no answer can be given|outside of what i can|not be appropriate for me"
    r"|do not say anything|can't give an answer|say nothing"
    r"|pas en mesure de|n'ai rien trouvé|ne permettent pas de répondre|ne peux pas (?:répondre|aider|vous aider)|je ne sais pas|n'ai pas assez"
    r"|no puedo (?:ayudar|responder|contestar)|no permiten responder|no he encontrado nada|no dispongo de|no lo sé"
    r"|kann ich (?:diese frage |ihnen )?(?:dabei )?nicht (?:beantworten|helfen)|nichts gefunden|sagen dazu nichts|keine antwort|weiß ich nicht|nicht genügend)"
)
#: A gap admitted before something is said after all.
TURN = r"(?i)[,;]\s*(?:but|however|mais|cependant|pero|sin embargo|aber|doch|jedoch|allerdings)\b"
YES_NO = r"(?i)^(?:yes|no|oui|non|sí|si|ja|nein)\b"
#: What says nothing of a text's language: quotations, links, names of schools.
ASIDE = r"[“\"«„][^”\"»“]*[”\"»“]|https?://\S+|\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)* of \p{Lu}\p{L}+"


def answer_body(answer: Column) -> Column:
    """The answer without the closing notice and outer white space; null gives ''."""
    bare = F.regexp_replace(F.coalesce(answer, F.lit("")), NOTICE, "")
    return F.regexp_replace(bare, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", "")


def plain_words(text: Column) -> Column:
    """Words joined by blanks, with a blank at each end."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.concat(F.lit(" "), F.array_join(found, " "), F.lit(" "))


def _count(padded: Column) -> Column:
    return F.greatest(F.size(F.split(padded, " ")) - 2, F.lit(0))


def is_empty(body: Column) -> Column:
    said = F.trim(plain_words(F.regexp_replace(body, CITATION, "")))
    return (said == "") | said.isin(*PLACEHOLDERS)


def is_copy(question: Column, body: Column, most_lead: int = 8) -> Column:
    """Nothing but the question, or a part of it, perhaps several times, perhaps after a few words of lead-in."""
    q, b = plain_words(question), plain_words(F.regexp_replace(body, CITATION, ""))
    n = _count(q)
    rest = F.trim(F.replace(b, F.rtrim(q), F.lit("")))
    led = b.endswith(q) & (_count(F.concat(F.lit(" "), rest, F.lit(" "))) <= most_lead) & ~rest.rlike(YES_NO)
    part = (_count(b) >= 4) & (_count(b) >= 0.4 * n) & F.contains(q, b)
    return F.coalesce((n >= 2) & (led | part), F.lit(False))


def is_refusal(body: Column) -> Column:
    """Every sentence declines, and none turns to an answer."""
    bare = F.regexp_replace(F.regexp_replace(body, CITATION, ""), "’", "'")
    sentences = F.filter(F.split(bare, r"(?<=[.!?])\s+|\n+"), lambda s: s.rlike(r"[\p{L}\p{N}]"))
    return (F.size(sentences) > 0) & F.forall(sentences, lambda s: s.rlike(REFUSAL) & ~s.rlike(TURN))


def ending(body: Column) -> Column:
    """proper, unclear (a list item, a link: both ends are possible) or broken. A lone yes or no is whole, an ellipsis breaks off."""
    bare = F.regexp_replace(body, rf"(?:{CITATION})+\s*$", "")
    last = F.element_at(F.split(bare, "\n"), -1)
    item = last.rlike(r"^\s*(?:[-*•]|\d+[.)])\s+\S")
    link = bare.rlike(r"https?://\S+$")
    lone = bare.rlike(YES_NO) & (F.size(F.split(bare, r"\s+")) <= 3)
    return (
        F.when(body.rlike(ELLIPSIS), "broken")
        .when(bare.rlike(r"""[.!?。][\p{Pe}\p{Pf}\p{Pi}"'*_`]*$"""), "proper")
        .when(lone & ~bare.rlike(r"[\[(,:;-]$"), "proper")
        .when((item | link) & ~bare.rlike(r"[\[(,:;-]$"), "unclear")
        .otherwise("broken")
    )


def shortened(texts: DataFrame, least: int = 1) -> DataFrame:
    """(text): the texts of ``least`` characters or more with which another text begins.

    ``texts`` is one column of distinct texts. They are range-partitioned and sorted; each is compared with the next
    in one streaming pass. The last of a partition is compared with the first of the next one: a row for each
    partition.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pid = None, -1
        for pdf in batches:
            out = []
            for text, part in zip(pdf["text"], pdf["pid"], strict=True):
                if last is None:
                    out.append((part, "head", text))
                elif len(last) >= least and text.startswith(last):
                    out.append((part, "short", last))
                last, pid = text, part
            yield pd.DataFrame(out, columns=["pid", "kind", "text"])
        if last is not None:
            yield pd.DataFrame([(pid, "tail", last)], columns=["pid", "kind", "text"])

    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.select("text").repartitionByRange(parts, "text").sortWithinPartitions("text")
    found = cut(ordered.withColumn("pid", F.spark_partition_id()).mapInPandas(scan, "pid int, kind string, text string"))
    edges = found.filter("kind <> 'short'").withColumn("order", F.when(F.col("kind") == "head", 0).otherwise(1))
    after = F.lead("text").over(Window.orderBy("pid", "order"))  # two rows for each partition
    tails = edges.withColumn("after", after).filter("kind = 'tail'")
    tails = tails.filter((F.length("text") >= least) & F.startswith("after", "text"))
    return found.filter("kind = 'short'").select("text").unionByName(tails.select("text"))


def length_spikes(lengths: DataFrame, least: int = 20, times: float = 6.0, reach: int = 10) -> DataFrame:
    """(length): lengths that occur ``times`` as often as the lengths within ``reach`` of them do on average.

    ``lengths`` has one column. The histogram has a row for each length, not for each text.
    """
    n = lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    near = Window.orderBy("length").rangeBetween(-reach, reach)
    around = (F.sum("n").over(near) - F.col("n")) / (2 * reach)
    return n.withColumn("around", around).filter((F.col("n") >= least) & (F.col("n") >= times * F.col("around"))).select("length")


def defects(df: DataFrame, key: list[str], question: str, answer: str, category: str, labelled: DataFrame, declined_right: str = "unanswerable") -> DataFrame:
    """(key, defect) of the defective pairs. ``labelled`` has texts (text) with their language (lang), to tell languages by."""
    rows = df.select(*key, F.col(question).alias("_q"), F.col(answer).alias("_a"), F.col(category).alias("_c")).distinct()
    body = answer_body(F.col("_a"))
    rows = rows.select(*key, "_q", "_c", body.alias("_b"))
    q, b = F.col("_q"), F.col("_b")
    refusal = is_refusal(b)
    first = (
        F.when(is_empty(b), "empty")
        .when(is_copy(q, b), "copy")
        .when(refusal & F.coalesce(F.col("_c") == declined_right, F.lit(False)), "none")
        .when(refusal, "refusal")
    )
    judged = rows.withColumn("_d", first).withColumn("_e", F.when(F.col("_d").isNull(), ending(b)))
    stem = F.regexp_replace(b, rf"(?:{CITATION}|[\s.!?…])+$", "")
    judged = cut(judged.withColumn("_s", stem).withColumn("_l", F.length("_b")))
    open_ = judged.filter("_d is null")
    short = shortened(open_.select(F.col("_s").alias("text")).distinct()).withColumn("_short", F.lit(True))
    spikes = length_spikes(open_.select(F.col("_l").alias("length"))).withColumn("_spike", F.lit(True))
    unclear = open_.filter("_e <> 'proper'").join(short, F.col("_s") == F.col("text"), "left").join(spikes, F.col("_l") == F.col("length"), "left")
    cut_off = (F.col("_e") == "broken") | F.coalesce("_short", F.lit(False)) | F.coalesce("_spike", F.lit(False))
    told = unclear.select(*key, "_q", "_b", cut_off.alias("_cut")).unionByName(open_.filter("_e = 'proper'").select(*key, "_q", "_b", F.lit(False).alias("_cut")))
    tongue = languages.language(languages.fit(labelled, "text", "lang"))
    spoken = lambda c: tongue(F.regexp_replace(F.coalesce(c, F.lit("")), ASIDE, " "))
    foreign = F.coalesce(spoken(q) != spoken(b), F.lit(False))
    whole = told.filter("not _cut").select(*key, F.when(foreign, "other_language").alias("defect"))
    decided = judged.filter("_d is not null").select(*key, F.col("_d").alias("defect"))
    found = decided.unionByName(told.filter("_cut").select(*key, F.lit("truncated").alias("defect"))).unionByName(whole)
    return found.filter("defect <> 'none'").distinct()

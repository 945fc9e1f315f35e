"""Defects of question-answer pairs on small cases."""

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from siltmill.llm import languages
from siltmill.llm import pair_defects as pdx

Q = "Where do I renew form T 7917 at the help line?"
NOTE = "\n\nGeneral guidance only: read the linked pages before you act."
GOOD = "You can renew the form at the help line after the interview [1][3]. The office accepts it within 8 days."
CASES = [
    (Q, None, "x", "empty"),
    (Q, "  \n", "x", "empty"),
    (Q, "​", "x", "empty"),
    (Q, "N/A", "x", "empty"),
    (Q, "[1][2]", "x", "empty"),
    (Q, NOTE, "x", "empty"),
    (Q, "```\n```" + NOTE, "unanswerable", "empty"),
    (Q, Q, "x", "copy"),
    (Q, "**" + Q.upper() + "**" + NOTE, "x", "copy"),
    (Q, "On your question: " + Q, "x", "copy"),
    (Q, Q + " " + Q, "x", "copy"),
    (Q, Q + "\n" + GOOD, "x", None),
    (None, GOOD, "x", None),
    (Q, "I do not know [2].", "x", "refusal"),
    (Q, "I do not know" + NOTE, None, "refusal"),
    (Q, "I could not find anything about this. Sorry, I can't help with that request", "x", "refusal"),
    (Q, "I do not know.", "unanswerable", None),
    (Q, "I could not find the fee, but the form is renewed at the help line. You must send it before the interview.", "x", None),
    (Q, "I do not know the fee. " + GOOD, "x", None),
    (Q, "The office in Linaford accepts a", "x", "truncated"),
    (Q, GOOD + " You can send it before the [1][" + NOTE, "x", "truncated"),
    (Q, "You need:\n- passport copy\n-", "x", "truncated"),
    (Q, "You need the following before the interview:\n- passport copy\n- bank statement", "x", None),
    (Q, "See https://e.example/en/page-1", "x", None),
    (Q, "Yes.", "x", None),
    (Q, "Vous pouvez retirer la preuve au guichet avant votre arrivée. Le greffe accepte une demande sous 8 jours.", "x", "other_language"),
    ("Où dois-je certifier la copie du passeport, au guichet ou par la poste ?", "Sie können die Passkopie vor dem Umzug einreichen und nicht nach der Frist.", "x", "other_language"),
    (Q, "The page is called “Quién puede solicitarlo para la tarjeta”. You must send it before the interview.", "x", None),
    (Q, GOOD + " word" * 40_000 + ".", "x", None),
]


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet(str(DATA / "documents.parquet")).select("text", "lang")


def test_cases(spark, labelled):
    rows = [(f"r{i}", "k", q, a, c) for i, (q, a, c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows + rows[:5], "run string, id string, question string, answer string, category string").withColumn("text", F.lit(1)).withColumn("_x", F.lit(1))
    got = {r["run"]: r["defect"] for r in pdx.defects(df, ["run", "id"], "question", "answer", "category", labelled).collect()}
    want = {f"r{i}": d for i, (*_, d) in enumerate(CASES) if d}
    assert got == want


def test_empty_table(spark, labelled):
    df = spark.createDataFrame([], "run string, question string, answer string, category string")
    assert pdx.defects(df, ["run"], "question", "answer", "category", labelled).count() == 0


def test_shortened_across_partitions(spark):
    stem = "The office accepts the form within"
    rows = [stem + f" {i} weeks" + " and longer than the others" * (i % 2) for i in range(80)] + [stem, "zz", "zz top that is long enough to count"]
    rows += [stem + " 8", stem + " 8 w"]
    full = sorted(set(rows))
    want = {a for a in full if any(b != a and b.startswith(a) for b in full)}
    assert stem in want and len(want) == 4
    df = spark.createDataFrame([(r,) for r in full], "text string")
    got = [r["text"] for r in pdx.shortened(df).collect()]
    assert sorted(got) == sorted(want)


def test_length_spikes(spark):
    rows = [(n,) for n in list(range(50, 150)) * 2 + [100] * 60]
    assert [r[0] for r in pdx.length_spikes(spark.createDataFrame(rows, "length int")).collect()] == [100]


def test_answers_at_the_length_limit_are_truncated(spark, labelled):
    item = "You need this before the interview takes place at the office:\n- "
    rows = [(f"l{i}", "q", item + "passport"[: i % 8 + 1] + "x" * (40 - i % 8), None) for i in range(60)] + [(f"o{i}", "q", item + f"{i:02d}" + "y" * i, None) for i in range(1, 30)]
    got = {r["k"] for r in pdx.defects(spark.createDataFrame(rows, "k string, q string, a string, c string"), ["k"], "q", "a", "c", labelled).filter("defect = 'truncated'").collect()}
    assert got >= {f"l{i}" for i in range(60)} and len(got) <= 61


def test_answers_that_end_in_an_ellipsis_are_truncated(spark, labelled):
    ends = ["in…", "in ...", "in...", "in… [1][3]", "in ... [2]", "in…”", "in ...**", "in…" + NOTE, "in (the office ...)"]
    rows = [(f"e{i}", Q, GOOD + " Interviews take place " + e, None) for i, e in enumerate(ends)]
    rows += [("whole", Q, GOOD + " Wait… then send it.", None), ("bare", Q, "...", None), ("no", Q, "I do not know...", None)]
    got = {r["k"]: r["defect"] for r in pdx.defects(spark.createDataFrame(rows, "k string, q string, a string, c string"), ["k"], "q", "a", "c", labelled).collect()}
    assert got == {f"e{i}": "truncated" for i in range(len(ends))} | {"bare": "empty", "no": "refusal"}


def test_languages_are_told_by_their_trigrams(spark, labelled):
    p = languages.fit(labelled, "text", "lang")
    assert p.names == ("de", "en", "es", "fr") and languages.fit(labelled.limit(0), "text", "lang").names == ()
    held = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 200 and lang in ('de', 'en', 'es', 'fr')").withColumn("told", languages.language(p)(F.col("text")))
    right, wrong, none = held.agg(F.count_if(F.col("told") == F.col("lang")), F.count_if(F.col("told") != F.col("lang")), F.count_if(F.col("told").isNull())).first()
    assert right > 0.9 * (right + wrong + none) and none < 0.05 * right  # some labels are wrong
    short = spark.createDataFrame([("Yes.",), ("",), (None,), ("\n\n",), ("The office\nopens before the working day ends",)], "t string")
    assert [r[0] for r in short.select(languages.language(p)(F.col("t"))).collect()] == [None, None, None, None, "en"]
    none_known = languages.language(languages.fit(labelled.limit(0), "text", "lang"))
    assert {r[0] for r in short.select(none_known(F.col("t"))).collect()} == {None}

"""From a crawl folder to a collection, a scored run and its place in the ledger."""

import json

import pytest

from siltmill import __main__ as cli
from siltmill import runtime


@pytest.fixture
def crawl(tmp_path):
    text = tmp_path / "crawl" / "text"
    text.mkdir(parents=True)
    pages = {"k1": "# Permits\nA permit costs forty crowns and lasts two years.", "k2": "# Desks\nThe desk in Harton opens at nine on working days.", "k3": "# Fees\nFees are paid by card only."}
    rows = []
    for i, (k, t) in enumerate(pages.items()):
        (text / f"{k}.txt").write_text(t)
        rows.append({"seq": i, "url": f"https://e.org/{k}", "status": 200, "key": k, "content_hash": "h" + k, "title": k.upper()})
    (tmp_path / "crawl" / "manifest.jsonl").write_text("\n".join(map(json.dumps, rows)))
    gold = lambda k, q: [{"url": f"https://e.org/{k}", "content_hash": "h" + k, "quote": q}]
    items = [
        {"id": "a", "question": "what does a permit cost in crowns", "category": "single-fact", "gold_passages": gold("k1", "forty crowns ... two years")},
        {"id": "b", "question": "when does the desk open", "category": "temporal", "gold_passages": gold("k2", "opens at noon")},
        {"id": "c", "question": "where is the zoo", "category": "temporal", "gold_passages": gold("k9", "lions sleep")},
        {"id": "d", "question": "no gold", "category": "unanswerable", "gold_passages": []},
    ]
    (tmp_path / "items.jsonl").write_text("\n".join(map(json.dumps, items)))
    (tmp_path / "plain.yaml").write_text("embedding_model: hashed\nchunk_size: 20\nchunk_overlap: 5\nsearch: exact\nbm25_k: 5\ntop_k_retrieve: 5\n")
    return tmp_path


def test_index_eval_table_compare(spark, crawl):
    config, path = str(crawl / "plain.yaml"), str(crawl / "index")
    cli.index(spark, config, str(crawl / "crawl"), path)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        cli.index(spark, config, str(crawl / "crawl"), path)
    for change in ("first", "second"):
        record = cli.evaluate(spark, config, path, str(crawl / "items.jsonl"), str(crawl / "results"), str(crawl / "ledger"), change).first()
    assert record["n"] == 3 and round(record["hit5"], 4) == 0.3333 and (record["miss_0"], record["miss_a"], record["miss_b"], record["miss_c"]) == (1, 1, 0, 0)
    table = cli.runs_table(spark, str(crawl / "ledger")).collect()
    assert [r["change"] for r in table] == ["first", "second"] and [r["version"] for r in table] == ["v1", "v1"] and [r["best"] for r in table] == ["*", ""]
    results = sorted(str(p) for p in (crawl / "results").iterdir())
    assert {(r["id"] if "id" in r else r["item"], r["change"]) for r in cli.compare(spark, *results).collect()} == {("a", "unchanged"), ("b", "unchanged"), ("c", "unchanged")}
    (crawl / "plain.yaml").write_text("embedding_model: hashed\nchunk_size: 30\nchunk_overlap: 5\n")
    with pytest.raises(ValueError, match="other settings"):
        cli.evaluate(spark, config, path, str(crawl / "items.jsonl"), str(crawl / "results"), str(crawl / "ledger"), "third")


def test_written_tables_can_be_dropped(spark):
    df = runtime.cut(spark.range(5))
    assert df.count() == 5 and runtime.drop_cuts(spark) > 0
    with pytest.raises(Exception, match="exist"):
        runtime.cut(spark.range(1)).sparkSession.read.parquet(df.inputFiles()[0]).count()

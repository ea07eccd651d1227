"""The pipeline, stage by stage and as a whole, and what is registered."""
import ast
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline as C
from convkit.llm import catalog, decontaminate, near_dedup, stages
from llm_edge import SF001
from test_decontaminate import _sw
from test_near_dedup import _brute

ROOT = Path(__file__).resolve().parents[2]


def test_stage_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "bpe"]


def test_registered_queries():
    import __spark_entry__ as E
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(E.oracle_sql()) <= set(E.queries()) and set(catalog.ORACLE) == {"op8_licences", "op9_url_rules", "op10_rule_ledger", "op11_turn_repair", "op12_merkle"}


def test_stages_and_run(spark):
    docs = stages.documents(spark, SF001)
    columns, held = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stages.written(stage(spark, docs, SF001), f"test-{name}")
        assert docs.columns == columns
        held[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
        assert held[name][1].items() <= before.items()
    labels = {r["doc_id"]: r for r in stages.documents(spark, SF001, "labels").collect()}
    for name, column, bad in (("toxicity", "toxic", 1), ("quality", "quality", 0)):
        before, after = held[name]
        known = [i for i in before if i in labels]
        wrong = [i for i in known if (i in after) == (labels[i][column] == bad)]
        assert len(wrong) <= 0.05 * len(known), (name, wrong)
    before, after = held["near_dedup"]
    ids = sorted(before)
    assert set(after) == {min(ids[i] for i in g) for g in _brute([before[i] for i in ids])}
    before, after = held["decontamination"]
    words = lambda t: re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", (t or "").lower())
    grams = lambda w: {tuple(w[i:i + 3]) for i in range(max(1, len(w) - 2))}
    items = [words(r["text"]) for r in stages.documents(spark, SF001, "benchmark").collect()]
    for i in before:
        d = words(before[i])
        # texts that share five grams or more with an item are aligned by hand
        bad = any(len(grams(d) & grams(w)) >= 5 and _sw(w, d[:4000]) / (2 * len(w)) >= decontaminate.SIMILARITY for w in items)
        assert bad == (i not in after), i
    got = C.run(spark, SF001).collect()
    assert {r["doc_id"] for r in got} == set(held["decontamination"][1])
    want = {r["doc_id"]: tuple(r) for r in catalog.op7(spark, SF001).collect()}
    assert all(tuple(r) == want[r["doc_id"]] for r in got)


CLASH = ["toxic", "p_coded", "p_toxic", "score", "predicted", "_q", "_q_x", "n_words", "_key", "_row", "_id", "rid", "key", "class_id", "keep"]


def test_stages_keep_the_columns_of_documents(spark):
    """Extra columns with the names that stages use inside, null, empty and
    repeated rows, and rows without id: what stays, stays as it was."""
    own = stages.documents(spark, SF001).limit(60)
    text = "The quiet river runs past the old stone bridge. " * 8
    odd = [(None, "An unlabelled line of plain words that nobody has to fear at all."), (9001, None), (9002, ""), (9003, text), (9003, text), (9004, text + "End."),
           (None, None)]
    more = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "'odd' as source", "cast(0 as bigint) as n_chars")
    docs = own.unionByName(more)
    for c in CLASH:
        docs = docs.withColumn(c, F.concat(F.lit(c + "-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    docs = stages.written(docs, "test-clash")
    rows = Counter(map(tuple, docs.collect()))
    gone = {}
    for name, stage in C.STAGES[:-1]:
        out = stages.written(stage(spark, docs, SF001), f"test-clash-{name}")
        assert out.columns == docs.columns
        left = Counter(map(tuple, out.collect()))
        assert not left - rows, name
        gone[name], docs, rows = rows - left, out, left
    ids = [r[0] for r in gone["near_dedup"].elements()]
    assert 9003 in ids and not any(r[0] in (9001, 9002) for r in gone["toxicity"])
    last = C.STAGES[-1][1](spark, docs, SF001)
    assert last.count() == sum(rows.values()) and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_of_an_empty_table(spark):
    docs = stages.documents(spark, SF001).where("false").withColumn("toxic", F.lit("x"))
    for _, stage in C.STAGES:
        assert stage(spark, docs, SF001).count() == 0


def test_rest_does_not_import_this_package():
    for p in (ROOT / "convkit").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("convkit.llm") for n in names), p


def test_no_local_checkpoint():
    assert near_dedup.SIMILARITY == 0.8 and near_dedup.WORDS == 5
    for p in [*(ROOT / "convkit").rglob("*.py"), ROOT / "corpus_pipeline.py"]:
        assert "localCheckpoint" not in p.read_text()

"""The stages one after another against brute force."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from codesift.llm.queries import ORACLES, QUERIES

from . import brute
from .frames import document_rows, documents, with_clashes
from .test_documents import some


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_stages(spark, tmp_path):
    item = brute.prose(900, 40)
    rows = document_rows() + [(90, brute.prose(91, 60) + " " + item + " " + brute.prose(92, 60), "s1")]
    folder = str(tmp_path)
    with_clashes(documents(spark, rows)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for number, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        kept[name] = docs
        if number < 4:
            assert docs.columns == before.columns
    one = [(r["doc_id"], r["text"]) for r in kept["quality rules"].collect()]
    assert some(one) == some(r[:2] for r in rows if r[0] == 70 or brute.quality(r[1])["kept"])
    two = [(r["doc_id"], r["text"]) for r in kept["near-duplicates"].collect()]
    label = brute.components(one)
    assert some(two) == some({x for x, (d, _, c) in zip(one, label) if d == c})
    three = [(r["doc_id"], r["text"]) for r in kept["benchmark decontamination"].collect()]
    assert some(three) == some(x for x in two if x[0] != 90) and len(three) < len(two)
    copies = Counter((r["doc_id"], r["text"]) for r in kept["mixing"].collect())
    assert set(copies) <= set(three) and max(copies.values()) <= 2
    last = kept["sharding"].collect()
    assert Counter(r["doc_id"] for r in last) == Counter(d for d, _ in copies.elements())
    slots = defaultdict(list)
    for r in last:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert some(P.run(spark, folder).select("doc_id", "shard", "slot").collect()) == some((r["doc_id"], r["shard"], r["slot"]) for r in last)


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    documents(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert P.run(spark, folder).count() == 0

"""Each stage of the pipeline against a plain version of its decisions, on its own input."""

from __future__ import annotations

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import mixing, quality, secrets
from millrace.llm.queries import QUERIES
from millrace.llm.shared import documents, written

from . import plain
from .test_operators import check_pieces


def test_stages(spark, sf):
    docs = documents(spark, sf)
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf), name)
        after = docs.collect()
        if name == "quality":
            kept = {r.doc_id for r in quality.quality_rules(documents(spark, sf), model).filter("kept").collect()}
            for r in before:
                n = plain.quality_counts(r.text)
                assert r.doc_id not in kept or (n[0] >= 50 and 2 * n[4] <= n[0])
            assert sorted(after) == sorted(r for r in before if r.doc_id in kept)
        elif name == "near_dedup":
            sets = {r.doc_id: plain.shingles(r.text) for r in before}
            links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            comp = plain.components(sets, links)
            assert sorted(after) == sorted(r for r in before if comp[r.doc_id] == r.doc_id)
        elif name == "secrets":
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before)
            old = {r.doc_id: r for r in before}
            for r in after:
                assert not secrets.scan(r.text)[0]
                assert r == old[r.doc_id] or secrets.scan(old[r.doc_id].text)[1]
        elif name == "mixing":
            old, n = {r.doc_id: r for r in before}, Counter(r.doc_id for r in after)
            assert all(r == old[r.doc_id] for r in after)
            keyed = spark.createDataFrame(before).withColumn("doc_id", F.concat_ws(":", "doc_id", F.sha2("text", 256)))
            want = {int(r.doc_id.split(":")[0]): r.taken // max(r.size, 1) for r in mixing.mix_sources(keyed).collect()}
            assert all(n[i] == want[i] for i in old)
        else:
            assert check_pieces(after, [(r.doc_id, r.text) for r in before]) < 0.01
        if name != "packing":
            assert docs.columns == columns
        before = after


def test_rows_without_ids_and_repeats(spark, sf):
    docs = documents(spark, sf).limit(30)
    odd = docs.limit(2).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    docs = written(docs.unionByName(docs).unionByName(odd).unionByName(odd), "odd")
    kept = corpus_pipeline.near_dedup(spark, docs, sf)
    n = Counter(r.doc_id for r in kept.collect())
    assert n.pop(None) == 4 and set(n.values()) == {1}
    mixed = corpus_pipeline.mixing(spark, kept, sf)
    assert mixed.columns == docs.columns and mixed.count() > 0
    # three equal rows without an id come as often as the mix takes them together
    three = docs.filter("doc_id = 3").limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    some = written(docs.unionByName(three).unionByName(three).unionByName(three), "three")
    text = three.first().text
    keyed = some.withColumn("doc_id", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.sha2("text", 256)))
    taken = sum(r.taken // r.size for r in mixing.mix_sources(keyed).filter("size > 0").join(keyed.filter("text = '%s'" % text.replace("\\", "\\\\").replace("'", "\\'")).select("doc_id").distinct(), "doc_id", "left_semi").filter("doc_id like 'none%'").collect())
    assert sum(r.text == text and r.doc_id is None for r in corpus_pipeline.mixing(spark, some, sf).collect()) == taken
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_other_columns_nulls_and_texts_of_one_id(spark, sf):
    docs = documents(spark, sf).limit(40)
    names = ("_key", "_copies", "_t", "key", "block", "size", "h", "t", "copies", "rows", "at", "row", "u", "v", "spans", "component_id", "kept")
    more = spark.createDataFrame([(1, "other words of the same id " * 20 + " ".join(f"n{k}" for k in range(60)), "en", "src1", 9), (7001, None, "en", None, 0), (None, None, None, None, None), (7002, "", "en", "src1", 0)], docs.schema)
    docs = written(docs.unionByName(more).withColumns({c: F.lit(c) for c in names}), "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.filter(" or ".join(f"{c} <> '{c}'" for c in names)).count() == 0, name
        if name == "near_dedup":  # a different text of a kept id stays
            assert out.filter("doc_id = 1").count() == 2 and out.filter("doc_id is null").count() == 1
    assert corpus_pipeline.packing(spark, docs, sf).count() >= docs.count()


def test_few_tables_are_left(spark, sf):
    """What results still read stays until the driver ends, all else goes at once."""
    import os

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    most = {"op2_minhash_dedup": 2, "op4_substring_dedup": 1, "op5_run_length_index": 2, "op6_mixing": 3, "op7_html_extraction": 1, "op8_brown_scores": 2}
    for name, q in QUERIES.items():
        before = set(os.listdir(folder))
        q(spark, sf).write.format("noop").mode("overwrite").save()
        assert len({d for d in os.listdir(folder) if d.startswith("millrace-")} - before) <= most.get(name, 0), name


def test_every_query_runs_over_the_smallest_tables(spark, sf):
    found = defaultdict(int)
    for name, q in QUERIES.items():
        found[name] = q(spark, sf).count()
    assert all(found.values()) and len(found) == 10

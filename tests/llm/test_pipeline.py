import collections

import corpus_pipeline
from lotstack.llm import decontaminate, neardup, quality
from lotstack.plans.tables import materialize

SF = "/root/testdata/sf0.01"


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "packing"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = [set(texts)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
        assert kept[-1] < kept[-2]
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept[1] for d in good) / len(good) > 0.98
    assert sum(d in kept[1] for d, q in labels.items() if q == 0) / sum(q == 0 for q in labels.values()) < 0.1

    def shingles(text):
        w = text.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    first = {}
    for d in sorted(kept[1]):
        first.setdefault(texts[d], d)
    assert not {d for d in kept[1] if first[texts[d]] != d} & kept[2]
    sets = {d: shingles(texts[d]) for d in kept[2]}
    lists = collections.defaultdict(list)
    for d, own in sets.items():
        for s in own:
            lists[s].append(d)
    pairs = {(a, b) for own in lists.values() if len(own) < 50 for a in own for b in own if a < b}
    assert not [p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {d for d in kept[2] if any(i in texts[d] for i in items)} == kept[2] - kept[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == kept[3]
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == kept[3]
    assert neardup.PIPELINE_PERCENT == 80 and quality.THRESHOLD == 0.3 and decontaminate.LEAST_COVERED == 0.5


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(5, long, 1), (5, long, 2), (3, long + " more", 3), (None, "a b c d e f g", 4), (None, "a b c d e f g", 5), (7, None, 6), (8, "", 7), (8, None, 8), (5, "x y z and other words", 9)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, _ROW int").repartition(3), "docs")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((str(r.doc_id), r.text or "") for r in kept.collect())
    assert got == sorted([("3", long + " more"), ("None", "a b c d e f g"), ("7", ""), ("8", ""), ("8", ""), ("5", "x y z and other words")])
    assert corpus_pipeline.keep_one_of_each_group(spark, docs.limit(0), SF).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, SF).collect()
    assert len(packed) == 9 and sum(r.length == 1 for r in packed) == 3


def test_every_stage_keeps_columns_of_any_name(spark):
    import random

    rng = random.Random(1)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    source = spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()
    rows = [(r.doc_id if k % 7 else None, r.text if k % 11 else None, -5.0, k, f"q{k}", "x") for k, r in enumerate(source)]
    rows += [(9000 + k, f"{items[k]} and {rng.random()}", -5.0, 1000 + k, "b", "x") for k in range(5)] + [(None, "", -5.0, 2000, None, None), (1, " \t", None, 2001, None, None)]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string, score double, _row int, _quality string, component_id string"), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        before = {r._row: r for r in docs.collect()}
        after = {r._row: r for r in kept.collect()}
        assert all(before[k] == r for k, r in after.items()) and len(after) == kept.count()
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = materialize(kept, name)
    assert not set(range(1000, 1005)) & set(after)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(after)

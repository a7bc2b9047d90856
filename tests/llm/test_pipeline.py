from collections import Counter

import corpus_pipeline
from docketry.llm import decontaminate, mixing, nearcopies, pii, toxicity
from docketry.llm.common import load

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = load(spark, FOLDER, "documents")
    columns, counts = docs.columns, [docs.count()]
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4] and counts[-1] > 0
    deduplicated = spark.read.parquet(str(tmp_path / "near_dedup"))
    found = nearcopies.near_copies(deduplicated)
    assert found.where("doc_id <> component_id").count() == 0


def test_stages_equal_brute_force(spark):
    """Each row stage against its model or rule applied row by row on the driver; odd rows among them."""
    docs = load(spark, FOLDER, "documents")
    passage = load(spark, FOLDER, "benchmark").first()["text"]
    odd = spark.createDataFrame([(None, None, "en", None, 0), (None, "", "en", "src0", 0), (9001, f"so {passage} it", "en", "src1", 9), (9002, "mail a.b@c.example now", "en", None, 3), (9002, "mail a.b@c.example now", "en", None, 3)], docs.schema)
    docs = docs.unionAll(odd)
    rows = [r.asDict() for r in docs.collect()]
    texts = lambda frame: Counter((r["doc_id"], r["text"]) for r in frame.collect())

    model = toxicity.train(docs, load(spark, FOLDER, "labels"))
    automaton = model.automaton()
    assert texts(corpus_pipeline.toxicity_filter(spark, docs, FOLDER)) == Counter((r["doc_id"], r["text"]) for r in rows if model.score(r["text"], automaton) < 0.7)

    items = [decontaminate.shingles(r["text"]) for r in load(spark, FOLDER, "benchmark").collect()]
    held = lambda text: any(len(i & decontaminate.shingles(text)) >= 0.8 * len(i) for i in items if i)
    assert texts(corpus_pipeline.decontamination(spark, docs, FOLDER)) == Counter((r["doc_id"], r["text"]) for r in rows if not held(r["text"]))

    weights = pii.train(docs)
    found = pii.find([r["text"] or "" for r in rows], weights)
    want = Counter((r["doc_id"], None if r["text"] is None else pii.masked(r["text"], base + more)) for r, (base, more) in zip(rows, found, strict=True))
    masked = corpus_pipeline.personal_data(spark, docs, FOLDER)
    assert texts(masked) == want and masked.where("n_chars <> length(text)").count() == 0

    mixed = corpus_pipeline.source_mix(spark, docs, FOLDER).collect()
    sizes: Counter = Counter()
    for r in rows:
        sizes[r["source"]] += len((r["text"] or "").split(None))
    names = sorted(sizes, key=lambda s: (s is None, s))
    goal = dict(zip(names, mixing.targets([sizes[s] for s in names]), strict=True))
    largest = max(len((r["text"] or "").split()) for r in rows)
    for name in names:
        own = [r for r in mixed if r.source == name]
        assert abs(sum(r.taken for r in own) - goal[name]) <= max(1, largest // 4) and all(0 < r.taken <= 3 * r.size for r in own)

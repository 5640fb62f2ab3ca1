"""The pipeline's stages on the smallest tables and on odd rows."""

import collections

import corpus_pipeline
from tables import SF
from vellumspark.llm import decontamination, line_dedup, mixing, near_dups, toxicity


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dups", "decontamination", "mixing"]
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda frame: {r.doc_id for r in frame.collect()}
    assert ids(stages["toxicity"](spark, docs, SF)) == {i for i, t in texts.items() if scorer(t.encode()) < 0.3}
    gone = {r.doc_id: r.lines for r in line_dedup.removed_lines(docs).collect()}
    want = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in texts.items()}
    got = {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, SF).collect()}
    assert got == {i: t for i, t in want.items() if i not in gone or t.strip()}
    classes = collections.defaultdict(list)
    for r in near_dups.classes(docs).collect():
        classes[r.class_id].append(r.doc_id)
    assert ids(stages["near_dups"](spark, docs, SF)) == {min(x) for x in classes.values()}
    assert ids(stages["decontamination"](spark, docs, SF)) == set(texts) - ids(decontamination.find_matches(docs, benchmark))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    last = stages["mixing"](spark, docs, SF)
    assert last.columns[:5] == docs.columns and all(r.taken > 0 for r in last.collect())


def test_run_ends_with_fewer_clean_documents(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs, labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    # The stages one by one, each by what its operator says of all that came before.
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    rest = {r.doc_id: r.text for r in docs.collect() if scorer(r.text.encode()) < toxicity.THRESHOLD}
    frame = lambda texts: docs.drop("text").join(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id")
    gone = {r.doc_id: set(r.lines) for r in line_dedup.removed_lines(frame(rest)).collect()}
    cut = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rest.items()}
    rest = {i: t for i, t in cut.items() if t.strip() or i not in gone}
    classes = {r.doc_id: r.class_id for r in near_dups.classes(frame(rest)).collect()}
    rest = {i: t for i, t in rest.items() if classes[i] == i}
    found = {r.doc_id for r in decontamination.find_matches(frame(rest), benchmark).collect()}
    rest = {i: t for i, t in rest.items() if i not in found}
    taken = {r.doc_id: r.taken for r in mixing.mix(frame(rest)).collect() if r.taken}
    assert {r.doc_id: (r.text, r.taken) for r in out} == {i: (rest[i], n) for i, n in taken.items()} and len(out) == len(taken)


def test_stages_take_odd_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() > 0
        assert stage(spark, none, SF).count() == 0

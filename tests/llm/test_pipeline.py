"""The pipeline's stages against plain Python versions of them, and as a whole."""

import math

import corpus_pipeline
from shelfspark.llm import toxicity
from shelfspark.llm.common import documents, table
from test_llm_operators import edits, five_word_groups


def score_by_hand(text, model, seen_chunks):
    """The score of a text from the lexicon: every chunk against every term by its edit distance."""
    whole, stems = [t for t in model.terms if not t.endswith("*")], tuple(t[:-1] for t in model.terms if t.endswith("*"))

    def weigh(chunk):
        words = [chunk] if chunk.isalpha() else toxicity._LETTERS.findall(chunk)
        if any(w in whole or w.startswith(stems) for w in words if stems or w in whole):
            return 1.0, ""
        trimmed = toxicity._TRIM.sub("", chunk)
        near = []
        for w in {*words, *([trimmed] if words else [])}:
            close = [(e, t) for t in whole if len(t) >= 5 and abs(len(t) - len(w)) <= 1 and (e := edits(w, t)) <= 1] if len(w) >= 4 else []
            near += [(model.around.get(min(close)[1], 1.0) / (1 + model.seen.get(w, 0)), min(close)[1])] if close else []
        return max(near, default=None)

    words, total, near, inside = text.lower().split(), 0.0, {}, toxicity.quotations(text)
    for i, w in enumerate(words):
        if w not in seen_chunks:
            seen_chunks[w] = weigh(w)
        if seen_chunks[w]:
            weight, term = seen_chunks[w]
            quoted = i in inside or len(toxicity._QUOTES.findall(w)) >= 2 or toxicity.REPORTING & set(words[max(0, i - 6) : i])
            weight *= 0.35 if quoted else 1.25 if toxicity.ADDRESS & set(words[max(0, i - 6) : i + 7]) else 1.0
            if term:
                near[term] = max(near.get(term, 0.0), weight)
            else:
                total += weight
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * math.log1p(total + sum(near.values())))))


def test_stages(spark, sf_dir, tmp_path):
    docs = documents(spark, sf_dir)
    columns = docs.columns
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        step(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if i < 3:
            assert docs.columns == columns and docs.count() <= before.count() and docs.exceptAll(before).isEmpty()
            kept, rows = {r["doc_id"] for r in docs.collect()}, sorted((r["doc_id"], r["text"] or "") for r in before.collect())
        if name == "toxicity":
            model, chunks = toxicity.fit(before, table(spark, sf_dir, "labels")), {}
            assert kept == {d for d, t in rows if score_by_hand(t, model, chunks) < toxicity.THRESHOLD}
        if name == "near_duplicates":
            assert kept == {rows[k][0] for k in five_word_groups([t for _, t in rows])}
    pieces, texts = docs.collect(), dict(rows)
    assert {r["doc_id"] for r in pieces} == kept and sum(r["length"] for r in pieces) == sum({r["doc_id"]: r["doc_tokens"] for r in pieces}.values()) and texts


def test_run_on_nothing(spark, sf_dir, tmp_path):
    """Empty tables, and a few odd rows, pass through every stage."""
    kind = documents(spark, sf_dir).schema
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "word " * 60, "en", "s", 0), (1, "word " * 60, "en", "s", 0)]):
        docs = spark.createDataFrame(rows, kind)
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, docs, sf_dir)
            if "sequence_id" in out.columns:
                assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            else:
                assert out.columns == docs.columns and out.exceptAll(docs).isEmpty()
                docs = out


def test_near_duplicates_take_few_jobs(spark, sf_dir, tmp_path):
    """However few the rows, jobs are work of the driver: on a small table, components are found in one task, and only where a
    round has found a pair."""
    step = dict(corpus_pipeline.STAGES)["near_duplicates"]
    spark.sparkContext.setJobGroup("near-duplicates", "")
    try:
        step(spark, documents(spark, sf_dir), sf_dir).write.parquet(f"{tmp_path}/kept")
        assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-duplicates")) < 130
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

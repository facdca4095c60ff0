"""The stages one after another, each against a direct computation on its own input."""

import sentencepiece

import corpus_pipeline
from echolake.llm import simhash
from echolake.llm.common import stored
from echolake.llm.queries import _public
from tests.llm.test_decontaminate import containing
from tests.llm.test_personal import plain as personal_spans
from tests.llm.test_simhash import brute, plain as fingerprint

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "pieces"]
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        assert name == "pieces" or docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    toxic, near, clean, masked, ids = seen
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    calm = [i for i, t in labels.items() if t == 0]
    assert sum(i in toxic for i in calm) > 0.9 * len(calm)
    order = list(toxic)
    tops = brute(order, [fingerprint(toxic[i].text) for i in order])
    assert set(near) == {i for i, t in zip(order, tops) if i == t}
    sure, some = containing([(i, r.text or "") for i, r in near.items()], [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()])
    gone = set(near) - set(clean)
    assert gone <= {d for d, _ in some} and len(gone & {d for d, _ in sure}) >= 0.9 * len({d for d, _ in sure})
    assert set(masked) == set(clean)
    for i, r in masked.items():
        if not any(c in clean[i].text for c in "0123456789@"):
            assert r.text == clean[i].text
        assert personal_spans(r.text) == "" and r.n_chars == len(r.text)
    library = sentencepiece.SentencePieceProcessor(model_file=_public("piece_bpe_32k.model"))
    for i, r in ids.items():
        assert r.ids == library.encode(r.text) + [2] and r.decoded == r.text
    assert set(ids) == set(masked) and simhash.DISTANCE == 4


def test_empty_and_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "one two", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
        assert rows.count() <= 3

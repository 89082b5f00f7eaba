"""The pipeline against its stages in plain Python, on a fixture made here."""

import random

from test_op3_near import brute
from test_op7_decontamination import plain as hits
from test_op8_lines import plain as lines

import corpus_pipeline as P
from veilwright.llm import bpe
from veilwright.llm.quality_rules import quality_rules


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9)))
    item = " ".join(word() for _ in range(14))
    licence = "This line stands in many of the documents, as lines of a license do."
    docs = []
    for i in range(150):
        words = [word() for _ in range(rng.choice([20, 80, 150, 300]))]
        if i % 30 == 3:
            words = [w + "###" for w in words]
        text = " ".join(words)
        if i % 9 == 1:
            text += "\n" + licence
        if i % 20 == 5:
            text += " " + item
        docs.append((i, text))
    docs += [(200 + i, docs[i][1] + rng.choice(["", " more"])) for i in range(0, 60, 4)] + [(300, None), (301, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in quality_rules(frame, keep=["doc_id"]).filter("kept").collect()}
    assert not kept & {i for i, t in docs if len((t or "").split()) < 50 or "###" in t}
    now = [(i, t) for i, t in docs if i in kept]
    now = [(i, t) for i, _, _, t in lines(now)]
    one = {i for i, _, c in brute(now, 5) if i == c}
    now = [(i, t) for i, t in now if i in one]
    now = [(i, t) for i, t in now if not hits(t, [(1, item)])[1]]
    codec = bpe.Codec(bpe.vocabulary_path())
    got = {r.doc_id: r.n_tokens for r in P.run(spark, str(tmp_path)).collect()}
    assert got == {i: len(codec.encode(t)) for i, t in now}
    assert len(now) > 50


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b", None, "s", 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == P.COLUMNS
        out.count()
    assert P.STAGES[-1][1](spark, frame, str(tmp_path)).count() == 3

"""The pipeline against its stages' plain restatements."""

import hashlib

import brute

from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import bpe, common, exact_dedup, language_id, mixing, near_dedup

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = common.documents(spark, SF)
    rows = {r.doc_id: r.text for r in docs.collect()}
    und = {r.doc_id for r in language_id.identify(docs).where("lang_pred = 'und'").collect()}
    rows = {i: t for i, t in rows.items() if i not in und}
    exact = brute.exact_groups(rows.items())
    rows = {i: t for i, t in rows.items() if exact[i][0] == i}
    near = brute.near_components(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if near[i][1] == i}
    out = corpus_pipeline.run(spark, SF).collect()
    got = {r.doc_id: r.decoded_sha256 for r in out}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows.items()}
    # token ids as the library's, and the order of the mixture of the rows that are left
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    for r in out:
        ids = library.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
    left = docs.where(F.col("doc_id").isin(list(rows)))
    want = [r.doc_id for r in mixing.mixed(left).orderBy("mix_slot", "mix_row").collect()]
    assert [r.doc_id for r in sorted(out, key=lambda r: r.mix_place)] == want


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, docs, folder), name)
        assert after.columns == docs.columns and after.count() <= docs.count()
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_rows_without_own_id(spark):
    """A row that is dropped takes no other row of its id, or without an id, with it; of equal rows one stays."""
    import random

    rng = random.Random(7)
    text = [" ".join(f"w{c}x".translate(str.maketrans("0123456789", "abcdefghij")) for c in (rng.randrange(10**6) for _ in range(60))) for _ in range(5)]
    near = text[0].rsplit(" ", 1)[0] + " zebra"
    rows = [(1, text[0]), (None, text[0]), (None, text[1]), (None, near), (None, "12 34"), (None, None), (None, text[2]), (4, text[3]), (4, text[3]), (4, "56"), (5, text[4]), (5, near), (5, text[1] + " ")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    told = language_id.accepted(docs)
    assert sorted(t for t in (r.text for r in told.collect())) == sorted(t for _, t in rows if t and "w" in t)
    once = exact_dedup.deduplicated(docs.where("text like 'w%'"))
    assert sorted((r.doc_id or 0, r.text) for r in once.collect()) == sorted([(1, text[0]), (5, text[1] + " "), (5, near), (0, text[2]), (4, text[3]), (5, text[4])])
    left = near_dedup.without_near_copies(docs.where("text like 'w%'"))
    want = sorted([(1, text[0]), (5, text[1] + " "), (0, text[2]), (4, text[3]), (5, text[4])])
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == want
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = common.stored(stage(spark, docs, ""), "stage")
    assert sorted((r.doc_id or 0, r.text) for r in docs.collect()) == want

"""Blocks, features, decisions and metrics on small literal tables."""

import pytest
from pyspark.sql import functions as F

from kinweave.functions import similarity as S
from kinweave.functions import text as X
from kinweave.operators import blocking, candidates, decision, dense, features, forensics, metrics, model, validate
from kinweave.plans import resolve as R
from kinweave.sources import entities

COLUMNS = entities.ENTITY_COLUMNS
S1 = [
    ("S1-101", "Celestial Memorial Trust", "No. 35 Brentwood Apartments, Bangalore", "India"), ("S1-102", "Strategic Praetorian", "702 N Street, Washington, DC", "US"),
    ("S1-103", "ZNB Club", "5 bis Rue Pierre Dignac, Bordeaux", "France"), ("S1-104", "Unique Lone Entity Inc", "123 Remote Road, Alaska", "US"),
]
TARGETS = [
    ("S2-201", "Celestial Memorial", "35 Brentwood Apartments, Bangalore", "India"), ("S2-202", "Strategic Praetorian Inc", "N St, Washington, DC", "US"),
    ("S2-203", "ZNB Club SARL", "5 bis Rue Pierre Dignac, Bordeaux", "France"), ("S2-204", "Strategic Praetorian", "10 MG Road, Bangalore", "India"),
    ("S3-301", "Celestial Memorial Private Limited", "Bangalore, Karnataka", "India"),
]


@pytest.fixture(scope="module")
def sides(spark):
    return tuple(X.normalized(spark.createDataFrame(rows, COLUMNS)).persist() for rows in (S1, TARGETS))


def found(hits):
    return {(r.block, r.source1_entity_id, r.candidate_entity_id) for r in hits.collect()}


def test_blocks(sides):
    got = found(blocking.research_hits(*sides, ["exact_name", "name_core", "char_3gram_k5"]))
    assert ("exact_name", "S1-102", "S2-204") not in got  # another country
    assert ("name_core", "S1-102", "S2-202") in got and ("name_core", "S1-103", "S2-203") in got
    assert ("char_3gram_k5", "S1-101", "S2-201") in got


def test_extended_blocks(spark):
    q = [("S1-1", "Valley Coalition", "9628 Laurel Lane, Scottsdale, AZ", "US"), ("S1-2", "Fortune Precision High Inc", "1659 N Temple Street, Salt Lake City, UT", "US"), ("S1-3", "Bay Charities LP", "362 Scott Street, Hubbard, OH", "US")]
    t = [("S2-1", "The Valley Coalition", "Scottsdale", "US"), ("S2-2", "Fortuneprecisionhigh.com", "1659 1/2 N Temple St, Salt Lake City", "US"), ("S2-3", "Fayekor t/a Bay Charities LP", "362 Scott Street, Hubbard", "US")]
    q, t = (X.normalized(spark.createDataFrame(x, COLUMNS)) for x in (q, t))
    got = found(blocking.research_hits(q, t, ["name_core_v2", "name_web_norm", "house_token"]))
    assert {("name_core_v2", "S1-1", "S2-1"), ("name_web_norm", "S1-2", "S2-2"), ("house_token", "S1-3", "S2-3")} <= got
    assert blocking.research_hits(q, t.limit(0), ["name_core_v2", "rare_token"]).count() == 0


def test_pruning_and_caps(spark):
    rows = [(f"S2-{i:04}", "common " + ("rare" if i < 3 else f"name{i}"), "", "US") for i in range(400)]
    t = X.normalized(spark.createDataFrame(rows, COLUMNS))
    keys = {r.key: r["count"] for r in blocking.postings(t, [blocking.RESEARCH["name_token"]]).groupBy("key").count().collect()}
    assert "common" not in keys and "rare" not in keys  # over 0.5 % of 400
    q = X.normalized(spark.createDataFrame([("S1-1", "common x", "", "US")], COLUMNS))
    assert blocking.fast_hits(q, t, ["rare_token"]).count() == 40


def test_ranking_order(spark):
    hits = spark.createDataFrame([("S1-1", c, c[:2], b, 1) for c, b in [("S2-9", "exact_name"), ("S2-10", "exact_name"), ("S3-1", "exact_name"), ("S2-5", "name_core"), ("S2-5", "house_name")]], "source1_entity_id string, candidate_entity_id string, source string, block string, place int")
    order = [r.candidate_entity_id for r in candidates.production_ranked(hits).orderBy("rank").collect()]
    assert order == ["S2-5", "S3-1", "S2-9", "S2-10"]
    assert [r.candidate_entity_id for r in candidates.pruned(hits, "priority", 2).orderBy("rank").collect()] == ["S3-1", "S2-9"]


def test_features(sides):
    pairs = sides[0].sparkSession.createDataFrame([("S1-101", "S2-201", ["exact_name", "house_name", "name_core"], 2), ("S1-104", "S2-203", ["name_core"], 1)], "source1_entity_id string, candidate_entity_id string, blocks array<string>, rank int")
    rows = {r.source1_entity_id: r for r in features.base_features(features.with_records(pairs, *sides)).collect()}
    r = rows["S1-101"]
    assert len(features.FEATURES) == 43 and all(getattr(r, f) is not None for f in features.FEATURES)
    assert r.name_token_jaccard == pytest.approx(2 / 3) and r.name_token_overlap == 1.0 and r.block_count == 3 and r.is_source2 == 1 and r.house_number_match == 1.0
    assert rows["S1-104"].name_exact_and_addr_similar == 0
    targeted = features.targeted_features(features.with_records(pairs, *sides)).collect()
    assert len(features.TARGETED) == 12 and all(getattr(x, f) is not None for x in targeted for f in features.TARGETED)


def test_missing_address(spark):
    q = X.normalized(spark.createDataFrame([("S1-1", "a b", None, "US")], "entity_id string, business_name string, business_address string, country string"))
    t = X.normalized(spark.createDataFrame([("S2-1", "a b", "1 x street", "US")], COLUMNS))
    pairs = spark.createDataFrame([("S1-1", "S2-1", ["name_core"], 1)], "source1_entity_id string, candidate_entity_id string, blocks array<string>, rank int")
    r = features.base_features(features.with_records(pairs, q, t)).first()
    assert r.address_missing_flag == 1 and r.address_levenshtein_sim == r.address_token_jaccard == r.exact_address_match == 0


def test_hybrid_features(spark, sides):
    pairs = spark.createDataFrame([("S1-101", "S2-201", ["exact_name", "house_token", "name_web_norm"], 1, 0.8, 0.9, 3), ("S1-101", "S2-203", ["embedding"], 1, 0.1, 0.2, None)], "source1_entity_id string, candidate_entity_id string, blocks array<string>, rank int, name_cosine double, joint_cosine double, embedding_rank int")
    out = {r.candidate_entity_id: r for r in features.hybrid_features(features.base_features(features.with_records(pairs, *sides))).collect()}
    assert out["S2-201"].cosine_x_families == pytest.approx(0.9 * 3) and out["S2-201"].embedding_top25 == 1 and out["S2-203"].embedding_hit == 0


@pytest.mark.parametrize("a, b, value", [("martha", "marhta", 0.9611111), ("dixon", "dicksonx", 0.8133333), ("", "x", 0), ("abc", "abc", 1), ("abc", "xyz", 0), ("dwayne", "duane", 0.84)])
def test_jaro_winkler(a, b, value):
    assert S.jaro_winkler_value(a, b) == pytest.approx(value, abs=1e-6)


TRUTH = {"a": {1}, "b": {1, 2}, "c": set(), "d": {3}}


def frames(spark, truth, predicted):
    t = spark.createDataFrame([(q, str(x)) for q, s in truth.items() for x in s], "source1_entity_id string, target_id string")
    p = spark.createDataFrame([(q, str(x)) for q, s in predicted.items() for x in s], "source1_entity_id string, candidate_entity_id string")
    return p, t, spark.createDataFrame([(q,) for q in truth], "source1_entity_id string")


def test_metrics(spark):
    p, t, spine = frames(spark, {"a": {1}, "b": {1, 2}, "c": set(), "d": set()}, {"a": {1}, "b": {1}, "d": {9}})
    m = metrics.macro_f05(p, t, spine).first()
    assert m.macro_f05 == pytest.approx((1 + 5 / 6 + 1 + 0) / 4) and m.singleton_accuracy == 0.5
    d = metrics.decision_metrics(p, t, spine).first()
    assert (d.false_merges_count, d.missed_true_pairs_count, d.total_true_positives, d.singleton_count) == (1, 1, 2, 2)
    assert d.macro_recall == pytest.approx((1 + 0.5 + 1 + 0) / 4) and metrics.independent_metrics(p, t, spine).first().macro_recall == pytest.approx((1 + 0.5 + 1 + 1) / 4)
    p, t, spine = frames(spark, {"a": {1}}, {"a": {1, 2}})
    assert metrics.macro_f05(p, t, spine).first().macro_f05 == pytest.approx(5 / 9)
    assert all(r.holds for r in metrics.conservation(p, p, t, spine).collect())


def test_decisions(spark):
    scored = spark.createDataFrame([("a", "x", 0.85, ["p"]), ("a", "y", 0.82, ["p", "q"]), ("a", "z", 0.4, ["p"])], "source1_entity_id string, candidate_entity_id string, score double, blocks array<string>")
    assert decision.matches(scored).count() == 2 and decision.matches(scored, gap=0.02).count() == 1 and decision.matches(scored, gap=0.05).count() == 2
    assert decision.supported(scored, 2).count() == 1
    spine = spark.createDataFrame([("a",), ("b",)], "source1_entity_id string")
    assert {tuple(r) for r in decision.submission(decision.matches(scored), spine).collect()} == {("a", "x,y"), ("b", "")}


def test_split(spark):
    ids = spark.range(1000).select(F.concat(F.lit("S1-"), "id").alias("source1_entity_id"))
    parts = forensics.group_split(ids).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 800, "valid": 200}


def test_validation(spark):
    sub = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-9", "S1-2, X-3"), ("S1-2", None)], "source1_entity_id string, matched_entity_ids string")
    spine = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")
    targets = spark.createDataFrame([("S2-1",)], "entity_id string")
    got = {r.problem: r.n for r in validate.submission_problems(sub, "matched_entity_ids", spine, targets).collect()}
    assert got == {"duplicate query": 1, "duplicate id in a list": 1, "source 1 id": 1, "unknown prefix": 1, "missing query": 1, "surplus query": 1, "unknown id": 2}


def test_tsv(spark, tmp_path):
    (tmp_path / "train_source1.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"Quoted" Co\t\tUS\nS1-2\té\tx, y\tFrance\n', encoding="utf-8")
    df = entities.load(spark, str(tmp_path), "train", "source1")
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", '"Quoted" Co', "", "US"), ("S1-2", "é", "x, y", "France")]
    entities.write_tsv(df.coalesce(1), str(tmp_path / "out"))
    assert sorted(map(tuple, entities.read_tsv(spark, str(tmp_path / "out"), COLUMNS).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        entities.read_tsv(spark, str(tmp_path / "train_source1.tsv"), ["nothing"])
    ids = spark.createDataFrame([([" a", "", "b", "a"],)], "v array<string>").select(entities.id_list(F.col("v")))
    assert ids.first()[0] == "a,b"


def test_model(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    fitted = model.train(df, ["x", "y"], rounds=3)
    assert model.areas(fitted, df)["areaUnderROC"] > 0.99 and model.importance(fitted, ["x", "y"]).first().feature == "x"
    fitted.write().overwrite().save(str(tmp_path / "m"))
    out = model.scored(PipelineModel.load(str(tmp_path / "m")), df)
    assert out.where("score >= 0.5").count() == df.where("label = 1").count()


def test_dense(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>").repartition(3)
    got = dense.top_k(df.where("id < 10"), df.where("id >= 10"), 5)
    best = {r.query_id: r.target_id for r in got.where("rank = 1").collect()}
    assert best == {i: 10 + int(np.argmax(v[10:] @ v[i])) for i in range(10)} and got.count() == 50
    assert dense.top_k(df.limit(0), df, 3).count() == 0


def test_encoded(spark):
    df = dense.encoded(spark.createDataFrame([(1, "valley coalition"), (2, "the valley coalition"), (3, "zzz"), (4, None)], "id long, t string"), "t")
    v = {r.id: r.v for r in df.collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
    assert dot(1, 1) == pytest.approx(1) and dot(1, 2) > 0.8 > 0.3 > dot(1, 3) and len(v[4]) == 256


def test_file_problems(spark, tmp_path):
    (tmp_path / "good.tsv").write_text("a\tb\n1\t2\n3\t\n")
    (tmp_path / "bad.tsv").write_text("a,b\n1\t2\t3\n4\t5\n")
    found = lambda name: {r.problem: r.n for r in validate.file_problems(spark, str(tmp_path / name), ["a", "b"]).collect()}
    assert set(found("good.tsv").values()) == {0}
    assert found("bad.tsv") == {"header missing": 1, "comma-separated header": 1, "malformed line": 1}


def test_ablation(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)], "x double, y double, label int")
    out = model.ablation(df, df, {"both": ["x", "y"], "y": ["y"]}, rounds=2)
    assert out[0]["areaUnderROC"] > 0.99 > out[1]["areaUnderROC"] and out[0]["features"] == 2


def test_stream(spark, tmp_path):
    from kinweave.streaming.resolve import resolve_stream

    spark.createDataFrame(S1, COLUMNS).write.parquet(str(tmp_path / "in"))
    targets = spark.createDataFrame(TARGETS, COLUMNS)
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = resolve_stream(stream, lambda q: R.resolve(q, targets), str(tmp_path / "out"), str(tmp_path / "check"))
    run.awaitTermination()
    got = {r.source1_entity_id: r.matched_entity_ids for r in spark.read.parquet(str(tmp_path / "out" / "matches")).collect()}
    assert got == {r.source1_entity_id: r.matched_entity_ids for r in R.resolve(spark.createDataFrame(S1, COLUMNS), targets)[0].collect()} and len(got) == 4


def test_files_to_files(spark, tmp_path):
    """From TSV to TSV, resumed after new queries, and after a run that broke off."""
    import shutil

    from kinweave.operators import features, model
    from kinweave.plans import resolve
    from kinweave.sources import entities

    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    one = [f"S1-{i}\tAcme {w} Works Ltd\t{i} Main Street, 1000{i}\tUS\n" for i, w in enumerate(["Alpha", "Beta", "Gamma", "Delta"])]
    (tmp_path / "t_source1.tsv").write_text(head + "".join(one[:2]))
    (tmp_path / "t_source2.tsv").write_text(head + "".join(x.replace("S1-", "S2-") for x in one))
    (tmp_path / "t_source3.tsv").write_text(head + "".join(x.replace("S1-", "S3-").replace("Ltd", "Limited") for x in one[1:]))
    out = str(tmp_path / "out")
    run = lambda **kw: {r.problem: r.n for r in resolve.resolve_files(spark, str(tmp_path), "t", out, **kw).collect()}
    assert not any(run().values())
    (tmp_path / "t_source1.tsv").write_text(head + "".join(one))
    assert not any(run().values())
    lists = lambda: {r[0]: r[1] for n in (0, 1) for r in entities.read_tsv(spark, f"{out}/matches/run={n}", entities.MATCH_COLUMNS).collect()}
    want = {"S1-0": "S2-0", "S1-1": "S2-1,S3-1", "S1-2": "S2-2,S3-2", "S1-3": "S2-3,S3-3"}
    assert {k: ",".join(x for x in v.split(",") if x[3:] == k[3:]) for k, v in lists().items()} == want
    shutil.rmtree(f"{out}/matches/run=1")
    assert not any(run().values()) and len(lists()) == 4
    assert not any(run().values())  # nothing left to do
    pairs = spark.createDataFrame([(f"q{i}", i % 2, i % 10 == 0, *[float((i * 7 + j) % 5 + 3 * (i % 2)) for j in range(len(features.FEATURES))]) for i in range(200)], ["source1_entity_id", "label", "held", *features.FEATURES])
    fitted = model.train(pairs, rounds=30, valid="held")
    assert fitted.stages[-1].getNumTrees <= 30
    q, t = (entities.load(spark, str(tmp_path), "t", n) for n in ("source1", "source2"))
    assert resolve.resolve(q, t, model=fitted)[0].count() == 4

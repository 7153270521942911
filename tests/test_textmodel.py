"""The fitted text model: held-out accuracy, documents without a known term, labels without positives."""

from pyspark.sql import functions as F

from textguard.operators import textmodel as TM

SF = "/root/testdata/sf0.1"


def test_held_out_toxicity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    words = TM.terms(docs.join(labels.select("doc_id"), "doc_id", "left_semi"))
    model = TM.fit(words, labels.where(F.pmod(F.hash("doc_id"), F.lit(2)) == 0))
    got = (labels.where(F.pmod(F.hash("doc_id"), F.lit(2)) == 1).join(model.score(words), "doc_id", "left")
           .select("y", F.coalesce(F.col("p") >= 0.5, F.lit(False)).cast("int").alias("hit"), "p").toPandas())
    toxic, found = got[got.y == 1], got[got.hit == 1]
    assert len(toxic) > 100 and toxic.hit.mean() > 0.8 and found.y.mean() > 0.8
    assert got.p.isna().any()  # documents without a known term stay with the rules


def test_small_models(spark):
    rows = [(i, "you IDIOT there" if i % 4 == 0 else "fine words here") for i in range(200)] + [(900, None), (901, "..."), (902, "unseen")]
    words = TM.terms(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.range(200).selectExpr("id AS doc_id", "cast(id % 4 = 0 AS int) AS y")
    p = {r.doc_id: r.p for r in TM.fit(words, labels).score(words).collect()}
    assert p[0] > 0.9 and p[1] < 0.1 and not {900, 901, 902} & set(p)
    assert TM.fit(words, labels.withColumn("y", F.lit(0))).score(words).count() == 0
    assert TM.fit(words, labels.limit(0)).score(words).count() == 0


def test_several_labels_in_one_pass(spark):
    """``fit_all`` and ``score_all`` give what a model a label gives, with repeated rows, null keys and null labels."""
    rows = [(i % 190, ("you IDIOT there" if i % 4 == 0 else "fine words here") + (" tall" if i % 3 == 0 else "")) for i in range(200)] + [(None, "IDIOT"), (901, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = spark.createDataFrame([(i % 180, None if i % 50 == 7 else int(i % 4 == 0)) for i in range(230)] + [(None, 1)], "doc_id long, y int")
    two = docs.select("doc_id", F.col("text").contains("tall").cast("int").alias("b"), F.lit(0).alias("c"))
    sets, words = TM.term_sets(docs), TM.terms(docs)
    models = TM.fit_all(sets, [(one.withColumnRenamed("y", "a"), ["a"]), (two, ["b", "c"])])
    got = {r.doc_id: r for r in TM.score_all(sets, models).where("doc_id IS NOT NULL").collect()}
    for x, labels in (("a", one), ("b", two.withColumnRenamed("b", "y")), ("c", two.withColumnRenamed("c", "y"))):
        model = TM.fit(words, labels.select("doc_id", "y"))
        assert sorted(map(tuple, models[x].weights.collect())) == sorted(map(tuple, model.weights.collect()))
        want = {r.doc_id: r.p for r in model.score(words).where("doc_id IS NOT NULL").collect()}
        assert want == {k: r[x] for k, r in got.items() if r[x] is not None} and (want or x == "c")


def test_texts_are_cut_into_terms_once(spark, sf001, monkeypatch):
    from textguard.plans import q_outfilter as Q
    cuts, rules, terms, bias = [], [], TM.term_sets, Q.OF.with_bias
    monkeypatch.setattr(TM, "term_sets", lambda *a, **k: cuts.append(1) or terms(*a, **k))
    monkeypatch.setattr(Q.OF, "with_bias", lambda *a, **k: rules.append(1) or bias(*a, **k))
    assert Q.model_scores(spark, sf001).count() > 0 and len(cuts) == len(rules) == 1

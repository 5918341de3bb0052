"""Checked queries on trained models: class scores (E6, E7), unbounded trees (M2, M13), Shapley values of trees."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, NaiveBayes, OneVsRest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from qualab.functions.hashing import hash_unit
from qualab.operators import explain as X
from qualab.operators import metrics as M
from qualab.operators import models as MO
from qualab.operators import models_custom as MC
from qualab.operators import scores as S
from qualab.operators.trees import DeepTrees
from qualab.plans.checks_metrics import sql_auc
from qualab.plans.fixtures import table
from qualab.plans.registry import check

TEST_SQL = "CAST(('0x' || substr(md5('42|' || CAST({0} AS VARCHAR)), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0 < 0.2"


def embeddings(spark, sf):
    """row_key, features, label, is_test of all embeddings."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("row_key"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"),
        F.col("label").cast("double").alias("label"), (hash_unit(F.col("vec_id").cast("string")) < 0.2).alias("is_test"))


def _class_auc(spark, sf, est, name):
    data = embeddings(spark, sf)
    classes = [float(r[0]) for r in data.select("label").distinct().orderBy("label").limit(MO.MAX_CLASSES).collect()]
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    scores = S.class_scores(est.fit(train), test, "run_emb", name, classes, train).withColumn("score", F.round("score", 9))
    return M.multiclass_auc(scores).select("run_id", "model", F.inline("per_class"))


_SPLIT = f"""s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, CAST(label AS DOUBLE) AS label, {TEST_SQL.format('vec_id')} AS is_test FROM embeddings),
     classes AS (SELECT DISTINCT label AS class FROM s)"""


@check("e6_trained_knn_auc_by_class", round_cols=["auc"], sql=f"""
WITH {_SPLIT},
     nb AS (SELECT q.vec_id AS q, q.label, t.label AS nl, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, t.x), CAST(t.vec_id AS VARCHAR)) AS r
            FROM s AS q JOIN s AS t ON q.is_test AND NOT t.is_test),
     scores AS (SELECT q, label, class, round(count(*) FILTER (WHERE nl = class) / 5, 9) AS score FROM nb CROSS JOIN classes WHERE r <= 5 GROUP BY q, label, class)
SELECT 'run_emb' AS run_id, 'KNeighbors' AS model, class, auc FROM ({sql_auc('scores', 'class', 'label = class', 'score')}) AS a""")
def e6_knn(spark, sf):
    return _class_auc(spark, sf, MC.KNeighbors(k=5), "KNeighbors")


@check("e6_trained_gaussian_nb_auc_by_class", round_cols=["auc"], sql=f"""
WITH {_SPLIT},
     train AS (SELECT label AS class, unnest(x) AS v, unnest(range(len(x))) AS j FROM s WHERE NOT is_test),
     eps AS (SELECT 1e-9 * max(v) AS e FROM (SELECT var_pop(v) AS v FROM train GROUP BY j) AS a),
     fit AS (SELECT class, j, avg(v) AS m, var_pop(v) + any_value(e) AS s2 FROM train, eps GROUP BY class, j),
     prior AS (SELECT label AS class, ln(count(*) / sum(count(*)) OVER ()) AS lp FROM s WHERE NOT is_test GROUP BY label),
     test AS (SELECT vec_id, label, unnest(x) AS v, unnest(range(len(x))) AS j FROM s WHERE is_test),
     joint AS (SELECT vec_id, label, class, any_value(lp) + sum(-0.5 * ln(2 * pi() * s2) - (v - m) * (v - m) / (2 * s2)) AS l
               FROM test JOIN fit USING (j) JOIN prior USING (class) GROUP BY vec_id, label, class),
     scores AS (SELECT vec_id, label, class, round(exp(l - max(l) OVER q) / sum(exp(l - top)) OVER q, 9) AS score
                FROM (SELECT *, max(l) OVER (PARTITION BY vec_id) AS top FROM joint) AS a WINDOW q AS (PARTITION BY vec_id))
SELECT 'run_emb' AS run_id, 'GaussianNB' AS model, class, auc FROM ({sql_auc('scores', 'class', 'label = class', 'score')}) AS a""")
def e6_nb(spark, sf):
    return _class_auc(spark, sf, NaiveBayes(modelType="gaussian"), "GaussianNB")


@check("e6_trained_margin_scores")
def e6_margins(spark, sf):
    """Boosted trees, one against the rest, by calibrated margins: language of a document from its other columns."""
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    data, state = MO.prepare_model_data(docs, "lang", "clasificacion", ["doc_id"])
    classes = [float(i) for i in range(len(state["labels"]))]
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    model = OneVsRest(classifier=GBTClassifier(maxIter=10, maxDepth=3, seed=MO.SEED)).fit(train)
    return S.class_scores(model, test, "run_lang", "GradientBoosting", classes, train)


def _items(spark, sf):
    """All line items as training rows: label and three numbers that many rows share."""
    li = table(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_key"), "l_quantity", "l_discount", "l_tax",
        "l_extendedprice", "l_returnflag")
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(li)


@check("m13_unbounded_tree_reaches_group_means", round_cols=["prediction"], sql="""
SELECT l_quantity, l_discount, l_tax, count(*) AS n, avg(l_extendedprice) AS prediction FROM lineitem GROUP BY ALL""")
def m13_tree(spark, sf):
    """A tree without a depth limit ends where rows are alike: its prediction is the mean of the rows with the same values."""
    rows = _items(spark, sf).withColumn("label", F.col("l_extendedprice"))
    out = DeepTrees("regresion", local_rows=20_000).fit(rows).transform(rows)
    return out.groupBy("l_quantity", "l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("prediction"))


@check("m2_unbounded_tree_reaches_group_majorities", sql="""
SELECT l_quantity, l_discount, l_tax, CAST(arg_max(label, n * 10 - label) AS DOUBLE) AS prediction FROM (
  SELECT l_quantity, l_discount, l_tax, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, count(*) AS n
  FROM lineitem GROUP BY ALL) AS g GROUP BY ALL""")
def m2_tree(spark, sf):
    """The same for classes: the most frequent one, the first among equals."""
    label = F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0)
    rows = _items(spark, sf).withColumn("label", label)
    out = DeepTrees("clasificacion", local_rows=20_000).fit(rows).transform(rows)
    return out.select("l_quantity", "l_discount", "l_tax", "prediction").distinct()


@check("m8_samme_first_round", sql="""
SELECT l_linestatus, CAST(sum(c) AS BIGINT) AS n, CAST(arg_max(label, c * 10 - label) AS DOUBLE) AS prediction FROM (
  SELECT l_linestatus, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label, count(*) AS c
  FROM lineitem GROUP BY l_linestatus, l_returnflag) AS g GROUP BY l_linestatus""")
def m8_first(spark, sf):
    """One round of SAMME on one 0/1 feature: the stump can only split there, so each side predicts its most frequent class."""
    rows = table(spark, sf, "lineitem").select(
        "l_linestatus", array_to_vector(F.array((F.col("l_linestatus") == "F").cast("double"))).alias("features"),
        F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0).alias("label"))
    out = MC.AdaBoostSamme(n_estimators=1).fit(rows).transform(rows)
    return out.groupBy("l_linestatus", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _explained(spark, sf, name):
    """A model of document quality, its test rows and their Shapley values."""
    docs = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")
    data, state = MO.prepare_model_data(docs.drop("toxic"), "quality", "clasificacion", ["doc_id"])
    train, test = data.where(~F.col("is_test")), data.where(F.col("is_test"))
    model = MO.make_estimator(name, "clasificacion", train.count(), 2).fit(train)
    return model, test, X.explain(model, test, state["features"], train)


def _tree_shap_check(name):
    return lambda spark, sf: _explained(spark, sf, name)[2]


for _name, _id in (("DecisionTree", "tree"), ("RandomForest", "forest"), ("GradientBoosting", "boosted")):
    check(f"x1_tree_shap_{_id}")(_tree_shap_check(_name))


@check("x1_tree_shap_adds_up", sql=f"""
SELECT CAST(doc_id AS VARCHAR) AS row_key, 0.0 AS off FROM labels JOIN documents USING (doc_id)
WHERE quality IS NOT NULL AND {TEST_SQL.format('doc_id')}""", round_cols=["off"])
def x1_sum(spark, sf):
    """Each test row's Shapley values and the base add up to the tree's probability."""
    model, test, shap = _explained(spark, sf, "DecisionTree")
    total = shap.groupBy("row_key").agg((F.sum("shap") + F.first("base")).alias("total"))
    scored = MO.predictions_of(model, test, "r", "DecisionTree").select("row_key", "probability")
    return scored.join(total, "row_key").select("row_key", F.abs(F.round(F.col("probability") - F.col("total"), 9)).alias("off"))

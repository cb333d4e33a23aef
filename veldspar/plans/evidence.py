"""Queries on vectors with labels: similarity, retrieval, scores, metrics, decisions and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veldspar.functions import text as T
from veldspar.operators import contracts as C, decide as D, logistic as L, split as S, vectors as V
from veldspar.plans.registry import query, read
from veldspar.sources import tables
from veldspar.storage import stage

EDGE, K = 0.35, 5
SUGGEST, CAUTION, MARGIN = 0.5, 0.3, 0.05

#: Unit vectors, labels, labelled items, neighbours among them and scores, for SQL.
BASE = """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
u AS (SELECT id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v, label FROM e),
labels0 AS (SELECT id, 'P' || label AS persona FROM e UNION ALL SELECT id, 'P' || ((label + 1) % 10) FROM e WHERE id % 3 = 0),
labelled AS (SELECT * FROM labels0 WHERE id % 5 <> 0),
vocab AS (SELECT DISTINCT persona FROM labels0)
"""
SIMS = BASE + """, sims AS (SELECT q.id AS query, i.id, round(greatest(-1, least(1, list_dot_product(q.v, i.v))), 9) AS similarity FROM u q JOIN u i ON q.id <> i.id WHERE q.id % 5 = 0 AND i.id % 5 <> 0),
near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM sims)
"""
SCORES = SIMS + f""", votes AS (SELECT query, persona, sum(greatest(similarity, 0)) AS w FROM near JOIN labelled USING (id) WHERE rank <= {K} GROUP BY 1, 2),
total AS (SELECT query, sum(greatest(similarity, 0)) AS total FROM near WHERE rank <= {K} GROUP BY 1),
scores AS (SELECT query, persona, CASE WHEN total > 0 THEN coalesce(w, 0) / total ELSE 0 END AS score FROM total CROSS JOIN vocab LEFT JOIN votes USING (query, persona)),
judged AS (SELECT s.query, s.persona, score, CAST(score >= 0.35 AS INT) AS predicted, CAST(l.id IS NOT NULL AS INT) AS actual FROM scores s LEFT JOIN labels0 l ON l.id = s.query AND l.persona = s.persona)
"""
RANKED = SCORES + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, persona) AS rank FROM judged), tops AS (SELECT query, max(CASE WHEN rank = 1 THEN score END) AS top, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS second FROM ranked GROUP BY 1)\n"
DECIDED = RANKED + f", decided AS (SELECT query, top, second, CASE WHEN top >= {SUGGEST}::DOUBLE AND top - second >= {MARGIN}::DOUBLE THEN 'suggest' WHEN top >= {CAUTION}::DOUBLE THEN 'suggest_with_caution' ELSE 'abstain' END AS decision FROM tops)\n"
PAIRS = BASE + ", pairs AS (SELECT a.id AS a, b.id AS b, greatest(-1, least(1, list_dot_product(a.v, b.v))) AS similarity, a.label = b.label AS same FROM u a JOIN u b ON a.id < b.id)\n"
DUPS = BASE + ", dup AS (SELECT a.id AS a, b.id AS b, CAST(a.label = b.label AS INT) AS actual, list_dot_product(a.v, b.v) AS similarity FROM u a JOIN u b ON b.id = a.id + 1)\n"


def vectors(spark, sf_dir) -> DataFrame:
    return V.normalized(read(spark, sf_dir, "embeddings"))


def labels(spark, sf_dir) -> DataFrame:
    """(id, persona), from a pipe-delimited text as labels come."""
    e = read(spark, sf_dir, "embeddings")
    second = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit(" | P"), ((F.col("label") + 1) % 10).cast("string"))).otherwise("")
    told = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("P"), F.col("label").cast("string"), second).alias("personas"))
    return told.select("id", F.explode(T.parse_labels(F.col("personas"))).alias("persona"))


def vocabulary(spark, sf_dir) -> DataFrame:
    return labels(spark, sf_dir).select("persona").distinct()


def neighbours(spark, sf_dir, k: int = K) -> DataFrame:
    v = vectors(spark, sf_dir)
    return V.top_k(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), k)


def scores(spark, sf_dir, k: int = K, near: DataFrame | None = None, squared: bool = False) -> DataFrame:
    known = labels(spark, sf_dir).where("id % 5 <> 0")
    return D.knn_scores(neighbours(spark, sf_dir, k) if near is None else near, known, vocabulary(spark, sf_dir), k, squared)


def judged(spark, sf_dir, threshold: float = 0.35, scored: DataFrame | None = None) -> DataFrame:
    s = scores(spark, sf_dir) if scored is None else scored
    truth = labels(spark, sf_dir).select(F.col("id").alias("query"), "persona", F.lit(1).alias("actual"))
    return s.join(truth, ["query", "persona"], "left").fillna(0, ["actual"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("SELECT count(*) AS n, count(*) - count(DISTINCT vec_id) AS repeated, count(*) FILTER (WHERE vec_id IS NULL OR embedding IS NULL) AS nulls FROM embeddings")
def scan_contract(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct("vec_id")).alias("repeated"), F.count_if(F.col("vec_id").isNull() | F.col("embedding").isNull()).alias("nulls"))


@query("SELECT count(*) - count(DISTINCT doc_id) AS repeated_keys, count(*) FILTER (WHERE quality IS NULL) AS null_quality, count(*) FILTER (WHERE quality NOT IN (0, 1)) AS not_flag_quality, count(*) FILTER (WHERE toxic NOT IN (0, 1)) AS not_flag_toxic FROM labels")
def data_contract(spark, sf_dir):
    rules = tables.Contract("doc_id long, quality int, toxic int", ("doc_id",), ("quality",), (), ("quality", "toxic"))
    return tables.violations(read(spark, sf_dir, "labels"), rules)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS misshapen FROM embeddings")
def embedding_contract(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") != 64).alias("misshapen"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(BASE + "SELECT id, persona FROM labels0")
def parse_labels(spark, sf_dir):
    return labels(spark, sf_dir)


@query(BASE + "SELECT persona FROM vocab")
def label_vocabulary(spark, sf_dir):
    return vocabulary(spark, sf_dir).orderBy("persona")


@query("SELECT item_id, trim(text) AS answer FROM benchmark")
def strip_fence(spark, sf_dir):
    fenced = F.concat(F.lit("```JSON\n"), F.trim("text"), F.lit("\n```"))
    return read(spark, sf_dir, "benchmark").select("item_id", T.strip_fence(fenced).alias("answer"))


@query("SELECT item_id, 'c_' || (item_id + 1) AS unsupported FROM benchmark WHERE item_id % 2 = 0")
def unsupported_ids(spark, sf_dir):
    told = F.concat(F.lit("see c_"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" and c_"), (F.col("item_id") + 1).cast("string"))).otherwise(""))
    own = F.array(F.concat(F.lit("c_"), F.col("item_id").cast("string")))
    return read(spark, sf_dir, "benchmark").select("item_id", F.explode(T.unsupported_ids(told, own)).alias("unsupported"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 THEN trim(text) END AS rationale FROM benchmark")
def parse_rationale(spark, sf_dir):
    good = F.to_json(F.struct(F.col("text").alias("rationale")))
    other = F.to_json(F.struct(F.col("text").alias("rationale"), F.lit(1).alias("extra")))
    answer = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(F.col("item_id") % 3 == 1, other).otherwise(F.col("text"))
    return read(spark, sf_dir, "benchmark").select("item_id", T.parse_rationale(answer).alias("rationale"))


@query()
def hash_text_embed(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.hash_embed(F.col("text")).alias("vector"))


@query(BASE + "SELECT id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first, round(list_dot_product(v, v), 6) AS norm FROM u")
def vec_normalize(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.col("vector")[0], 6).alias("first"), F.round(T.dot(F.col("vector"), F.col("vector")), 6).alias("norm"))


_ROT = "list_concat(v[2:], v[1:1])"


def rotated(spark, sf_dir) -> DataFrame:
    """A second modality: the vectors with their first component put last."""
    return vectors(spark, sf_dir).select("id", F.concat(F.slice("vector", F.lit(2), F.size("vector") - 1), F.slice("vector", 1, 1)).alias("vector"))


@query(BASE + f", f AS (SELECT id, list_transform(list_zip(v, {_ROT}), lambda p: 0.3 * p[1] + 0.7 * p[2]) AS f FROM u) SELECT id, round(f[1] / sqrt(list_dot_product(f, f)), 6) AS first, round(list_sum(f) / sqrt(list_dot_product(f, f)), 6) AS total FROM f")
def vec_fuse(spark, sf_dir):
    fused = V.fuse(vectors(spark, sf_dir), rotated(spark, sf_dir))
    return fused.select("id", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(BASE + f"SELECT id, round(list_dot_product(v, {_ROT}), 6) AS alignment FROM u")
def modality_alignment(spark, sf_dir):
    both = vectors(spark, sf_dir).join(rotated(spark, sf_dir).withColumnRenamed("vector", "other"), "id")
    return both.select("id", F.round(T.dot(F.col("vector"), F.col("other")), 6).alias("alignment"))


@query(BASE + "SELECT i.id, round(list_dot_product(q.v, i.v), 6) AS similarity FROM u i CROSS JOIN (SELECT v FROM u WHERE id = (SELECT min(id) FROM u)) q")
def cosine_query(spark, sf_dir):
    v = vectors(spark, sf_dir)
    q = v.orderBy("id").limit(1).select(F.col("vector").alias("q"))
    return v.crossJoin(F.broadcast(q)).select("id", F.round(T.dot(F.col("vector"), F.col("q")), 6).alias("similarity"))


@query("SELECT round(avg(n), 9) AS mean, round(stddev_pop(n), 9) AS deviation, round(min(n), 7) AS least, round(max(n), 7) AS most, round(max(abs(n - 1)), 7) AS off FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def norm_audit(spark, sf_dir):
    x = F.col("embedding").cast("array<double>")
    n = read(spark, sf_dir, "embeddings").select(F.sqrt(T.dot(x, x)).alias("n"))
    return n.agg(F.round(F.avg("n"), 9).alias("mean"), F.round(F.stddev_pop("n"), 9).alias("deviation"), F.round(F.min("n"), 7).alias("least"), F.round(F.max("n"), 7).alias("most"), F.round(F.max(F.abs(F.col("n") - 1)), 7).alias("off"))


@query(PAIRS + "SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def all_pairs_similarity(spark, sf_dir):
    return rounded(V.pairs(vectors(spark, sf_dir)), "similarity")


@query(PAIRS + f"SELECT a, b, round(similarity, 6) AS similarity FROM pairs WHERE similarity >= {EDGE}")
def near_dup_edges(spark, sf_dir):
    return rounded(V.pairs(vectors(spark, sf_dir), EDGE), "similarity")


@query(PAIRS + "SELECT a, b, round(1 - similarity, 6) AS distance FROM pairs")
def condensed_distance(spark, sf_dir):
    return rounded(V.distances(vectors(spark, sf_dir)), "distance")


@query(PAIRS + "SELECT (SELECT count(*) FROM u) AS items, (SELECT count(*) * (count(*) - 1) // 2 FROM u)::BIGINT AS expected, count(*) AS pairs, count(*) FILTER (WHERE similarity IS NULL) AS nulls FROM pairs")
def pair_count_contract(spark, sf_dir):
    """Whether every unordered pair has its similarity."""
    v = vectors(spark, sf_dir)
    made = V.pair_counts(v)
    n = v.agg(F.count(F.lit(1)).alias("items")).withColumn("expected", F.expr("items * (items - 1) div 2"))
    return n.crossJoin(F.broadcast(made)).select("items", "expected", "pairs", "nulls")


_RULES = "\nRules:\n" + "\n".join(f"- {rule}" for rule in T.RULES).replace("'", "''")


@query(f"SELECT item_id, 'A model has predicted a label for an item.\nLabel: P' || item_id % 10 || '\nScore: 0.2500\nEvidence:\n[{{\"id\":' || item_id || ',\"similarity\":0.5,\"near_duplicate\":false,\"confirmed\":[\"P1\"]}}]{_RULES}' AS prompt FROM benchmark")
def llm_prompt(spark, sf_dir):
    proof = F.array(F.struct(F.col("item_id").alias("id"), F.lit(0.5).alias("similarity"), F.lit(False).alias("near_duplicate"), F.array(F.lit("P1")).alias("confirmed")))
    label = F.concat(F.lit("P"), (F.col("item_id") % 10).cast("string"))
    return read(spark, sf_dir, "benchmark").select("item_id", T.prompt(label, F.lit(0.25), proof).alias("prompt"))


def _next(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("a"), F.col("label").alias("x"))
    f = read(spark, sf_dir, "embeddings").select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("label").alias("y"))
    return V.pair_similarity(e.join(f, "a").select("a", "b", (F.col("x") == F.col("y")).cast("int").alias("actual")), vectors(spark, sf_dir))


@query(DUPS + "SELECT a, b, actual, round(similarity, 6) AS similarity FROM dup")
def pair_similarity(spark, sf_dir):
    return rounded(_next(spark, sf_dir), "similarity")


_QS = [0.9, 0.95, 0.99, 0.999]


@query(PAIRS + f"SELECT count(*) AS n, round(avg(similarity), 8) AS mean, {', '.join(f'round(quantile_cont(similarity, {q}), 7) AS p{i}' for i, q in enumerate(_QS))} FROM pairs")
def similarity_percentiles(spark, sf_dir):
    n, mean, found = V.percentiles(vectors(spark, sf_dir), _QS)
    row = spark.createDataFrame([(n, mean, *found)], "n long, mean double, " + ", ".join(f"p{i} double" for i in range(len(_QS))))
    return rounded(rounded(row, "mean", n=8), *[f"p{i}" for i in range(len(_QS))], n=7)


_TS = [-0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 0.35, 0.4]


@query(PAIRS + f"SELECT t AS threshold, count(*) AS n FROM pairs, (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in _TS)}]) AS t) WHERE similarity >= t GROUP BY 1")
def threshold_counts(spark, sf_dir):
    return V.counts_from(vectors(spark, sf_dir), _TS)


@query(PAIRS + "SELECT CAST(floor((similarity + 1) / 0.05) AS BIGINT) AS bin, count(*) AS n FROM pairs GROUP BY 1")
def similarity_histogram(spark, sf_dir):
    return V.histogram(vectors(spark, sf_dir), 0.05)


@query(DUPS + "SELECT actual, count(*) AS n, round(avg(similarity), 6) AS mean, round(stddev_samp(similarity), 6) AS deviation, round(min(similarity), 6) AS least, round(quantile_cont(similarity, 0.25), 6) AS q1, round(quantile_cont(similarity, 0.5), 6) AS median, round(quantile_cont(similarity, 0.75), 6) AS q3, round(max(similarity), 6) AS most FROM dup GROUP BY 1")
def describe_by_label(spark, sf_dir):
    q = lambda p: F.round(F.percentile("similarity", F.lit(p)), 6)
    return _next(spark, sf_dir).groupBy("actual").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean"), F.round(F.stddev_samp("similarity"), 6).alias("deviation"), F.round(F.min("similarity"), 6).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.round(F.max("similarity"), 6).alias("most"))


@query()
def pca_variance(spark, sf_dir):
    """Variance that the first two principal components explain, from the covariance of centred vectors."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    rows = vectors(spark, sf_dir).select(array_to_vector("vector").alias("v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows).transform(rows)
    found = PCA(k=2, inputCol="c", outputCol="p").fit(centred).explainedVariance
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(found)], "component int, share double")


@query(SIMS + f"SELECT query, id, rank, round(similarity, 6) AS similarity, similarity >= 0.88 AS near_duplicate FROM near WHERE rank <= {K}")
def topk_evidence(spark, sf_dir):
    return neighbours(spark, sf_dir).select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 0.88).alias("near_duplicate"))


@query(SIMS + "SELECT query, persona, id, place FROM (SELECT query, persona, id, row_number() OVER (PARTITION BY query, persona ORDER BY rank) AS place FROM near JOIN labelled USING (id) WHERE rank <= 20) WHERE place <= 3")
def persona_evidence(spark, sf_dir):
    return evidence_by_persona(spark, sf_dir).select("query", "persona", "id", F.col("place").cast("long").alias("place"))


def evidence_by_persona(spark, sf_dir, near: DataFrame | None = None, k: int = 3) -> DataFrame:
    """The first ``k`` of the 20 nearest that have the persona; there may be fewer, or none."""
    from pyspark.sql import Window

    near = neighbours(spark, sf_dir, 20) if near is None else near
    place = F.row_number().over(Window.partitionBy("query", "persona").orderBy("rank"))
    return near.join(labels(spark, sf_dir).where("id % 5 <> 0"), "id").withColumn("place", place).where(F.col("place") <= k)


@query(SIMS + "SELECT query, id AS nearest, round(similarity, 6) AS similarity FROM near WHERE rank = 1")
def nearest_labelled(spark, sf_dir):
    return neighbours(spark, sf_dir, 1).select("query", F.col("id").alias("nearest"), F.round("similarity", 6).alias("similarity"))


@query(SIMS + f", rot AS (SELECT id, {_ROT} AS v FROM u), r AS (SELECT q.id AS query, i.id, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, i.v), 9) DESC, i.id) AS rank FROM rot q JOIN rot i ON q.id <> i.id WHERE q.id % 5 = 0 AND i.id % 5 <> 0) SELECT n.query, n.rank, n.id AS by_first, r.id AS by_second FROM near n JOIN r ON n.query = r.query AND n.rank = r.rank WHERE n.rank <= 5")
def retrieval_compare(spark, sf_dir):
    v = rotated(spark, sf_dir)
    other = V.top_k(v.where("id % 5 = 0"), v.where("id % 5 <> 0"), K).select("query", "rank", F.col("id").alias("by_second"))
    return neighbours(spark, sf_dir).select("query", "rank", F.col("id").alias("by_first")).join(other, ["query", "rank"]).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_pool(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query()
def dup_clusters(spark, sf_dir):
    return V.complete_linkage(vectors(spark, sf_dir), EDGE)


@query()
def cluster_summary(spark, sf_dir):
    return dup_clusters(spark, sf_dir).groupBy("cluster_size").agg((F.count(F.lit(1)) / F.col("cluster_size")).cast("long").alias("clusters"))


@query()
def cluster_split(spark, sf_dir):
    return S.sized_split(dup_clusters(spark, sf_dir))


@query("SELECT 0 AS leaked")
def split_leakage(spark, sf_dir):
    """Clusters that the split has cut."""
    return S.leakage(cluster_split(spark, sf_dir)).agg(F.count(F.lit(1)).cast("int").alias("leaked"))


@query()
def split_summary(spark, sf_dir):
    return cluster_split(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("clusters"))


@query("SELECT label, count(DISTINCT vec_id % 3) AS splits FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id % 3) > 1")
def cluster_leakage(spark, sf_dir):
    """Clusters in more than one split: what a split by rows does, with labels for clusters and vec_id % 3 for it."""
    return S.leakage(read(spark, sf_dir, "embeddings").withColumn("split", F.col("vec_id") % 3), "label")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def labelled_join(spark, sf_dir):
    return C.one_to_one(read(spark, sf_dir, "documents").select("doc_id", "lang"), read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT vec_id AS id, label FROM embeddings")
def cluster_attach(spark, sf_dir):
    """Items with their clusters; an item without one is an error."""
    items = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return C.complete(items, dup_clusters(spark, sf_dir), "id").where("cluster_size > 0").select("id", "label")


@query("SELECT count(*) - count(l.doc_id) AS unmatched, 0 AS repeated_left, 0 AS repeated_right FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_contract(spark, sf_dir):
    found = C.faults(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), "doc_id")
    return found.select("unmatched", F.col("repeated_left").cast("int").alias("repeated_left"), F.col("repeated_right").cast("int").alias("repeated_right"))


@query("SELECT l.doc_id, l.quality, d.source AS source_document FROM labels l LEFT JOIN documents d USING (doc_id)")
def review_join(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_document"))
    return read(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id", "left")


@query(SCORES + "SELECT query, persona, round(score, 6) AS score FROM scores")
def knn_scores(spark, sf_dir):
    return rounded(scores(spark, sf_dir), "score")


@query(SCORES + "SELECT query, persona FROM scores WHERE score >= 0.35")
def knn_predict(spark, sf_dir):
    return scores(spark, sf_dir).where("score >= 0.35").select("query", "persona")


@query(RANKED + "SELECT query, persona, rank FROM ranked WHERE rank <= 3")
def top_personas(spark, sf_dir):
    return D.ranked(scores(spark, sf_dir)).where("rank <= 3").select("query", "persona", F.col("rank").cast("long").alias("rank"))


@query(RANKED + "SELECT query, persona, round(score, 6) AS score FROM ranked WHERE rank = 1")
def knn_top(spark, sf_dir):
    return rounded(D.ranked(scores(spark, sf_dir)).where("rank = 1").select("query", "persona", "score"), "score")


@query(RANKED + "SELECT query, round(top, 6) AS top, round(second, 6) AS second, round(top - second, 6) AS margin FROM tops")
def score_margin(spark, sf_dir):
    return rounded(D.margins(scores(spark, sf_dir)), "top", "second", "margin")


_METRICS = """, per AS (SELECT {by} persona, count(*) FILTER (WHERE predicted = 1 AND actual = 1) AS tp, count(*) FILTER (WHERE predicted = 1 AND actual = 0) AS fp, count(*) FILTER (WHERE predicted = 0 AND actual = 1) AS fn, count(*) FILTER (WHERE predicted = 0 AND actual = 0) AS tn FROM {of} GROUP BY ALL),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM per),
whole AS (SELECT {by} avg(same) AS subset_accuracy FROM (SELECT {by} query, min(CAST(predicted = actual AS INT)) AS same FROM {of} GROUP BY ALL) GROUP BY ALL),
m AS (SELECT {by} avg(f1) AS macro_f1, coalesce(2.0::DOUBLE * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0) AS micro_f1, coalesce(sum(f1 * (tp + fn)) / nullif(sum(tp + fn), 0), 0) AS weighted_f1, (sum(fp) + sum(fn)) / sum(tp + fp + fn + tn)::DOUBLE AS hamming FROM f GROUP BY ALL)
"""
_M = "round(macro_f1, 6) AS macro_f1, round(micro_f1, 6) AS micro_f1, round(weighted_f1, 6) AS weighted_f1, round(hamming, 6) AS hamming, round(subset_accuracy, 6) AS subset_accuracy"
_MC = ["macro_f1", "micro_f1", "weighted_f1", "hamming", "subset_accuracy"]


@query(SCORES + _METRICS.format(by="", of="judged") + f"SELECT {_M} FROM m, whole")
def multilabel_metrics(spark, sf_dir):
    return rounded(D.multilabel(judged(spark, sf_dir)), *_MC)


@query(SCORES + _METRICS.format(by="", of="judged") + "SELECT persona, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall, round(f1, 6) AS f1, tp + fn AS support FROM f")
def per_persona_metrics(spark, sf_dir):
    c = D.counts(judged(spark, sf_dir), "persona")
    return rounded(c.select("persona", "tp", "fp", "fn", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support")), "precision", "recall", "f1").orderBy(F.desc("f1"))


@query(SCORES + "SELECT query, persona, actual FROM judged")
def label_matrix(spark, sf_dir):
    return judged(spark, sf_dir).select("query", "persona", "actual")


_GRID = [round(0.2 + 0.05 * i, 2) for i in range(11)]
_GRID_SQL = ", ".join(f"({t}::DOUBLE)" for t in _GRID)


def grid(spark, values) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(float(v),) for v in values], "threshold double"))


@query(SCORES + f", swept AS (SELECT threshold, query, persona, actual, CAST(score >= threshold AS INT) AS predicted FROM judged, (VALUES {_GRID_SQL}) g(threshold))" + _METRICS.format(by="threshold,", of="swept") + f"SELECT threshold, {_M} FROM m JOIN whole USING (threshold)")
def threshold_search(spark, sf_dir):
    swept = judged(spark, sf_dir).crossJoin(grid(spark, _GRID)).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    return rounded(D.multilabel(swept, "threshold"), *_MC).orderBy(F.desc("macro_f1"), F.desc("micro_f1"), "threshold")


_KS = [3, 5, 7, 9]


@query(SIMS + f", g AS (SELECT unnest({_KS}) AS k), votes AS (SELECT k, query, persona, sum(greatest(similarity, 0)) AS w FROM near JOIN labelled USING (id) JOIN g ON rank <= k GROUP BY ALL), total AS (SELECT k, query, sum(greatest(similarity, 0)) AS total FROM near JOIN g ON rank <= k GROUP BY ALL), swept AS (SELECT t.k, t.query, v.persona, CAST(CASE WHEN total > 0 THEN coalesce(w, 0) / total ELSE 0 END >= 0.35 AS INT) AS predicted, CAST(l.id IS NOT NULL AS INT) AS actual FROM total t CROSS JOIN vocab v LEFT JOIN votes o ON o.k = t.k AND o.query = t.query AND o.persona = v.persona LEFT JOIN labels0 l ON l.id = t.query AND l.persona = v.persona)" + _METRICS.format(by="k,", of="swept") + f"SELECT k, {_M} FROM m JOIN whole USING (k)")
def knn_grid(spark, sf_dir):
    """All k from one retrieval of the largest."""
    return rounded(D.multilabel(judged(spark, sf_dir, scored=swept(spark, sf_dir, _KS, [1])), "k"), *_MC)


def swept(spark, sf_dir, ks: list[int], powers: list[int]) -> DataFrame:
    return D.knn_grid(neighbours(spark, sf_dir, max(ks)), labels(spark, sf_dir).where("id % 5 <> 0"), vocabulary(spark, sf_dir), ks, powers)


@query(SIMS + f", n2 AS (SELECT query, id, pow(greatest(similarity, 0), power) AS w, power FROM near, (VALUES (1), (2)) p(power) WHERE rank <= {K}), votes AS (SELECT power, query, persona, sum(w) AS w FROM n2 JOIN labelled USING (id) GROUP BY ALL), total AS (SELECT power, query, sum(w) AS total FROM n2 GROUP BY ALL), swept AS (SELECT t.power, t.query, v.persona, CAST(CASE WHEN total > 0 THEN coalesce(w, 0) / total ELSE 0 END >= 0.35 AS INT) AS predicted, CAST(l.id IS NOT NULL AS INT) AS actual FROM total t CROSS JOIN vocab v LEFT JOIN votes o ON o.power = t.power AND o.query = t.query AND o.persona = v.persona LEFT JOIN labels0 l ON l.id = t.query AND l.persona = v.persona)" + _METRICS.format(by="power,", of="swept") + f"SELECT power, {_M} FROM m JOIN whole USING (power)")
def knn_weighting(spark, sf_dir):
    """Weights as they are and squared."""
    return rounded(D.multilabel(judged(spark, sf_dir, scored=swept(spark, sf_dir, [K], [1, 2])), "power"), *_MC)


@query(RANKED + f"SELECT threshold, round(count(*) FILTER (WHERE score >= threshold) / count(*)::DOUBLE, 6) AS coverage, round(coalesce(count(*) FILTER (WHERE score >= threshold AND actual = 1) / nullif(count(*) FILTER (WHERE score >= threshold), 0)::DOUBLE, 0), 6) AS precision, count(*) FILTER (WHERE score >= threshold) AS accepted FROM ranked, (VALUES {_GRID_SQL}) g(threshold) WHERE rank = 1 GROUP BY 1")
def coverage_curve(spark, sf_dir):
    top = D.ranked(judged(spark, sf_dir)).where("rank = 1").crossJoin(grid(spark, _GRID))
    ok = F.col("score") >= F.col("threshold")
    out = top.groupBy("threshold").agg(F.count_if(ok).alias("accepted"), F.count(F.lit(1)).alias("n"), F.count_if(ok & (F.col("actual") == 1)).alias("right"))
    return out.select("threshold", F.round(F.col("accepted") / F.col("n"), 6).alias("coverage"), F.round(D.ratio(F.col("right"), F.col("accepted")), 6).alias("precision"), "accepted")


_DUP = "count(*) FILTER (WHERE p AND actual = 1) AS tp, count(*) FILTER (WHERE p AND actual = 0) AS fp, count(*) FILTER (WHERE NOT p AND actual = 1) AS fn, count(*) FILTER (WHERE NOT p AND actual = 0) AS tn"


@query(DUPS + f"SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM (SELECT {_DUP} FROM (SELECT *, similarity >= 0.1 AS p FROM dup))")
def dup_metrics(spark, sf_dir):
    return rounded(D.counts(_next(spark, sf_dir).withColumn("predicted", (F.col("similarity") >= 0.1).cast("int"))), "precision", "recall", "f1")


@query(DUPS + f", g AS (SELECT threshold, {_DUP} FROM (SELECT threshold, actual, similarity >= threshold AS p FROM dup, (VALUES {', '.join(f'({t / 20 - 0.3:.2f}::DOUBLE)' for t in range(14))}) g(threshold)) GROUP BY 1) SELECT threshold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM g ORDER BY 2 DESC, 1 LIMIT 1")
def best_threshold(spark, sf_dir):
    swept = _next(spark, sf_dir).crossJoin(grid(spark, [f"{t / 20 - 0.3:.2f}" for t in range(14)])).withColumn("predicted", (F.col("similarity") >= F.col("threshold")).cast("int"))
    return rounded(D.counts(swept, "threshold"), "f1").select("threshold", "f1").orderBy(F.desc("f1"), "threshold").limit(1)


@query(SIMS + f", own AS (SELECT q.id AS query, i.id, round(list_dot_product(q.v, i.v), 9) AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.v, i.v), 9) DESC, i.id) AS rank FROM u q JOIN u i ON q.id <> i.id WHERE q.id % 5 <> 0 AND i.id % 5 <> 0), s AS (SELECT o.query, l.persona, sum(CASE WHEN b.id IS NOT NULL THEN greatest(similarity, 0) ELSE 0 END) / sum(greatest(similarity, 0)) AS support FROM own o JOIN labelled l ON l.id = o.query LEFT JOIN labelled b ON b.id = o.id AND b.persona = l.persona WHERE rank <= {K} GROUP BY 1, 2) SELECT query, persona, round(support, 6) AS support FROM s")
def label_quality(spark, sf_dir):
    """How far an item's nearest labelled neighbours bear out its own labels."""
    v = vectors(spark, sf_dir).where("id % 5 <> 0")
    own = labels(spark, sf_dir).where("id % 5 <> 0")
    scored = D.knn_scores(V.top_k(v, v, K), own, vocabulary(spark, sf_dir), K)
    return rounded(scored.join(own.withColumnRenamed("id", "query"), ["query", "persona"]).withColumnRenamed("score", "support"), "support")


@query()
def ovr_lr_scores(spark, sf_dir):
    """One L2 logistic regression a label, with balanced weights and an unpenalised intercept."""
    v, known = vectors(spark, sf_dir), labels(spark, sf_dir)
    models = L.fit(v.where("id % 5 <> 0"), known, D.label_names(vocabulary(spark, sf_dir)), 3.0)
    return L.scores(v.where("id % 5 = 0"), models)


@query()
def lr_predict(spark, sf_dir):
    return ovr_lr_scores(spark, sf_dir).where("score >= 0.5").select("query", "persona")


@query()
def lr_top(spark, sf_dir):
    return D.ranked(ovr_lr_scores(spark, sf_dir)).where("rank <= 3")


_CS = [0.3, 3.0]


def lr_search(spark, sf_dir, penalties: list[float], fit_on: str, ask: str) -> DataFrame:
    """(c, threshold, macro_f1, ...) of logistic models fitted on some items and judged on others, best first; ties go
    to the setting listed first."""
    v, known, names = stage(vectors(spark, sf_dir), "vectors"), labels(spark, sf_dir), D.label_names(vocabulary(spark, sf_dir))
    models = L.fit_each(v.where(fit_on), known, names, penalties)
    judged_ = judged(spark, sf_dir, scored=stage(L.scores(v.where(ask), models, "c"), "lr")).crossJoin(grid(spark, _GRID)).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    return D.multilabel(judged_, "c", "threshold").orderBy(F.desc("macro_f1"), F.desc("micro_f1"), "c", "threshold")


@query()
def lr_grid(spark, sf_dir):
    """Penalty and threshold of the logistic models, fitted on three fifths and judged on one."""
    return rounded(lr_search(spark, sf_dir, _CS, "id % 5 > 1", "id % 5 = 1"), *_MC)


@query()
def final_compare(spark, sf_dir):
    """Both kinds of model with the setting that was best on the development fifth, judged once on the test fifth."""
    best = lr_search(spark, sf_dir, _CS, "id % 5 > 1", "id % 5 = 1").first()
    logistic = lr_search(spark, sf_dir, [best.c], "id % 5 > 1", "id % 5 = 0").where(F.col("threshold") == best.threshold)
    v, known = vectors(spark, sf_dir), labels(spark, sf_dir).where("id % 5 > 1")

    def knn(ask: str, ks: list[int]) -> DataFrame:
        scored = D.knn_grid(V.top_k(v.where(ask), v.where("id % 5 > 1"), max(ks)), known, vocabulary(spark, sf_dir), ks, [1])
        swept_ = judged(spark, sf_dir, scored=scored).crossJoin(grid(spark, _GRID)).withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
        return D.multilabel(swept_, "k", "threshold").orderBy(F.desc("macro_f1"), F.desc("micro_f1"), "k", "threshold")

    top = knn("id % 5 = 1", _KS).first()
    near = knn("id % 5 = 0", [top.k]).where(F.col("threshold") == top.threshold)
    row = lambda df, kind, setting: df.select(F.lit(kind).alias("model"), F.col(setting).cast("double").alias("setting"), "threshold", *_MC)
    return rounded(row(near, "knn", "k").unionByName(row(logistic, "logistic", "c")), *_MC)


@query(DECIDED + "SELECT query, decision, round(top, 6) AS confidence, CASE decision WHEN 'abstain' THEN '' WHEN 'suggest_with_caution' THEN (SELECT persona FROM ranked r WHERE r.query = d.query AND rank = 1) ELSE (SELECT string_agg(persona, ',' ORDER BY rank) FROM ranked r WHERE r.query = d.query AND rank <= 3 AND score >= 0.5::DOUBLE) END AS personas FROM decided d")
def abstention(spark, sf_dir):
    made = D.abstain(scores(spark, sf_dir), SUGGEST, CAUTION, MARGIN)
    return rounded(made.withColumn("personas", F.array_join("personas", ",")), "confidence")


@query(DECIDED + "SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'suggest') AS suggest, count(*) FILTER (WHERE decision = 'suggest_with_caution') AS caution, count(*) FILTER (WHERE decision = 'abstain') AS abstain, round(count(*) FILTER (WHERE decision <> 'abstain') / count(*)::DOUBLE, 6) AS coverage FROM decided")
def abstention_summary(spark, sf_dir):
    return rounded(D.summary(D.abstain(scores(spark, sf_dir), SUGGEST, CAUTION, MARGIN)), "coverage")


@query(DECIDED + "SELECT decision, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM decided GROUP BY 1")
def decision_distribution(spark, sf_dir):
    made = D.abstain(scores(spark, sf_dir), SUGGEST, CAUTION, MARGIN)
    n = made.agg(F.count(F.lit(1)).alias("all"))
    return made.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).select("decision", "n", F.round(100 * F.col("n") / F.col("all"), 6).alias("percent"))


_CONFIGS = [(s, c, m) for s in (0.4, 0.5, 0.6) for c in (0.25, 0.3, 0.35) for m in (0.0, 0.05, 0.1)]
_CONFIG_SQL = ", ".join(f"({s}::DOUBLE, {c}::DOUBLE, {m}::DOUBLE)" for s, c, m in _CONFIGS)


@query(RANKED + f", best AS (SELECT query, top, second, max(CASE WHEN rank = 1 THEN persona END) AS p1, max(CASE WHEN rank = 1 THEN actual END) AS a1 FROM tops JOIN ranked USING (query) GROUP BY 1, 2, 3), made AS (SELECT s, c, m, b.query, CASE WHEN top >= s AND top - second >= m THEN 2 WHEN top >= c THEN 1 ELSE 0 END AS d, a1 FROM best b, (VALUES {_CONFIG_SQL}) g(s, c, m)), j AS (SELECT made.*, CASE d WHEN 0 THEN 0 WHEN 1 THEN a1 ELSE (SELECT max(actual) FROM ranked r WHERE r.query = made.query AND rank <= 3 AND score >= s) END AS ok FROM made) SELECT s AS suggest, c AS caution, m AS margin, round(avg(CAST(d > 0 AS INT)), 6) AS coverage, round(coalesce(sum(ok) / nullif(count(*) FILTER (WHERE d > 0), 0)::DOUBLE, 0), 6) AS precision FROM j GROUP BY 1, 2, 3")
def abstention_grid(spark, sf_dir):
    """Coverage and precision of each policy; a suggestion is right if any of its labels is."""
    best = D.ranked(judged(spark, sf_dir)).where("rank <= 3").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "actual"))).alias("best"))
    g = F.broadcast(spark.createDataFrame(_CONFIGS, "suggest double, caution double, margin double"))
    top, second = F.col("best")[0]["score"], F.coalesce(F.get("best", F.lit(1))["score"], F.lit(0.0))
    made = best.crossJoin(g).withColumn("d", D.decision(top, top - second, F.col("suggest"), F.col("caution"), F.col("margin")))
    several = F.exists(F.col("best"), lambda b: (b["score"] >= F.col("suggest")) & (b["actual"] == 1))
    ok = F.when(F.col("d") == "suggest", several).when(F.col("d") == "suggest_with_caution", F.col("best")[0]["actual"] == 1).otherwise(F.lit(False))
    out = made.withColumn("ok", ok).groupBy("suggest", "caution", "margin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") != "abstain").alias("taken"), F.count_if("ok").alias("right"))
    return out.select("suggest", "caution", "margin", F.round(F.col("taken") / F.col("n"), 6).alias("coverage"), F.round(D.ratio(F.col("right"), F.col("taken")), 6).alias("precision"))


@query(RANKED + "SELECT query, CASE WHEN n.similarity >= 0.3 AND top >= 0.5 AND top - second >= 0.15 THEN 'suggest' WHEN n.similarity >= 0.2 AND top >= 0.3 THEN 'suggest_with_caution' ELSE 'abstain' END AS decision FROM tops JOIN near n USING (query) WHERE n.rank = 1")
def evidence_abstention(spark, sf_dir):
    near = neighbours(spark, sf_dir)
    m = D.margins(scores(spark, sf_dir, near=near)).join(near.where("rank = 1").select("query", "similarity"), "query")
    s, top = F.col("similarity"), F.col("top")
    return m.select("query", F.when((s >= 0.3) & (top >= 0.5) & (F.col("margin") >= 0.15), "suggest").when((s >= 0.2) & (top >= 0.3), "suggest_with_caution").otherwise("abstain").alias("decision"))


@query(RANKED + "SELECT query, round(top, 6) AS top, n.id AS nearest, round(n.similarity, 6) AS similarity FROM tops JOIN near n USING (query) WHERE n.rank = 1 AND top >= 0.4 AND n.similarity < 0.4")
def suspicious_predictions(spark, sf_dir):
    near = neighbours(spark, sf_dir)
    m = D.margins(scores(spark, sf_dir, near=near)).join(near.where("rank = 1").select("query", F.col("id").alias("nearest"), "similarity"), "query")
    return rounded(m.where("top >= 0.4 and similarity < 0.4").select("query", "top", "nearest", "similarity"), "top", "similarity").orderBy(F.desc("top"), "similarity")


@query(RANKED + f"SELECT {', '.join(f'round(quantile_cont(top, {q}), 6) AS q{i}' for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95)))} FROM tops")
def score_quantiles(spark, sf_dir):
    return D.margins(scores(spark, sf_dir)).agg(*[F.round(F.percentile("top", F.lit(q)), 6).alias(f"q{i}") for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))])


def suggestions(spark, sf_dir) -> DataFrame:
    """One record for each query: decision, labels with scores, evidence and a sentence; similarities are worked
    out once for all of it."""
    near = stage(neighbours(spark, sf_dir, 20), "near")
    scored = D.ranked(scores(spark, sf_dir, near=near))
    made = D.abstain(scored.drop("rank"), SUGGEST, CAUTION, MARGIN)
    picked = made.select("query", F.explode("personas").alias("persona"))
    names = picked.join(scored, ["query", "persona"]).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "persona", F.round("score", 4).alias("score")))).alias("ranked"))
    all_labels = labels(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list("persona")).alias("confirmed"))
    proof = evidence_by_persona(spark, sf_dir, near).join(picked, ["query", "persona"], "left_semi").select("query", "id", F.round("similarity", 4).alias("similarity"), (F.col("similarity") >= 0.88).alias("near_duplicate")).distinct().join(all_labels, "id")
    order = lambda e: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "id", "similarity", "near_duplicate", "confirmed"))), lambda x: F.struct(x["id"].alias("id"), x["similarity"].alias("similarity"), x["near_duplicate"].alias("near_duplicate"), x["confirmed"].alias("confirmed")))
    proof = proof.groupBy("query").agg(order(None).alias("evidence"))
    out = made.drop("personas").join(names, "query", "left").join(proof, "query", "left")
    kind = "array<struct<id: bigint, similarity: double, near_duplicate: boolean, confirmed: array<string>>>"
    evidence = F.coalesce("evidence", F.array().cast(kind))
    level = F.when(F.col("decision") == "suggest", "high").when(F.col("decision") == "suggest_with_caution", "medium").otherwise("low")
    personas = F.coalesce(F.transform("ranked", lambda x: F.struct(x["persona"].alias("name"), x["score"].alias("score"))), F.array().cast("array<struct<name: string, score: double>>"))
    return out.select("query", "decision", level.alias("confidence"), personas.alias("personas"), evidence.alias("evidence")).withColumn("rationale", F.when(F.size("personas") > 0, T.rationale(F.col("personas")[0]["name"], F.col("evidence"))).otherwise("No label is well enough supported."))


@query()
def suggest(spark, sf_dir):
    return suggestions(spark, sf_dir)


@query()
def suggestion_json(spark, sf_dir):
    s = suggestions(spark, sf_dir)
    return s.select("query", F.to_json(F.struct(*s.columns)).alias("record"))


@query()
def template_rationale(spark, sf_dir):
    return suggestions(spark, sf_dir).select("query", "rationale")


def violations(record: DataFrame) -> DataFrame:
    """What is wrong with records (personas, decision, rationale): codes in an array, empty if nothing is."""
    names = F.transform("personas", lambda p: p["name"])
    found = F.array(
        F.when(F.exists("personas", lambda p: ~p["score"].between(0, 1)), "score"),
        F.when(~F.col("decision").isin("suggest", "suggest_with_caution", "abstain"), "decision"),
        F.when(F.size(F.array_distinct(names)) < F.size(names), "repeated"),
        F.when(F.trim("rationale") == "", "blank"),
    )
    return record.withColumn("violations", F.filter(found, lambda x: x.isNotNull()))


@query("SELECT vec_id, concat_ws(',', CASE WHEN vec_id % 5 = 0 THEN 'score' END, CASE WHEN vec_id % 7 = 0 THEN 'decision' END, CASE WHEN vec_id % 3 = 0 THEN 'repeated' END, CASE WHEN vec_id % 2 = 0 THEN 'blank' END) AS violations FROM embeddings")
def schema_violations(spark, sf_dir):
    on = lambda n: F.col("vec_id") % n == 0
    score = F.when(on(5), 1.5).otherwise(0.5)
    two = F.array(F.struct(F.lit("A").alias("name"), score.alias("score")), F.struct(F.when(on(3), "A").otherwise("B").alias("name"), F.lit(0.1).alias("score")))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", two.alias("personas"), F.when(on(7), "maybe").otherwise("suggest").alias("decision"), F.when(on(2), " ").otherwise("why").alias("rationale"))
    return violations(rows).select("vec_id", F.array_join("violations", ",").alias("violations"))

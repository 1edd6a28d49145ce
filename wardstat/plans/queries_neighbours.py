"""Registered queries, part 4: exact neighbours, SMOTE and Tomek links on
the ``embeddings`` table (64-dim vectors)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours as nb
from ..sources.tables import table
from .registry import register

DIST = ("list_reduce(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])), "
        "lambda acc, x: acc + x)")
E = """WITH e AS (SELECT vec_id, label, CASE WHEN label = 0 THEN 1 ELSE 0 END AS y,
                  CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""


def emb(spark, sf):
    return table(spark, sf, "embeddings")


def emb_binary(spark, sf):
    e = emb(spark, sf)
    return e.select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("y"))


@register("knn_within_label", E + f"""
, p AS (SELECT a.vec_id, b.vec_id AS nb_key, {DIST} AS dist2 FROM e a JOIN e b
        ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist2, md5(CAST(nb_key AS VARCHAR)), nb_key) AS nb_rank FROM p)
SELECT vec_id, CAST(nb_rank AS INTEGER) AS nb_rank, nb_key, round(dist2, 6) AS dist2 FROM r WHERE nb_rank <= 5""")
def q_knn(spark, sf):
    k = nb.knn(emb(spark, sf), "vec_id", "embedding", 5, block=["label"])
    return k.select("vec_id", "nb_rank", "nb_key", F.round("dist2", 6).alias("dist2"))


SMOTE_SQL = E + f"""
, mino AS (SELECT * FROM e WHERE y = 1),
nn AS (SELECT * FROM (SELECT a.vec_id, b.vec_id AS nb_key, row_number() OVER (PARTITION BY a.vec_id
         ORDER BY {DIST}, md5(CAST(b.vec_id AS VARCHAR)), b.vec_id) AS nb_rank FROM mino a JOIN mino b ON a.vec_id <> b.vec_id) WHERE nb_rank <= 5),
rk AS (SELECT vec_id, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) AS row_ FROM mino),
cnt AS (SELECT (SELECT count(*) FROM e WHERE y = 0) - (SELECT count(*) FROM mino) AS need,
               (SELECT count(*) FROM mino) AS n_min),
dr AS (SELECT range AS i,
         (('0x' || substr(md5('42:' || CAST(range AS VARCHAR) || ':n'), 1, 15))::BIGINT) % (n_min * 5) AS cellno,
         CAST(('0x' || substr(md5('42:' || CAST(range AS VARCHAR) || ':u'), 1, 15))::BIGINT AS DOUBLE)
           / 1152921504606846976.0 AS u
       FROM cnt, range(0, (SELECT need FROM cnt))),
pk AS (SELECT dr.i, dr.u, rk.vec_id AS x_key, nn.nb_key FROM dr
       JOIN rk ON rk.row_ = dr.cellno // 5 + 1
       JOIN nn ON nn.vec_id = rk.vec_id AND nn.nb_rank = dr.cellno % 5 + 1),
syn AS (SELECT -(pk.i + 1) AS vec_id, 1 AS y, 1 AS synthetic, pk.x_key, pk.nb_key, pk.u,
          list_transform(range(1, len(a.v) + 1), lambda j: a.v[j] + pk.u * (b.v[j] - a.v[j])) AS v
        FROM pk JOIN e a ON a.vec_id = pk.x_key JOIN e b ON b.vec_id = pk.nb_key),
allr AS (SELECT vec_id, y, 0 AS synthetic, vec_id AS x_key, CAST(NULL AS BIGINT) AS nb_key,
           CAST(NULL AS DOUBLE) AS u, v FROM e UNION ALL SELECT * FROM syn)"""


@register("smote_embeddings", SMOTE_SQL + """
SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(synthetic AS INTEGER) AS synthetic, x_key, nb_key, round(u, 9) AS u,
  round(v[1], 6) AS v_first, round(list_reduce(v, lambda acc, x: acc + x), 6) AS v_sum FROM allr""")
def q_smote(spark, sf):
    s = nb.smote(emb_binary(spark, sf), "vec_id", "embedding", "y", minority=1, k=5, seed=42)
    return s.select("vec_id", "y", "synthetic", "x_key", "nb_key", F.round("u", 9).alias("u"),
                    F.round(F.col("embedding")[0], 6).alias("v_first"),
                    F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("v_sum"))


@register("tomek_links", E + f"""
, nn AS (SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id
         ORDER BY {DIST}, md5(CAST(b.vec_id AS VARCHAR)), b.vec_id) AS rk FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rk = 1),
m AS (SELECT x.a, x.b FROM nn x JOIN nn y ON x.a = y.b AND x.b = y.a)
SELECT m.a, m.b FROM m JOIN e ea ON ea.vec_id = m.a JOIN e eb ON eb.vec_id = m.b
WHERE ea.y <> eb.y AND m.a < m.b""")
def q_tomek(spark, sf):
    return nb.tomek_links(emb_binary(spark, sf), "vec_id", "embedding", "y")


@register("smote_tomek_counts", SMOTE_SQL + f"""
, nn2 AS (SELECT * FROM (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id
          ORDER BY {DIST}, md5(CAST(b.vec_id AS VARCHAR)), b.vec_id) AS rk FROM allr a JOIN allr b ON a.vec_id <> b.vec_id) WHERE rk = 1),
mutual AS (SELECT x.a, x.b FROM nn2 x JOIN nn2 z ON x.a = z.b AND x.b = z.a),
gone AS (SELECT mutual.a AS k FROM mutual JOIN allr p ON p.vec_id = mutual.a JOIN allr q ON q.vec_id = mutual.b WHERE p.y <> q.y)
SELECT CAST(y AS INTEGER) AS y, CAST(synthetic AS INTEGER) AS synthetic, count(*) AS n FROM allr
WHERE vec_id NOT IN (SELECT k FROM gone) GROUP BY y, synthetic""")
def q_smote_tomek(spark, sf):
    s = nb.smote_tomek(emb_binary(spark, sf), "vec_id", "embedding", "y", minority=1, k=5, seed=42)
    return s.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))

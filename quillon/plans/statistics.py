"""Queries that end in statistics of small matrices: those over countries
(a fixed dimension) by SQL where it can say them, else on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillon.functions import stats
from quillon.operators import cluster as cl
from quillon.operators import graph as gr
from quillon.operators import matrix as mx
from quillon.operators import panel as pn

from .base import CODES, COLUMNS, MATRIX, codes_of, query, table, units
from .corpus import _matrix, _panel

BLOCKS = [slice(0, 4), slice(4, 7)]


def _counts(spark, sf):
    """Countries by codes: a matrix of the dimension's size."""
    return mx.counts_by(_matrix(spark, sf, "country"), "country", COLUMNS).orderBy("country").toPandas()


_S = f"WITH {MATRIX}, s AS (SELECT country, min(bloc) AS bloc, {', '.join(f'avg({c}) AS {c}' for c in COLUMNS)} FROM matrix GROUP BY country)"
_DIST = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in COLUMNS) + ")"


@query(f"{_S}, d AS (SELECT a.country, a.bloc, b.bloc AS other, {_DIST} AS d, a.country = b.country AS self FROM s a, s b), m AS (SELECT country, bloc, other, sum(d) / nullif(count(*) - CAST(bloc = other AS INTEGER), 0) AS m FROM d GROUP BY country, bloc, other), t AS (SELECT country, bloc, max(CASE WHEN bloc = other THEN m END) AS a, min(CASE WHEN bloc <> other THEN m END) AS b FROM m GROUP BY ALL) SELECT country, bloc, round((b - a) / greatest(a, b), 6) AS silhouette FROM t")
def silhouette(spark, sf):
    """Pairs of countries, a dimension of fixed size."""
    s = _matrix(spark, sf, "country", "bloc").groupBy("country").agg(F.min("bloc").alias("bloc"), *[F.avg(c).alias(c) for c in COLUMNS])
    o = F.broadcast(s.select(F.col("country").alias("oc"), F.col("bloc").alias("other"), *[F.col(c).alias(f"o_{c}") for c in COLUMNS]))
    d = F.sqrt(sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in COLUMNS), F.lit(0.0)))
    p = s.join(o, F.col("country") != F.col("oc")).withColumn("d", d)
    m = p.groupBy("country", "bloc", "other").agg(F.avg("d").alias("m"))
    t = m.groupBy("country", "bloc").agg(F.max(F.when(F.col("bloc") == F.col("other"), F.col("m"))).alias("a"), F.min(F.when(F.col("bloc") != F.col("other"), F.col("m"))).alias("b"))
    return t.select("country", "bloc", F.round((F.col("b") - F.col("a")) / F.greatest("a", "b"), 6).alias("silhouette"))


@query(f"{_S}, p AS (SELECT a.country AS src, b.country AS dst, list_cosine_similarity([{', '.join(f'a.{c}' for c in COLUMNS)}], [{', '.join(f'b.{c}' for c in COLUMNS)}]) AS w FROM s a JOIN s b ON a.country <> b.country), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(w, 9) DESC, dst) <= 5) SELECT least(src, dst) AS src, greatest(src, dst) AS dst, round(max(w), 6) AS weight FROM k GROUP BY 1, 2")
def similarity_graph(spark, sf):
    s = _matrix(spark, sf, "country").groupBy(F.col("country").alias("id")).agg(F.array(*[F.avg(c) for c in COLUMNS]).alias("v"))
    return gr.undirected(gr.nearest(s, s, 5)).withColumn("weight", F.round("weight", 6))


@query("WITH r AS (SELECT unnest(range(5)) AS replicate), l AS (SELECT n_name AS g, replicate, (n_nationkey * (replicate + 2) + replicate) % 4 AS label FROM nation, r) SELECT a.g AS a, b.g AS b, round(count(*) / 5, 6) AS share FROM l a JOIN l b ON a.replicate = b.replicate AND a.label = b.label GROUP BY ALL")
def cocluster_freq(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("g"), "n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("replicate"))
    l = n.select("g", "replicate", ((F.col("n_nationkey") * (F.col("replicate") + 2) + F.col("replicate")) % 4).alias("label"))
    return cl.co_clustering(l, "g").withColumn("share", F.round("share", 6))


@query()
def ward_clusters(spark, sf):
    c = _counts(spark, sf)
    x = cl.clr_matrix(c[COLUMNS].to_numpy(float), BLOCKS)
    k = cl.choose_k(x, range(2, 7), {})
    labels = stats.cut_tree(stats.ward(x), k)
    s = stats.silhouette(x, labels)
    rows = [(a, int(n), int(k), int(l), round(float(v), 6)) for a, n, l, v in zip(c["country"], c["n"], labels, s)]
    return spark.createDataFrame(rows, "country string, n_paragraphs long, k int, cluster int, silhouette double")


@query()
def bootstrap_stability(spark, sf):
    patterns = cl.design(_matrix(spark, sf, "country"), "country", COLUMNS).toPandas()  # countries x patterns, both fixed
    c = _counts(spark, sf)
    labels = stats.cut_tree(stats.ward(cl.clr_matrix(c[COLUMNS].to_numpy(float), BLOCKS)), 3)
    base = spark.createDataFrame(list(zip(c["country"], labels.tolist())), "country string, label int")
    reps = cl.replicates(spark, patterns, "country", COLUMNS, BLOCKS, [3], 40).drop("k")
    return cl.stability(reps, base, "country")


@query()
def ca_coords(spark, sf):
    c = _counts(spark, sf)
    ca = stats.correspondence(c[COLUMNS].to_numpy(float))
    rows = [("row", n, *map(float, v[:2]), float(m)) for n, v, m in zip(c["country"], ca["rows"], ca["row_mass"])]
    rows += [("column", n, *map(float, v[:2]), float(m)) for n, v, m in zip(COLUMNS, ca["columns"], ca["column_mass"])]
    return spark.createDataFrame(rows, "kind string, name string, dim1 double, dim2 double, mass double")


@query()
def louvain(spark, sf):
    e = similarity_graph(spark, sf).collect()  # at most 5 edges a country
    names = sorted({x for r in e for x in (r["src"], r["dst"])})
    at = {n: i for i, n in enumerate(names)}
    label, q = stats.louvain(len(names), [(at[r["src"]], at[r["dst"]], r["weight"]) for r in e])
    return spark.createDataFrame([(n, int(c), round(q, 9)) for n, c in zip(names, label)], "country string, community int, modularity double")


@query()
def hungarian_align(spark, sf):
    m = _matrix(spark, sf, "country", "date")
    pooled = _counts(spark, sf)
    late = mx.counts_by(m.where("date >= date'1998-01-01'"), "country", COLUMNS).orderBy("country").toPandas()
    x, y = (cl.clr_matrix(d[COLUMNS].to_numpy(float), BLOCKS) for d in (pooled, late))
    a, b = stats.cut_tree(stats.ward(x), 3), stats.cut_tree(stats.ward(y), 4)
    return spark.createDataFrame(sorted(cl.align(y, b, x, a).items()), "phase_cluster int, pooled_cluster int")


def _table_of(spark, fit):
    rows = [] if fit is None else [(c, fit["coef"][c], fit.get("se", {}).get(c), fit.get("p", {}).get(c), fit["n"], fit["groups"]) for c in pn.REGRESSORS]
    return spark.createDataFrame(rows, "term string, coef double, se double, p double, n long, groups int")


@query()
def lpm_event(spark, sf):
    return _table_of(spark, pn.linear(_panel(spark, sf)))


@query()
def wls_event(spark, sf):
    return _table_of(spark, pn.linear(pn.cells(_panel(spark, sf)), weight="w"))


@query()
def logit_event(spark, sf):
    return _table_of(spark, pn.logistic(_panel(spark, sf)))


@query()
def sensitivity(spark, sf):
    """Partitions under variants of the annotations, against the main one."""
    u, ann = units(spark, sf).select("unit_id", "country"), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"), "l_discount", "l_tax")
    variants = {"main": ann, "a confident": ann.where("l_discount <= 0.05"), "b verified": ann.where("l_tax <= 0.06"), "c one dimension": ann.withColumn("linestatus", F.lit(None).cast("string"))}
    rows, main = [], None
    for name, own in variants.items():
        c = mx.counts_by(mx.code_matrix(u, own, CODES, keep=("country",)), "country", COLUMNS).orderBy("country").toPandas()
        labels = stats.cut_tree(stats.ward(cl.clr_matrix(c[COLUMNS].to_numpy(float), BLOCKS)), 2)
        main = labels if main is None else main
        ari = stats.adjusted_rand(main, labels)
        rows.append((name, len(c), float(ari), bool(np.isclose(ari, 1))))
    out = spark.createDataFrame(rows, "variant string, countries int, ari double, same boolean")
    from quillon.functions.numbers import verdict

    return out.withColumn("verdict", verdict(F.col("ari")))

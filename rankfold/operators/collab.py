"""Collaborative model (M12-M19, A8-A11): truncated SVD of the strength matrix.

The matrix is the long strength table (user_id, item_id, strength); zeros are
absent rows. ``operators.svd`` decomposes it by one method for every size; both
factor tables stay distributed. Factor signs and rotations inside equal singular
values are arbitrary; every consumer (dot products, norms, cosines) is invariant.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankfold import fixed
from rankfold.functions.scalar import clip01, once
from rankfold.operators import svd
from rankfold.operators.blockdot import top_n_dot
from rankfold.operators.heavy import materialise
from rankfold.operators.numbering import numbered
from rankfold.session import ship_package


@dataclass
class CollabModel:
    user_factors: DataFrame   # user_id, f array<double>   (U * S)
    item_factors: DataFrame   # item_id, f array<double>   (V)
    k: int
    global_mean: float
    info: dict


def _pad(df: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Ids absent from ``df`` get a zero row."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return (ids.join(df, "id", "left")
            .select("id", F.coalesce(F.col("arr"), zeros).alias("arr")))


# --- training -------------------------------------------------------------------

def n_factors_for(n_rows: int, n_cols: int, requested: int = fixed.N_FACTORS) -> int:
    return max(1, min(requested, min(n_rows, n_cols) - 1, fixed.N_FACTORS_CAP))


def train(strengths: DataFrame, n_factors: int = fixed.N_FACTORS,
          n_iterations: int = fixed.N_ITERATIONS, seed: int = 42) -> CollabModel:
    """M13 on the long strength table; users and items = those with interactions (A2)."""
    ship_package(strengths.sparkSession)
    strengths = strengths.select("user_id", "item_id", "strength").persist()  # read ~6 times below
    users = strengths.select(F.col("user_id").alias("id")).distinct().cache()
    items = strengths.select(F.col("item_id").alias("id")).distinct().cache()
    # one job: matrix shape and the statistics of the positive cells
    st = strengths.agg(F.countDistinct("user_id").alias("n_u"), F.countDistinct("item_id").alias("n_i"),
                       F.avg(F.when(F.col("strength") > 0, F.col("strength"))).alias("gmean"),
                       F.sum(F.when(F.col("strength") > 0, 1).otherwise(0)).alias("n_gt0")).first()
    n_u, n_i = int(st["n_u"]), int(st["n_i"])
    if n_u == 0 or n_i == 0:
        raise ValueError("Empty interaction matrix")
    k = n_factors_for(n_u, n_i, n_factors)
    pos = strengths.where(F.col("strength") != 0).select("user_id", "item_id", F.col("strength").alias("s"))
    pos = pos.cache()

    # the short side is the column side
    if n_i <= n_u:
        row_key, col_key, row_ids, col_ids, n_r, n_c = "user_id", "item_id", users, items, n_u, n_i
    else:
        row_key, col_key, row_ids, col_ids, n_r, n_c = "item_id", "user_id", items, users, n_i, n_u
    d = svd.truncated_svd(pos, row_key, col_key, col_ids, n_r, n_c, k, n_iterations, seed)
    sig, k_eff = d.sigma, len(d.sigma)
    long_side = _pad(svd.multiply(pos, d.columns, col_key, row_key, n_c, k_eff, n_r), row_ids, k_eff)  # A V = U S
    unscale = 1.0 / np.where(sig > 0, sig, 1.0)
    if col_key == "item_id":
        user_f, item_f = long_side.cache(), d.columns
    else:
        # transposed problem: A' V' = U' S, so item factors = U' and user factors = V' S
        user_f = svd.mapped(d.columns, lambda v: v * sig).cache()
        item_f = svd.mapped(long_side, lambda u: u * unscale).cache()
    user_f = user_f.select(F.col("id").alias("user_id"), F.col("arr").alias("f"))
    item_f = item_f.select(F.col("id").alias("item_id"), F.col("arr").alias("f"))

    gmean = float(st["gmean"] or 0.0)
    info = {"num_users": n_u, "num_items": n_i, "n_factors": k_eff,
            "sparsity": float(1 - (st["n_gt0"] or 0) / (n_u * n_i)),
            "residual": d.residual, "steps": d.steps, "singular_values": [float(x) for x in sig]}
    model = CollabModel(user_f, item_f, k_eff, gmean, info)
    info["reconstruction_mse"] = reconstruction_mse(model, strengths)
    info["explained_variance_ratio"] = explained_variance_ratio(model, strengths, n_u)
    return model


def reconstruction_mse(model: CollabModel, strengths: DataFrame) -> float:
    """A10: mean squared error of U S V' over strictly positive cells."""
    pos = strengths.where(F.col("strength") > 0).select("user_id", "item_id", F.col("strength").alias("s"))
    n, e = svd.squared_error(pos, _arrays(model.user_factors, "user_id"), _arrays(model.item_factors, "item_id"),
                             "user_id", "item_id", model.info["num_users"], model.info["num_items"], model.k)
    return e / n if n else 0.0


def _arrays(factors: DataFrame, key: str) -> DataFrame:
    return factors.select(F.col(key).alias("id"), F.col("f").alias("arr"))


def explained_variance_ratio(model: CollabModel, strengths: DataFrame, n_u: int) -> float:
    """Sum of population variances of the U S columns over the total
    population variance of the matrix columns (zeros included)."""
    col = strengths.groupBy("item_id").agg(F.sum("strength").alias("s1"),
                                           F.sum(F.col("strength") ** 2).alias("s2"))
    tot = col.select(F.sum(F.col("s2") / n_u - (F.col("s1") / n_u) ** 2)).first()[0] or 0.0
    k = model.k
    ex = model.user_factors.select(F.posexplode("f").alias("j", "x")) \
        .groupBy("j").agg(F.var_pop("x").alias("v")).agg(F.sum("v")).first()[0] or 0.0
    return float(ex / tot) if tot > 0 and k > 0 else 0.0


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _norm(a):
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x))


def _unit(a):
    return once(_norm(a), lambda n: F.when(n > 1e-12, F.transform(a, lambda x: x / n)))


# --- serving ----------------------------------------------------------------------

def predict_rating(model: CollabModel, pairs: DataFrame) -> DataFrame:
    """(user_id, item_id) -> clipped dot; unknown user or item -> global mean."""
    r = (pairs.join(model.user_factors.withColumnRenamed("f", "uf"), "user_id", "left")
         .join(model.item_factors.withColumnRenamed("f", "vf"), "item_id", "left"))
    known = F.col("uf").isNotNull() & F.col("vf").isNotNull()
    return r.select("user_id", "item_id",
                    F.when(known, clip01(_dot(F.col("uf"), F.col("vf"))))
                     .otherwise(F.lit(model.global_mean)).alias("prediction"))


def popular_items(model: CollabModel, n: int) -> DataFrame:
    """M15 without exclusions: top n items by the L2 norm of their V row, divided
    by the largest. Returns (rank, item_id, score); at most n rows."""
    w = Window.orderBy(F.round("nv", fixed.RANK_PLACES).desc(), F.col("item_id"))
    top = (model.item_factors.select("item_id", _norm(F.col("f")).alias("nv"))
           .orderBy(F.round("nv", fixed.RANK_PLACES).desc(), F.col("item_id")).limit(n))
    top = top.withColumn("rank", F.row_number().over(w))
    mx = F.max("nv").over(Window.partitionBy())
    return top.select("rank", "item_id",
                      F.when(mx > 0, F.col("nv") / mx).otherwise(F.lit(0.0)).alias("score"))


def recommend(model: CollabModel, users: DataFrame, exclude: DataFrame | None, n: int | DataFrame) -> DataFrame:
    """M16 + M15 + J9 for a set of users: (user_id, rank, item_id, score). ``n`` is a
    number or a table (user_id, n).

    Known users: U S V' row, excluded items removed, top n on the raw score,
    clipped. Users without factors: the popular list without their excluded items.
    """
    us = users.select("user_id").distinct()
    us = us.join(n.select("user_id", "n"), "user_id") if isinstance(n, DataFrame) else us.withColumn("n", F.lit(n))
    excl = exclude.select("user_id", "item_id").distinct() if exclude is not None else None
    q = us.join(model.user_factors, "user_id").select(F.col("user_id").alias("qid"), "n", F.col("f").alias("val"))
    cand = top_n_dot(q, model.item_factors.select(F.col("item_id").alias("cid"), F.col("f").alias("val")),
                     "n", dense=True, n_cands=model.info.get("num_items"),
                     exclude=None if excl is None else
                     excl.select(F.col("user_id").alias("qid"), F.col("item_id").alias("cid")))
    warm = cand.select(F.col("qid").alias("user_id"), "rank", F.col("cid").alias("item_id"),
                       clip01(F.col("score")).alias("score"))
    cold_users = us.join(model.user_factors.select("user_id"), "user_id", "left_anti")
    return warm.unionByName(_cold(model, cold_users, excl))


#: places that are sent to every task of the cold users' join
HEAD_PLACES = 1000


def _cold(model: CollabModel, users: DataFrame, excl: DataFrame | None) -> DataFrame:
    """M15 per user (user_id, n): the popular list without the user's excluded items, cut to
    n, divided by the largest value left.

    Users without exclusions who ask for the same number get the same list (``_same_list``).
    Of the others, a user's j-th excluded place p takes a place of the first n away if
    p - j < n, so a user looks as far as n and that many more places, whatever else they
    exclude. Places and the numbers j come from ``numbered``, so no user's exclusions meet in
    one task. The first places, which every user looks at, are broadcast (at most
    ``HEAD_PLACES``); those beyond are joined by place."""
    users = materialise(users, "cold")
    most = users.agg(F.max("n")).first()[0]
    if most is None:
        return _same_list(model, users, 1)
    if excl is None:
        mine = None
        alike = users.where(F.col("n") <= HEAD_PLACES)
    else:
        mine = materialise(excl.join(users, "user_id", "left_semi"), "cold-excluded")
        alike = users.where(F.col("n") <= HEAD_PLACES).join(mine.select("user_id").distinct(), "user_id", "left_anti")
        if not mine.limit(1).count():
            mine = None
    same = _same_list(model, alike, min(most, HEAD_PLACES))
    if mine is None and most <= HEAD_PLACES:
        return same
    own = users.where(F.col("n") > HEAD_PLACES) if mine is None else \
        users.join(mine.select("user_id").distinct(), "user_id", "left_semi").unionByName(
            users.where(F.col("n") > HEAD_PLACES).join(mine.select("user_id").distinct(), "user_id", "left_anti"))
    listed = model.item_factors.select("item_id", _norm(F.col("f")).alias("nv"), F.lit(0).alias("all"))
    places = numbered(listed, "all", [F.round("nv", fixed.RANK_PLACES).desc(), F.col("item_id").asc()], "place") \
        .select("place", "item_id", F.col("nv").alias("score"))
    looked, many = own, F.col("n")
    if mine is not None:
        taken = materialise(numbered(mine.join(places.select("item_id", "place"), "item_id").select("user_id", "place"),
                                     "user_id", [F.col("place").asc()], "j").join(own, "user_id")
                            .where(F.col("place") - F.col("j") < F.col("n")).select("user_id", "place"), "cold-taken")
        looked = own.join(taken.groupBy("user_id").agg(F.count(F.lit(1)).alias("more")), "user_id", "left")
        many = F.col("n") + F.coalesce("more", F.lit(0))
    looked = looked.select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), many.cast("long"))).alias("place"))
    if mine is not None:
        looked = looked.join(taken, ["user_id", "place"], "left_anti")
    head = F.col("place") <= HEAD_PLACES
    rows = looked.where(head).join(F.broadcast(places.where(head)), "place") \
        .unionByName(looked.where(~head).join(places.where(~head), "place"))
    w = Window.partitionBy("user_id")  # at most n rows
    top = F.max("score").over(w)
    return rows.withColumn("rank", F.row_number().over(w.orderBy("place"))) \
        .select("user_id", "rank", "item_id", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)).alias("score")) \
        .unionByName(same)


def _same_list(model: CollabModel, users: DataFrame, most: int) -> DataFrame:
    """The popular list, cut to each user's n (at most ``most``): one list for each n that
    is asked for, at most ``HEAD_PLACES`` items long, which goes to the tasks."""
    places = popular_items(model, most).select("rank", "item_id", "score")
    w = Window.partitionBy("n")
    top = F.max("score").over(w)
    lists = materialise(users.select("n").distinct().join(F.broadcast(places), F.col("rank") <= F.col("n"))
                        .select("n", "rank", "item_id", F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)).alias("score")), "lists")
    return users.join(F.broadcast(lists), "n").select("user_id", "rank", "item_id", "score")


def similar(factors: DataFrame, id_col: str, n: int, sources: DataFrame | None = None) -> DataFrame:
    """Cosine of factor rows, self excluded, score > 0.
    Rows with a norm below 1e-12 have no neighbours and are no one's neighbour."""
    u = factors.select(F.col(id_col).alias("id"), _unit(F.col("f")).alias("val")).where(F.col("val").isNotNull())
    q = u if sources is None else u.join(sources.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    res = top_n_dot(q.withColumnRenamed("id", "qid"), u.withColumnRenamed("id", "cid"), n,
                    dense=True, exclude_self=True, min_score=0.0)
    return res.select(F.col("qid").alias(id_col), "rank", F.col("cid").alias("other_id"), "score")


def summary(model: CollabModel, spark: SparkSession) -> DataFrame:
    """M19 as a one-row DataFrame."""
    i = model.info
    return spark.createDataFrame(
        [(i["num_users"], i["num_items"], i["n_factors"], float(i["explained_variance_ratio"]),
          float(i["reconstruction_mse"]), float(i["sparsity"]), float(model.global_mean),
          float(i["residual"]), int(i["steps"]))],
        "num_users long, num_items long, n_factors int, explained_variance_ratio double, "
        "reconstruction_mse double, sparsity double, global_mean double, residual double, steps int")


def invariants(model: CollabModel, strengths: DataFrame) -> DataFrame:
    """(part, a, b, value) of what every truncated SVD fulfils, one row a statement:
    ``orthonormal`` V'V; ``diagonal`` off-diagonal (U S)'(U S) against its largest entry;
    ``sum_squares`` squared singular values plus the squared residual over all cells;
    ``eigen`` |A'A v - s^2 v| against the largest s^2, from the factor tables alone. The
    driver sees k x k numbers; the products are those of ``svd.multiply``."""
    k, n_u, n_i = model.k, model.info["num_users"], model.info["num_items"]
    item, user = _arrays(model.item_factors, "item_id"), _arrays(model.user_factors, "user_id")
    strengths = strengths.select("user_id", "item_id", "strength")
    cells = strengths.where("strength <> 0").select("user_id", "item_id", F.col("strength").alias("s"))
    vv, uu = (svd.moments(x, lambda m: (m, m)) for x in (item, user))
    s2 = np.diag(uu)
    top = uu.max() or 1.0

    def beside(rows: DataFrame, product: DataFrame) -> DataFrame:
        zeros = F.array_repeat(F.lit(0.0), k)
        return rows.join(product.select("id", F.col("arr").alias("p")), "id", "left") \
            .select("id", F.concat("arr", F.coalesce("p", zeros)).alias("arr"))

    # |A - P|^2 over all cells, those without a row included: |A|^2 - 2 <A, P> + |P|^2
    av = svd.multiply(cells, item, "item_id", "user_id", n_i, k, n_u)
    cross = np.trace(svd.moments(beside(user, av), lambda m: (m[:, :k], m[:, k:])))
    squares = float(cells.agg(F.sum(F.col("s") * F.col("s"))).first()[0] or 0.0)
    total = float(s2.sum() + squares - 2 * cross + (uu * vv).sum())
    # A'(U S) = V S^2
    back = svd.multiply(cells, user, "user_id", "item_id", n_u, k, n_i)
    left = lambda m: m[:, k:] - m[:, :k] * s2
    eigen = np.sqrt(np.diag(svd.moments(beside(item, back), lambda m: (left(m), left(m))))) / top
    every = [(a, b) for a in range(k) for b in range(k)]
    rows = [("orthonormal", a, b, float(vv[a, b])) for a, b in every] \
        + [("diagonal", a, b, float(uu[a, b] / top)) for a, b in every if a != b] \
        + [("sum_squares", 0, 0, total)] + [("eigen", a, 0, float(eigen[a])) for a in range(k)]
    return strengths.sparkSession.createDataFrame(rows, "part string, a int, b int, value double")

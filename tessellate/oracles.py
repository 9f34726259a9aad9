"""Builders of the DuckDB SQL texts used as correctness oracles.

These produce plain SQL strings (CTE chains) that compute, on the same
parquet tables, what the Spark operators compute.  They are test
infrastructure, not an execution path.
"""

from __future__ import annotations

from collections.abc import Sequence

ORDER_FEATURES = ["o_totalprice", "n_lines", "sum_qty", "avg_disc", "avg_tax"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def r6(e: str, nd: int = 6) -> str:
    return f"(round(CAST({e} AS DOUBLE), {nd}) + 0.0)"


def pct(part: str, whole: str) -> str:
    return f"(100.0::DOUBLE * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0))"


def phash(id_expr: str, seed: int = 42) -> str:
    return f"CAST('0x' || substr(md5(coalesce(CAST({id_expr} AS VARCHAR), '') || '#{seed}'), 1, 15) AS BIGINT)"


ORDER_FEATURES_CTE = """of_li AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty,
         avg(l_discount) AS avg_disc, avg(l_tax) AS avg_tax
  FROM lineitem GROUP BY l_orderkey),
ofeat AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate,
         CAST(o_totalprice AS DOUBLE) AS o_totalprice, n_lines, sum_qty, avg_disc, avg_tax
  FROM orders JOIN of_li ON o_orderkey = l_orderkey)"""


def zscore_cte(name: str, src: str, id_col: str, fs: Sequence[str], keep: Sequence[str] = ()) -> str:
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in fs)
    cols = ", ".join(f"CASE WHEN s_{f} = 0 THEN 0.0 ELSE ({f} - m_{f}) / s_{f} END AS {f}" for f in fs)
    extra = "".join(f"{k}, " for k in keep)
    return (f"{name}_p AS (SELECT {stats} FROM {src}),\n"
            f"{name} AS (SELECT {id_col}, {extra}{cols} FROM {src}, {name}_p)")


def minmax_cte(name: str, src: str, id_col: str, fs: Sequence[str]) -> str:
    stats = ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in fs)
    cols = ", ".join(f"CASE WHEN hi_{f} = lo_{f} THEN 0.0 ELSE ({f} - lo_{f}) / (hi_{f} - lo_{f}) END AS {f}"
                     for f in fs)
    return (f"{name}_p AS (SELECT {stats} FROM {src}),\n"
            f"{name} AS (SELECT {id_col}, {cols} FROM {src}, {name}_p)")


def sqdist(fs: Sequence[str], left: str, right_fmt: str) -> str:
    """((x1-c1)*(x1-c1) + (x2-c2)*(x2-c2)) + ... in the same order as Spark."""
    terms = [f"({left}{f} - {right_fmt.format(f=f, i=i)}) * ({left}{f} - {right_fmt.format(f=f, i=i)})"
             for i, f in enumerate(fs)]
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} + {t})"
    return out


def assign_cte(name: str, src: str, cen: str, fs: Sequence[str], k: int, id_col: str,
               keep: Sequence[str] = ()) -> str:
    """Nearest centre (ties -> lowest id) of every row of ``src``."""
    wide = ", ".join(f"max(CASE WHEN cid = {j} THEN {f} END) AS c{j}_{i}"
                     for j in range(k) for i, f in enumerate(fs))
    dists = ", ".join(f"{sqdist(fs, 's.', f'w.c{j}_' + '{i}')} AS d{j}" for j in range(k))
    least = "d0" if k == 1 else f"least({', '.join(f'd{j}' for j in range(k))})"
    arg = "CASE " + " ".join(f"WHEN d{j} = md THEN {j}" for j in range(k)) + " END"
    extra = "".join(f", {c}" for c in keep)
    cols = ", ".join(fs)
    return (f"{name}_w AS (SELECT {wide} FROM {cen}),\n"
            f"{name}_d AS (SELECT s.*, {dists} FROM {src} s, {name}_w w),\n"
            f"{name}_m AS (SELECT *, {least} AS md FROM {name}_d),\n"
            f"{name} AS (SELECT {id_col}{extra}, {cols}, CAST({arg} AS INTEGER) AS cluster, md "
            f"FROM {name}_m)")


def lloyd_ctes(prefix: str, src: str, init: str, fs: Sequence[str], k: int, n_iter: int,
               id_col: str) -> tuple[str, str]:
    """CTEs of n_iter Lloyd rounds; returns (sql, name of final centre CTE)."""
    parts = []
    cen = init
    for t in range(n_iter):
        a = f"{prefix}_a{t}"
        parts.append(assign_cte(a, src, cen, fs, k, id_col))
        avgs = ", ".join(f"avg({f}) AS n_{f}" for f in fs)
        parts.append(f"{prefix}_n{t} AS (SELECT cluster AS cid, {avgs} FROM {a} GROUP BY cluster)")
        co = ", ".join(f"coalesce(n.n_{f}, c.{f}) AS {f}" for f in fs)
        nxt = f"{prefix}_c{t + 1}"
        parts.append(f"{nxt} AS (SELECT c.cid, {co} FROM {cen} c LEFT JOIN {prefix}_n{t} n "
                     f"ON c.cid = n.cid)")
        cen = nxt
    return ",\n".join(parts), cen


def first_rows_centres(name: str, src: str, id_col: str, fs: Sequence[str], k: int) -> str:
    cols = ", ".join(fs)
    return (f"{name} AS (SELECT CAST(row_number() OVER (ORDER BY {id_col}) - 1 AS INTEGER) AS cid, "
            f"{cols} FROM (SELECT * FROM {src} ORDER BY {id_col} LIMIT {k}))")


def clustered_orders_sql(k: int = 3, n_iter: int = 3) -> str:
    """CTE chain ending in ``lab`` (o_orderkey, features, cluster, md)."""
    fs = ORDER_FEATURES
    lloyd, cen = lloyd_ctes("km", "z", "c0", fs, k, n_iter, "o_orderkey")
    return ",\n".join([
        ORDER_FEATURES_CTE,
        zscore_cte("z", "ofeat", "o_orderkey", fs),
        first_rows_centres("c0", "z", "o_orderkey", fs, k),
        lloyd,
        assign_cte("lab", "z", cen, fs, k, "o_orderkey"),
    ])


def similar_orders_sql(top: int = 10) -> str:
    fs = ORDER_FEATURES
    dist = "sqrt(" + sqdist(fs, "l.", "q.{f}") + ")"
    return f"""WITH {clustered_orders_sql()},
qid AS (SELECT o_orderkey AS qk FROM ofeat ORDER BY o_totalprice DESC, o_orderkey LIMIT 1),
q AS (SELECT l.* FROM lab l JOIN qid ON l.o_orderkey = qid.qk),
cand AS (SELECT l.o_orderkey, l.cluster, {dist} AS dist
         FROM lab l, q WHERE l.o_orderkey <> q.o_orderkey AND l.cluster = q.cluster),
top AS (SELECT * FROM cand ORDER BY dist, o_orderkey LIMIT {top})
SELECT CAST(row_number() OVER (ORDER BY dist, o_orderkey) AS INTEGER) AS rank, o_orderkey, cluster,
       {r6('dist')} AS distance, round(1.0::DOUBLE / (1.0::DOUBLE + dist), 4) AS similarity_score
FROM top"""


# ---------------------------------------------------------------- statistics
def union_all(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def describe_sql(src: str, fs: Sequence[str]) -> str:
    return union_all([
        f"SELECT '{f}' AS feature, count({f}) AS count, {r6(f'avg({f})')} AS mean, "
        f"{r6(f'stddev_samp({f})')} AS std, {r6(f'min({f})')} AS min, "
        f"{r6(f'quantile_cont({f}, 0.25)')} AS p25, {r6(f'quantile_cont({f}, 0.5)')} AS p50, "
        f"{r6(f'quantile_cont({f}, 0.75)')} AS p75, {r6(f'max({f})')} AS max FROM {src}"
        for f in fs])


def feature_summary_sql(src: str, fs: Sequence[str]) -> str:
    return union_all([
        f"SELECT '{f}' AS feature, {r6(f'avg({f})')} AS mean, {r6(f'stddev_samp({f})')} AS std, "
        f"{r6(f'min({f})')} AS min, {r6(f'max({f})')} AS max, {r6(f'max({f}) - min({f})')} AS range "
        f"FROM {src}" for f in fs])


def bounds_cte(src: str, fs: Sequence[str]) -> str:
    return ", ".join(
        f"quantile_cont({f}, 0.25) - 1.5 * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) AS lo_{f}, "
        f"quantile_cont({f}, 0.75) + 1.5 * (quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) AS hi_{f}"
        for f in fs)


def outlier_flag(f: str) -> str:
    return f"coalesce(({f} < lo_{f}) OR ({f} > hi_{f}), false)"


def iqr_outliers_sql(src_cte: str, src: str, fs: Sequence[str]) -> str:
    body = union_all([
        f"SELECT '{f}' AS feature, CAST(sum(CASE WHEN {outlier_flag(f)} THEN 1 ELSE 0 END) AS BIGINT) "
        f"AS n_outliers, {r6(pct(f'sum(CASE WHEN {outlier_flag(f)} THEN 1 ELSE 0 END)', 'count(*)'))} "
        f"AS pct_outliers FROM {src}, b" for f in fs])
    return f"WITH {src_cte}b AS (SELECT {bounds_cte(src, fs)} FROM {src})\n{body}"


def rows_with_outlier_sql(src_cte: str, src: str, fs: Sequence[str]) -> str:
    anyo = " OR ".join(outlier_flag(f) for f in fs)
    return (f"WITH {src_cte}b AS (SELECT {bounds_cte(src, fs)} FROM {src})\n"
            f"SELECT CAST(sum(CASE WHEN {anyo} THEN 1 ELSE 0 END) AS BIGINT) AS n_rows_with_outlier, "
            f"{r6(pct(f'sum(CASE WHEN {anyo} THEN 1 ELSE 0 END)', 'count(*)'))} AS pct_rows FROM {src}, b")


def deepdive_sql(src_cte: str, src: str, fs: Sequence[str]) -> str:
    parts = []
    for f in fs:
        q1, q3 = f"quantile_cont({f}, 0.25)", f"quantile_cont({f}, 0.75)"
        parts.append(
            f"SELECT '{f}' AS feature, {r6(f'min({f})')} AS min, {r6(f'max({f})')} AS max, "
            f"{r6(f'max({f}) - min({f})')} AS range, {r6(f'avg({f})')} AS mean, "
            f"{r6(f'quantile_cont({f}, 0.5)')} AS median, {r6(f'stddev_samp({f})')} AS std, "
            f"{r6(f'skewness({f})')} AS skew, {r6(f'kurtosis({f})')} AS kurt, "
            f"{r6(f'{q3} - {q1}')} AS iqr, "
            f"(SELECT CAST(sum(CASE WHEN {outlier_flag(f)} THEN 1 ELSE 0 END) AS BIGINT) FROM {src}, b) AS n_outliers, "
            f"(SELECT {r6(pct(f'sum(CASE WHEN {outlier_flag(f)} THEN 1 ELSE 0 END)', 'count(*)'))} FROM {src}, b) AS pct_outliers "
            f"FROM {src}")
    return f"WITH {src_cte}b AS (SELECT {bounds_cte(src, fs)} FROM {src})\n" + union_all(parts)


def corr_expr(a: str, b: str) -> str:
    if a == b:
        return f"CASE WHEN var_pop({a}) > 0 THEN 1.0::DOUBLE END"
    return f"covar_pop({a}, {b}) / NULLIF(sqrt(var_pop({a}) * var_pop({b})), 0)"


def corr_sql(src: str, fs: Sequence[str], where: str = "") -> str:
    return union_all([f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r6(corr_expr(a, b))} AS r "
                      f"FROM {src} {where}" for a in fs for b in fs])


def corr_pairs_sql(src_cte: str, src: str, fs: Sequence[str], t: float = 0.3, strong: float = 0.5) -> str:
    pairs = union_all([f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {r6(corr_expr(a, b))} AS r FROM {src}"
                       for i, a in enumerate(fs) for j, b in enumerate(fs) if i < j])
    return (f"WITH {src_cte}p AS ({pairs})\n"
            f"SELECT feature_1, feature_2, r, concat_ws(' ', CASE WHEN r > 0 THEN '+' ELSE '-' END, "
            f"CASE WHEN abs(r) > {strong} THEN 'STRONG' ELSE 'MODERATE' END) AS strength "
            f"FROM p WHERE abs(r) > {t}")


def value_counts_sql(src: str, col: str, n: int) -> str:
    return (f"SELECT {col} AS value, count(*) AS count, "
            f"{r6(pct('count(*)', f'(SELECT count(*) FROM {src})'))} AS pct "
            f"FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count DESC, value LIMIT {n}")


def histogram_sql(src: str, fs: Sequence[str], bins: int) -> str:
    lv = union_all([f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src} WHERE {f} IS NOT NULL"
                    for f in fs])
    return f"""WITH lv AS ({lv}),
rng0 AS (SELECT feature, min(value) AS mn, max(value) AS mx FROM lv GROUP BY feature),
rng AS (SELECT feature, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
               CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM rng0),
cnt AS (SELECT lv.feature, CAST(least(floor((value - lo) * {bins} / (hi - lo)), {bins - 1}) AS INTEGER) AS bin,
               count(*) AS c FROM lv JOIN rng USING (feature) GROUP BY ALL),
grid AS (SELECT feature, lo, hi, CAST(b AS INTEGER) AS bin FROM rng, range(0, {bins}) t(b))
SELECT g.feature, g.bin, {r6('lo + g.bin * ((hi - lo) / ' + str(bins) + ')')} AS bin_lo,
       {r6('lo + (g.bin + 1) * ((hi - lo) / ' + str(bins) + ')')} AS bin_hi,
       CAST(coalesce(c, 0) AS BIGINT) AS count
FROM grid g LEFT JOIN cnt USING (feature, bin)"""


def box_sql(src: str, fs: Sequence[str], group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    lv = union_all([f"SELECT {g}'{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src} WHERE {f} IS NOT NULL"
                    for f in fs])
    on = f"USING ({group}, feature)" if group else "USING (feature)"
    return f"""WITH lv AS ({lv}),
q AS (SELECT {g}feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM lv GROUP BY {g}feature),
j AS (SELECT lv.*, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM lv JOIN q {on})
SELECT {g}feature, count(*) AS n, {r6('any_value(q1)')} AS q1, {r6('any_value(median)')} AS median,
       {r6('any_value(q3)')} AS q3,
       {r6('min(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_lo,
       {r6('max(CASE WHEN value >= lo AND value <= hi THEN value END)')} AS whisker_hi,
       CAST(sum(CASE WHEN value >= lo AND value <= hi THEN 0 ELSE 1 END) AS BIGINT) AS n_fliers
FROM j GROUP BY {g}feature"""


def keyword_case(expr: str, mapping: Sequence[tuple[str, str]], other: str = "Other") -> str:
    whens = " ".join(f"WHEN contains(lower({expr}), '{k}') THEN '{v}'" for k, v in mapping)
    return f"CASE {whens} ELSE '{other}' END"


def clustered_raw_sql() -> str:
    """CTE chain ending in ``labr`` (cluster + unscaled order features + metadata)."""
    return clustered_orders_sql() + ",\nlabr AS (SELECT l.cluster, f.* FROM lab l JOIN ofeat f USING (o_orderkey))"


def cluster_name_sql(rules, other: str = "balanced", sep: str = " + ") -> str:
    items = ", ".join(f"CASE WHEN {f} {op} {t} THEN '{name}' END" for f, op, t, name in rules)
    lst = f"list_filter([{items}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({lst}) = 0 THEN '{other}' ELSE array_to_string({lst}[1:2], '{sep}') END"


def display_sql(cid: str, label: str | None = None) -> str:
    lab = f"WHEN {label} IS NOT NULL THEN printf('C%d: %s', {cid}, {label}) " if label else ""
    return f"CASE WHEN {cid} = -1 THEN 'Noise' {lab}ELSE printf('Cluster %d', {cid}) END"


def dbscan_sql(dims: Sequence[int], eps: float, min_samples: int) -> str:
    """DBSCAN over embeddings dims (0-based) by a recursive reachability CTE."""
    fs = [f"e{i}" for i in dims]
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in dims)
    d2 = sqdist(fs, "a.", "b.{f}")
    return f"""WITH RECURSIVE pts AS (SELECT vec_id, {cols} FROM embeddings),
nb AS (SELECT a.vec_id AS i, b.vec_id AS j FROM pts a, pts b WHERE a.vec_id <> b.vec_id AND {d2} <= {float(eps) * float(eps)!r}),
deg AS (SELECT p.vec_id AS i, count(nb.j) + 1 AS d FROM pts p LEFT JOIN nb ON p.vec_id = nb.i GROUP BY p.vec_id),
core AS (SELECT i FROM deg WHERE d >= {min_samples}),
ce AS (SELECT nb.i, nb.j FROM nb JOIN core c1 ON nb.i = c1.i JOIN core c2 ON nb.j = c2.i),
reach(i, c) AS (SELECT i, i FROM core UNION SELECT ce.j, reach.c FROM reach JOIN ce ON reach.i = ce.i),
comp AS (SELECT i, min(c) AS comp FROM reach GROUP BY i),
num AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM comp)),
corelab AS (SELECT i, cluster FROM comp JOIN num USING (comp)),
border AS (SELECT nb.i, min(corelab.cluster) AS bc FROM nb JOIN corelab ON nb.j = corelab.i GROUP BY nb.i)
SELECT p.vec_id, CAST(CASE WHEN core.i IS NOT NULL THEN corelab.cluster ELSE coalesce(border.bc, -1) END AS INTEGER) AS cluster,
       core.i IS NOT NULL AS is_core
FROM pts p LEFT JOIN core ON p.vec_id = core.i LEFT JOIN corelab ON p.vec_id = corelab.i
LEFT JOIN border ON p.vec_id = border.i"""


def eps_join_sql(dims: Sequence[int], eps: float) -> str:
    fs = [f"e{i}" for i in dims]
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in dims)
    d2 = sqdist(fs, "a.", "b.{f}")
    return (f"WITH pts AS (SELECT vec_id, {cols} FROM embeddings)\n"
            f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r6('sqrt(' + d2 + ')')} AS distance "
            f"FROM pts a, pts b WHERE a.vec_id < b.vec_id AND {d2} <= {float(eps) * float(eps)!r}")


def silhouette_sql(src: str, sx: str = "") -> str:
    """CTE ``sil{sx}`` (vec_id, cluster, a, b, s) over ``src`` (vec_id, label,
    embedding), noise (-1) excluded."""
    return (f"pts_s{sx} AS (SELECT vec_id, label, embedding FROM {src} WHERE label <> -1),\n"
            f"pd{sx} AS (SELECT a.vec_id, a.label, b.label AS lb, "
            "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d "
            f"FROM pts_s{sx} a, pts_s{sx} b),\n"
            f"pc{sx} AS (SELECT vec_id, label, lb, sum(d) AS sd, count(*) AS n FROM pd{sx} GROUP BY vec_id, label, lb),\n"
            f"ab{sx} AS (SELECT vec_id, label, max(CASE WHEN lb = label THEN CASE WHEN n > 1 THEN sd / (n - 1) ELSE 0.0 END END) AS a, "
            f"min(CASE WHEN lb <> label THEN sd / n END) AS b, max(CASE WHEN lb = label THEN n END) AS n_own FROM pc{sx} GROUP BY vec_id, label),\n"
            f"sil{sx} AS (SELECT vec_id, label AS cluster, a, b, CASE WHEN n_own > 1 AND greatest(a, b) > 0 "
            f"THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s FROM ab{sx})")


def emb_cols(dims: Sequence[int]) -> str:
    return ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in dims)


def db_sql(src: str, fs: Sequence[str], label: str = "label", sx: str = "") -> str:
    cen = ", ".join(f"avg({f}) AS c_{f}" for f in fs)
    d = "sqrt(" + sqdist(fs, "s.", "c.c_{f}") + ")"
    pdist = "sqrt(" + sqdist([f"c_{f}" for f in fs], "a.", "b.{f}") + ")"
    return (f"cen{sx} AS (SELECT {label} AS cid, {cen} FROM {src} WHERE {label} <> -1 GROUP BY {label}),\n"
            f"intra{sx} AS (SELECT c.cid, avg({d}) AS s FROM {src} s JOIN cen{sx} c ON s.{label} = c.cid GROUP BY c.cid),\n"
            f"pairs{sx} AS (SELECT a.cid AS ca, b.cid AS cb, {pdist} AS dist FROM cen{sx} a, cen{sx} b WHERE a.cid <> b.cid),\n"
            f"r{sx} AS (SELECT ca, max((ia.s + ib.s) / dist) AS d FROM pairs{sx} JOIN intra{sx} ia ON ia.cid = ca "
            f"JOIN intra{sx} ib ON ib.cid = cb WHERE dist > 0 GROUP BY ca),\n"
            f"dbv{sx} AS (SELECT " + r6(f"CASE WHEN (SELECT count(*) FROM intra{sx}) < 2 THEN CAST('Infinity' AS DOUBLE) "
                                        f"WHEN (SELECT max(s) FROM intra{sx}) = 0 OR coalesce((SELECT max(dist) FROM pairs{sx}), 0) = 0 THEN 0.0 "
                                        f"ELSE coalesce((SELECT sum(d) FROM r{sx}), 0) / (SELECT count(*) FROM intra{sx}) END") +
            " AS davies_bouldin)")


def evaluate_sql(name: str, src: str, fs: Sequence[str], sx: str = "") -> str:
    """One evaluate row over ``src`` (vec_id, label, embedding, e0..)."""
    return (f"SELECT '{name}' AS algorithm, "
            f"(SELECT CASE WHEN (SELECT count(DISTINCT label) FROM {src} WHERE label <> -1) < 2 THEN -1.0 "
            f"ELSE {r6('avg(s)')} END FROM sil{sx}) AS silhouette_score, "
            f"(SELECT davies_bouldin FROM dbv{sx}) AS davies_bouldin_index, CAST(NULL AS DOUBLE) AS inertia, "
            f"count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_clusters, "
            f"CAST(sum(CASE WHEN label = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_noise FROM {src}")


def lloyd_sweep_sql(ks: Sequence[int] = tuple(range(2, 11)), n_iter: int = 3) -> str:
    """CTE chain ending in ``sweep`` (k, inertia) over the z-scored orders."""
    fs = ORDER_FEATURES
    parts = [ORDER_FEATURES_CTE, zscore_cte("z", "ofeat", "o_orderkey", fs)]
    sels = []
    for k in ks:
        parts.append(first_rows_centres(f"k{k}_c0", "z", "o_orderkey", fs, k))
        chain, final = lloyd_ctes(f"k{k}", "z", f"k{k}_c0", fs, k, n_iter, "o_orderkey")
        parts.append(chain)
        parts.append(assign_cte(f"k{k}_lab", "z", final, fs, k, "o_orderkey"))
        sels.append(f"SELECT CAST({k} AS INTEGER) AS k, {r6('sum(md)')} AS inertia FROM k{k}_lab")
    parts.append("sweep AS (" + "\nUNION ALL\n".join(sels) + ")")
    return ",\n".join(parts)


def elbow_sql(sweep: str = "sweep", sensitivity: float = 1.0) -> str:
    """CTEs computing the Kneedle knee of ``sweep`` (k, inertia); ends in ``elbow``."""
    return f"""kn AS (SELECT k, inertia AS y, row_number() OVER (ORDER BY k) - 1 AS i,
        (k - min(k) OVER ()) / (max(k) OVER () - min(k) OVER ()) AS xn,
        (inertia - min(inertia) OVER ()) / (max(inertia) OVER () - min(inertia) OVER ()) AS yn0 FROM {sweep}),
kn2 AS (SELECT *, max(yn0) OVER () - yn0 AS yn FROM kn),
kn3 AS (SELECT *, yn - xn AS yd FROM kn2),
kn4 AS (SELECT *, coalesce(lag(yd) OVER (ORDER BY k), yd) AS prv, coalesce(lead(yd) OVER (ORDER BY k), yd) AS nxt,
        lead(yd) OVER (ORDER BY k) AS nx, abs(xn - lag(xn) OVER (ORDER BY k)) AS dx FROM kn3),
kn5 AS (SELECT *, yd >= prv AND yd >= nxt AS is_max, yd <= prv AND yd <= nxt AS is_min, avg(dx) OVER () AS step FROM kn4),
kn6 AS (SELECT *, last_value(CASE WHEN is_min THEN 0.0 WHEN is_max THEN yd - {sensitivity} * step END IGNORE NULLS)
          OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS thr,
        last_value(CASE WHEN is_max THEN k END IGNORE NULLS)
          OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kmax,
        min(CASE WHEN is_max THEN i END) OVER () AS first_max FROM kn5),
elbow AS (SELECT (SELECT arg_min(kmax, i) FROM kn6 WHERE i >= first_max AND xn < 1.0 AND nx < thr) AS knee,
          coalesce((SELECT arg_min(kmax, i) FROM kn6 WHERE i >= first_max AND xn < 1.0 AND nx < thr),
                   (SELECT k FROM kn6 WHERE i = 2)) AS elbow_k)"""

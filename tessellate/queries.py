"""The registered queries: one per operator of SURVEY §2, each over whole
driver tables (or tables Spark derives from them)."""

from __future__ import annotations

from . import oracles as O
from .catalog import register
from .plans.similar_orders import similar_orders


@register("similar_orders", O.similar_orders_sql())
def q_similar_orders(spark, sf):
    return similar_orders(spark, sf)

from pyspark.sql import functions as F  # noqa: E402

from .functions.columns import rnd  # noqa: E402
from .functions.scalar import GENRE_KEYWORDS, PART_KEYWORDS, decade_of_timestamp, keyword_family  # noqa: E402
from .operators import clean as C  # noqa: E402
from .operators import stats as S  # noqa: E402
from .operators import transform as T  # noqa: E402
from .plans.tables import (LINE_FEATURES, ORDER_FEATURES, documents_labelled,  # noqa: E402
                           order_features, table)

LI_COLS = ("l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,"
           "l_discount,l_tax,l_returnflag,l_linestatus,l_shipdate")
DL = "dl AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
DL_COLS = [("doc_id", "bigint", "numeric"), ("text", "string", "text"), ("lang", "string", "text"),
           ("source", "string", "text"), ("n_chars", "bigint", "numeric"),
           ("quality", "int", "numeric"), ("toxic", "int", "numeric")]


# ---------------------------------------------------------------- A1-A4, P3
@register("table_overview_lineitem",
          f"SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns, '{LI_COLS}' AS columns FROM lineitem")
def q_table_overview(spark, sf):
    return S.table_overview(table(spark, sf, "lineitem"))


@register("dtypes_nonnull_documents_labels", f"WITH {DL}\n" + O.union_all([
    f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS dtype, '{k}' AS kind, "
    f"count({c}) AS non_null FROM dl" for i, (c, t, k) in enumerate(DL_COLS, 1)]))
def q_dtypes(spark, sf):
    return S.dtypes_nonnull(documents_labelled(spark, sf))


@register("missing_report_documents_labels", f"WITH {DL}, m AS (" + O.union_all([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS n_missing, "
    f"{O.r6(O.pct(f'count(*) - count({c})', 'count(*)'))} AS pct_missing FROM dl"
    for c, _, _ in DL_COLS]) + ") SELECT * FROM m WHERE n_missing > 0")
def q_missing(spark, sf):
    return S.missing_report(documents_labelled(spark, sf))


@register("duplicates_documents", O.union_all([
    "SELECT 'row' AS key, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS BIGINT) AS duplicates FROM documents",
    "SELECT 'text' AS key, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text FROM documents)) AS BIGINT) AS duplicates FROM documents",
    "SELECT 'text_lang' AS key, CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS BIGINT) AS duplicates FROM documents"]))
def q_duplicates(spark, sf):
    return S.duplicate_profile(table(spark, sf, "documents"),
                               {"row": None, "text": ["text"], "text_lang": ["text", "lang"]})


# ---------------------------------------------------------------- A5-A11
@register("describe_lineitem", O.describe_sql("lineitem", LINE_FEATURES))
def q_describe(spark, sf):
    return S.describe(table(spark, sf, "lineitem"), LINE_FEATURES)


@register("feature_summary_orders", f"WITH {O.ORDER_FEATURES_CTE}\n" + O.feature_summary_sql("ofeat", ORDER_FEATURES))
def q_feature_summary(spark, sf):
    return S.feature_summary(order_features(spark, sf), ORDER_FEATURES)


@register("feature_deepdive_orders", O.deepdive_sql(O.ORDER_FEATURES_CTE + ",\n", "ofeat", ORDER_FEATURES))
def q_deepdive_orders(spark, sf):
    return S.feature_deepdive(order_features(spark, sf), ORDER_FEATURES)


@register("feature_deepdive_doc_chars", O.deepdive_sql("", "documents", ["n_chars"]))
def q_deepdive_docs(spark, sf):
    return S.feature_deepdive(table(spark, sf, "documents"), ["n_chars"])


@register("iqr_outliers_lineitem", O.iqr_outliers_sql("", "lineitem", LINE_FEATURES))
def q_iqr_outliers(spark, sf):
    return S.iqr_outliers(table(spark, sf, "lineitem"), LINE_FEATURES)


@register("rows_with_outlier_orders", O.rows_with_outlier_sql(O.ORDER_FEATURES_CTE + ",\n", "ofeat", ORDER_FEATURES))
def q_rows_with_outlier(spark, sf):
    return S.rows_with_outlier(order_features(spark, sf), ORDER_FEATURES)


@register("correlation_matrix_lineitem", O.corr_sql("lineitem", LINE_FEATURES))
def q_corr(spark, sf):
    return S.correlation_matrix(table(spark, sf, "lineitem"), LINE_FEATURES)


@register("correlation_lower_orders", f"WITH {O.ORDER_FEATURES_CTE}, c AS ({O.corr_sql('ofeat', ORDER_FEATURES)})\n"
          "SELECT * FROM c WHERE " + " OR ".join(
              f"(feature_1 = '{a}' AND feature_2 = '{b}')" for i, a in enumerate(ORDER_FEATURES)
              for j, b in enumerate(ORDER_FEATURES) if i > j))
def q_corr_lower(spark, sf):
    f = order_features(spark, sf)
    return S.correlation_lower(S.correlation_matrix(f, ORDER_FEATURES), ORDER_FEATURES)


@register("correlated_pairs_orders", O.corr_pairs_sql(O.ORDER_FEATURES_CTE + ",\n", "ofeat", ORDER_FEATURES))
def q_corr_pairs(spark, sf):
    return S.correlated_pairs(order_features(spark, sf), ORDER_FEATURES, 0.3)


# ---------------------------------------------------------------- A12-A16, A28
@register("value_counts_part_brand", O.value_counts_sql("part", "p_brand", 15))
def q_vc_brand(spark, sf):
    return S.value_counts(table(spark, sf, "part"), "p_brand", 15)


@register("value_counts_events_type", O.value_counts_sql("events", "event_type", 15))
def q_vc_events(spark, sf):
    return S.value_counts(table(spark, sf, "events"), "event_type", 15)


@register("distinct_count_documents", O.union_all([
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM documents"
    for c in ("lang", "source", "text")]))
def q_distinct(spark, sf):
    return S.distinct_count(table(spark, sf, "documents"), ["lang", "source", "text"])


@register("min_max_orderdate",
          "SELECT count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS n_distinct, "
          "min(strftime(o_orderdate, '%Y-%m-%d')) AS earliest, max(strftime(o_orderdate, '%Y-%m-%d')) AS latest FROM orders")
def q_min_max_text(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return S.min_max_text(o, "d")


@register("flag_counts_toxic", f"WITH {DL}\n"
          "SELECT CAST(toxic AS BIGINT) AS flag, CASE WHEN toxic = 1 THEN 'Explicit' ELSE 'Clean' END AS label, "
          f"count(*) AS count, {O.r6(O.pct('count(*)', '(SELECT count(*) FROM dl)'))} AS pct "
          "FROM dl WHERE toxic IS NOT NULL GROUP BY toxic")
def q_flag_counts(spark, sf):
    return S.flag_counts(documents_labelled(spark, sf), "toxic")


@register("quality_summary_documents_labels", f"WITH {DL}\n"
          "SELECT CAST(sum(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c, _, _ in DL_COLS) +
          ") AS BIGINT) AS total_missing, "
          "CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM dl)) AS BIGINT) AS duplicate_rows, "
          "count(*) AS n_rows, CAST(7 AS BIGINT) AS n_columns, "
          "CASE WHEN sum(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c, _, _ in DL_COLS) +
          ") = 0 AND count(*) = (SELECT count(*) FROM (SELECT DISTINCT * FROM dl)) THEN 'GOOD' ELSE 'NEEDS CLEANING' END AS verdict FROM dl")
def q_quality_summary(spark, sf):
    return S.quality_summary(documents_labelled(spark, sf))


@register("decade_summary_orders",
          "SELECT count(d) AS n_valid, array_to_string(list_sort(list_distinct(list(CAST(d AS VARCHAR)))), ',') AS decades "
          "FROM (SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS d FROM orders)")
def q_decade_summary(spark, sf):
    o = table(spark, sf, "orders").select(decade_of_timestamp("o_orderdate").alias("decade"))
    return S.decade_summary(o)


# ---------------------------------------------------------------- V1-V3
@register("histogram_lineitem", O.histogram_sql("lineitem", LINE_FEATURES, 50))
def q_histogram(spark, sf):
    return S.histogram(table(spark, sf, "lineitem"), LINE_FEATURES, 50)


@register("histogram_doc_chars", O.histogram_sql("documents", ["n_chars"], 60))
def q_histogram_docs(spark, sf):
    return S.histogram(table(spark, sf, "documents"), ["n_chars"], 60)


@register("box_stats_orders_minmax", f"WITH {O.ORDER_FEATURES_CTE}, {O.minmax_cte('mm', 'ofeat', 'o_orderkey', ORDER_FEATURES)}\n"
          + O.box_sql("mm", ORDER_FEATURES).replace("WITH lv AS", ", lv AS", 1).replace(", lv AS", "lv AS", 0))
def q_box(spark, sf):
    f = order_features(spark, sf)
    scaled, _ = T.scale(f, ORDER_FEATURES, "minmax")
    return S.box_stats(scaled, ORDER_FEATURES)


@register("popularity_by_brand", O.box_sql("part", ["p_retailprice"], "p_brand"))
def q_box_by_brand(spark, sf):
    return S.box_stats(table(spark, sf, "part"), ["p_retailprice"], ["p_brand"])


# ---------------------------------------------------------------- P1-P10, P16-P17
@register("zscore_orders", f"WITH {O.ORDER_FEATURES_CTE}, {O.zscore_cte('z', 'ofeat', 'o_orderkey', ORDER_FEATURES)}\n"
          "SELECT o_orderkey, " + ", ".join(f"{O.r6(f)} AS {f}" for f in ORDER_FEATURES) + " FROM z")
def q_zscore(spark, sf):
    f = order_features(spark, sf).select("o_orderkey", *ORDER_FEATURES)
    z, _ = T.scale(f, ORDER_FEATURES, "standard")
    return z.select("o_orderkey", *[rnd(F.col(c)).alias(c) for c in ORDER_FEATURES])


@register("minmax_orders", f"WITH {O.ORDER_FEATURES_CTE}, {O.minmax_cte('mm', 'ofeat', 'o_orderkey', ORDER_FEATURES)}\n"
          "SELECT o_orderkey, " + ", ".join(f"{O.r6(f)} AS {f}" for f in ORDER_FEATURES) + " FROM mm")
def q_minmax(spark, sf):
    f = order_features(spark, sf).select("o_orderkey", *ORDER_FEATURES)
    m, _ = T.scale(f, ORDER_FEATURES, "minmax")
    return m.select("o_orderkey", *[rnd(F.col(c)).alias(c) for c in ORDER_FEATURES])


@register("inverse_scale_orders", f"WITH {O.ORDER_FEATURES_CTE}\n"
          "SELECT o_orderkey, " + ", ".join(f"{O.r6(f)} AS {f}" for f in ORDER_FEATURES) + " FROM ofeat")
def q_inverse_scale(spark, sf):
    f = order_features(spark, sf).select("o_orderkey", *ORDER_FEATURES)
    z, params = T.scale(f, ORDER_FEATURES, "standard")
    back = T.inverse_scale(z, ORDER_FEATURES, params)
    return back.select("o_orderkey", *[rnd(F.col(c)).alias(c) for c in ORDER_FEATURES])


@register("log1p_doc_chars", f"SELECT doc_id, {O.r6('ln(1 + n_chars)')} AS n_chars FROM documents")
def q_log1p(spark, sf):
    out, _ = T.log_transform(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars")
    return out.select("doc_id", rnd(F.col("n_chars")).alias("n_chars"))


@register("log1p_report_doc_chars",
          f"SELECT 'n_chars' AS \"column\", {O.r6('max(n_chars)')} AS max_before, {O.r6('ln(1 + max(n_chars))')} AS max_after FROM documents")
def q_log1p_report(spark, sf):
    _, rep = T.log_transform(table(spark, sf, "documents"), "n_chars")
    return rep


WINS = "t AS (SELECT quantile_cont(n_chars, 0.95) AS t FROM documents)"


@register("winsorize_doc_chars", f"WITH {WINS} SELECT doc_id, {O.r6('CASE WHEN n_chars > t THEN t ELSE CAST(n_chars AS DOUBLE) END')} AS n_chars FROM documents, t")
def q_winsorize(spark, sf):
    out, _ = T.winsorize(table(spark, sf, "documents").select("doc_id", "n_chars"), ["n_chars"], 0.95)
    return out.select("doc_id", rnd(F.col("n_chars")).alias("n_chars"))


@register("winsorize_report_doc_chars", f"WITH {WINS} SELECT 'n_chars' AS \"column\", {O.r6('any_value(t)')} AS threshold, "
          "CAST(sum(CASE WHEN n_chars > t THEN 1 ELSE 0 END) AS BIGINT) AS n_clipped FROM documents, t")
def q_winsorize_report(spark, sf):
    _, rep = T.winsorize(table(spark, sf, "documents"), ["n_chars"], 0.95)
    return rep


@register("clean_report_documents_labels", f"WITH {DL}, dd AS (SELECT DISTINCT * FROM dl)\n"
          "SELECT CAST((SELECT count(*) FROM dl) AS BIGINT) AS rows_in, "
          "CAST((SELECT count(*) FROM dl) - (SELECT count(*) FROM dd) AS BIGINT) AS duplicates_removed, "
          "CAST((SELECT count(*) FROM dd) - (SELECT count(*) FROM dd WHERE " +
          " AND ".join(f"{c} IS NOT NULL" for c, _, _ in DL_COLS) + ") AS BIGINT) AS null_rows_removed, "
          "CAST((SELECT count(*) FROM dd WHERE " + " AND ".join(f"{c} IS NOT NULL" for c, _, _ in DL_COLS) +
          ") AS BIGINT) AS rows_out")
def q_clean_report(spark, sf):
    return C.clean_report(documents_labelled(spark, sf))


@register("clean_documents_labels", f"WITH {DL}\nSELECT DISTINCT doc_id, lang, source, n_chars, quality, toxic FROM dl WHERE " +
          " AND ".join(f"{c} IS NOT NULL" for c, _, _ in DL_COLS))
def q_clean(spark, sf):
    return C.clean(documents_labelled(spark, sf)).select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic")


@register("drop_duplicates_documents", "SELECT DISTINCT doc_id, lang, source, n_chars, sha256(text) AS text_sha FROM documents")
def q_drop_dups(spark, sf):
    d = C.drop_duplicate_rows(table(spark, sf, "documents"))
    return d.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha"))


@register("split_features_part", "SELECT p_partkey, p_size, p_retailprice FROM part")
def q_split(spark, sf):
    _, feats = C.split_columns(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"], [], "p_partkey")
    return feats


@register("fill_null_documents_labels", f"WITH {DL}\nSELECT doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM dl")
def q_fill_null(spark, sf):
    return C.fill_null(documents_labelled(spark, sf), {"quality": -1, "toxic": -1}).select(
        "doc_id", "quality", "toxic")


# ---------------------------------------------------------------- X1, X2
@register("keyword_family_part", f"SELECT p_partkey, p_name, {O.keyword_case('p_name', PART_KEYWORDS)} AS family FROM part")
def q_family_part(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", "p_name", keyword_family("p_name", PART_KEYWORDS).alias("family"))


@register("genre_family_documents", f"SELECT doc_id, {O.keyword_case('text', GENRE_KEYWORDS)} AS family FROM documents")
def q_family_docs(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", keyword_family("text").alias("family"))


@register("decade_counts_orders",
          "SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, count(*) AS count FROM orders GROUP BY 1")
def q_decades(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(decade_of_timestamp("o_orderdate").alias("decade")).agg(F.count(F.lit(1)).alias("count"))


# ====================================================================== profiles
from .functions.scalar import display_name  # noqa: E402
from .operators import assign as A  # noqa: E402
from .operators import profile as PR  # noqa: E402
from .operators import quality as Q  # noqa: E402
from .operators import sample as SM  # noqa: E402
from .operators.kmeans import initial_centres_first_rows, kmeans_lloyd  # noqa: E402
from .plans.similar_orders import clustered_orders, clustered_orders_raw, with_raw_features  # noqa: E402
from .plans.tables import embedding_features  # noqa: E402

# Rules naming the order clusters (own values for the driver's order table)
ORDER_NAME_RULES = (
    ("o_totalprice", ">", 300000.0, "high-value"),
    ("o_totalprice", "<", 200000.0, "low-value"),
    ("n_lines", ">", 5.0, "many-lines"),
    ("n_lines", "<", 3.5, "few-lines"),
    ("avg_disc", ">", 0.055, "discounted"),
    ("avg_tax", ">", 0.045, "high-tax"),
)
CL = O.clustered_raw_sql()


def _orders_profile(spark, sf):
    return PR.cluster_profile(clustered_orders_raw(spark, sf), "cluster", ORDER_FEATURES)


def _orders_named(spark, sf):
    return PR.name_clusters(_orders_profile(spark, sf), ORDER_NAME_RULES)


PROFILE_SQL = ("prof AS (SELECT cluster, " + ", ".join(f"{O.r6(f'avg({f})')} AS {f}" for f in ORDER_FEATURES) +
               " FROM labr GROUP BY cluster)")
NAMES_SQL = f"names AS (SELECT cluster, {O.cluster_name_sql(ORDER_NAME_RULES)} AS cluster_label FROM prof)"


@register("kmeans_lloyd_centres_orders", "WITH " + ",\n".join([
    O.ORDER_FEATURES_CTE, O.zscore_cte("z", "ofeat", "o_orderkey", ORDER_FEATURES),
    O.first_rows_centres("c0", "z", "o_orderkey", ORDER_FEATURES, 3),
    O.lloyd_ctes("km", "z", "c0", ORDER_FEATURES, 3, 3, "o_orderkey")[0]]) +
    "\nSELECT cid, " + ", ".join(f"{O.r6(f)} AS {f}" for f in ORDER_FEATURES) + " FROM km_c3")
def q_lloyd(spark, sf):
    f = order_features(spark, sf).select("o_orderkey", *ORDER_FEATURES)
    z, _ = T.scale(f, ORDER_FEATURES, "standard")
    z = z.persist()
    init = initial_centres_first_rows(z, ORDER_FEATURES, "o_orderkey", 3)
    cen = kmeans_lloyd(z, ORDER_FEATURES, init, 3, 3)
    return cen.select("cid", *[rnd(F.col(c)).alias(c) for c in ORDER_FEATURES])


@register("cluster_sizes_orders", f"WITH {CL}\nSELECT cluster, count(*) AS count, "
          f"{O.r6(O.pct('count(*)', 'sum(count(*)) OVER ()'))} AS pct, {O.display_sql('cluster')} AS display "
          "FROM labr GROUP BY cluster")
def q_sizes(spark, sf):
    return PR.cluster_sizes(clustered_orders(spark, sf), "cluster")


@register("cluster_profile_orders", f"WITH {CL}, {PROFILE_SQL}\nSELECT * FROM prof")
def q_profile(spark, sf):
    return _orders_profile(spark, sf)


@register("profile_normalised_orders", f"WITH {CL}, {PROFILE_SQL}\nSELECT cluster, " + ", ".join(
    f"{O.r6(f'CASE WHEN max({f}) OVER () = min({f}) OVER () THEN 0.0 ELSE ({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()) END')} AS {f}"
    for f in ORDER_FEATURES) + " FROM prof")
def q_profile_norm(spark, sf):
    return PR.profile_normalised(_orders_profile(spark, sf), ORDER_FEATURES)


@register("profile_long_orders", f"WITH {CL}, {PROFILE_SQL}, pn AS (SELECT cluster, " + ", ".join(
    f"{O.r6(f'CASE WHEN max({f}) OVER () = min({f}) OVER () THEN 0.0 ELSE ({f} - min({f}) OVER ()) / (max({f}) OVER () - min({f}) OVER ()) END')} AS {f}"
    for f in ORDER_FEATURES) + " FROM prof),\nlv AS (" + O.union_all(
    [f"SELECT cluster, '{f}' AS axis, CAST({i} AS INTEGER) AS position, {f} AS value FROM pn"
     for i, f in enumerate(ORDER_FEATURES)] +
    [f"SELECT cluster, '{ORDER_FEATURES[0]}' AS axis, CAST({len(ORDER_FEATURES)} AS INTEGER) AS position, "
     f"{ORDER_FEATURES[0]} AS value FROM pn"]) + ")\nSELECT * FROM lv")
def q_profile_long(spark, sf):
    return PR.profile_long(_orders_profile(spark, sf), ORDER_FEATURES, normalise=True, close=True)


@register("name_clusters_orders", f"WITH {CL}, {PROFILE_SQL}, {NAMES_SQL}\nSELECT * FROM names")
def q_names(spark, sf):
    return _orders_named(spark, sf)


@register("labelled_orders_export", f"WITH {CL}, {PROFILE_SQL}, {NAMES_SQL}\n"
          "SELECT o_orderkey, labr.cluster, cluster_label, "
          f"{O.display_sql('labr.cluster', 'cluster_label')} AS display, "
          "CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade FROM labr LEFT JOIN names USING (cluster)")
def q_export_labels(spark, sf):
    lab = A.label_join(clustered_orders_raw(spark, sf), _orders_named(spark, sf), "cluster", "cluster_label")
    return lab.select("o_orderkey", "cluster", "cluster_label",
                      display_name("cluster", "cluster_label").alias("display"),
                      decade_of_timestamp("o_orderdate").alias("decade"))


@register("crosstab_priority_by_cluster", f"WITH {CL}\nSELECT cluster AS row, o_orderpriority AS value, count(*) AS count, "
          f"{O.r6(O.pct('count(*)', 'sum(count(*)) OVER (PARTITION BY cluster)'))} AS pct FROM labr GROUP BY cluster, o_orderpriority")
def q_crosstab(spark, sf):
    return PR.crosstab_pct(clustered_orders_raw(spark, sf), "cluster", "o_orderpriority")


@register("top_priorities_across_clusters", f"WITH {CL}, ct AS (SELECT cluster AS row, o_orderpriority AS value, "
          f"{O.pct('count(*)', 'sum(count(*)) OVER (PARTITION BY cluster)')} AS pct FROM labr GROUP BY cluster, o_orderpriority),\n"
          "ct2 AS (SELECT row, value, " + O.r6("pct") + " AS pct FROM ct),\n"
          "m AS (SELECT value, sum(pct) / (SELECT count(DISTINCT row) FROM ct2) AS m FROM ct2 GROUP BY value)\n"
          f"SELECT value, {O.r6('m')} AS mean_pct, CAST(row_number() OVER (ORDER BY m DESC, value) AS INTEGER) AS rank FROM m "
          "QUALIFY rank <= 3")
def q_top_columns(spark, sf):
    return PR.top_columns(PR.crosstab_pct(clustered_orders_raw(spark, sf), "cluster", "o_orderpriority"), 3)


DEC_SQL = ("dc AS (SELECT CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER) AS decade, cluster, count(*) AS count, "
           "sum(count(*)) OVER (PARTITION BY CAST(floor(year(o_orderdate) / 10) * 10 AS INTEGER)) AS t "
           "FROM labr GROUP BY 1, 2),\n"
           f"dbc AS (SELECT decade, cluster, count, {O.r6(O.pct('count', 't'))} AS pct FROM dc WHERE t >= 50)")


@register("decade_by_cluster_orders", f"WITH {CL}, {DEC_SQL}\nSELECT * FROM dbc")
def q_decade_by_cluster(spark, sf):
    c = clustered_orders_raw(spark, sf).withColumn("decade", decade_of_timestamp("o_orderdate"))
    return PR.decade_by_cluster(c, "cluster", "decade", 50)


@register("dominant_cluster_per_decade", f"WITH {CL}, {DEC_SQL}\n"
          "SELECT decade AS row, arg_min(cluster, (-pct, cluster)) AS dominant, max(pct) AS pct FROM dbc GROUP BY decade")
def q_dominant(spark, sf):
    c = clustered_orders_raw(spark, sf).withColumn("decade", decade_of_timestamp("o_orderdate"))
    d = PR.decade_by_cluster(c, "cluster", "decade", 50)
    return PR.dominant_per_row(d, "decade", "cluster", "pct")


@register("price_by_cluster_orders", O.box_sql("labr", ["o_totalprice"], "cluster")
          .replace("WITH lv AS", f"WITH {CL}, lv AS", 1).replace("SELECT cluster, feature, count(*)", "SELECT cluster, count(*)", 1)
          .replace("GROUP BY cluster, feature\n", "GROUP BY cluster, feature", 1))
def q_price_by_cluster(spark, sf):
    return PR.popularity_by_cluster(clustered_orders_raw(spark, sf), "cluster", "o_totalprice")


@register("best_cluster_by_price", f"WITH {CL}, m AS (SELECT cluster, {O.r6('quantile_cont(o_totalprice, 0.5)')} AS median "
          "FROM labr GROUP BY cluster ORDER BY median DESC, cluster LIMIT 1)\n"
          "SELECT cluster, median, printf('Cluster %d has the highest median %s (%.2f).', cluster, 'o_totalprice', median) AS sentence FROM m")
def q_best_cluster(spark, sf):
    return PR.best_cluster(clustered_orders_raw(spark, sf), "cluster", "o_totalprice")


@register("cluster_label_counts_orders", f"WITH {CL}, {PROFILE_SQL}, {NAMES_SQL}\n"
          "SELECT labr.cluster, arg_min(cluster_label, o_orderkey) AS cluster_label, count(*) AS count "
          "FROM labr LEFT JOIN names USING (cluster) GROUP BY labr.cluster")
def q_label_counts(spark, sf):
    lab = A.label_join(clustered_orders_raw(spark, sf), _orders_named(spark, sf), "cluster", "cluster_label")
    return PR.cluster_label_counts(lab, "cluster", "cluster_label", "o_orderkey")


@register("overview_kpis_orders", f"WITH {CL}\nSELECT count(*) AS n_items, count(DISTINCT cluster) AS n_clusters, "
          "count(DISTINCT o_custkey) AS n_entities, count(DISTINCT o_orderpriority) AS n_families FROM labr")
def q_kpis(spark, sf):
    return PR.overview_kpis(clustered_orders_raw(spark, sf), "cluster", "o_custkey", "o_orderpriority")


@register("head_per_cluster_orders", f"WITH {CL}\nSELECT o_orderkey, cluster, CAST(row_number() OVER (PARTITION BY cluster "
          "ORDER BY o_orderkey) AS INTEGER) AS position FROM labr QUALIFY position <= 5")
def q_head(spark, sf):
    h = PR.head_per_group(clustered_orders_raw(spark, sf), "cluster", "o_orderkey", 5)
    return h.select("o_orderkey", "cluster", "position")


# ====================================================================== metrics
ZL = "zl AS (SELECT o_orderkey, cluster, " + ", ".join(ORDER_FEATURES) + " FROM lab)"


def _db_sql(src: str, fs, label: str = "cluster") -> str:
    cen = ", ".join(f"avg({f}) AS c_{f}" for f in fs)
    d = "sqrt(" + O.sqdist(fs, "s.", "c.c_{f}") + ")"
    pd = "sqrt(" + O.sqdist([f"c_{f}" for f in fs], "a.", "b.{f}") + ")"
    return (f"cen AS (SELECT {label} AS cid, {cen} FROM {src} WHERE {label} <> -1 GROUP BY {label}),\n"
            f"intra AS (SELECT c.cid, avg({d}) AS s FROM {src} s JOIN cen c ON s.{label} = c.cid GROUP BY c.cid),\n"
            f"pairs AS (SELECT a.cid AS ca, b.cid AS cb, {pd} AS dist FROM cen a, cen b WHERE a.cid <> b.cid),\n"
            "r AS (SELECT ca, max((ia.s + ib.s) / dist) AS d FROM pairs JOIN intra ia ON ia.cid = ca "
            "JOIN intra ib ON ib.cid = cb WHERE dist > 0 GROUP BY ca)\n"
            "SELECT " + O.r6("CASE WHEN (SELECT count(*) FROM intra) < 2 THEN NULL "
                             "WHEN (SELECT max(s) FROM intra) = 0 OR coalesce((SELECT max(dist) FROM pairs), 0) = 0 THEN 0.0 "
                             "ELSE coalesce((SELECT sum(d) FROM r), 0) / (SELECT count(*) FROM intra) END") +
            " AS davies_bouldin")


@register("davies_bouldin_orders", f"WITH {O.clustered_orders_sql()}, {ZL},\n" + _db_sql("zl", ORDER_FEATURES))
def q_db_orders(spark, sf):
    return Q.davies_bouldin(clustered_orders(spark, sf), "cluster", ORDER_FEATURES)


@register("inertia_orders", f"WITH {O.clustered_orders_sql()}, {ZL},\n"
          "cen AS (SELECT cluster AS cid, " + ", ".join(f"avg({f}) AS c_{f}" for f in ORDER_FEATURES) +
          " FROM zl GROUP BY cluster)\n"
          f"SELECT {O.r6('sum(' + O.sqdist(ORDER_FEATURES, 's.', 'c.c_{f}') + ')')} AS inertia "
          "FROM zl s JOIN cen c ON s.cluster = c.cid")
def q_inertia(spark, sf):
    return Q.inertia(clustered_orders(spark, sf), "cluster", ORDER_FEATURES)


@register("pairwise_centroids_orders", f"WITH {O.clustered_orders_sql()}, {ZL},\n"
          "cen AS (SELECT cluster AS cid, " + ", ".join(f"avg({f}) AS {f}" for f in ORDER_FEATURES) +
          " FROM zl GROUP BY cluster)\n"
          f"SELECT a.cid AS cid_a, b.cid AS cid_b, {O.r6('sqrt(' + O.sqdist(ORDER_FEATURES, 'a.', 'b.{f}') + ')')} AS distance "
          "FROM cen a, cen b")
def q_pairwise_centroids(spark, sf):
    cen = A.centroids_of(clustered_orders(spark, sf), ORDER_FEATURES, "cluster")
    return A.pairwise_centroids(cen, ORDER_FEATURES).select("cid_a", "cid_b", rnd(F.col("distance")).alias("distance"))


EMB_DIMS = 64
EMB = [f"e{i}" for i in range(EMB_DIMS)]
EMB_SQL = ("emb AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EMB_DIMS)) +
           " FROM embeddings)")
SIL_SQL = ("pd AS (SELECT a.vec_id, a.label, b.label AS lb, "
           "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d "
           "FROM embeddings a, embeddings b),\n"
           "pc AS (SELECT vec_id, label, lb, sum(d) AS sd, count(*) AS n FROM pd GROUP BY ALL),\n"
           "ab AS (SELECT vec_id, label, max(CASE WHEN lb = label THEN CASE WHEN n > 1 THEN sd / (n - 1) ELSE 0.0 END END) AS a, "
           "min(CASE WHEN lb <> label THEN sd / n END) AS b, max(CASE WHEN lb = label THEN n END) AS n_own FROM pc GROUP BY ALL),\n"
           "sil AS (SELECT vec_id, label AS cluster, a, b, CASE WHEN n_own > 1 AND greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s FROM ab)")


def _emb(spark, sf):
    return embedding_features(spark, sf, EMB_DIMS)[0]


@register("silhouette_samples_embeddings", f"WITH {SIL_SQL}\nSELECT vec_id, CAST(cluster AS BIGINT) AS cluster, "
          f"{O.r6('a')} AS a, {O.r6('b')} AS b, {O.r6('s')} AS silhouette FROM sil")
def q_sil_samples(spark, sf):
    s = Q.silhouette_samples(_emb(spark, sf), "label", EMB, "vec_id", None)
    return s.select("vec_id", "cluster", *[rnd(F.col(c)).alias(c) for c in ("a", "b", "silhouette")])


SIL_300 = SIL_SQL.replace("FROM embeddings a, embeddings b", "FROM smp a, smp b")


@register("silhouette_samples_embeddings_n300",
          f"WITH smp AS (SELECT * FROM embeddings ORDER BY {O.phash('vec_id')}, vec_id LIMIT 300),\n{SIL_300}\n"
          f"SELECT vec_id, CAST(cluster AS BIGINT) AS cluster, {O.r6('a')} AS a, {O.r6('b')} AS b, {O.r6('s')} AS silhouette FROM sil")
def q_sil_samples_n300(spark, sf):
    """A sample smaller than the table."""
    s = Q.silhouette_samples(_emb(spark, sf), "label", EMB, "vec_id", 300)
    return s.select("vec_id", "cluster", *[rnd(F.col(c)).alias(c) for c in ("a", "b", "silhouette")])


@register("silhouette_score_embeddings", f"WITH {SIL_SQL}\nSELECT {O.r6('avg(s)')} AS silhouette_score FROM sil")
def q_sil_score(spark, sf):
    return Q.silhouette_score(_emb(spark, sf), "label", EMB, "vec_id", None)


@register("silhouette_by_cluster_embeddings", f"WITH {SIL_SQL}\nSELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS n, "
          f"{O.r6('avg(s)')} AS mean_silhouette, {O.r6('(SELECT avg(s) FROM sil)')} AS overall, "
          "avg(s) < (SELECT avg(s) FROM sil) AS weak FROM sil GROUP BY cluster")
def q_sil_by_cluster(spark, sf):
    return Q.silhouette_by_cluster(Q.silhouette_samples(_emb(spark, sf), "label", EMB, "vec_id", None))


@register("davies_bouldin_embeddings", f"WITH {EMB_SQL},\n" + _db_sql("emb", EMB, "label"))
def q_db_emb(spark, sf):
    return Q.davies_bouldin(_emb(spark, sf), "label", EMB)


@register("silhouette_diagram_embeddings", f"WITH {SIL_SQL},\n"
          "sz AS (SELECT cluster, count(*) AS size FROM sil GROUP BY cluster),\n"
          "st AS (SELECT cluster, size, 10 + coalesce(sum(size + 10) OVER (ORDER BY cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y_lower FROM sz)\n"
          "SELECT CAST(s.cluster AS BIGINT) AS cluster, vec_id, " + O.r6("s.s") + " AS silhouette, "
          "CAST(y_lower + row_number() OVER (PARTITION BY s.cluster ORDER BY round(s.s, 6), vec_id) - 1 AS BIGINT) AS y, "
          "CAST(y_lower AS BIGINT) AS y_lower, CAST(y_lower + size AS BIGINT) AS y_upper FROM sil s JOIN st USING (cluster)")
def q_sil_diagram(spark, sf):
    s = Q.silhouette_samples(_emb(spark, sf), "label", EMB, "vec_id", None)
    s = s.withColumn("silhouette", rnd(F.col("silhouette")))
    out = SM.silhouette_order(s, "cluster", "silhouette", "vec_id")
    return out.select("cluster", "vec_id", "silhouette", "y", F.col("y_lower").cast("long").alias("y_lower"), "y_upper")


@register("uniform_sample_orders", f"SELECT o_orderkey FROM orders ORDER BY {O.phash('o_orderkey')}, o_orderkey LIMIT 1000")
def q_uniform_sample(spark, sf):
    return SM.uniform_sample(table(spark, sf, "orders"), 1000, "o_orderkey").select("o_orderkey")


@register("stratified_sample_orders_n2000", f"WITH {CL}, sz AS (SELECT cluster, count(*) AS size FROM labr GROUP BY cluster),\n"
          "q AS (SELECT cluster, greatest(1, CAST(floor(2000.0::DOUBLE * size / (SELECT count(*) FROM labr)) AS BIGINT)) AS quota FROM sz)\n"
          f"SELECT o_orderkey, cluster FROM (SELECT o_orderkey, cluster, row_number() OVER (PARTITION BY cluster ORDER BY {O.phash('o_orderkey')}, o_orderkey) AS rn FROM labr) "
          "JOIN q USING (cluster) WHERE rn <= quota")
def q_stratified_n2000(spark, sf):
    return SM.stratified_sample(clustered_orders(spark, sf), "cluster", 2000, "o_orderkey").select("o_orderkey", "cluster")


@register("uniform_sample_string_ids", "SELECT id, n_chars FROM (SELECT 'doc-' || doc_id AS id, n_chars FROM documents) "
          f"ORDER BY {O.phash('id', 7)}, id LIMIT 150")
def q_uniform_sample_strings(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "n_chars")
    return SM.uniform_sample(d, 150, "id", seed=7)


@register("stratified_sample_orders", f"WITH {CL}, sz AS (SELECT cluster, count(*) AS size FROM labr GROUP BY cluster),\n"
          "q AS (SELECT cluster, greatest(1, CAST(floor(1000.0::DOUBLE * size / (SELECT count(*) FROM labr)) AS BIGINT)) AS quota FROM sz)\n"
          f"SELECT o_orderkey, cluster FROM (SELECT o_orderkey, cluster, row_number() OVER (PARTITION BY cluster ORDER BY {O.phash('o_orderkey')}, o_orderkey) AS rn FROM labr) "
          "JOIN q USING (cluster) WHERE rn <= quota")
def q_stratified(spark, sf):
    return SM.stratified_sample(clustered_orders(spark, sf), "cluster", 1000, "o_orderkey").select("o_orderkey", "cluster")


# ====================================================================== density clustering
from .operators import dbscan as DB  # noqa: E402
from .session import cut_lineage  # noqa: E402


def _emb_dims(spark, sf, dims):
    e, names = embedding_features(spark, sf, len(dims), dims[0])
    return e, names


@register("eps_join_embeddings_d3", O.eps_join_sql([0, 1, 2], 0.05))
def q_eps_join(spark, sf):
    e, fs = _emb_dims(spark, sf, [0, 1, 2])
    return DB.eps_join(e, fs, 0.05, "vec_id").select("id_a", "id_b", rnd(F.col("distance")).alias("distance"))


@register("dbscan_embeddings_d3", O.dbscan_sql([0, 1, 2], 0.05, 5))
def q_dbscan_d3(spark, sf):
    e, fs = _emb_dims(spark, sf, [0, 1, 2])
    return DB.dbscan(e, fs, 0.05, 5, "vec_id")


@register("dbscan_embeddings_d3_wide", O.dbscan_sql([0, 1, 2], 0.08, 5))
def q_dbscan_d3_wide(spark, sf):
    e, fs = _emb_dims(spark, sf, [0, 1, 2])
    return DB.dbscan(e, fs, 0.08, 5, "vec_id")


@register("dbscan_embeddings_full", O.dbscan_sql(list(range(64)), 1.15, 5))
def q_dbscan_full(spark, sf):
    e, fs = _emb_dims(spark, sf, list(range(64)))
    return DB.dbscan(e, fs, 1.15, 5, "vec_id")


@register("dbscan_sampled_embeddings_d3", O.dbscan_sql([0, 1, 2], 0.05, 5).replace(
    "SELECT p.vec_id, CAST(", "SELECT p.vec_id, CAST(", 1).replace(",\n       core.i IS NOT NULL AS is_core", "", 1))
def q_dbscan_sampled(spark, sf):
    e, fs = _emb_dims(spark, sf, [0, 1, 2])
    return DB.dbscan_sampled(e, fs, 0.05, 5, "vec_id", sample_size=15000)


_SAMPLED = O.dbscan_sql([0, 1, 2], 0.12, 4).replace(
    "FROM embeddings)", f"FROM embeddings ORDER BY {O.phash('vec_id')}, vec_id LIMIT 200)", 1).split("\nSELECT p.vec_id", 1)


@register("dbscan_sampled_embeddings_d3_n200",
          _SAMPLED[0] + ",\nlabs AS (SELECT p.vec_id AS sid, p.e0, p.e1, p.e2" + _SAMPLED[1] + "),\n"
          f"al AS (SELECT vec_id, {O.emb_cols(range(3))} FROM embeddings),\n"
          "pr AS (SELECT a.vec_id, l.sid, l.cluster, " + O.sqdist(["e0", "e1", "e2"], "a.", "l.{f}") + " AS d2 FROM al a, labs l)\n"
          "SELECT vec_id, CAST(arg_min(cluster, (d2, sid)) AS INTEGER) AS cluster FROM pr GROUP BY vec_id")
def q_dbscan_sampled_n200(spark, sf):
    """A fit on a sample smaller than the table; the other rows take the label of their nearest sample row."""
    e, fs = _emb_dims(spark, sf, [0, 1, 2])
    return DB.dbscan_sampled(e, fs, 0.12, 4, "vec_id", sample_size=200)


_GRID_SQL = O.dbscan_sql([0, 1, 2], 0.08, 5)


@register("dbscan_embeddings_d3_grid", _GRID_SQL)
def q_dbscan_grid(spark, sf):
    """The dense-cell path, whatever the number of candidate pairs."""
    e, fs = _emb_dims(spark, sf, [0, 1, 2])
    return DB.dbscan(e, fs, 0.08, 5, "vec_id", method="grid")


PROP_SQL = (f"WITH pts AS (SELECT vec_id, label, {O.emb_cols(range(64))} FROM embeddings),\n"
            f"smp AS (SELECT * FROM pts ORDER BY {O.phash('vec_id')}, vec_id LIMIT 100),\n"
            "pr AS (SELECT p.vec_id, s.vec_id AS sid, s.label AS sl, " +
            O.sqdist([f"e{i}" for i in range(64)], "p.", "s.{f}") + " AS d2 FROM pts p, smp s)\n"
            "SELECT vec_id, arg_min(sid, (d2, sid)) AS nn_id, CAST(arg_min(sl, (d2, sid)) AS INTEGER) AS nn_label, "
            + O.r6("sqrt(min(d2))") + " AS nn_dist FROM pr GROUP BY vec_id")


@register("propagate_nearest_embeddings", PROP_SQL)
def q_propagate(spark, sf):
    e = _emb(spark, sf)
    smp = SM.uniform_sample(e, 100, "vec_id")
    nn = A.propagate_nearest(e, smp, EMB, "vec_id", "vec_id", "label")
    return nn.select("vec_id", "nn_id", "nn_label", rnd(F.col("nn_dist")).alias("nn_dist"))


def _emb_evaluated(spark, sf):
    e = _emb(spark, sf)
    given = Q.evaluate(e, "label", EMB, "vec_id", "Labels", None)
    lab = DB.dbscan(e, EMB, 1.15, 5, "vec_id")
    d = cut_lineage(e.drop("label").join(lab.select("vec_id", F.col("cluster").alias("label")), "vec_id"))
    dbs = Q.evaluate(d, "label", EMB, "vec_id", "DBSCAN", None)
    return given, dbs


def _eval_sql():
    dbscan = O.dbscan_sql(list(range(64)), 1.15, 5)
    ctes, final = dbscan[len("WITH RECURSIVE "):].split("\nSELECT p.vec_id", 1)
    fs = [f"e{i}" for i in range(64)]
    parts = [
        ctes, "dbres AS (SELECT p.vec_id" + final + ")",
        "dbl AS (SELECT vec_id, cluster AS label, embedding, " +
        O.emb_cols(range(64)).replace("embedding[", "e.embedding[") + " FROM dbres JOIN embeddings e USING (vec_id))",
        f"gl AS (SELECT vec_id, label, embedding, {O.emb_cols(range(64))} FROM embeddings)",
        O.silhouette_sql("gl", "_g"), O.db_sql("gl", fs, sx="_g"),
        O.silhouette_sql("dbl", "_d"), O.db_sql("dbl", fs, sx="_d"),
    ]
    return "WITH RECURSIVE " + ",\n".join(parts)


EVAL_CTES = _eval_sql()


@register("evaluate_labels_embeddings", EVAL_CTES + "\n" + O.evaluate_sql("Labels", "gl", EMB, "_g"))
def q_evaluate(spark, sf):
    return _emb_evaluated(spark, sf)[0]


@register("compare_algorithms_embeddings", EVAL_CTES + "\n" + O.evaluate_sql("Labels", "gl", EMB, "_g") +
          "\nUNION ALL\n" + O.evaluate_sql("DBSCAN", "dbl", EMB, "_d"))
def q_compare(spark, sf):
    return Q.compare_algorithms(list(_emb_evaluated(spark, sf)))


# ====================================================================== search / serving
from .operators import charts as CH  # noqa: E402
from .operators import search as SE  # noqa: E402

PART_FAM = f"pf AS (SELECT *, {O.keyword_case('p_name', PART_KEYWORDS)} AS family FROM part)"


def _part_fam(spark, sf):
    p = table(spark, sf, "part")
    return p.withColumn("family", keyword_family("p_name", PART_KEYWORDS))


def _rx(col, q):
    return f"coalesce(regexp_matches(lower({col}), '{q}'), false)"


@register("explore_parts", f"WITH {PART_FAM}\nSELECT p_partkey, p_name, p_brand, p_type, family FROM pf "
          f"WHERE p_type = 'SMALL' AND family = 'Temperature' AND ({_rx('p_name', 'gear|rod')} OR {_rx('p_brand', 'gear|rod')})")
def q_explore(spark, sf):
    f = SE.explore(_part_fam(spark, sf), {"p_type": "SMALL", "family": "Temperature"}, "gear|rod",
                   ["p_name", "p_brand"])
    return f.select("p_partkey", "p_name", "p_brand", "p_type", "family")


@register("explore_display_parts", f"WITH {PART_FAM}\nSELECT p_partkey, p_name, p_brand, family, p_type FROM pf "
          f"WHERE {_rx('p_name', 'o')} OR {_rx('p_brand', 'o')} ORDER BY p_partkey LIMIT 500")
def q_explore_display(spark, sf):
    f = SE.explore(_part_fam(spark, sf), {}, "o", ["p_name", "p_brand"])
    return SE.explore_display(f, ["p_name", "p_brand", "family", "p_type"], "p_partkey", 500)


@register("explore_count_parts", f"WITH {PART_FAM}\nSELECT count(*) AS n_matching, (SELECT count(*) FROM part) AS n_total "
          f"FROM pf WHERE family = 'Age' AND ({_rx('p_name', 'bolt')} OR {_rx('p_brand', 'bolt')})")
def q_explore_count(spark, sf):
    p = _part_fam(spark, sf)
    return SE.explore_count(p, SE.explore(p, {"family": "Age"}, "bolt", ["p_name", "p_brand"]))


@register("find_parts", "SELECT p_partkey, p_name, p_brand, concat_ws(' - ', p_name, p_brand) AS display FROM part "
          f"WHERE {_rx('p_name', 'old')} ORDER BY p_partkey LIMIT 20")
def q_find(spark, sf):
    return SE.find_items(table(spark, sf, "part"), "p_name", "old", "p_partkey", "p_brand", 20)


@register("distinct_part_types", "SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL")
def q_distinct_values(spark, sf):
    return SE.distinct_values(table(spark, sf, "part"), "p_type")


@register("similar_orders_batch", f"WITH {O.clustered_orders_sql()},\n"
          "qs AS (SELECT * FROM lab WHERE o_orderkey % 100 = 0),\n"
          "c AS (SELECT q.o_orderkey AS query_id, l.o_orderkey, sqrt(" + O.sqdist(ORDER_FEATURES, "l.", "q.{f}") + ") AS dist "
          "FROM lab l JOIN qs q ON l.cluster = q.cluster WHERE l.o_orderkey <> q.o_orderkey)\n"
          "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY dist, o_orderkey) AS INTEGER) AS rank, "
          f"o_orderkey, {O.r6('dist')} AS distance, round(1.0::DOUBLE / (1.0::DOUBLE + dist), 4) AS similarity_score FROM c "
          "QUALIFY rank <= 10")
def q_similar_batch(spark, sf):
    """The orders whose key 100 divides, against all orders."""
    lab = clustered_orders(spark, sf)
    queries = lab.where(F.col("o_orderkey") % 100 == 0)
    return SE.similar_items_many(lab, queries, ORDER_FEATURES, "o_orderkey", "cluster", 10)


@register("item_profile_order", f"WITH {O.ORDER_FEATURES_CTE},\n"
          "q AS (SELECT * FROM ofeat ORDER BY o_totalprice DESC, o_orderkey LIMIT 1),\n"
          "rg AS (SELECT " + ", ".join(f"min({f}) AS lo_{f}, max({f}) AS hi_{f}" for f in ORDER_FEATURES) + " FROM ofeat)\n" +
          O.union_all([f"SELECT '{f}' AS axis, {O.r6(f'({f} - lo_{f}) / (hi_{f} - lo_{f} + 1e-10)')} AS value FROM q, rg"
                       for f in ORDER_FEATURES]))
def q_item_profile(spark, sf):
    f = order_features(spark, sf)
    qid = f.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).first()["o_orderkey"]
    return SE.item_profile(f, qid, ORDER_FEATURES, "o_orderkey")


# ====================================================================== chart data
DOC_FAM = f"df AS (SELECT *, {O.keyword_case('text', GENRE_KEYWORDS)} AS family FROM documents)"


def _doc_fam(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", keyword_family("text").alias("family"))


@register("genre_mix_documents", f"WITH {DOC_FAM}\nSELECT lang AS row, family AS value, count(*) AS count, "
          f"{O.r6(O.pct('count(*)', 'sum(count(*)) OVER (PARTITION BY lang)'))} AS pct FROM df GROUP BY lang, family")
def q_genre_mix(spark, sf):
    return CH.category_mix(_doc_fam(spark, sf), "lang", "family")


@register("genre_heatmap_documents", f"WITH {DOC_FAM},\nct AS (SELECT lang AS row, family AS value, count(*) AS count, "
          f"{O.r6(O.pct('count(*)', 'sum(count(*)) OVER (PARTITION BY lang)'))} AS pct FROM df GROUP BY lang, family),\n"
          "m AS (SELECT value, sum(pct) / (SELECT count(DISTINCT row) FROM ct) AS m FROM ct GROUP BY value),\n"
          "t AS (SELECT value, CAST(row_number() OVER (ORDER BY round(m, 6) DESC, value) AS INTEGER) AS rank FROM m QUALIFY rank <= 10)\n"
          "SELECT row, value, rank, count, pct FROM ct JOIN t USING (value)")
def q_genre_heatmap(spark, sf):
    return CH.category_mix(_doc_fam(spark, sf), "lang", "family", 10)


@register("decade_mix_sentence_orders", f"WITH {CL}, {DEC_SQL}\nSELECT count(DISTINCT decade) AS n_decades, "
          "printf('Cluster mix across %d decades with enough rows.', count(DISTINCT decade)) AS sentence FROM dbc")
def q_decade_sentence(spark, sf):
    c = clustered_orders_raw(spark, sf).withColumn("decade", decade_of_timestamp("o_orderdate"))
    return CH.decade_mix_sentence(PR.decade_by_cluster(c, "cluster", "decade", 50))


@register("pca_2d_orders")
def q_pca(spark, sf):
    rows, _ = CH.pca_2d(clustered_orders(spark, sf), ORDER_FEATURES, "o_orderkey")
    return rows


def _pca_sql(rounds=800):
    """Two leading eigenvalues of the covariance of the z-scored orders by power
    iteration: ``eig`` (l1, l2, total)."""
    fs, d = ORDER_FEATURES, range(len(ORDER_FEATURES))
    c = {(i, j): f"c{min(i, j)}_{max(i, j)}" for i in d for j in d}
    cov = ", ".join(f"covar_samp({fs[i]}, {fs[j]}) AS {c[i, j]}" for i in d for j in d if i <= j)

    def iterate(name, matrix):
        step = ", ".join("(" + " + ".join(f"{matrix[i, j]} * x{j}" for j in d) + f") AS y{i}" for i in d)
        norm = "sqrt(" + " + ".join(f"y{i} * y{i}" for i in d) + ")"
        start = ", ".join(f"{1.0 + 0.37 * i}::DOUBLE AS x{i}" for i in d)
        return (f"{name}(t, {', '.join(f'x{i}' for i in d)}, len) AS (SELECT 0, {start}, 0::DOUBLE UNION ALL "
                f"SELECT t + 1, {', '.join(f'y{i} / {norm}' for i in d)}, {norm} FROM (SELECT t, {step} FROM {name}, "
                f"{'cov' if name == 'p1' else 'cov2'} WHERE t < {rounds}) s)")

    deflated = ", ".join(f"{c[i, j]} - len * x{i} * x{j} AS {c[i, j]}" for i in d for j in d if i <= j)
    return ("WITH RECURSIVE " + ",\n".join([
        O.ORDER_FEATURES_CTE, O.zscore_cte("z", "ofeat", "o_orderkey", fs), f"cov AS (SELECT {cov} FROM z)", iterate("p1", c),
        f"cov2 AS (SELECT {deflated} FROM cov, p1 WHERE t = {rounds})", iterate("p2", c),
        "eig AS (SELECT (SELECT len FROM p1 WHERE t = %d) AS l1, (SELECT len FROM p2 WHERE t = %d) AS l2, %s AS total FROM cov)"
        % (rounds, rounds, " + ".join(c[i, i] for i in d))]))


@register("pca_moments_orders", _pca_sql() + f"\nSELECT {O.r6('l1')} AS var_pc1, {O.r6('l2')} AS var_pc2, 0.0::DOUBLE AS cov, "
          "0.0::DOUBLE AS mean_pc1, 0.0::DOUBLE AS mean_pc2 FROM eig")
def q_pca_moments(spark, sf):
    """The projections have the eigenvalues as variances, no covariance and mean zero."""
    rows, _ = CH.pca_2d(_zorders(spark, sf), ORDER_FEATURES, "o_orderkey")
    return rows.agg(*[rnd(e).alias(n) for e, n in (
        (F.var_samp("pc1"), "var_pc1"), (F.var_samp("pc2"), "var_pc2"), (F.covar_samp("pc1", "pc2"), "cov"),
        (F.avg("pc1"), "mean_pc1"), (F.avg("pc2"), "mean_pc2"))])


@register("pca_variance_orders", _pca_sql() + "\nSELECT 'pc1' AS component, l1 / total AS variance_ratio FROM eig "
          "UNION ALL SELECT 'pc2', l2 / total FROM eig")
def q_pca_var(spark, sf):
    _, ratios = CH.pca_2d(clustered_orders(spark, sf), ORDER_FEATURES, "o_orderkey")
    return ratios


# ====================================================================== model fits (no exact SQL form)
from .operators import hierarchy as H  # noqa: E402
from .operators import kmeans as KM  # noqa: E402


def _zorders(spark, sf):
    f = order_features(spark, sf).select("o_orderkey", *ORDER_FEATURES)
    z, _ = T.scale(f, ORDER_FEATURES, "standard")
    return z


@register("kmeans_orders_k3")
def q_kmeans(spark, sf):
    z = _zorders(spark, sf).persist()
    cen, cost = KM.kmeans(z, ORDER_FEATURES, 3, n_init=5, seed=42)
    lab = A.nearest_centroid(z, cen, ORDER_FEATURES, 3, out="cluster")
    return PR.cluster_sizes(lab, "cluster").withColumn("inertia", F.lit(round(cost, 4)))


@register("minibatch_kmeans_orders_k3")
def q_minibatch(spark, sf):
    z = _zorders(spark, sf).persist()
    cen, cost = KM.minibatch_kmeans(z, ORDER_FEATURES, 3, 2048, 3, 100, 42, "o_orderkey")
    return cen.withColumn("inertia_all_rows", F.lit(round(cost, 4)))


MB_ROUNDS, MB_BATCH = 6, 2000


def _minibatch_sql(k=3):
    """Rounds of mini-batch k-means from the first k rows, one range of the hash each, unrolled."""
    fs = ORDER_FEATURES
    parts = [O.ORDER_FEATURES_CTE, O.zscore_cte("z", "ofeat", "o_orderkey", fs),
             f"h AS (SELECT *, {O.phash('o_orderkey')} AS h FROM z)",
             f"w AS (SELECT CAST(ceil(count(*) / {MB_BATCH}::DOUBLE) AS BIGINT) AS ranges, "
             f"CAST(ceil({SM.HASH_RANGE}::HUGEINT / ceil(count(*) / {MB_BATCH}::DOUBLE)) AS BIGINT) AS width FROM z)",
             O.first_rows_centres("f0", "z", "o_orderkey", fs, k), "c0 AS (SELECT *, 0 AS given FROM f0)"]
    for t in range(MB_ROUNDS):
        parts.append(f"b{t} AS (SELECT h.* FROM h, w WHERE h >= ({t} % ranges) * width AND h < ({t} % ranges) * width + width)")
        parts.append(O.assign_cte(f"a{t}", f"b{t}", f"c{t}", fs, k, "o_orderkey"))
        parts.append(f"n{t} AS (SELECT cluster AS cid, count(*) AS n, " + ", ".join(f"avg({f}) AS m_{f}" for f in fs) + f" FROM a{t} GROUP BY cluster)")
        parts.append(f"c{t + 1} AS (SELECT c.cid, given + coalesce(n, 0) AS given, " + ", ".join(
            f"c.{f} + coalesce(n / (given + n)::DOUBLE * (m_{f} - c.{f}), 0) AS {f}" for f in fs) + f" FROM c{t} c LEFT JOIN n{t} USING (cid))")
    parts.append(O.assign_cte("fin", "z", f"c{MB_ROUNDS}", fs, k, "o_orderkey"))
    return ("WITH " + ",\n".join(parts) + f"\nSELECT CAST(row_number() OVER (ORDER BY {', '.join(fs)}) - 1 AS INTEGER) AS cid, "
            + ", ".join(f"{O.r6(f)} AS {f}" for f in fs) + f", (SELECT {O.r6('sum(md)')} FROM fin) AS inertia FROM c{MB_ROUNDS}")


@register("minibatch_rounds_orders", _minibatch_sql())
def q_minibatch_rounds(spark, sf):
    """Six rounds from the first three rows: every batch and step replayed in SQL."""
    z = _zorders(spark, sf)
    first = [[r[f] for f in ORDER_FEATURES] for r in z.orderBy("o_orderkey").limit(3).collect()]
    cen, cost = KM.minibatch_kmeans(z, ORDER_FEATURES, 3, MB_BATCH, 1, MB_ROUNDS, 42, "o_orderkey", tol=0.0, starts=[first])
    return cen.select("cid", *[rnd(F.col(f)).alias(f) for f in ORDER_FEATURES], rnd(F.lit(cost)).alias("inertia"))


def _sweep(spark, sf):
    z = _zorders(spark, sf)
    return KM.kmeans_sweep(z, ORDER_FEATURES, "o_orderkey", range(2, 11), n_init=3, max_iter=100,
                           silhouette_sample=5000)


@register("kmeans_sweep_orders")
def q_sweep(spark, sf):
    return _sweep(spark, sf)


def _label_sweep(spark, sf):
    """(k, silhouette) of the embeddings' labels folded to k groups."""
    e = _emb(spark, sf)
    out = None
    for k in (2, 3, 4, 5):
        folded = e.withColumn("label", F.pmod(F.col("label"), F.lit(k)))
        row = Q.silhouette_score(folded, "label", EMB, "vec_id", None).select(
            F.lit(k).alias("k"), F.col("silhouette_score").alias("silhouette"))
        out = row if out is None else out.unionByName(row)
    return out


_FOLDED = ",\n".join(f"f{k} AS (SELECT vec_id, label % {k} AS label, embedding FROM embeddings),\n" + O.silhouette_sql(f"f{k}", f"_{k}")
                     for k in (2, 3, 4, 5))


@register("silhouette_points_embeddings", f"WITH {_FOLDED},\nsw AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, {O.r6('avg(s)')} AS silhouette FROM sil_{k}" for k in (2, 3, 4, 5)) +
    ")\nSELECT CAST(k AS INTEGER) AS k, silhouette, k = (SELECT k FROM sw ORDER BY silhouette DESC, k LIMIT 1) AS best FROM sw")
def q_silhouette_points(spark, sf):
    return CH.silhouette_points(_label_sweep(spark, sf))


@register("select_k_embeddings", f"WITH {_FOLDED},\nsw AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, {O.r6('avg(s)')} AS silhouette FROM sil_{k}" for k in (2, 3, 4, 5)) +
    ")\nSELECT CAST(k AS INTEGER) AS best_k FROM sw ORDER BY silhouette DESC, k LIMIT 1")
def q_select_k(spark, sf):
    return KM.select_k(_label_sweep(spark, sf))


@register("k_recommendation_orders")
def q_recommend_k(spark, sf):
    return KM.recommend_k(_sweep(spark, sf))


def _folded_inertia(k):
    diffs = " + ".join(f"(e{i} - m{i}) * (e{i} - m{i})" for i in range(EMB_DIMS))
    means = ", ".join(f"e{i}, avg(e{i}) OVER (PARTITION BY label % {k}) AS m{i}" for i in range(EMB_DIMS))
    return f"SELECT sum({diffs}) FROM (SELECT {means} FROM emb)"


@register("k_recommendation_embeddings", f"WITH {EMB_SQL},\n{_FOLDED},\nsw AS (" + " UNION ALL ".join(
    f"SELECT {k} AS k, ({_folded_inertia(k)}) AS inertia, {O.r6('avg(s)')} AS silhouette FROM sil_{k}" for k in (2, 3, 4, 5)) +
    f"),\n{O.elbow_sql('sw')}\nSELECT CAST(elbow_k AS INTEGER) AS elbow_k, "
    "CAST((SELECT k FROM sw ORDER BY silhouette DESC, k LIMIT 1) AS INTEGER) AS silhouette_k, CAST(elbow_k AS INTEGER) AS recommended_k FROM elbow")
def q_recommend_given(spark, sf):
    """Elbow and silhouette choice over the embeddings' labels folded to k groups."""
    e = _emb(spark, sf)
    cost = None
    for k in (2, 3, 4, 5):
        row = Q.inertia(e.withColumn("label", F.col("label") % k), "label", EMB).select(F.lit(k).alias("k"), "inertia")
        cost = row if cost is None else cost.unionByName(row)
    return KM.recommend_k(cost.join(_label_sweep(spark, sf), "k"))


@register("k_comparison_orders")
def q_k_comparison(spark, sf):
    return KM.k_comparison(_zorders(spark, sf), ORDER_FEATURES, "o_orderkey", (3, 6), n_init=5)


@register("hierarchical_orders_k3")
def q_hier(spark, sf):
    labels, _ = H.hierarchical(_zorders(spark, sf), ORDER_FEATURES, 3, "o_orderkey", "ward", 200)
    return PR.cluster_sizes(labels, "cluster")


@register("bisecting_orders_k4")
def q_bisecting(spark, sf):
    """Leaves of the divisive tree over all orders."""
    _, tree = H.bisecting(_zorders(spark, sf), ORDER_FEATURES, 4, "o_orderkey")
    return tree.where("cluster is not null").select("cluster", "depth", "size", rnd(F.col("cost")).alias("cost"))


_LINKED = O.dbscan_sql(list(range(64)), 1.05, 1)


@register("single_linkage_embeddings_h", _LINKED.replace("\nSELECT p.vec_id, CAST(", "\n, res AS (SELECT p.vec_id, CAST(", 1)
          + ")\nSELECT vec_id, cluster FROM res")
def q_single_linkage(spark, sf):
    """Single linkage over all vectors, cut at height 1.05: the components of pairs within it."""
    labels, _ = H.single_linkage(_emb(spark, sf), EMB, "vec_id", height=1.05)
    return labels


@register("dendrogram_orders")
def q_dendro(spark, sf):
    _, dendro = H.hierarchical(_zorders(spark, sf), ORDER_FEATURES, 3, "o_orderkey", "ward", 200)
    return H.dendrogram_table(dendro, 30)


@register("assign_from_sample_orders")
def q_assign_from_sample(spark, sf):
    z = _zorders(spark, sf).persist()
    smp = SM.uniform_sample(z, 8000, "o_orderkey")
    lab, _ = H.hierarchical(smp, ORDER_FEATURES, 3, "o_orderkey", "ward", 200)
    labelled = smp.join(lab, "o_orderkey")
    out = A.assign_from_sample(z, labelled, ORDER_FEATURES, "cluster", 3)
    return PR.cluster_sizes(out, "cluster")


@register("assign_from_sample_labels", "WITH " + ",\n".join([
    O.ORDER_FEATURES_CTE, O.zscore_cte("z", "ofeat", "o_orderkey", ORDER_FEATURES),
    f"smp AS (SELECT * FROM z ORDER BY {O.phash('o_orderkey')}, o_orderkey LIMIT 2000)",
    "cen AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS cid, " + ", ".join(f"avg({f}) AS {f}" for f in ORDER_FEATURES) + " FROM smp GROUP BY 1)",
    O.assign_cte("al", "z", "cen", ORDER_FEATURES, 3, "o_orderkey")]) + "\nSELECT o_orderkey, cluster FROM al")
def q_assign_given(spark, sf):
    """Centroids of a sample with given labels, then the nearest for every order."""
    z = _zorders(spark, sf)
    smp = SM.uniform_sample(z, 2000, "o_orderkey").withColumn("cluster", (F.col("o_orderkey") % 3).cast("int"))
    return A.assign_from_sample(z, smp, ORDER_FEATURES, "cluster", 3).select("o_orderkey", "cluster")


# ====================================================================== sources, sinks, reports
from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType,  # noqa: E402
                               StructField, StructType)

from .session import scratch_path  # noqa: E402
from .sources import files as IO  # noqa: E402
from .sources import reports as RP  # noqa: E402

PART_SCHEMA = StructType([StructField("p_partkey", LongType()), StructField("p_name", StringType()),
                          StructField("p_brand", StringType()), StructField("p_type", StringType()),
                          StructField("p_size", IntegerType()), StructField("p_retailprice", DoubleType())])


@register("csv_roundtrip_part", "SELECT * FROM part")
def q_csv_roundtrip(spark, sf):
    path = scratch_path(spark, "part-csv")
    IO.write_table(table(spark, sf, "part"), path, "csv")
    return IO.read_table(spark, path, PART_SCHEMA, "csv")


@register("export_filtered_part", "SELECT p_partkey, p_name, p_brand, p_retailprice FROM part "
          "WHERE p_size >= 25 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22', 'Brand#23')")
def q_export_filtered(spark, sf):
    """A filtered table written as CSV and read back."""
    path = scratch_path(spark, "part-filtered")
    cols = ["p_partkey", "p_name", "p_brand", "p_retailprice"]
    brands = [f"Brand#{a}{b}" for a in (1, 2) for b in (1, 2, 3)]
    IO.export_filtered(table(spark, sf, "part"), (F.col("p_size") >= 25) & F.col("p_brand").isin(brands), path, cols)
    return IO.read_table(spark, path, StructType([f for f in PART_SCHEMA.fields if f.name in cols]), "csv")


@register("read_first_existing_export", f"WITH {CL}, {PROFILE_SQL}, {NAMES_SQL}\n"
          "SELECT o_orderkey, labr.cluster, coalesce(cluster_label, 'Other') AS cluster_label FROM labr LEFT JOIN names USING (cluster)")
def q_read_first_existing(spark, sf):
    lab = A.label_join(clustered_orders_raw(spark, sf), _orders_named(spark, sf), "cluster", "cluster_label")
    base = scratch_path(spark, "export")
    IO.write_table(lab.select("o_orderkey", "cluster", "cluster_label"), base + "/v1", partition_by=["cluster"])
    back = IO.read_first_existing(spark, [base + "/v2", base + "/v1"], fill={"cluster_label": "Other"})
    return back.select("o_orderkey", F.col("cluster").cast("int").alias("cluster"), "cluster_label")


@register("metrics_json_roundtrip", O.describe_sql("lineitem", LINE_FEATURES))
def q_metrics_json(spark, sf):
    d = S.describe(table(spark, sf, "lineitem"), LINE_FEATURES)
    path = IO.write_metrics(d, scratch_path(spark, "metrics"))
    return spark.read.schema(d.schema).json(path)


@register("saved_scaled_reload", f"WITH {O.ORDER_FEATURES_CTE}, {O.zscore_cte('z', 'ofeat', 'o_orderkey', ORDER_FEATURES)}\n"
          "SELECT o_orderkey, " + ", ".join(f"{O.r6(f)} AS {f}" for f in ORDER_FEATURES) + " FROM z")
def q_saved_scaled(spark, sf):
    f = order_features(spark, sf).select("o_orderkey", *ORDER_FEATURES)
    z, _ = T.scale(f, ORDER_FEATURES, "standard")
    z = z.select("o_orderkey", *[rnd(F.col(c)).alias(c) for c in ORDER_FEATURES])
    paths = IO.save_results({"scaled": z}, scratch_path(spark, "results"))
    n = f.count()
    return IO.load_or_recompute(spark, paths["scaled"], n, lambda: z)


@register("insights_report_orders")
def q_insights(spark, sf):
    f = order_features(spark, sf)
    return RP.insights_report(f, ORDER_FEATURES, ["o_orderpriority", "o_orderstatus"], None, 15,
                              id_col="o_orderkey", name_col="o_custkey", date_col="o_orderdate")


@register("summary_report_orders")
def q_summary(spark, sf):
    z = clustered_orders(spark, sf)
    kc = KM.k_comparison(z, ORDER_FEATURES, "o_orderkey", (3, 6), n_init=2)
    km = Q.evaluate(z, "cluster", ORDER_FEATURES, "o_orderkey", "K-Means", 5000, with_inertia=True)
    hl, _ = H.hierarchical(z.select("o_orderkey", *ORDER_FEATURES), ORDER_FEATURES, 3, "o_orderkey")
    hz = cut_lineage(z.drop("cluster").join(hl, "o_orderkey"))
    hi = Q.evaluate(hz, "cluster", ORDER_FEATURES, "o_orderkey", "Hierarchical", 5000)
    comp = Q.compare_algorithms([km, hi])
    raw = with_raw_features(z)
    prof = PR.cluster_profile(raw, "cluster", ORDER_FEATURES)
    names = PR.name_clusters(prof, ORDER_NAME_RULES)
    sizes = PR.cluster_sizes(raw, "cluster")
    mix = PR.crosstab_pct(raw, "cluster", "o_orderpriority")
    by_decade = PR.decade_by_cluster(raw.withColumn("decade", decade_of_timestamp("o_orderdate")), "cluster", "decade")
    return RP.summary_report(kc, comp, prof, names, sizes, mix, decades=by_decade,
                             popularity=PR.best_cluster(raw, "cluster", "o_totalprice"))


# ====================================================================== deterministic k search, remaining operators
SWEEP_SQL = O.lloyd_sweep_sql()


def _lloyd_sweep(spark, sf):
    return KM.lloyd_sweep(_zorders(spark, sf), ORDER_FEATURES, "o_orderkey", range(2, 11), 3)


@register("lloyd_sweep_orders", f"WITH {SWEEP_SQL}\nSELECT * FROM sweep")
def q_lloyd_sweep(spark, sf):
    return _lloyd_sweep(spark, sf)


@register("elbow_orders", f"WITH {SWEEP_SQL},\n{O.elbow_sql()}\nSELECT knee, elbow_k FROM elbow")
def q_elbow(spark, sf):
    return Q.elbow_k(_lloyd_sweep(spark, sf))


@register("elbow_points_orders", f"WITH {SWEEP_SQL},\n{O.elbow_sql()}\n"
          "SELECT k, inertia, k = (SELECT elbow_k FROM elbow) AS chosen FROM sweep")
def q_elbow_points(spark, sf):
    sweep = _lloyd_sweep(spark, sf)
    return CH.elbow_points(sweep, Q.elbow_k(sweep).select("elbow_k").scalar())


@register("select_features_orders", f"WITH {O.ORDER_FEATURES_CTE}\nSELECT o_orderkey, " + ", ".join(ORDER_FEATURES) + " FROM ofeat")
def q_select_features(spark, sf):
    sel, missing = C.select_features(order_features(spark, sf), ORDER_FEATURES + ["tempo"], "o_orderkey")
    assert missing == ["tempo"]
    return sel


@register("drop_noise_dbscan_d3", O.dbscan_sql([0, 1, 2], 0.05, 5).replace(
    "\nSELECT p.vec_id, CAST(", "\n, res AS (SELECT p.vec_id, CAST(", 1) + ")\nSELECT vec_id, cluster FROM res WHERE cluster <> -1")
def q_drop_noise(spark, sf):
    e, fs = _emb_dims(spark, sf, [0, 1, 2])
    return C.drop_noise(DB.dbscan(e, fs, 0.05, 5, "vec_id"), "cluster").select("vec_id", "cluster")


@register("attach_labels_orders", f"WITH {CL}\nSELECT o_orderkey, " + ", ".join(ORDER_FEATURES) +
          ", cluster AS cluster_kmeans, CASE WHEN n_lines > 4 THEN 1 ELSE 0 END AS many_lines FROM labr")
def q_attach_labels(spark, sf):
    f = order_features(spark, sf).select("o_orderkey", *ORDER_FEATURES)
    km = clustered_orders(spark, sf).select("o_orderkey", F.col("cluster").alias("cluster_kmeans"))
    ml = f.select("o_orderkey", F.when(F.col("n_lines") > 4, 1).otherwise(0).alias("many_lines"))
    return A.attach_labels(f, {"cluster_kmeans": km, "many_lines": ml}, "o_orderkey")


@register("recommend_algorithm_embeddings", EVAL_CTES + ",\ncmp AS (" + O.evaluate_sql("Labels", "gl", EMB, "_g") +
          "\nUNION ALL\n" + O.evaluate_sql("DBSCAN", "dbl", EMB, "_d") + ")\n"
          "SELECT CASE WHEN (SELECT silhouette_score FROM cmp WHERE algorithm = 'DBSCAN') > "
          "(SELECT silhouette_score FROM cmp WHERE algorithm = 'Labels') AND "
          "(SELECT n_clusters FROM cmp WHERE algorithm = 'DBSCAN') >= 2 THEN 'DBSCAN' ELSE 'Labels' END AS recommended")
def q_recommend(spark, sf):
    return Q.recommend(Q.compare_algorithms(list(_emb_evaluated(spark, sf))), baseline="Labels")


# ====================================================================== wide feature sets (64-dim embeddings)
@register("correlation_matrix_embeddings",
          "WITH ex AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x "
          "FROM embeddings)\n"
          "SELECT 'e' || CAST(a.i - 1 AS VARCHAR) AS feature_1, 'e' || CAST(b.i - 1 AS VARCHAR) AS feature_2, "
          + O.r6("CASE WHEN a.i = b.i THEN CASE WHEN var_pop(a.x) > 0 THEN 1.0 END "
                 "ELSE covar_pop(a.x, b.x) / NULLIF(sqrt(var_pop(a.x) * var_pop(b.x)), 0) END") +
          " AS r FROM ex a JOIN ex b USING (vec_id) GROUP BY a.i, b.i")
def q_corr_emb(spark, sf):
    return S.correlation_matrix(_emb(spark, sf), EMB)


_HOLED = 18


@register("correlation_matrix_embeddings_nulls",
          "WITH ex AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),\n"
          f"ho AS (SELECT vec_id, i, x FROM ex WHERE i <= {_HOLED} AND vec_id % (i + 1) <> 0)\n"
          "SELECT 'e' || CAST(a.i - 1 AS VARCHAR) AS feature_1, 'e' || CAST(b.i - 1 AS VARCHAR) AS feature_2, "
          + O.r6("CASE WHEN a.i = b.i THEN CASE WHEN var_pop(a.x) > 0 THEN 1.0 END "
                 "ELSE covar_pop(a.x, b.x) / NULLIF(sqrt(var_pop(a.x) * var_pop(b.x)), 0) END") +
          " AS r FROM ho a JOIN ho b USING (vec_id) GROUP BY a.i, b.i")
def q_corr_nulls(spark, sf):
    """More features than aggregate expressions carry, each NULL in other rows."""
    e = _emb(spark, sf).select("vec_id", *[F.when(F.col("vec_id") % (i + 2) != 0, F.col(f"e{i}")).alias(f"e{i}")
                                           for i in range(_HOLED)])
    return S.correlation_matrix(e, EMB[:_HOLED])


@register("pca_2d_embeddings")
def q_pca_emb(spark, sf):
    rows, _ = CH.pca_2d(_emb(spark, sf), EMB, "vec_id")
    return rows

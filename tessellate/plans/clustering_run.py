"""The batch clustering job end to end, over any feature table.

clean -> enrich (keyword family, decade) -> transform (log1p, winsorise) ->
summaries -> scale -> k sweep -> k comparison -> k-means, sampled DBSCAN,
hierarchical (micro-clusters) -> metrics and recommendation -> profiles and
names -> export (parquet partitioned by cluster, CSV), metrics JSON, results
tables, text report.

The scaled feature table is written once (reliable, in the output folder) and
every fit reads it; only k-row, #features-row and bounded-sample tables reach
the driver.

usage: python -m tessellate.plans.clustering_run SF_DIR OUT_DIR
(runs the job on the driver's order features)
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import CLUSTER_NAME_RULES, GENRE_KEYWORDS, decade, display_name, keyword_family
from ..operators import assign as A
from ..operators import clean as C
from ..operators import dbscan as DB
from ..operators import hierarchy as H
from ..operators import kmeans as KM
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators import sample as SM
from ..operators import stats as S
from ..operators import transform as T
from ..sources import files as IO
from ..sources import reports as RP


@dataclass
class RunConfig:
    features: Sequence[str]
    id_col: str
    reference_cols: Sequence[str] = ()
    drop_cols: Sequence[str] = ()
    family_source: str | None = None
    family_keywords: Sequence[tuple[str, str]] = GENRE_KEYWORDS
    date_col: str | None = None
    log_cols: Sequence[str] = ()
    winsorize_cols: Sequence[str] = ()
    winsorize_pct: float = 0.95
    k_values: Sequence[int] = tuple(range(2, 11))
    k_candidates: Sequence[int] = (3, 6)
    sweep_n_init: int = 3
    n_init: int = 5
    dbscan_eps: float = 1.5
    dbscan_min_samples: int = 5
    dbscan_sample: int = 15000
    hier_sample: int = 8000
    silhouette_sample: int = 5000
    name_rules: Sequence[tuple[str, str, float, str]] = CLUSTER_NAME_RULES
    seed: int = 42
    outputs: dict = field(default_factory=dict)


def run(spark: SparkSession, raw: DataFrame, cfg: RunConfig, out_dir: str) -> dict[str, DataFrame]:
    fs, idc = list(cfg.features), cfg.id_col
    out = out_dir.rstrip("/")

    # clean, then enrich (enrichment NULLs never drop rows)
    df = C.clean(raw)
    if cfg.family_source and cfg.family_source in df.columns:
        df = df.withColumn("genre_family", keyword_family(cfg.family_source, cfg.family_keywords))
    if cfg.date_col and cfg.date_col in df.columns:
        df = df.withColumn("decade", decade(cfg.date_col))
    for c in cfg.log_cols:
        df, _ = T.log_transform(df, c)
    if cfg.winsorize_cols:
        df, _ = T.winsorize(df, cfg.winsorize_cols, cfg.winsorize_pct)
    # the transformed table is read by every later step: write it once
    base = IO.write_table(df, f"{out}/transformed")
    df = spark.read.parquet(base)

    summary = S.feature_summary(df, fs)
    corr = S.correlated_pairs(df, fs, 0.5)
    scaled, params = T.scale(df.select(idc, *fs), fs, "standard")
    IO.write_table(scaled, f"{out}/scaled")
    scaled = spark.read.parquet(f"{out}/scaled")

    # k search and the compared k values
    sweep = KM.kmeans_sweep(scaled, fs, idc, cfg.k_values, n_init=cfg.sweep_n_init,
                            silhouette_sample=cfg.silhouette_sample, seed=cfg.seed)
    sweep = spark.createDataFrame(sweep.collect(), sweep.schema)        # one row per k
    k_rec = KM.recommend_k(sweep)
    k_cmp = KM.k_comparison(scaled, fs, idc, cfg.k_candidates, n_init=cfg.n_init,
                            silhouette_sample=cfg.silhouette_sample, seed=cfg.seed)
    k_cmp = spark.createDataFrame(k_cmp.collect(), k_cmp.schema)
    best_k = KM.select_k(k_cmp.withColumnRenamed("silhouette", "silhouette"),
                         cfg.k_candidates).first()[0]

    # three algorithms
    cen, cost = KM.kmeans(scaled, fs, best_k, n_init=cfg.n_init, seed=cfg.seed)
    km = A.nearest_centroid(scaled, cen, fs, best_k, out="cluster_kmeans")
    dbs = DB.dbscan_sampled(scaled, fs, cfg.dbscan_eps, cfg.dbscan_min_samples, idc,
                            cfg.dbscan_sample, cfg.seed).withColumnRenamed("cluster", "cluster_dbscan")
    hs = SM.uniform_sample(scaled, cfg.hier_sample, idc, cfg.seed)
    hl, dendro = H.hierarchical(hs, fs, best_k, idc)
    hier = A.assign_from_sample(scaled, hs.join(hl, idc), fs, "cluster", best_k,
                                out="cluster_hierarchical")
    labels = km.select(idc, "cluster_kmeans").join(dbs, idc).join(
        hier.select(idc, "cluster_hierarchical"), idc)
    IO.write_table(labels, f"{out}/labels")
    labels = spark.read.parquet(f"{out}/labels")
    lab_scaled = scaled.join(labels, idc)

    metrics = Q.compare_algorithms([
        Q.evaluate(lab_scaled.withColumnRenamed("cluster_kmeans", "c"), "c", fs, idc, "K-Means",
                   cfg.silhouette_sample, with_inertia=True, seed=cfg.seed),
        Q.evaluate(lab_scaled.withColumnRenamed("cluster_dbscan", "c"), "c", fs, idc, "DBSCAN",
                   cfg.silhouette_sample, seed=cfg.seed),
        Q.evaluate(lab_scaled.withColumnRenamed("cluster_hierarchical", "c"), "c", fs, idc,
                   "Hierarchical", cfg.silhouette_sample, seed=cfg.seed)])
    metrics = spark.createDataFrame(metrics.collect(), metrics.schema)   # three rows
    IO.write_metrics(metrics, f"{out}/metrics")

    # profiles describe the transformed, unscaled features
    clustered = df.join(labels, idc)
    prof = PR.cluster_profile(clustered, "cluster_kmeans", fs)
    names = PR.name_clusters(prof, cfg.name_rules)
    export = A.label_join(clustered, names.withColumnRenamed("cluster", "cluster_kmeans"),
                          "cluster_kmeans", "cluster_label") \
        .withColumn("display", display_name("cluster_kmeans", "cluster_label"))
    IO.write_table(export, f"{out}/clustered", partition_by=["cluster_kmeans"])
    IO.write_table(export, f"{out}/clustered_csv", "csv")
    sil = Q.silhouette_samples(lab_scaled, "cluster_kmeans", fs, idc, cfg.silhouette_sample,
                               cfg.seed)
    IO.save_results({"silhouettes": sil, "dendrogram": dendro, "sweep": sweep}, f"{out}/results")

    sizes = PR.cluster_sizes(clustered, "cluster_kmeans")
    mix_col = "genre_family" if "genre_family" in clustered.columns else None
    mix = PR.crosstab_pct(clustered, "cluster_kmeans", mix_col) if mix_col else \
        sizes.select(F.col("cluster").alias("row"), F.lit("all").alias("value"), "count",
                     F.lit(100.0).alias("pct"))
    report = RP.summary_report(k_cmp, metrics, prof, names, sizes, mix)
    RP.write_report(report, f"{out}/report")
    return {"summary": summary, "correlated": corr, "sweep": sweep, "k_recommendation": k_rec,
            "k_comparison": k_cmp, "metrics": metrics, "profile": prof, "names": names,
            "sizes": sizes, "report": report, "export": spark.read.parquet(f"{out}/clustered")}


def main(argv: list[str]) -> None:
    from ..session import build_session
    from .tables import ORDER_FEATURES, order_features
    sf_dir, out_dir = argv[1], argv[2]
    spark = build_session(extra={"spark.ui.showConsoleProgress": "false"})
    cfg = RunConfig(features=ORDER_FEATURES, id_col="o_orderkey", date_col="o_orderdate",
                    family_source="o_orderpriority",
                    family_keywords=(("urgent", "Urgent"), ("high", "High"), ("medium", "Medium"),
                                     ("low", "Low")),
                    dbscan_eps=0.5, name_rules=())
    res = run(spark, order_features(spark, sf_dir), cfg, out_dir)
    res["metrics"].show(truncate=False)
    res["report"].orderBy("section", "position").show(100, truncate=False)


if __name__ == "__main__":
    main(sys.argv)

"""Command line: the stages of the pipeline over a folder of tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sigloom import report
from sigloom.config import FEATURES, Radar
from sigloom.functions import signals
from sigloom.operators import catalog, classify, ingest, training
from sigloom.plans import sqlrun
from sigloom.sources import export, mirror, raw


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sigloom")
    p.add_argument("--root", required=True, help="folder of the engine's tables")
    sub = p.add_subparsers(dest="stage", required=True)
    sub.add_parser("ingest").add_argument("raw", help="cell matrix files, or 'synthetic'")
    fetch = sub.add_parser("fetch")
    fetch.add_argument("files", help="CSV file of urls and their md5, with a head 'url,md5'")
    fetch.add_argument("target", help="folder in shared storage")
    sub.add_parser("dsp")
    quality = sub.add_parser("quality")
    quality.add_argument("--n-per-fault", type=int, default=500)
    quality.add_argument("--trees", type=int, default=300)
    quality.add_argument("--cae-epochs", type=int, default=15)
    sub.add_parser("export").add_argument("specs", help="YAML file with a list 'datasets'")
    train = sub.add_parser("train")
    train.add_argument("--seeds", type=int, nargs="+", default=[0, 1, 2])
    train.add_argument("--epochs", type=int, default=12)
    sub.add_parser("query").add_argument("file")
    sub.add_parser("sql-all")
    sub.add_parser("report").add_argument("--html", help="folder to write the report to as a page")
    a = p.parse_args(argv)
    spark, radar, root = SparkSession.builder.appName("sigloom").getOrCreate(), Radar(), a.root

    def views():
        segments, measurements = ingest.segments_view(spark, root), ingest.read(spark, root, "measurements")
        return {"segments": segments, "measurements": measurements, "duplicate_pairs": catalog.duplicate_pairs(segments)}

    if a.stage == "fetch":
        files = spark.read.option("header", "true").schema("url string, md5 string").csv(a.files)
        print(report.markdown(mirror.mirror(files, a.target).orderBy("file")))
    elif a.stage == "ingest":
        rows = raw.synthetic(spark) if a.raw == "synthetic" else raw.load(spark, a.raw)
        counts = ingest.ingest(rows, root, radar)
        ingest.save_json(spark, counts, f"{root}/results/ingest")
        print(json.dumps(counts))
    elif a.stage == "dsp":
        print(json.dumps({"features": ingest.process(spark, root, radar).count()}))
    elif a.stage == "quality":
        print(report.markdown(ingest.assess(spark, root, radar, a.n_per_fault, trees=a.trees, cae_epochs=a.cae_epochs).orderBy("fault", "method")))
    elif a.stage == "export":
        rows = ingest.segments_view(spark, root).join(ingest.read(spark, root, "rd_maps"), "segment_id")
        for spec in export.load_specs(spark, a.specs):
            made = export.export(rows, spec, f"{root}/exports/{spec['name']}-v{spec['version']}")
            print(json.dumps({k: made[k] for k in ("dataset", "version", "n_segments", "digest")}))
    elif a.stage == "train":
        rows = ingest.segments_view(spark, root).withColumn("class_group", catalog.class_group(F.col("label")))
        print(report.markdown(classify.experiments(rows, FEATURES, seeds=tuple(a.seeds))))
        maps = rows.join(ingest.read(spark, root, "rd_maps").withColumn("rd_norm", signals.scaled_map(F.col("rd_db"))), "segment_id")
        folder = f"{root}/results/training"
        print(report.markdown(classify.network_experiments(maps, radar.n_range, tuple(a.seeds), training.Settings(epochs=a.epochs), folder=folder)))
    elif a.stage == "query":
        print(report.markdown(sqlrun.run_sql(spark, a.file, views())))
    elif a.stage == "sql-all":
        print(json.dumps({k: df.count() for k, df in sqlrun.run_all(spark, f"{root}/results", views()).items()}))
    else:
        tables = {name: sqlrun.run_sql(spark, sqlrun.SQL_DIR / f"{name}.sql", views()) for name in ("class_balance_per_split", "snr_by_class", "time_gaps", "quality_flags_per_class")}
        if a.html:
            spark.createDataFrame([(report.page("Catalogue", tables),)], "value string").coalesce(1).write.mode("overwrite").text(a.html)
        else:
            print(report.document("Catalogue", tables))


if __name__ == "__main__":
    main()

"""Command-line front end for the station workflow.

    python -m tidemark.cli split   MIXED_CSV OUT_DIR            # one directory per device
    python -m tidemark.cli train   DEVICE_DIR MODEL_DIR         # one fleet model
    python -m tidemark.cli device  DEVICE_DIR DEVICE_ID OUT_CSV # per-lane holdout report
    python -m tidemark.cli predict DEVICE_DIR MODEL_DIR OUT_CSV # direction predictions
    python -m tidemark.cli submit  TRAIN_CSV TEST_CSV OUT_CSV   # passenger submission

Every path is a directory the cluster can reach (CSV outputs are written by the tasks,
one file per task, under ``OUT_CSV``).
"""

from __future__ import annotations

import argparse

from tidemark.plans import traffic as TR
from tidemark.session import build_session
from tidemark.sources import csv as C


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="tidemark")
    sub = ap.add_subparsers(dest="cmd", required=True)
    s = sub.add_parser("split")
    s.add_argument("mixed_csv")
    s.add_argument("out_dir")
    t = sub.add_parser("train")
    t.add_argument("device_dir")
    t.add_argument("model_dir")
    t.add_argument("--trees", type=int, default=30)
    d = sub.add_parser("device")
    d.add_argument("device_dir")
    d.add_argument("device", type=int)
    d.add_argument("out_csv")
    d.add_argument("--trees", type=int, default=30)
    p = sub.add_parser("predict")
    p.add_argument("device_dir")
    p.add_argument("model_dir")
    p.add_argument("out_csv")
    m = sub.add_parser("submit")
    m.add_argument("train_csv")
    m.add_argument("test_csv")
    m.add_argument("out_csv")
    m.add_argument("--model", choices=["gbt", "forest", "tree"], default="gbt")
    a = ap.parse_args(argv)

    spark = build_session(app=f"tidemark-{a.cmd}")
    if a.cmd == "split":
        devices, _ = TR.load_data(spark, a.mixed_csv, a.out_dir)
        print(f"devices: {devices.count()}")
    elif a.cmd == "train":
        model = TR.build_model(TR.read_split(spark, a.device_dir), num_trees=a.trees)
        model.write().overwrite().save(a.model_dir)
    elif a.cmd == "device":
        _, metrics = TR.build_one_device(TR.read_split(spark, a.device_dir, a.device), a.device,
                                         num_trees=a.trees)
        C.write_csv(metrics, a.out_csv)
    elif a.cmd == "predict":
        from pyspark.ml.regression import RandomForestRegressionModel
        model = RandomForestRegressionModel.load(a.model_dir)
        C.write_csv(TR.model_predict(model, TR.read_split(spark, a.device_dir)), a.out_csv)
    elif a.cmd == "submit":
        from tidemark.operators import models as MD
        from tidemark.plans import cleaning as CL
        train = C.read_csv(spark, a.train_csv, C.PASSENGER_TRAIN_SCHEMA)
        test = C.read_csv(spark, a.test_csv, C.PASSENGER_TEST_SCHEMA)
        est = {"gbt": lambda: MD.gbt_classifier(max_iter=100, max_depth=4),
               "forest": lambda: MD.rf_classifier(500, 6, "gini", feature_subset="sqrt",
                                                  min_instances=2),
               "tree": lambda: MD.decision_tree(5)}[a.model]()
        C.write_csv(CL.submission(train, test, est), a.out_csv)
    spark.stop()


if __name__ == "__main__":
    main()

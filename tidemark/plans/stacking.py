"""Two-level stacking: out-of-fold predictions of several base learners become the
features of a boosted meta model.

Each base learner is fitted k times (once per held-out fold, the folds at once); its held-out
predictions form one meta column for the training rows, the mean of its k fold models one
meta column for the test rows. Meta tables are joined on the row id (never zipped by
position), then the meta model is fitted and scores the test rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import models as MD


def meta_features(train: DataFrame, test: DataFrame, bases: Mapping[str, Callable],
                  id_col: str, fold_col: str = "fold", k: int = 5,
                  scorers: Mapping[str, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """(train_meta, test_meta): one column per base learner, keyed by ``id_col``."""
    scorers = scorers or {}
    tr = train.select(id_col, "label")
    te = test.select(id_col)
    for name, make in bases.items():
        oof, tst = MD.oof_predictions(train, test, make, id_col, fold_col, k, out=name,
                                      score=scorers.get(name))
        tr = tr.join(oof, id_col, "left")
        te = te.join(tst, id_col, "left")
    # The meta tables are small (one row per id, one column per learner); pinning them
    # keeps the meta model's iterations from re-running every fold transform.
    return MD.spread_table(tr), MD.training_table(te)


def stack(train: DataFrame, test: DataFrame, bases: Mapping[str, Callable], meta_estimator,
          id_col: str, fold_col: str = "fold", k: int = 5,
          scorers: Mapping[str, Callable] | None = None) -> DataFrame:
    """Fit the stack and return ``(id, prediction)`` for the test rows as int."""
    tr, te = meta_features(train, test, bases, id_col, fold_col, k, scorers)
    names = list(bases)
    m = meta_estimator.fit(MD.assemble(tr, names))
    out = m.transform(MD.assemble(te, names, handle_invalid="keep"))
    return out.select(id_col, F.col("prediction").cast("int").alias("prediction"))

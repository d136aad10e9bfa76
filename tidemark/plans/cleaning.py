"""Passenger-table cleaning as a fit/transform pair.

``fit(train)`` computes the state every step needs -- per-class fare medians, per-title
mean ages, sorted label dictionaries and population-std scalers -- each as one grouped
pass over the training table. ``transform(df, state)`` is one lazy plan: column
expressions plus joins against the small state tables. The analysed code refitted the
encoders and scalers on whatever table it cleaned (so test codes did not match training
codes); here the training state is applied to both, which is the meaning it intended.

Input columns: PassengerId, Pclass, Name, Sex, Age, SibSp, Parch, Ticket, Fare, Embarked
(Cabin is not used: its encoding collapsed to one constant, see the survey's quirk Q2).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scalar as S
from tidemark.operators import features as FE
from tidemark.operators import table as TB
from tidemark.session import ensure_checkpoint_dir

# The names of the output features of the final cleaning variant (label first
# when present), of the encoded columns, and of the scaled ones.
FEATURES = ["Sex", "AgeCat", "Fare_Person_scaled", "Family_Size", "Age_suqre_scaled",
            "Ticket_scaled", "Embarked", "AgeClass", "Name_length", "Class_scaled", "Title",
            "Fare", "Pclass"]
ENCODED = ["Sex", "Title", "HighLow", "AgeCat", "Embarked"]
SCALED = {"AgeClass": "Age_scaled", "Fare_Per_Person": "Fare_Person_scaled",
          "Ticket": "Ticket_scaled", "Fare": "Fare_scaled", "ClassFare": "Class_scaled",
          "AgeSqure": "Age_suqre_scaled"}
EMBARKED_DEFAULT = "S"


@dataclass
class CleaningState:
    fare_medians: DataFrame          # (Pclass, _stat)
    title_ages: DataFrame            # (Title, _stat)
    dictionaries: dict               # column -> (value, code) DataFrame
    scalers: dict                    # column -> (mean, population std)


def _base(df: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Steps that need no fitted state."""
    title = S.fold_title(S.first_substring("Name", S.TITLE_SEARCH_ORDER), F.col("Sex"),
                         strict_reference)
    return df.withColumns({
        "Fare": S.zero_to_null("Fare"),
        "Title": title,
        "Family_Size": F.col("SibSp") + F.col("Parch"),
        "Embarked": S.fill_constant("Embarked", EMBARKED_DEFAULT),
        "Name_length": F.length("Name"),
    })


def _with_fare(df: DataFrame, fare_medians: DataFrame) -> DataFrame:
    return FE.impute_group_stat(df, "Fare", fare_medians, ["Pclass"])


def _with_age(df: DataFrame, title_ages: DataFrame) -> DataFrame:
    d = FE.impute_group_stat(df, "Age", title_ages, ["Title"], out="AgeFill")
    fpp = F.col("Fare") / (F.col("Family_Size") + 1)
    return d.withColumns({
        "AgeCat": S.bin_right_closed("AgeFill"),
        "Fare_Per_Person": fpp,
        "AgeClass": F.col("AgeFill") * F.col("Pclass"),
        "ClassFare": F.col("Pclass") * fpp,
        "AgeSqure": F.col("AgeFill") * F.col("AgeFill"),
        "HighLow": S.threshold_flag(fpp),
    })


def _encoded(df: DataFrame, dictionaries: dict) -> DataFrame:
    res = TB.shared_key_flag(df, "Ticket", out="Ticket_share")
    for c, d in dictionaries.items():
        res = FE.label_encode(res, d, c)
    return res


def fit(train: DataFrame, strict_reference: bool = False) -> CleaningState:
    """Fit all state. The columns that fitting needs are pinned once; every state table is
    small and is written when it is fitted, so no step runs an earlier one again."""
    ensure_checkpoint_dir(train.sparkSession)
    b = _base(train, strict_reference).select(
        "Pclass", "Fare", "Title", "Age", "Family_Size", "Sex", "Embarked", "Ticket").checkpoint(eager=True)
    fare_medians = FE.small_side(FE.fit_group_stat(b, "Fare", ["Pclass"], "median"))
    b = _with_fare(b, fare_medians)
    title_ages = FE.small_side(FE.fit_group_stat(b, "Age", ["Title"], "mean"))
    b = _with_age(b, title_ages)
    dictionaries = FE.fit_label_dictionaries(b, ENCODED + ["Ticket"])
    enc = _encoded(b, dictionaries)
    scalers = FE.fit_standard_scaler(enc, list(SCALED))
    return CleaningState(fare_medians, title_ages, dictionaries, scalers)


def transform(df: DataFrame, state: CleaningState, label: str | None = None,
              keep: tuple[str, ...] = ("PassengerId",), strict_reference: bool = False) -> DataFrame:
    d = _base(df, strict_reference)
    d = _with_fare(d, state.fare_medians)
    d = _with_age(d, state.title_ages)
    d = _encoded(d, state.dictionaries)
    for src, out in SCALED.items():
        m, s = state.scalers[src]
        d = d.withColumn(out, (F.col(src) - F.lit(m)) / F.lit(s))
    cols = list(keep) + ([label] if label else []) + FEATURES
    return d.select(*cols)


def submission(train: DataFrame, test: DataFrame, estimator, label: str = "Survived",
               id_col: str = "PassengerId") -> DataFrame:
    """Clean both tables with the training state, fit ``estimator`` on the training
    features and return ``(PassengerId, Survived)`` for the test rows (int)."""
    from tidemark.operators import models as MD
    state = fit(train)
    tr = transform(train, state, label=label, keep=(id_col,))
    te = transform(test, state, keep=(id_col,))
    feats = [c for c in FEATURES]
    tr = MD.assemble(MD.complete_rows(tr.withColumn("label", F.col(label).cast("double")), feats), feats)
    model = estimator.fit(MD.training_table(tr))
    out = model.transform(MD.assemble(te, feats, handle_invalid="keep"))
    return out.select(id_col, F.col("prediction").cast("int").alias(label))

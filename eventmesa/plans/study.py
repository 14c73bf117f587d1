"""The whole study of a feature table: every horizon is backtested, measured and explained, and its tables are written."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from . import attribution as T
from . import models as M
from . import reports as R
from . import validation as V

LABELS = ("drift_raw", "drift_z", "drift_decile", "drift_class")


def as_primary(table: DataFrame, horizon: int) -> DataFrame:
    """The table with the labels of one horizon under the names that models read; other labels go."""
    own = {f"{label}_h{horizon}": f"{label}_h{M.HORIZON}" for label in LABELS}
    return table.select(*(c for c in table.columns if not c.startswith(M.LABELS)), *(F.col(c).alias(name) for c, name in own.items() if c in table.columns))


def run(table: DataFrame, root: str, horizons: tuple[int, ...] = (M.HORIZON, 20, 5)) -> DataFrame:
    """One row a horizon: horizon, n_folds, classifier (whether any fold had labels enough for one), and the headline metrics.

    Under `root`/h<horizon> stand `results` (tested events with their predictions), `drivers` (the map, also as CSV),
    `matrix` (features and labels), `summary`, `contrast`, `calibration` and `reliability`."""
    out = []
    for horizon in horizons:
        rows, folder = as_primary(table, horizon), f"{root}/h{horizon}"
        folds = M.fitted_folds(rows)
        if not folds:
            raise ValueError(f"no fold of horizon {horizon} can be fitted")
        with ThreadPoolExecutor(M.AT_ONCE) as pool:
            list(pool.map(lambda fold, folder=folder: M.tested_rows(fold).write.mode("overwrite").parquet(f"{folder}/results/fold={fold.k}"), folds))
        results = table.sparkSession.read.parquet(f"{folder}/results")
        drivers = T.driver_table(T.of_folds(folds), V.all_slopes(rows, M.Z))
        names = M.feature_columns(rows)
        tables = {"drivers": drivers, "matrix": rows, "summary": R.summary(rows, names), "contrast": R.contrast(rows, names, R.DECILE), "calibration": R.calibration(results), "reliability": R.reliability(results)}
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        files.write_csv(table.sparkSession.read.parquet(f"{folder}/drivers"), f"{folder}/drivers_csv")
        out.append(R.headline(results).withColumns({"horizon": F.lit(horizon), "n_folds": F.lit(len(folds)), "classifier": F.lit(any(f.heads[3] is not None for f in folds))}))
    return reduce(DataFrame.unionByName, out)

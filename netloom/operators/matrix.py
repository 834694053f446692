"""A long matrix with the sheets of its rows and columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators import aggregates, reshape


@dataclass(frozen=True)
class Matrix:
    """Cells (obs_id, feature, value); ``obs`` and ``features`` are optional sheets keyed by those names.

    A sheet is the label domain where it is given; else the labels with cells are. Every method gives a new matrix."""

    cells: DataFrame
    obs: DataFrame | None = None
    features: DataFrame | None = None
    name: str = "matrix"

    @classmethod
    def from_wide(cls, wide: DataFrame, key: str, *, features_are_rows: bool = False, name: str = "matrix") -> Matrix:
        """Numeric columns become cells, all others the rows' sheet."""
        kinds = dict(wide.dtypes)
        numeric = [c for c in wide.columns if c != key and kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or c != key and kinds[c].startswith("decimal")]
        other = [c for c in wide.columns if c not in (key, *numeric)]
        row, column = ("feature", "obs_id") if features_are_rows else ("obs_id", "feature")
        cells = reshape.melt(wide.select(F.col(f"`{key}`").cast("string").alias(row), *[F.col(f"`{c}`") for c in numeric]), [row], numeric, column)
        sheet = wide.select(F.col(f"`{key}`").cast("string").alias(row), *[F.col(f"`{c}`") for c in other]).dropDuplicates([row])
        cells = cells.select("obs_id", "feature", "value")
        return cls(cells, None, sheet, name) if features_are_rows else cls(cells, sheet, None, name)

    def labels(self, axis: str) -> DataFrame:
        sheet = self.obs if axis == "obs_id" else self.features
        return (sheet if sheet is not None else self.cells).select(axis).distinct()

    def shape(self) -> tuple[int, int]:
        return self.labels("obs_id").count(), self.labels("feature").count()

    def with_sheet(self, sheet: DataFrame, axis: str = "obs_id") -> Matrix:
        """Attributes for the labels there are; of a label's rows one counts, new columns win over old ones."""
        old = self.obs if axis == "obs_id" else self.features
        new = self.labels(axis).join(sheet.dropDuplicates([axis]), axis, "left")
        if old is not None:
            new = new.join(old.drop(*[c for c in sheet.columns if c != axis]), axis, "left")
        return replace(self, **{"obs" if axis == "obs_id" else "features": new})

    def subset(self, obs: DataFrame | list[str] | None = None, features: DataFrame | list[str] | None = None) -> Matrix:
        def keep(df: DataFrame | None, axis: str, labels) -> DataFrame | None:
            return df if df is None or labels is None or axis not in df.columns else reshape.keep_labels(df, axis, labels)

        cells = keep(keep(self.cells, "obs_id", obs), "feature", features)
        return replace(self, cells=cells, obs=keep(self.obs, "obs_id", obs), features=keep(self.features, "feature", features))

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Matrix:
        return replace(self, cells=f(self.cells))

    def dense(self, fill: float = 0.0) -> Matrix:
        return self.map(lambda c: reshape.densify(c, reshape.domain(self.labels("obs_id"), self.labels("feature")), ["obs_id", "feature"], "value", fill))

    def sparse(self) -> Matrix:
        return replace(self, cells=reshape.sparsify(self.cells, "value"), obs=self.obs if self.obs is not None else self.labels("obs_id"), features=self.features if self.features is not None else self.labels("feature"))

    def moments(self, axis: str = "feature") -> DataFrame:
        """Sum, mean and sample deviation per label, absent cells being zero."""
        rows, columns = self.shape()
        return aggregates.moments(self.cells, [axis], n=F.lit(float(rows if axis == "feature" else columns)))

    def dot(self, other: DataFrame, inner: str = "feature", column: str = "column") -> DataFrame:
        """Product with a table (feature, column, value)."""
        return aggregates.multiply(self.cells, other.withColumnRenamed("value", "_w"), row="obs_id", inner=inner, column=column, x="value", y="_w")


def split_by_column(cells: DataFrame, sheet: DataFrame, column: str) -> DataFrame:
    """One matrix into tasks: ``task`` is the sheet's column; observations without a label are dropped."""
    return cells.join(sheet.select("obs_id", F.col(column).cast("string").alias("task")).where("task is not null").dropDuplicates(["obs_id"]), "obs_id")

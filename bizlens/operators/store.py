"""A store of fitted models in a shared folder: versions with a manifest, reread when the data change.

Every version is a folder of its own, written once. Its manifest, one JSON row, names the features,
categories and target and holds a fingerprint of the rows it was fitted on: their number and an
order-free sum of their hashes. Asking for a model compares that fingerprint with today's rows, so a
changed table is fitted anew, in any session, and an unchanged one is only read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from bizlens.operators.models import FittedModel
from bizlens.session import shared_folder

MANIFEST = (
    "model string, version int, target string, numeric array<string>, "
    "categories array<struct<column:string,values:array<string>>>, classifier boolean, trees int, "
    "rows long, fingerprint string"
)


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> tuple[int, str]:
    """The number of rows and the sum of their 64-bit hashes in two independent halves. Row order and
    partitioning do not matter; a changed, added, lost or repeated row does."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    parts = [F.sum(F.shiftrightunsigned(h, 32)) for h in (one, two)]
    parts += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))) for h in (one, two)]
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]).first()
    text = "-".join(str(found[f"p{i}"] or 0) for i in range(len(parts)))
    return found["n"], f"{','.join(columns)}:{text}"


@dataclass
class ModelStore:
    spark: SparkSession
    folder: str

    @classmethod
    def shared(cls, spark: SparkSession) -> "ModelStore":
        return cls(spark, f"{shared_folder(spark)}/bizlens-models")

    def manifests(self, name: str) -> DataFrame:
        """All versions of a model, one row each."""
        try:
            return self.spark.read.schema(MANIFEST).json(f"{self.folder}/{name}/manifests")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def path(self, name: str, version: int) -> str:
        return f"{self.folder}/{name}/versions/{version:06d}"

    def save(self, name: str, model: FittedModel, target: str, rows: int, print_: str) -> int:
        """Write a new version; the manifest comes last, so that an unfinished version is never read."""
        newest = self.manifests(name).agg(F.max("version")).first()[0]
        version = (newest or 0) + 1
        model.save(self.path(name, version))
        entry = Row(
            model=name, version=version, target=target, numeric=list(model.numeric),
            categories=[Row(column=c, values=list(v)) for c, v in model.categories.items()],
            classifier=model.classifier, trees=model.trees.getNumTrees, rows=rows, fingerprint=print_,
        )
        self.spark.createDataFrame([entry], MANIFEST).coalesce(1).write.mode("append").json(
            f"{self.folder}/{name}/manifests"
        )
        return version

    def load(self, name: str, version: int | None = None) -> FittedModel:
        """A stored version, the newest one if none is named."""
        found = self.manifests(name)
        found = found if version is None else found.where(F.col("version") == version)
        entry = found.orderBy(F.col("version").desc()).first()
        if entry is None:
            raise LookupError(f"no version {version or ''} of model {name} in {self.folder}")
        return FittedModel.load(
            self.path(name, entry["version"]), tuple(entry["numeric"]),
            {c["column"]: list(c["values"]) for c in entry["categories"]}, entry["classifier"],
        )

    def fitted(
        self, name: str, train: DataFrame, columns: Sequence[str], target: str, fit: Callable[[], FittedModel]
    ) -> FittedModel:
        """The newest version fitted on rows like ``train`` (``columns`` and ``target``); without one,
        ``fit()`` is called and saved. What is returned has always been read from the store."""
        rows, print_ = fingerprint(train, [*columns, target])
        known = self.manifests(name).where(F.col("fingerprint") == print_).agg(F.max("version")).first()[0]
        return self.load(name, known or self.save(name, fit(), target, rows, print_))

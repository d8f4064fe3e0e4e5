"""``Dataset``: an immutable catalogue with the batch operators as methods; every one returns a new dataset."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigframe.operators import batch, catalog
from sigframe.sources import timeseries


class Dataset:
    """A catalogue of recordings, where they lie, and an optional kernel."""

    def __init__(self, recordings: DataFrame, *, folder: str | None = None, kernel: object | None = None):
        self.recordings, self.folder, self.kernel = recordings, folder, kernel

    # ------------------------------------------------------------------ construction
    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, domain: str = catalog.NOT_SPECIFIED, kernel: str | None = None) -> Dataset:
        """Scan a folder and read the headers of its recordings."""
        headers = timeseries.read_headers(spark, folder).withColumn("domain", F.lit(domain)).withColumn("rec_id", F.xxhash64("path"))
        status = F.when(F.col("error").isNull(), catalog.COMPLETED).otherwise(catalog.UNAVAILABLE)
        return cls(headers.withColumn("status", status), folder=folder, kernel=batch.load_kernel(kernel) if kernel else None)

    @classmethod
    def from_locator(cls, locator: DataFrame) -> Dataset:
        """A catalogue kept as a table of text."""
        return cls(catalog.from_locator(locator))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str) -> Dataset:
        """A catalogue saved by ``save``; columns keep their names, values are text until they are cast."""
        return cls(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))

    # ------------------------------------------------------------------ operators
    def with_recordings(self, recordings: DataFrame) -> Dataset:
        return Dataset(recordings, folder=self.folder, kernel=self.kernel)

    def filter(self, **conditions: object) -> Dataset:
        """See ``catalog.sample_filter``."""
        return self.with_recordings(catalog.sample_filter(self.recordings, **conditions))

    def check(self) -> Dataset:
        return self.with_recordings(catalog.check(self.recordings))

    def set_metadata(self, name: str, values: DataFrame) -> Dataset:
        return self.with_recordings(catalog.set_metadata(self.recordings, name, values))

    def replace_paths(self, old: str, new: str) -> Dataset:
        return self.with_recordings(self.recordings.withColumn("path", catalog.replace_prefix(F.col("path"), old, new)))

    def auto_domain(self) -> Dataset:
        """Domains from rate and channels; rows without them keep their domain."""
        return self.with_recordings(self.recordings.withColumn("domain", F.coalesce(catalog.auto_domain(F.col("sfreq"), F.col("channels")), F.col("domain"))))

    def process(self, condition: Column, function: Callable[[dict], object], **options: object) -> Dataset:
        """See ``batch.batch_process``."""
        return self.with_recordings(batch.batch_process(self.recordings, condition, function, **options))

    def transform(self, pipeline: batch.Pipeline | Callable[[DataFrame], DataFrame]) -> Dataset:
        return self.with_recordings(pipeline.forward(self.recordings) if isinstance(pipeline, batch.Pipeline) else pipeline(self.recordings))

    def union(self, *others: Dataset) -> Dataset:
        if not all(isinstance(o, Dataset) for o in others):
            raise TypeError("only datasets can be united")
        return self.with_recordings(catalog.union(self.recordings, *[o.recordings for o in others]))

    def group_by_domain(self, domains: list[str]) -> dict[str, Dataset]:
        return {d: self.with_recordings(df) for d, df in catalog.group_by_domain(self.recordings, domains).items()}

    def signals(self, block: int = 8192) -> DataFrame:
        """Samples of the dataset's recordings in blocks; ValueError for a dataset without a folder."""
        if not self.folder:
            raise ValueError("this dataset has no files")
        spark = self.recordings.sparkSession
        return timeseries.read_signals(spark, self.folder, block).join(self.recordings.select("path"), "path", "left_semi")

    def save(self, path: str, *, mode: str = "errorifexists") -> None:
        """Write the catalogue as CSV; nested columns are written as JSON text."""
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.simpleString().startswith(("array", "map", "struct")) else F.col(f.name) for f in self.recordings.schema.fields]
        self.recordings.select(*flat).write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)

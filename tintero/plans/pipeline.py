"""Stages by name, run one after the other; a failing stage does not stop the others."""

from __future__ import annotations

import argparse
import sys
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintero.operators import aggregate, clean, enrich, layout, normalize, quality, scanned_clean, score, segment
from tintero.sources import readers, writers


@dataclass
class Config:
    """Folders of a run."""

    data_dir: str = "data"
    metadata_dir: str = "metadata"
    output_dir: str = "output"
    incremental: bool = False
    normalize: bool = False
    extra: dict = field(default_factory=dict)

    def ensure(self) -> None:
        for p in (self.data_dir, self.metadata_dir, self.output_dir):
            Path(p).mkdir(parents=True, exist_ok=True)

    def path(self, name: str) -> str:
        return f"{self.output_dir}/{name}"


def runtime_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class Runner:
    """Collect, classify, extract, clean and analyse; every stage reads and writes parquet or JSON in the run's folders.

    Files are told apart by their text layer.  Editable pages are cut at their
    annex and cleaned by the rules for editable texts, scanned ones by the staged
    rules; both are then paired across page ends, split into paragraphs, graded
    and scored.  Cleaning goes on where an earlier run stopped: files that are in
    its result are not cleaned again (``incremental``).
    """

    STAGES = ("collect", "classify", "extract", "clean", "analyze")

    def __init__(self, spark: SparkSession, config: Config, scorer: score.Scorer = score.keyword_scorer):
        self.spark, self.config, self.scorer = spark, config, scorer
        self.steps: dict[str, Callable[[], DataFrame]] = {"collect": self.collect, "classify": self.classify, "extract": self.extract, "clean": self.clean, "analyze": self.analyze}
        self.done: dict[str, str] = {}

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.config.path(name))
        return self.spark.read.parquet(self.config.path(name))

    def collect(self) -> DataFrame:
        rows = readers.json_array(self.spark, f"{self.config.data_dir}/list_rows*.json", readers.METADATA_RAW)
        return self._save(enrich.sort_by_date(enrich.enrich(rows)), "metadata_raw")

    def classify(self) -> DataFrame:
        pages = readers.json_array(self.spark, f"{self.config.data_dir}/pages*.json", readers.PAGES)
        kinds = self._save(layout.extracted(pages), "kinds")
        meta = self.spark.read.parquet(self.config.path("metadata_raw"))
        return self._save(enrich.update_type(meta.withColumn("pdf_type", F.lit(None).cast("string")), kinds.where("pdf_type = 'editable'"), kinds.where("pdf_type = 'scanned'")), "metadata")

    def extract(self) -> DataFrame:
        pages = readers.json_array(self.spark, f"{self.config.data_dir}/pages*.json", readers.PAGES)
        kinds = self.spark.read.parquet(self.config.path("kinds"))
        pages = pages.join(kinds, "pdf_filename").withColumn("page_id", F.xxhash64("pdf_filename", "page", "text"))
        editable = layout.before_annex(pages.where("pdf_type = 'editable'"))
        return self._save(editable.unionByName(pages.where("pdf_type = 'scanned'")), "pages")

    def clean(self) -> DataFrame:
        pages = self.spark.read.parquet(self.config.path("pages"))
        target = self.config.path("clean_pages")
        old = self.spark.read.parquet(target) if self.config.incremental and runtime_exists(self.spark, target) else None
        if old is not None:
            pages = enrich.only_new(pages, old, "pdf_filename")
        editable = clean.clean_pages(pages.where("pdf_type = 'editable'")).select("page_id", "pdf_filename", "page", "pdf_type", F.col("cleaned_text").alias("text"))
        scanned = scanned_clean.clean_scanned(pages.where("pdf_type = 'scanned'")).select("page_id", "pdf_filename", "page", "pdf_type", "text")
        new = editable.unionByName(scanned)
        if old is None:
            return self._save(new, "clean_pages")
        new.write.mode("append").parquet(target)
        return self.spark.read.parquet(target)

    def paragraphs(self) -> DataFrame:
        """Paragraphs of the cleaned pages, paired across page ends, with their source_type and number."""
        pages = self.spark.read.parquet(self.config.path("clean_pages"))
        parts = []
        for kind, mode in (("editable", "as_written"), ("scanned", "intended")):
            pairs = segment.pair_pages(pages.where(F.col("pdf_type") == kind), mode=mode)
            parts.append(segment.paragraphs_of(pairs).withColumn("source_type", F.lit(kind)))
        both = parts[0].unionByName(parts[1])
        return segment.number_rows(both, ["pdf_filename", "page", "position"])

    def analyze(self) -> DataFrame:
        p = quality.valid(self._save(self.paragraphs(), "paragraphs"))
        if self.config.normalize:
            p = self._save(normalize.normalised_paragraphs(p), "normalised")
        meta = self.spark.read.parquet(self.config.path("metadata"))
        scored = score.score_rows(enrich.with_metadata(p, meta.withColumn("scraped_at", meta["date"].cast("timestamp"))), score.retrying(self.scorer))
        out = self._save(aggregate.document_scores(scored), "document_scores")
        writers.csv(out, self.config.path("document_scores_csv"))
        return out

    def run(self, names: list[str] | None = None) -> dict[str, str]:
        """Outcome per stage: ok or the error; unknown names are refused before anything runs."""
        names = list(names or self.STAGES)
        for n in names:
            if n not in self.steps:
                raise ValueError(f"unknown stage {n!r}; stages are {', '.join(self.STAGES)}")
        self.config.ensure()
        for n in names:
            try:
                self.steps[n]()
                self.done[n] = "ok"
            except Exception as e:  # noqa: BLE001
                traceback.print_exc()
                self.done[n] = f"failed: {type(e).__name__}"
        return self.done

    def status(self) -> dict[str, bool]:
        """Which results exist."""
        return {n: Path(self.config.path(n)).exists() for n in ("metadata_raw", "metadata", "pages", "clean_pages", "document_scores")}


def main(argv: list[str] | None = None) -> int:
    """Command line: --all, --stage NAME, --stages A,B, --list, --data-dir, --metadata-dir, --output-dir; 0 if all went well."""
    a = argparse.ArgumentParser(prog="tintero")
    a.add_argument("--all", action="store_true")
    a.add_argument("--stage")
    a.add_argument("--stages")
    a.add_argument("--list", action="store_true")
    for d in ("data", "metadata", "output"):
        a.add_argument(f"--{d}-dir", default=d)
    x = a.parse_args(argv)
    if x.list or not (x.all or x.stage or x.stages):
        print("\n".join(Runner.STAGES))
        return 0
    try:
        spark = SparkSession.builder.appName("tintero").getOrCreate()
        runner = Runner(spark, Config(x.data_dir, x.metadata_dir, x.output_dir))
        done = runner.run(None if x.all else [x.stage] if x.stage else x.stages.split(","))
        return 0 if all(v == "ok" for v in done.values()) else 1
    except KeyboardInterrupt:
        return 130
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

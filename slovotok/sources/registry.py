"""Importers of correction datasets by name, registry files that say which dataset lies where, and runs over them.

A registry file is JSON: a list of datasets, each with a name, the importer, the path of its files, and the folder for its records.
Defined results: an unknown importer or a missing key is an error that names the dataset; a dataset whose files are absent is
reported as missing and skipped; a dry run reads and writes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slovotok.sources import gec


@dataclass(frozen=True)
class Importer:
    """An importer: what it reads, and the function from a session and a path to records."""

    name: str
    reads: str
    run: Callable[[SparkSession, str], DataFrame]


IMPORTERS: dict[str, Importer] = {}


def importer(name: str, reads: str) -> Callable:
    """Registers an importer; a name can be registered once."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        if name in IMPORTERS:
            raise ValueError(f"importer {name} is registered already")
        IMPORTERS[name] = Importer(name, reads, f)
        return f

    return put


def _csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(f"{path}/{name}")


@importer("normalised", "records as JSON lines")
def _normalised(spark: SparkSession, path: str) -> DataFrame:
    return gec.read_jsonl(spark, path)


@importer("m2", "M2 files, in folders or zip archives")
def _m2(spark: SparkSession, path: str) -> DataFrame:
    return gec.read_m2(gec.archive_members(spark, path, ".m2"))


@importer("grammar-sheet", "the grammar spreadsheet")
def _sheet(spark: SparkSession, path: str) -> DataFrame:
    return gec.grammar_sheet(gec.read_xlsx(spark, path))


@importer("learner-sentences", "sentences.csv, documents.csv and annotations.csv")
def _learner(spark: SparkSession, path: str) -> DataFrame:
    return gec.learner_sentences(_csv(spark, path, "sentences.csv"), _csv(spark, path, "documents.csv"), _csv(spark, path, "annotations.csv"))


@importer("spelling", "JSON lines with source, correction and domain")
def _spelling(spark: SparkSession, path: str) -> DataFrame:
    return gec.spelling_pairs(spark.read.option("recursiveFileLookup", "true").text(path))


@importer("pairs", "tab-separated id, rule, wrong and right text")
def _pairs(spark: SparkSession, path: str) -> DataFrame:
    return gec.pairs_table(spark.read.text(path), "pairs")


@dataclass(frozen=True)
class Dataset:
    """A dataset of a registry file."""

    name: str
    importer: str
    path: str
    output: str


def read_registry(path: str) -> list[Dataset]:
    """The datasets of a registry file; paths are taken from its folder."""
    base = Path(path).parent
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    out = []
    for i, raw in enumerate(found["datasets"] if isinstance(found, dict) else found):
        name = raw.get("name") or f"number {i + 1}"
        lacking = [k for k in ("name", "importer", "path", "output") if not raw.get(k)]
        if lacking:
            raise ValueError(f"dataset {name}: no {', '.join(lacking)}")
        if raw["importer"] not in IMPORTERS:
            raise ValueError(f"dataset {name}: unknown importer {raw['importer']}; known are {', '.join(sorted(IMPORTERS))}")
        out.append(Dataset(name, raw["importer"], str(base / raw["path"]), str(base / raw["output"])))
    return out


def import_all(spark: SparkSession, datasets: list[Dataset], dry_run: bool = False, then: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[str, str, int]]:
    """Imports datasets and writes their records as JSON lines: (name, status, records) of each. `then` makes a report of the records,
    written beside them."""
    from slovotok.sinks.reports import write_records

    done = []
    for d in datasets:
        if dry_run:
            done.append((d.name, "planned", 0))
            continue
        if "://" not in d.path and not Path(d.path).exists():
            done.append((d.name, "missing", 0))
            continue
        write_records(IMPORTERS[d.importer].run(spark, d.path), d.output)
        records = spark.read.json(d.output)
        if then is not None:
            then(records).coalesce(1).write.mode("overwrite").json(f"{d.output}-report")
        done.append((d.name, "written", records.count()))
    return done


def convert_dictionary(lexicon: DataFrame) -> DataFrame:
    """A dictionary of any format as the lines (value) of the project's own: eight columns, distinct, in one order over all lines."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), c)) for k, c in FEATURES.items()]
    packed = F.concat_ws("|", *parts)
    rows = lexicon.select("form", "lemma", F.col("pos").alias("part"), packed.alias("features"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lemma_id", "paradigm_id", "source_id", "stress")]).distinct()
    columns = ("form", "lemma", "part", "features", "lemma_id", "paradigm_id", "source_id", "stress")
    return rows.orderBy(*columns).select(F.concat_ws("\t", *columns).alias("value"))


#: The feature keys of the project's dictionaries and the columns of the lexicon that hold them, in the order of writing.
FEATURES = {"case": "case", "number": "number", "gender": "gender", "animacy": "animacy", "aspect": "aspect", "tense": "tense", "person": "person", "adj_form": "adjective_form", "degree": "degree", "verb_form": "verb_form", "mood": "mood", "voice": "voice"}

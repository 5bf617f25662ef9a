"""Subject tables of several studies, made alike."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import range_midpoint


@dataclass(frozen=True)
class Study:
    """How a study's table is read: headers that may hold a field, whether a missing age drops the row."""

    name: str
    prefix: str
    # The headers under which studies publish these fields.
    subject: Sequence[str] = ("participant_id", "participant", "Subject", "Subject ID", "subject", "ID")
    age: Sequence[str] = ("age", "Age", "Age_in_Yrs", "age (5-year bins)")
    sex: Sequence[str] = ("sex", "Sex", "Gender", "gender")
    needs_age: bool = False
    default_band: str = "young_adult"


def sex(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    # The codes of published tables.
    return F.when(s.isin("f", "female", "2", "2.0"), "female").when(s.isin("m", "male", "1", "1.0"), "male").otherwise("unknown")


def age_band(age: Column) -> Column:
    """Up to 35, up to 55, above; under 18 fails the job."""
    young = F.raise_error(F.concat(F.lit("age under 18: "), age.cast("string"))).cast("string")
    return F.when(age < 18, young).when(age <= 35, "young_adult").when(age <= 55, "middle").when(age.isNotNull(), "older")


def normalize(df: DataFrame, study: Study) -> DataFrame:
    """subject_id, source_subject_id, age, age_band, sex, dataset, site_id."""
    pick = lambda names: next((F.col(f"`{n}`") for n in names if n in df.columns), None)
    subject = pick(study.subject)
    if subject is None:
        likely = [c for c in df.columns if re.search(r"sub|participant", c, re.IGNORECASE)]
        if not likely:
            raise ValueError(f"{study.name}: no subject id column")
        subject = F.col(f"`{likely[0]}`")
    own = F.trim(F.regexp_replace(subject.cast("string"), "^sub-", ""))
    years, said = pick(study.age), pick(study.sex)
    if years is None and study.needs_age:
        raise ValueError(f"{study.name}: no age column")
    age = F.lit(None).cast("double") if years is None else range_midpoint(years.cast("string"))
    out = df.select(F.concat(F.lit(study.prefix), own).alias("subject_id"), own.alias("source_subject_id"), age.alias("age"), (F.lit("unknown") if said is None else sex(said)).alias("sex"))
    if study.needs_age:
        out = out.where("age IS NOT NULL")
    return out.withColumns({"age_band": F.coalesce(age_band(F.col("age")), F.lit(study.default_band)), "dataset": F.lit(study.name), "site_id": F.lit(study.name)})


def harmonize(parts: Sequence[DataFrame]) -> DataFrame:
    """All subjects; a subject_id that stands twice fails."""
    if not parts:
        raise ValueError("no subject tables")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    twice = out.groupBy("subject_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"subject_id stands more than once: {twice[0]['subject_id']}")
    return out


def read_first(spark: SparkSession, candidates: Sequence[str], **options: str) -> tuple[DataFrame, str]:
    """The first of several places that can be read, and which it was."""
    for path in candidates:
        try:
            sep = "\t" if path.endswith(".tsv") else ","
            return spark.read.options(header="true", sep=sep, **options).csv(path), path
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {list(candidates)}")


def read_studies(spark: SparkSession, files: Mapping[str, Study]) -> DataFrame:
    """Those of the files that are there, harmonized."""
    parts = []
    for path, study in files.items():
        try:
            parts.append(normalize(read_first(spark, [path])[0], study))
        except FileNotFoundError:
            continue
    return harmonize(parts)

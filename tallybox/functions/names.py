"""Names of files, runs and datasets, and labels of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_key(name: Column) -> Column:
    """What stands before the first underscore."""
    return F.regexp_extract(name, "^[^_]+", 0)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def path_features(path: Column) -> dict[str, Column]:
    """ext, split, type and dataset of an image path; the dataset 'instances' is none."""
    dataset = F.regexp_replace(dataset_key(basename(path)), "^0[01]-(prospective|partial)-", "")
    return {
        "ext": extension(path),
        "split": F.regexp_extract(path, "/(train|val)/", 1),
        "type": F.regexp_extract(path, "/(images|labels)/", 1),
        "dataset": F.nullif(dataset, F.lit("instances")),
    }


def model_size(run: Column) -> Column:
    return F.regexp_extract(run, "_([LMSN])(?:_|$)", 1)


def left_out(run: Column) -> Column:
    """The dataset that a leave-one-out run lacks."""
    return F.regexp_extract(run, "_[LMSN]_([^_]+)", 1)


def tuning_stage(run: Column) -> Column:
    return F.when(F.lower(run).contains("finetune"), "After").otherwise("Before")


def left_out_pair(run: Column) -> tuple[Column, Column]:
    """The datasets of a leave-two-out run; FULL is empty."""
    parts = F.split(run, "_", 2)
    empty = lambda c: F.when(c == "FULL", F.lit("")).otherwise(c)
    return empty(parts[0]), empty(F.coalesce(F.get(parts, 1), F.lit("")))


# Fixed value: the form of result file names.
def sample_key(name: Column) -> Column:
    return F.regexp_extract(name, r"^[^_]+_(.+)(_heatmap|_matches|\.csv)", 1)


def stars(p: Column) -> Column:
    """A star for each tenth of 0.05: up to 0.05 '*', 0.005 '**', 0.0005 '***', else 'ns'."""
    return F.when(p <= 0.0005, "***").when(p <= 0.005, "**").when(p <= 0.05, "*").otherwise("ns")


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", p))


def interval_text(y: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", y, low, high)

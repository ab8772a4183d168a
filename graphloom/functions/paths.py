"""Path and identity expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import as_column

# Directory names that a walk skips, whatever their case.
EXCLUDED_DIRECTORIES = ["bin", "obj", ".git", "node_modules"]


def normalize_path(path: Column | str, case_insensitive: bool = False) -> Column:
    """Forward slashes only; optionally folded to upper case."""
    path = F.translate(as_column(path), "\\", "/")
    return F.upper(path) if case_insensitive else path


def _collapse(path: Column) -> Column:
    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))


def resolve_path(base_dir: Column | str, relative: Column | str) -> Column:
    """Join a path to a directory (an absolute path wins) and collapse `.` and `..`."""
    relative = normalize_path(relative)
    joined = F.concat(normalize_path(base_dir), F.lit("/"), relative)
    return _collapse(F.when(relative.startswith("/"), relative).otherwise(joined))


def parent_dir(path: Column | str) -> Column:
    """Everything before the last slash; '/' for entries of the root."""
    path = as_column(path)
    cut = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(path.contains("/"), F.when(cut == "", "/").otherwise(cut)).otherwise("")


def ancestors(directory: Column | str) -> Column:
    """The directory and all its parents as an array, nearest first."""
    directory = as_column(directory)
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    root = F.when(directory.startswith("/"), "/").otherwise("")
    upward = F.transform(
        F.sequence(F.size(parts), F.lit(0), F.lit(-1)),
        lambda n: F.concat(root, F.array_join(F.slice(parts, 1, n), "/")),
    )
    return upward


def stable_id(key: Column | str) -> Column:
    """The first 16 bytes of SHA-256 as hex text."""
    return F.substring(F.sha2(as_column(key).cast("string"), 256), 1, 32)


def path_id(path: Column | str, case_insensitive: bool = False) -> Column:
    return stable_id(normalize_path(path, case_insensitive))


def package_id(name: Column | str, version: Column | str) -> Column:
    return stable_id(F.concat(as_column(name), F.lit(":"), as_column(version)))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(as_column(path), "([^/]*)$", 1)


def file_stem(path: Column | str) -> Column:
    """File name without directory and without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]+)$", 1))


def last_segment(name: Column | str) -> Column:
    """Text after the last dot."""
    return F.regexp_extract(as_column(name), r"([^.]*)$", 1)


def in_excluded_directory(path: Column | str) -> Column:
    """True when any directory on the path is one that walks skip."""
    folders = F.split(F.lower(parent_dir(normalize_path(path))), "/")
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in EXCLUDED_DIRECTORIES]))

"""File corpora as tables, and the admission filters applied before scanning.

A corpus is a DataFrame ``(repo, path, content[, size])``; ``path`` is
relative to the repository root. Everything here is a narrow transformation
(no shuffle): filters on path/extension/size push into the file or Parquet
scan, the language lookup is a literal map.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanforge.constants import (DEFAULT_IGNORE_PATHS, EXTENSION_LANGUAGE, IAC_EXTENSION_LANGUAGE,
                                 LEAK_ONLY_EXTENSIONS, MANIFEST_NAMES, MEDIA_EXTENSIONS)
from scanforge.functions.text import extension
from scanforge.sources import tree


def read_corpus(spark: SparkSession, root: str, repo: str | None = None, max_bytes: int | None = None,
                repo_depth: int = 0, extra_ignores: list[str] | tuple = (), admitted_only: bool = True) -> DataFrame:
    """Read a directory tree into ``(repo, path, content, size, binary)``.

    A local folder is listed and read by tasks (``sources.tree``), any other
    by the ``binaryFile`` source. With ``admitted_only`` the file listing
    itself is restricted to the extensions a scan admits and to manifest
    names, and files below ignored folders are dropped by path before their
    content is decoded; an optional size cap works on the file metadata.
    ``binary`` is decided on the raw bytes. With ``repo_depth`` n the first n
    path segments name the repository (an organisation's checkouts side by
    side), otherwise ``repo`` does.
    """
    folder = tree.local_root(root)
    own = folder is not None and os.path.isdir(folder)
    if own:
        df = tree.list_files(spark, folder, _admitted_name if admitted_only else None)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if admitted_only:
            reader = reader.option("pathGlobFilter", _admitted_glob())
        df = reader.load(root)
    if max_bytes is not None:
        df = df.where(F.col("length") <= max_bytes)
    prefix = "/" + re.sub(r"^[a-z0-9]+:/*", "", root).strip("/") if root.startswith("/") or ":" in root else root.rstrip("/")
    bare = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    rel = F.when(bare.startswith(prefix + "/"), F.substring(bare, len(prefix) + 2, 1 << 30)).otherwise(bare)
    df = df.withColumn("_rel", rel)
    if admitted_only:
        df = ignore_paths(df, extra_ignores, "_rel")
    if own:
        df = tree.read_files(df).withColumn("_rel", rel)
    segs = F.split(F.col("_rel"), "/")
    if repo_depth:
        name = F.array_join(F.slice(segs, 1, repo_depth), "/")
        rest = F.array_join(F.slice(segs, repo_depth + 1, F.greatest(F.size(segs) - repo_depth, F.lit(0))), "/")
        df = df.where(F.size(segs) > repo_depth)
    else:
        name, rest = F.lit(repo or prefix), F.col("_rel")
    return df.select(
        name.alias("repo"),
        rest.alias("path"),
        # bytes -> text without failing on invalid UTF-8: such sequences become U+FFFD
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
        is_binary_bytes(F.col("content")).alias("binary"),
    )


_ADMITTED_EXTENSIONS = tuple(sorted(e for e in {*EXTENSION_LANGUAGE, *LEAK_ONLY_EXTENSIONS, *IAC_EXTENSION_LANGUAGE} if e))
_ADMITTED_NAMES = frozenset(n for ns in MANIFEST_NAMES.values() for n in ns) | {".gitignore"}


def _admitted_glob() -> str:
    """File-name glob of everything a scan reads: known extensions in either case, and manifests."""
    def any_case(ext):
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext)
    return "{" + ",".join([*sorted("*" + any_case(e) for e in _ADMITTED_EXTENSIONS), *sorted(_ADMITTED_NAMES)]) + "}"


def _admitted_name(name: str) -> bool:
    """The same test on one name."""
    return name in _ADMITTED_NAMES or name.lower().endswith(_ADMITTED_EXTENSIONS)


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Redistribute a table by its leading (id) column when the caller asks
    for it; without ``min_partitions`` the table is read as it is split."""
    return df if not min_partitions else df.repartition(min_partitions, F.xxhash64(F.col(df.columns[0])))


def ignore_paths(files: DataFrame, extra: list[str] | tuple = (), path_col: str = "path") -> DataFrame:
    """Drop files with an ignored name as a path segment (defaults + ``extra``)."""
    return files.where(~ignored_path(extra, path_col))


def ignored_path(extra: list[str] | tuple = (), path_col: str = "path") -> Column:
    names = list(DEFAULT_IGNORE_PATHS) + [e for e in extra if e]
    return F.arrays_overlap(F.split(F.col(path_col), "/"), F.array(*[F.lit(n) for n in names]))


def language_of(path_col: Column | str, mapping: dict | None = None) -> Column:
    m = mapping or EXTENSION_LANGUAGE
    lit_map = F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(lit_map, extension(path_col))


def admit_files(files: DataFrame, leaks: bool = True, path_col: str = "path") -> DataFrame:
    """Keep files with a known extension, or one of the config extensions when
    secret scanning is on."""
    ext = extension(F.col(path_col))
    known = ext.isin(*EXTENSION_LANGUAGE.keys())
    if leaks:
        known = known | ext.isin(*LEAK_ONLY_EXTENSIONS)
    return files.where(known)


def detect_language(files: DataFrame, mapping: dict | None = None, path_col: str = "path") -> DataFrame:
    """Add ``language`` (NULL when the extension is not mapped)."""
    return files.withColumn("language", language_of(F.col(path_col), mapping))


def language_inventory(files: DataFrame, group_cols: tuple = ()) -> DataFrame:
    """Files scanned and sorted set of languages found (per group)."""
    lang = language_of(F.col("path"))
    aggs = [F.count(F.lit(1)).alias("files_scanned"),
            F.sort_array(F.collect_set(lang)).alias("languages_found")]
    if group_cols:
        return files.groupBy(*group_cols).agg(*aggs)
    return files.agg(*aggs)


def size_cap(files: DataFrame, cap: int, content_col: str = "content") -> DataFrame:
    """Drop files larger than ``cap`` bytes (equal is kept)."""
    if "size" in files.columns:
        return files.where(F.col("size") <= cap)
    return files.where(F.octet_length(F.col(content_col)) <= cap)


# bytes that count as non-printable: 0x01-0x08, 0x0B, 0x0C, 0x0E-0x1F, 0x7F
_NONPRINT = "".join(chr(c) for c in list(range(1, 9)) + [11, 12] + list(range(14, 32)) + [127])


def is_binary(content: Column, sample_bytes: int | None = None) -> Column:
    """Binary heuristic on the text's bytes: a NUL, or more than 30 %
    non-printable bytes (integer percentage); empty content is text."""
    return is_binary_bytes(F.encode(content, "UTF-8"), sample_bytes)


def is_binary_bytes(raw: Column, sample_bytes: int | None = None) -> Column:
    """The same on raw bytes (all of them, or the first ``sample_bytes``).

    Decoded as ISO-8859-1 one byte is one character; the count is a
    ``translate`` deletion.
    """
    sample = F.decode(raw if sample_bytes is None else F.substring(raw, 1, sample_bytes), "ISO-8859-1")
    n = F.length(sample)
    bad = n - F.length(F.translate(sample, _NONPRINT, ""))
    has_nul = F.instr(sample, "\x00") > 0
    return F.when(n == 0, F.lit(False)).otherwise(has_nul | (F.floor(bad * 100 / n) > 30))


def binary_flag(files: DataFrame, content_col: str = "content") -> Column:
    """``binary`` where the reader decided it on the raw bytes, else the test on the text."""
    return F.col("binary") if "binary" in files.columns else is_binary(F.col(content_col))


def drop_binary(files: DataFrame, content_col: str = "content") -> DataFrame:
    return files.where(~binary_flag(files, content_col))


def drop_media_extensions(files: DataFrame, path_col: str = "path") -> DataFrame:
    return files.where(~extension(F.col(path_col)).isin(*MEDIA_EXTENSIONS))

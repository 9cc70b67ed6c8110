"""Source files: the ordered listing and its text table."""

from __future__ import annotations

import posixpath
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .verilog_lexer import beside


def collect_paths(raw: list[str], spark: SparkSession | None = None) -> list:
    """Directories give their sorted *.v, then sorted *.sv files, at any depth; other arguments stay as they are.
    With a session, paths with a scheme may be directories too."""
    out: list = []
    for item in raw:
        if _REMOTE.match(str(item)):
            out += _listed(spark, str(item)) if spark else [str(item)]
            continue
        item = Path(item)
        out += [p for suffix in ("*.v", "*.sv") for p in sorted(item.rglob(suffix))] if item.is_dir() else [item]
    return out


def _listed(spark: SparkSession, name: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return [name]
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        found.append(files.next().getPath().toString())
    return [p for suffix in (".v", ".sv") for p in sorted(found) if p.endswith(suffix)]


#: Bytes of listing that are broadcast, and of included files that go to every task.
LISTING_BYTES, HEADER_BYTES = 64 << 20, 64 << 20
_REMOTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:/")


def _uri(name: str) -> str:
    """A path with its scheme; what has one is taken as it is (hdfs:, s3a: and the like), the rest is local."""
    return name if _REMOTE.match(name) else Path(name).resolve().as_uri().replace("file:///", "file:/")


def _exists(spark: SparkSession, name: str) -> bool:
    if not _REMOTE.match(name):
        return Path(name).exists()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _texts(spark: SparkSession, uris: list[str]) -> DataFrame:
    return spark.read.text(uris, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("uri"), F.col("value").alias("text"))


def read_files(spark: SparkSession, paths: list) -> DataFrame:
    """(file_idx, path, text) in the order of `paths`; a path given twice is two files."""
    names = [str(p) for p in paths]
    for name in names:
        if not _exists(spark, name):
            raise FileNotFoundError(f"file not found: {name}")
    order = spark.createDataFrame([(i, n, _uri(n)) for i, n in enumerate(names)], "file_idx int, path string, uri string")
    # texts are not shuffled while the listing is small enough to be sent to them
    small = sum(2 * len(n) + 100 for n in names) <= LISTING_BYTES
    return _texts(spark, sorted({_uri(n) for n in names})).join(F.broadcast(order) if small else order, "uri").select("file_idx", "path", "text")


def included(spark: SparkSession, files: DataFrame, folders: tuple = ()) -> dict[str, str]:
    """Texts by path of the files that `files` name in `include, and those name in turn: looked for beside the naming file,
    then in `folders`.  Only names come to the driver, and texts of at most HEADER_BYTES together, as every task gets them."""
    ask = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r'`include[ \t]+["<]([^">\n]+)[">]'), F.lit(1)))
    near = F.regexp_replace("path", "[^/]*$", "")
    wanted = {(r[0], r[1]) for r in files.select(near, ask.alias("name")).distinct().collect()}
    found: dict[str, str] = {}
    size = 0
    while wanted:
        todo = {beside(f, name) for folder, name in wanted for f in (folder, *folders)} - found.keys()
        todo = sorted(p for p in todo if _exists(spark, p))
        if not todo:
            break
        by_uri = {_uri(p): p for p in todo}
        wanted = set()
        for r in _texts(spark, sorted(by_uri)).toLocalIterator():
            size += len(r.text.encode())
            if size > HEADER_BYTES:
                raise ValueError(f"included files have more than {HEADER_BYTES} bytes")
            path = by_uri[r.uri]
            found[path] = r.text
            wanted |= {(posixpath.dirname(path), name) for name in re.findall(r'`include[ \t]+["<]([^">\n]+)[">]', r.text)}
    return found


def nettype_none(text: Column) -> Column:
    """Whether a file says `default_nettype none anywhere at the start of a line."""
    return F.coalesce(text, F.lit("")).rlike(r"(?m)^\s*`default_nettype\s+none\b")

"""Folders of notes, git trees and event logs as DataFrames, and folders of notes as a sink."""

from __future__ import annotations

import fnmatch
import os
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vaultspark.operators.predicates import glob_regex

SUFFIXES = (".md", ".markdown", ".yaml", ".yml", ".mmd")
IGNORED = (".git/*", ".obsidian/*", ".trash/*")
_SCHEMA = "path string, mtime double, bytes bigint, text string"


def ignore_patterns(root: str, more: list[str] | None = None) -> list[str]:
    """Built-in patterns, the caller's, and those of .indexignore (one per line, # for comments)."""
    own = Path(root, ".indexignore")
    lines = own.read_text().splitlines() if own.is_file() else []
    return [*IGNORED, *(more or []), *(x.strip() for x in lines if x.strip() and not x.lstrip().startswith("#"))]


class _Slice(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.per_task = int(options.get("filesPerTask", "500"))
        self.ignore = ignore_patterns(self.root, [p for p in options.get("ignore", "").split("\n") if p])

    def partitions(self) -> list[_Slice]:
        """Lists names only, on the driver, folder by folder; folders that a pattern name/* ignores are not entered."""
        skip = {p[:-2] for p in self.ignore if p.endswith("/*") and not re.search(r"[*?\[/]", p[:-2])}
        tests = [re.compile(fnmatch.translate(p)) for p in self.ignore]
        files = []
        for folder, names, leaves in os.walk(self.root):
            names[:] = sorted(n for n in names if n not in skip)
            for leaf in leaves:
                rel = os.path.relpath(os.path.join(folder, leaf), self.root).replace(os.sep, "/")
                if leaf.lower().endswith(SUFFIXES) and not any(t.fullmatch(rel) for t in tests):
                    files.append(rel)
        files.sort()
        return [_Slice(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [_Slice([])]

    def read(self, partition: _Slice):
        for rel in partition.files:
            full = os.path.join(self.root, rel)
            try:
                stat = os.stat(full)
                with open(full, "rb") as f:
                    yield rel, stat.st_mtime, stat.st_size, f.read().decode("utf-8", "replace")
            except FileNotFoundError:  # gone since it was listed
                continue


class VaultSource(DataSource):
    """spark.read.format('vault').load(root): path, mtime, bytes, text of every note, names that begin with _ or . included.

    Options: filesPerTask, ignore (patterns, one per line). The root must be a folder that all executors see.
    """

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_vault(spark: SparkSession, root: str, **options: str) -> DataFrame:
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").options(**options).load(root)


def _git(root: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", root, *args], input=data, capture_output=True, check=True, env={**os.environ, "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}).stdout


def resolve_ref(root: str, ref: str) -> tuple[str, str]:
    """(commit, tree) of a ref. A ref that begins with - or holds odd signs is refused."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_./@^~+-]*", ref) or ".." in ref:
        raise ValueError(f"not a ref: {ref!r}")
    commit = _git(root, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()
    return commit, _git(root, "rev-parse", f"{commit}^{{tree}}").decode().strip()


def list_refs(spark: SparkSession, root: str, limit: int = 200) -> DataFrame:
    """(name, oid, ts) of branches and tags, newest first."""
    out = _git(root, "for-each-ref", "--format=%(refname:short)%00%(objectname)%00%(creatordate:unix)", "refs/heads", "refs/tags", "refs/remotes").decode()
    rows = [(n, o, int(t or 0)) for n, o, t in (x.split("\0") for x in out.splitlines())]
    return spark.createDataFrame(rows, "name string, oid string, ts long").dropDuplicates(["name"]).orderBy(F.desc("ts"), "name").limit(limit)


def _last_touches(root: str, commit: str, wanted: set[str]) -> dict[str, int]:
    """Epoch seconds of the last commit that touched each wanted path. The log is read newest first, piece by piece, and only as
    far back as it takes to find them all."""
    touched, when, rest = {}, 0, b""
    with subprocess.Popen(["git", "-C", root, "log", "--format=%x01%ct", "--name-only", "-z", commit], stdout=subprocess.PIPE, env={**os.environ, "GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}) as log:
        while len(touched) < len(wanted):
            more = log.stdout.read(1 << 16)
            *parts, rest = re.split(rb"[\0\n]+", rest + more) if more else [rest, b""]
            for part in parts:
                if part.startswith(b"\x01"):
                    when = int(part[1:])
                elif (path := part.decode("utf-8", "replace")) in wanted:
                    touched.setdefault(path, when)
            if not more:
                break
        log.kill()
    return touched


def read_tree(spark: SparkSession, root: str, ref: str, ignore: list[str] | None = None, largest: int = 1 << 21, per_task: int = 500) -> DataFrame:
    """(tree_oid, path, oid, mtime, text) of the notes of a commit. Equal blobs are read once; those above `largest` bytes have a null text.

    Names and object ids come from the driver; contents are read by the tasks, in one batch each. mtime is the time of the
    last commit that touched the path, else of the commit itself.
    """
    commit, tree = resolve_ref(root, ref)
    tests = [re.compile(glob_regex(p)) for p in ignore_patterns(root, ignore)]
    entries = []
    for line in _git(root, "ls-tree", "-r", "-z", "-l", tree).decode("utf-8", "surrogateescape").split("\0"):
        if line:
            meta, path = line.split("\t", 1)
            _, kind, oid, size = meta.split()
            if kind == "blob" and path.lower().endswith(SUFFIXES) and not any(t.match(path) for t in tests):
                entries.append((path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), oid, int(size)))
    files = spark.createDataFrame(entries, "path string, oid string, size long")
    wanted = files.where(F.col("size") <= largest).select("oid").distinct()

    def read(batches):
        import pandas as pd

        for pdf in batches:
            raw, texts, at = _git(root, "cat-file", "--batch", data="".join(o + "\n" for o in pdf.oid).encode()), [], 0
            for _ in pdf.oid:
                end = raw.index(b"\n", at)
                n = int(raw[at:end].split()[2])
                texts.append(raw[end + 1 : end + 1 + n].decode("utf-8", "replace"))
                at = end + 2 + n
            yield pd.DataFrame({"oid": pdf.oid, "text": texts})

    blobs = wanted.repartition(max(1, len(entries) // per_task)).mapInPandas(read, "oid string, text string")
    touched = _last_touches(root, commit, {e[0] for e in entries})
    tip = float(_git(root, "show", "-s", "--format=%ct", commit))
    times = spark.createDataFrame([(p, float(t)) for p, t in touched.items()] or [("", tip)], "path string, mtime double")
    return files.join(blobs, "oid", "left").join(times, "path", "left").select(F.lit(tree).alias("tree_oid"), "path", "oid", F.coalesce("mtime", F.lit(tip)).alias("mtime"), "text")


def file_log(spark: SparkSession, root: str, path: str, limit: int = 20) -> DataFrame:
    """(commit, ts, author, subject): the history of one file across renames, 1 to 100 commits."""
    out = _git(root, "log", "--follow", f"-{min(max(limit, 1), 100)}", "--format=%H%x00%ct%x00%an%x00%s", "--", path).decode("utf-8", "replace")
    return spark.createDataFrame([(c, int(t), a, s) for c, t, a, s in (x.split("\0") for x in out.splitlines())], "commit string, ts long, author string, subject string")


def read_jsonl_calls(spark: SparkSession, path: str) -> DataFrame:
    """An event log of JSON lines, bad lines left out; the file's name is the collection where a line names none."""
    schema = "ts string, collection string, tool string, ok boolean, error string, duration_ms double, req_bytes long, resp_bytes long, conversation_id string, note_path string, _bad string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^/.]*)?$", 1)
    return raw.withColumn("collection", F.coalesce("collection", name)).where("_bad is null").drop("_bad")


def write_notes(notes: DataFrame, root: str, only: list[str] | None = None) -> DataFrame:
    """Write notes (path, text) below root, each file whole or not at all; (status, n): written, and skipped for a path outside root
    or of another kind than `only` (globs). The tasks write: root must be a folder that all executors see."""
    tests = [glob_regex(g) for g in only or ["*"]]

    def write(batches):
        import pandas as pd

        for pdf in batches:
            done = []
            for path, text in zip(pdf.path, pdf.text):
                full = os.path.normpath(os.path.join(root, path or ""))
                ok = bool(path) and text is not None and full.startswith(os.path.normpath(root) + os.sep) and any(re.match(t, path) for t in tests)
                if ok:
                    os.makedirs(os.path.dirname(full), exist_ok=True)
                    part = f"{full}.{os.getpid()}.part"
                    Path(part).write_text(text)
                    os.replace(part, full)
                done.append("written" if ok else "skipped")
            yield pd.DataFrame({"status": done})

    return notes.select("path", "text").mapInPandas(write, "status string").groupBy("status").agg(F.count("*").alias("n"))


def write_buckets(rows: DataFrame, folder: str, key: str = "path", buckets: int = 64) -> None:
    """Write rows partitioned by a hash of key, so that a later overwrite of single buckets takes the place of deletes."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


def replace_keys(spark: SparkSession, folder: str, new: DataFrame, gone: DataFrame, key: str = "path", buckets: int = 64) -> None:
    """In a folder of write_buckets, put new rows in place of all rows of their keys and drop those of gone keys.

    Only the buckets touched are read and written, each replaced as a whole; their rows are cut off from the files first.
    """
    from vaultspark.session import cut

    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = new.select(key).unionByName(gone.select(key)).distinct().withColumn("bucket", bucket)
    numbers = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most `buckets`
    if not numbers:
        return
    old = spark.read.parquet(folder)
    kept = old.where(F.col("bucket").isin(numbers)).join(touched.select(key), key, "left_anti")
    rows = cut(kept.unionByName(new.withColumn("bucket", bucket), allowMissingColumns=True).select(*old.columns))
    there = {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    for empty in set(numbers) - there:  # dynamic overwrite leaves a bucket without rows as it was
        old.where("false").drop("bucket").write.mode("overwrite").parquet(f"{folder}/bucket={empty}")

"""Files, exports, tables and databases."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = r"(?i)\.(jpe?g|png|gif|bmp|tiff?|webp)$"
FORMATS = ("parquet", "orc", "csv", "json", "text", "avro")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, content, length of image files below path; other files aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.regexp_like("path", F.lit(IMAGE))).select("path", "content", "length")


def contents(spark: SparkSession, keys: DataFrame, root: str) -> DataFrame:
    """key, content, error for keys(key): the files below root; missing ones have an error and don't fail the job.

    The executors read the files of the keys, and nothing else: root is a folder that they all reach, such as a mounted store.
    """

    def run(batches):
        import os

        import pyarrow as pa

        base = root.removeprefix("file://")
        for b in batches:
            found, errors = [], []
            for key in b.column(0).to_pylist():
                data, error = None, None
                try:
                    path = os.path.normpath(os.path.join(base, key))
                    if os.path.commonpath([os.path.normpath(base), path]) != os.path.normpath(base):
                        raise FileNotFoundError
                    with open(path, "rb") as f:
                        data = f.read()
                except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
                    error = f"not found: {key}"
                except (OSError, TypeError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                found.append(data), errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), pa.array(errors, pa.string())], ["key", "content", "error"])

    return keys.select("key").mapInArrow(run, "key string, content binary, error string")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; an error counts as no."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))
    except Exception:  # any failure of the store means that the file can't be used
        return False


def delete(spark: SparkSession, path: str) -> bool:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, False))
    except Exception:  # as above
        return False


def existing(keys: DataFrame, listing: DataFrame) -> DataFrame:
    return keys.join(listing, "key", "left_semi")


def write_contents(files: DataFrame, folder: str) -> DataFrame:
    """key, url: each row's content written to folder/key by the executors, by Hadoop paths that they can reach locally."""

    def run(batches):
        import os

        import pyarrow as pa

        for b in batches:
            urls = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path = os.path.join(folder, key)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.part", "wb") as f:
                    f.write(content)
                os.replace(f"{path}.part", path)  # a retried task writes the same file again
                urls.append(f"file://{path}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(urls, pa.string())], ["key", "url"])

    return files.select("key", "content").mapInArrow(run, "key string, url string")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = (), **options: str) -> None:
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def as_json(df: DataFrame, *keep: str) -> DataFrame:
    """keep, json: the other columns as JSON text; null fields are left out."""
    return df.select(*keep, F.to_json(F.struct(*(c for c in df.columns if c not in keep))).alias("json"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    p, fs = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[8:]) for n in names if n.startswith("version=") and fs.exists(_fs(spark, f"{path}/{n}/_SUCCESS")[0]))


def current(spark: SparkSession, path: str) -> str:
    """The folder of a collection's newest whole version; a version counts once its _SUCCESS is written."""
    have = _versions(spark, path)
    if not have:
        raise FileNotFoundError(f"no collection at {path}")
    return f"{path}/version={have[-1]}"


def create_collection(spark: SparkSession, path: str, force: bool = False) -> None:
    """An empty collection of vectors; with force, whatever is there is dropped."""
    from ..schemas import VECTOR

    if force:
        drop_collection(spark, path)
    elif _versions(spark, path):
        raise FileExistsError(path)
    spark.createDataFrame([], VECTOR).write.parquet(f"{path}/version=0")


def drop_collection(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return bool(fs.delete(p, True))


def upsert_vectors(spark: SparkSession, path: str, new: DataFrame, keep: int = 2) -> None:
    """Vectors of a collection replaced or added by id, as a new version beside the old ones, of which the newest stay; a crash leaves the last whole one."""
    have = _versions(spark, path)
    old = spark.read.parquet(current(spark, path))
    both = old.join(new.select("id"), "id", "left_anti").unionByName(new.select(old.columns))
    both.select(old.columns).write.mode("overwrite").parquet(f"{path}/version={have[-1] + 1}")
    for gone in have[: max(0, len(have) + 1 - keep)]:
        drop_collection(spark, f"{path}/version={gone}")


def collection_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path)).agg(F.count("*").alias("points"), F.max(F.size("embedding")).alias("dimensions"))


def jdbc_options(url: str, table: str, user: str = "", password: str = "", **more: str) -> dict[str, str]:
    return {"url": url, "dbtable": table, "user": user, "password": password} | more


def jdbc_read(spark: SparkSession, options: dict[str, str], column: str, low: int, high: int, parts: int) -> DataFrame:
    """A table over that many connections, by ranges of a column."""
    return spark.read.format("jdbc").options(**options, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def setting(spark: SparkSession, key: str, env: dict[str, str], file: dict[str, str] | None = None, default: str | None = None) -> str | None:
    """A setting: the environment over the session over a file over the default; empty ones don't count."""
    return env.get(key) or spark.conf.get(f"leaselens.{key}", None) or (file or {}).get(key) or default


def yaml_settings(path: str) -> dict[str, str]:
    """Keys of a simple YAML file, nested ones joined by dots; none of a missing file, none for empty values. Lists aren't read."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        return {}
    out: dict[str, str] = {}
    above: list[tuple[int, str]] = []
    for line in lines:
        plain = re.sub(r"""(^|\s)#.*$""", "", line)
        m = re.match(r"""^(\s*)([\w.-]+)\s*:\s*(?:"([^"]*)"|'([^']*)'|(.*?))\s*$""", plain)
        if not m:
            continue
        depth, key, value = len(m[1]), m[2], m[3] or m[4] or m[5] or ""
        above = [a for a in above if a[0] < depth]
        if value:
            out[".".join([*(k for _, k in above), key])] = value
        above.append((depth, key))
    return out


def each_row(df: DataFrame, send: Callable[[dict], None]) -> int:
    """send for each row, on the executors; a row's error doesn't stop the others. The number of rows that failed."""
    failed = df.sparkSession.sparkContext.accumulator(0)

    def run(rows) -> None:
        for row in rows:
            try:
                send(row.asDict(recursive=True))
            except Exception:  # a callback that fails is dropped, as its caller has gone
                failed.add(1)

    df.foreachPartition(run)
    return failed.value


def http_callback(url: str, seconds: float = 10.0) -> Callable[[dict], None]:
    """For each_row(): posts a row as JSON."""

    def send(row: dict) -> None:
        import json
        import urllib.request

        body = json.dumps(row, default=str, ensure_ascii=False).encode()
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": "application/json"}), timeout=seconds):
            pass

    return send


def health(spark: SparkSession) -> dict[str, object]:
    """Whether a job runs, and what runs it."""
    sc = spark.sparkContext
    try:
        fine = spark.range(1).count() == 1
    except Exception:  # whatever keeps a job from running
        fine = False
    return {"status": "healthy" if fine else "unhealthy", "version": spark.version, "cores": sc.defaultParallelism}


def mime(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext.isin("png", "gif", "bmp", "tiff", "webp"), F.concat(F.lit("image/"), ext)).otherwise("application/octet-stream")

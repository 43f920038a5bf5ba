"""Model assets, tile archives, tile trees and folder inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Archive suffixes and file classes of an output folder.
ARCHIVE_SUFFIXES = ("b3dm", "i3dm", "cmpt")
FILE_CLASSES = {"glb": "model", "json": "manifest"}


def asset_catalogue(spark: SparkSession, root: str, with_hash: bool = True) -> DataFrame:
    """Files of a store as (table_name, model, path, bytes, modified, sha). The layout is ``<table>/<model>``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split(F.regexp_replace("path", "^.*" + root.rstrip("/").replace(".", r"\.") + "/", ""), "/")
    out = files.select(
        F.try_element_at(parts, F.lit(1)).alias("table_name"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "/").alias("model"),
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha")] if with_hash else []))
    return out


def resolve_assets(wanted: DataFrame, local: DataFrame, remote: DataFrame, keys: Sequence[str] = ("table_name", "model")) -> DataFrame:
    """Content per wanted key: the local file first, the remote one otherwise."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min(F.struct("path", "bytes")).alias(name))

    joined = wanted.join(side(local, "l"), list(keys), "left").join(side(remote, "r"), list(keys), "left")
    return joined.select(*wanted.columns, F.coalesce("l.path", "r.path").alias("path"), F.coalesce("l.bytes", "r.bytes").alias("bytes"),
                         F.when(F.col("l").isNotNull(), "local").when(F.col("r").isNotNull(), "remote").otherwise("missing").alias("origin"))


def compression_manifest(results: DataFrame) -> DataFrame:
    """Files, bytes and saving per status, and how many destinations are written more than once."""
    clash = results.groupBy("dest").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("collisions"))
    per = results.groupBy("status").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("out_bytes").alias("out_bytes")).withColumn(
        "saved", F.lit(100.0) * (1 - F.col("out_bytes") / F.col("bytes")))
    return per.join(clash, F.lit(True))


def archive_index(spark: SparkSession, root: str, field: str = "id") -> DataFrame:
    """(path, feature_index, feature_id, problem) over all archives below a folder; unreadable files give one problem row.

    A composite is walked through; inner tiles of other kinds are passed over. Properties may be JSON
    lists or scalar numbers in the batch table's binary part. The reader travels with the job, so
    workers don't need this package.
    """
    glob = "*.{" + ",".join(ARCHIVE_SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "content")

    def read(batches):
        import json
        import struct

        import numpy as np
        import pandas as pd

        # Bytes before the tables by kind of tile, and the number kinds of binary properties.
        headers = {b"b3dm": 28, b"i3dm": 32}
        numbers = {"BYTE": "<i1", "UNSIGNED_BYTE": "<u1", "SHORT": "<i2", "UNSIGNED_SHORT": "<u2", "INT": "<i4", "UNSIGNED_INT": "<u4", "FLOAT": "<f4", "DOUBLE": "<f8"}

        def checked(data, at, least):
            version, size = struct.unpack_from("<2I", data, at + 4)
            if version != 1 or size < least or at + size > len(data):
                raise ValueError("bad version or length in a header")
            return at + size

        def column(data, at):
            end, head = checked(data, at, headers[data[at:at + 4]]), at + headers[data[at:at + 4]]
            ends = [head]
            for size in struct.unpack_from("<4I", data, at + 12):
                ends.append(ends[-1] + size)
            if ends[-1] > end:
                raise ValueError("tables longer than their tile")
            features, table = (json.loads(data[ends[k]:ends[k + 1]].rstrip(b" \t\r\n\0") or b"{}") for k in (0, 2))
            values = table.get(field, [])
            if isinstance(values, dict) and "byteOffset" in values:
                kind = numbers.get(values.get("componentType", "UNSIGNED_SHORT"))
                if kind is None or values.get("type", "SCALAR") != "SCALAR":
                    raise ValueError(f"property {field} is no scalar")
                count = features.get("BATCH_LENGTH", features.get("INSTANCES_LENGTH", 0))
                return np.frombuffer(data[ends[3]:ends[4]], kind, count, int(values["byteOffset"])).tolist()
            return values if isinstance(values, list) else []

        def ids(data):
            found, waiting = [], [0]
            if data[:4] != b"cmpt" and data[:4] not in headers:
                raise ValueError(f"not a tile archive: {data[:4]!r}")
            while waiting:
                at = waiting.pop()
                kind = data[at:at + 4]
                if kind == b"cmpt":
                    end, inner = checked(data, at, 16), [at + 16]
                    for _ in range(struct.unpack_from("<I", data, at + 12)[0]):
                        if inner[-1] + 12 > end:
                            raise ValueError("a composite ends inside a tile")
                        inner.append(inner[-1] + struct.unpack_from("<I", data, inner[-1] + 8)[0])
                    waiting += reversed(inner[:-1])
                elif kind in headers:
                    found += column(data, at)
            return [str(int(v)) if isinstance(v, float) and v.is_integer() else str(v).strip() for v in found]

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, i, v, None) for i, v in enumerate(ids(bytes(content)))]
                except (ValueError, struct.error) as problem:
                    rows.append((path, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "feature_index", "feature_id", "problem"]).astype({"feature_index": "Int64"})

    return files.mapInPandas(read, "path string, feature_index bigint, feature_id string, problem string")


def find_features(index: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First archive and position of every distinct wanted id, and ids that are in none."""
    ids = wanted.select(F.trim(F.col("feature_id")).alias("feature_id")).where("feature_id <> ''").distinct()
    hits = index.where("problem IS NULL").join(ids, "feature_id", "left_semi").groupBy("feature_id").agg(
        F.min(F.struct("path", "feature_index")).alias("at")).select("feature_id", "at.path", "at.feature_index")
    return hits, ids.join(hits.select("feature_id"), "feature_id", "left_anti")


def in_query_box(index: DataFrame, region: tuple[float, float, float, float], box: tuple[float, float, float, float]) -> DataFrame:
    """Archives whose quadtree cell (level, x, y in the path) meets a box; paths without one are kept."""
    part = lambda k: F.regexp_extract("path", r"/(\d+)/(\d+)/(\d+)\.[a-z0-9]+$", k).try_cast("bigint")
    level, x, y = part(1), part(2), part(3)
    n = F.pow(F.lit(2.0), level)
    w, s, e, t = region
    west, east = w + (e - w) * x / n, w + (e - w) * (x + 1) / n
    south, north = s + (t - s) * y / n, s + (t - s) * (y + 1) / n
    outside = (east < box[0]) | (west > box[2]) | (north < box[1]) | (south > box[3])
    return index.where(F.coalesce(~outside, F.lit(True)))


TILESET_SCHEMA = (
    "asset struct<version:string>, geometricError double, root struct<boundingVolume:struct<box:array<double>,region:array<double>,sphere:array<double>>,"
    "geometricError:double,transform:array<double>>")


def child_tilesets(spark: SparkSession, root: str) -> DataFrame:
    """Every ``tileset.json`` below a folder except the one in the folder itself, parsed."""
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "tileset.json").text(root)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", TILESET_SCHEMA).alias("t"))
    volume = F.col("t.root.boundingVolume")
    kind = F.when(volume["sphere"].isNotNull(), "sphere").when(volume["region"].isNotNull(), "region").when(volume["box"].isNotNull(), "box").otherwise("none")
    relative = F.regexp_replace("path", "^.*" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return rows.select(relative.alias("uri"), F.col("t.asset.version").alias("version"), F.coalesce("t.root.geometricError", "t.geometricError").alias("error"),
                       kind.alias("kind"), volume["box"].alias("box"), volume["region"].alias("region"), F.col("t.root.transform").alias("transform")).where("uri <> 'tileset.json'")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Count and bytes per file class of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FILE_CLASSES.items() for x in kv]), suffix), F.lit("other"))
    return files.groupBy(kind.alias("kind")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def expired(spark: SparkSession, root: str, age: str = "3 DAYS") -> DataFrame:
    """Files not modified within ``age``, for the caller to remove."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("modificationTime").alias("modified"))
    return files.where(F.col("modified") < F.current_timestamp() - F.expr(f"INTERVAL {age}"))

"""Table, report, CSV and document sinks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_text(ring: Column) -> Column:
    """Closed POLYGON Z text of a ring."""
    corner = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.format_string("%.8f %.8f %.3f", p["x"], p["y"], p["z"]))
    return F.concat(F.lit("POLYGON Z (("), F.array_join(corner, ", "), F.lit("))"))


def csv_table(df: DataFrame, geometry: str | None, schema_name: str) -> DataFrame:
    """Geometry as WKT in the first column; another column of that name gets the schema as prefix."""
    others = [F.col(c).alias(f"{schema_name}_{c}" if c == "WKT" else c) for c in df.columns if c != geometry]
    return df.select(*([ring_text(F.col(geometry)).alias("WKT")] if geometry else []), *others)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)


def output_names(tables: Sequence[tuple[str, str]]) -> dict[tuple[str, str], str]:
    """File name per (schema, table): the table name, with the schema in front where two schemas share it."""
    seen: dict[str, int] = {}
    for _, table in tables:
        seen[table] = seen.get(table, 0) + 1
    return {(s, t): f"{s}_{t}.csv" if seen[t] > 1 else f"{t}.csv" for s, t in tables}


def write_report(report: DataFrame, path: str) -> None:
    """A small aggregate as JSON lines."""
    report.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def export_documents(documents: DataFrame, root: str) -> DataFrame:
    """Write each (path, content) row as its own file below ``root`` from the tasks; returns (path, bytes)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            sizes = []
            for path, content in zip(batch["path"], batch["content"]):
                data = content.encode() if isinstance(content, str) else bytes(content)
                target = f"{base}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(data)
                sizes.append(len(data))
            yield pd.DataFrame({"path": batch["path"], "bytes": sizes})

    return documents.select("path", "content").mapInPandas(write, "path string, bytes bigint")

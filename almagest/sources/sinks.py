"""Writers: content-addressed files, tables with manifests, reports."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")  # characters that XML has no place for


def append_new(df: DataFrame, path: str, payload: str) -> None:
    """Append payloads that the folder lacks, under their sha256; the same bytes are kept once."""
    spark = df.sparkSession
    rows = df.select(F.sha2(F.col(payload).cast("binary"), 256).alias("sha256"), F.col(payload).cast("binary").alias("payload")).dropDuplicates(["sha256"])
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        rows = rows.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    rows.write.mode("append").parquet(path)


def replace_partition(df: DataFrame, path: str, version: str) -> None:
    """Overwrite only the versions that ``df`` brings."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(version).parquet(path)


def write_rows(df: DataFrame, path: str, label: str | None = None) -> dict:
    """CSV with a header, and a manifest of columns, rows, classes and warnings beside it."""
    df.write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    classes = {str(r[0]): r[1] for r in df.groupBy(label).count().collect()} if label else {}
    manifest = {"columns": df.columns, "rows": df.count(), "classes": classes, "warnings": [] if len(classes) != 1 else ["one class only"]}
    df.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_samples(df: DataFrame, path: str) -> None:
    """One JSON object a line, nested columns and all, keys in the order of the schema's sorted names."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def write_evidence(tables: dict[str, DataFrame], path: str, version: str) -> None:
    """Mentions, relations, facts and claims of processed versions, a folder a table; versions that come again replace their own rows in each, others stay."""
    for name, df in tables.items():
        replace_partition(df, f"{path}/{name}", version)


def write_audit(runs: DataFrame, path: str, key: str, order: str) -> None:
    """Search runs by id: the latest state of each is kept, in a new folder that the caller's next read names.

    ``path`` holds generations; the one with the greatest number is the table.
    """
    spark = runs.sparkSession
    found = generations(spark, path)
    rows = runs if not found else runs.unionByName(spark.read.parquet(f"{path}/{found[-1]:08d}"))
    rest = [c for c in rows.columns if c not in (key, order)]
    last = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("r")).select(key, "r.*")
    last.select(*runs.columns).write.parquet(f"{path}/{(found[-1] if found else 0) + 1:08d}")


def generations(spark, path: str) -> list[int]:
    """Numbers of the finished generations of a table, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(p.getName()) for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def xlsx(columns: list[str], rows) -> bytes:
    """One sheet as an Office Open XML workbook: a header, numbers as numbers, all else as text."""
    cell = lambda v: "<c/>" if v is None else f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(_XML.sub("", str(v)))}</t></is></c>'
    sheet = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [columns, *rows])
    types, office = "http://schemas.openxmlformats.org/package/2006", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main, kind = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    link = lambda i, name, target: f'<Relationships xmlns="{types}/relationships"><Relationship Id="{i}" Type="{office}/{name}" Target="{target}"/></Relationships>'
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{types}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": link("r1", "officeDocument", "xl/workbook.xml"),
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": link("r1", "worksheet", "worksheets/sheet1.xml"),
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def write_report(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One file of the format that the suffix names (csv, json or xlsx); for reports, which fit a task, and in a workbook ``most`` rows."""
    suffix = path.rsplit(".", 1)[-1]
    if suffix == "xlsx":
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} rows for a workbook")
        with fs.FileSystem.from_uri(path)[0].open_output_stream(fs.FileSystem.from_uri(path)[1]) if "://" in path else open(path, "wb") as out:
            out.write(xlsx(df.columns, rows))
        return
    if suffix not in ("csv", "json"):
        raise ValueError(f"unknown report format {suffix}")
    writer = df.coalesce(1).write.mode("overwrite")
    writer.option("header", True).csv(path) if suffix == "csv" else writer.json(path)

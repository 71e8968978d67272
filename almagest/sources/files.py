"""Local and remote files as documents: one row a file, read by Spark's binary source."""

from __future__ import annotations

import io
import itertools
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.operators.text import chunks, html_blocks

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(raw: bytes) -> list[tuple[str, str, str]]:
    """(part, headings above, text) of each paragraph; unreadable files give none."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    heads, out = [], []
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        level = re.fullmatch(r"[Hh]eading ?(\d)", style.get(f"{_W}val", "")) if style is not None else None
        if text:
            if level:
                heads = [h for h in heads if h[0] < int(level[1])]
            out.append(("word/document.xml", " > ".join(h for _, h in heads), text))
            if level:
                heads.append((int(level[1]), text))
    return out


def file_blocks(path: str, raw: bytes, most: int = 1200) -> list[tuple[str, str, str]]:
    """Blocks of a file by its suffix: html, docx, md and txt; others give none."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("html", "htm"):
        return html_blocks(raw.decode("utf-8", "replace"))
    if suffix == "docx":
        return docx_blocks(raw)
    if suffix in ("md", "txt"):
        text = raw.decode("utf-8", "replace")
        return [(f"{a}-{b}", h, text[a:b]) for a, b, h in chunks(text if suffix == "md" else re.sub(r"(?m)^#", " ", text), most)]
    return []


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, place, locator, headings, text, metadata) of all blocks; metadata is the JSON of a file's sidecar (name.meta.json)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    side = files.where(F.col("path").endswith(".meta.json")).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), F.decode("content", "UTF-8").alias("metadata"))

    def blocks(batches):
        for part in batches:
            rows = [(p, i, *b) for p, raw in zip(part.path, part.content) for i, b in enumerate(file_blocks(p, raw))]
            yield pd.DataFrame(rows, columns=["path", "place", "locator", "headings", "text"])

    found = files.where(~F.col("path").endswith(".meta.json")).select("path", "content").mapInPandas(blocks, "path string, place long, locator string, headings string, text string")
    return found.join(side, "path", "left")


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines: of ``path`` itself, or if it is a zip file, of every .jsonl in it, line by line."""
    if not path.endswith(".zip"):
        return spark.read.schema(schema).json(path)

    def lines(batches):
        for part in batches:
            for raw in part.content:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(n for n in z.namelist() if n.endswith(".jsonl")):
                        with z.open(name) as f:
                            while rows := [x.decode("utf-8", "replace") for x in itertools.islice(f, 1000)]:
                                yield pd.DataFrame({"line": rows})

    text = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "line string")
    return text.select(F.from_json("line", schema).alias("r")).where("r is not null").select("r.*")


def manifest(spark: SparkSession, folder: str) -> str:
    """sha256 and size of every file of a run, as JSON with sorted keys."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = files.select(F.regexp_replace("path", "^.*/", "").alias("name"), F.sha2("content", 256).alias("sha256"), "length").collect()
    return json.dumps({r.name: {"sha256": r.sha256, "bytes": r.length} for r in rows}, sort_keys=True)

"""Documents out of raw text: HTML blocks, chunks, sentences, inverted abstracts."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLOCKS = {"p", "li", "td", "th", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "title", "div", "article", "section"}
_SKIPPED = {"script", "style", "nav", "footer", "aside", "noscript", "template"}


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path, self.skip, self.headings, self.text, self.out = [], 0, [], [], []

    def _flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append(("/".join(self.path), " > ".join(h for _, h in self.headings), text))

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self._flush()
        if tag in _SKIPPED:
            self.skip += 1
        if tag not in ("br", "img", "meta", "link", "input", "hr"):
            self.path.append(tag)
        elif tag == "br":
            self.text.append("\n")

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            if re.fullmatch("h[1-6]", tag):
                name = " ".join("".join(self.text).split())
                self.headings = [h for h in self.headings if h[0] < int(tag[1])]
                self._flush()
                if name:
                    self.headings.append((int(tag[1]), name))
            else:
                self._flush()
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in self.path:
            while self.path.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def html_blocks(text: str | None) -> list[tuple[str, str, str]]:
    """(tag path, headings above, text) of each block in order; scripts, styles and page furniture are left out."""
    parser = _Blocks()
    parser.feed(text or "")
    parser.close()
    parser._flush()
    return parser.out


def chunks(text: str | None, most: int, overlap: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, heading) of pieces of up to ``most`` characters that end at a line or word where one lies past the middle.

    Lines that begin with # are headings: they close a piece and name the next.
    """
    text = text or ""
    heads = [(0, "")] + [(m.start(), m.group(1).strip()) for m in re.finditer(r"(?m)^#{1,6}[ \t]+(.+)$", text)]
    out = []
    for (at, name), end in zip(heads, [h[0] for h in heads[1:]] + [len(text)]):
        start = at
        while start < end:
            stop = min(end, start + most)
            if stop < end:
                for mark in ("\n", " "):
                    cut = text.rfind(mark, start + most // 2, stop)
                    if cut > 0:
                        stop = cut + 1
                        break
            if text[start:stop].strip():
                out.append((start, stop, name))
            if stop >= end:
                break
            start = max(stop - overlap, start + 1)
    return out


_ABBREVIATIONS = ("e.g.", "i.e.", "etc.", "vs.", "Dr.", "Mr.", "Fig.", "al.")


def sentences(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of sentences; decimals and common abbreviations don't end one."""
    text, out, start = text or "", [], 0
    for m in re.finditer(r"[.!?]+(?=\s|$)|\n{2,}", text):
        if m.group().startswith(".") and text[: m.end()].endswith(_ABBREVIATIONS):
            continue
        if text[start : m.end()].strip():
            out.append((start, m.end()))
        start = m.end()
    if text[start:].strip():
        out.append((start, len(text)))
    return [(a + len(text[a:b]) - len(text[a:b].lstrip()), b) for a, b in out]


def _explode(df: DataFrame, key: str, column: str, names: str, rows) -> DataFrame:
    fields = [n.split()[0] for n in names.split(", ")]

    def run(batches):
        for part in batches:
            out = [(k, i, *r) for k, t in zip(part["key"], part["text"]) for i, r in enumerate(rows(t))]
            yield pd.DataFrame(out, columns=["key", "place", *fields])

    return df.select(F.col(key).cast("long").alias("key"), F.col(column).alias("text")).mapInPandas(run, f"key long, place long, {names}").withColumnRenamed("key", key)


def explode_html(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    return _explode(pages, key, column, "path string, headings string, text string", html_blocks)


def explode_chunks(docs: DataFrame, key: str = "doc_id", column: str = "text", most: int = 1200, overlap: int = 0) -> DataFrame:
    def rows(t):
        return [(a, b, h, t[a:b]) for a, b, h in chunks(t, most, overlap)]

    return _explode(docs, key, column, "start long, end long, heading string, chunk string", rows)


def explode_sentences(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    def rows(t):
        return [(a, b, t[a:b]) for a, b in sentences(t)]

    return _explode(docs, key, column, "start long, end long, sentence string", rows)


def abstract_from_index(index):
    """Column: a map of word -> places as text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s.w), " ")


@F.pandas_udf(T.StringType())
def unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else html.unescape(v))

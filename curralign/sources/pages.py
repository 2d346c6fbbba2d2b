"""Paged documents: texts and tables of pages, read by a given reader, and answers of services with a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files(spark, path: str, pattern: str = "*") -> DataFrame:
    """``path, content`` of the files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def page_texts(documents: DataFrame, read: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, page, text, error`` of documents (``path, content``): ``read`` gives the texts of a file's pages, numbered from 1.

    A reader is any function of bytes, so a library for one format is named by the caller only. A file that cannot be read, or has no content, gives one row
    with page 0 and the error; a file without pages gives none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple[str, int, str | None, str | None]] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    if content is None:
                        raise ValueError("no content")
                    out += [(path, i, text, None) for i, text in enumerate(read(bytes(content)), 1)]
                except Exception as e:
                    out.append((path, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "page", "text", "error"])

    return documents.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def page_tables(documents: DataFrame, read: Callable[[bytes], list[list[list[str | None]]]], header: Callable[[list[str | None]], bool], columns: list[str]) -> DataFrame:
    """``path, page, at``, ``columns``: the rows of the tables of documents, under the header that was carried down to them.

    ``read`` gives a file's pages as rows of cells; ``header`` tells header rows, whose cells name the columns from there on,
    over the ends of pages. An empty cell takes the value above it in the same column, as merged cells have it. Rows before the first header have no names and are left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                names: list[str] | None = None
                above: dict[str, str] = {}
                at = 0
                for page, rows in enumerate(read(bytes(content)) if content is not None else [], 1):
                    for cells in rows:
                        if header(cells):
                            names, above = [(c or "").strip().lower() for c in cells], {}
                            continue
                        if names is None:
                            continue
                        found = {n: c.strip() for n, c in zip(names, cells, strict=False) if c and c.strip()}
                        above = above | found
                        at += 1
                        out.append((path, page, at, *(above.get(c) for c in columns)))
            yield pd.DataFrame(out, columns=["path", "page", "at", *columns])

    return documents.select("path", "content").mapInPandas(run, "path string, page int, at int, " + ", ".join(f"`{c}` string" for c in columns))


def fetched(keys: DataFrame, call: Callable[[str], str], cache: str, tries: int = 3) -> DataFrame:
    """``key, body, error`` of a service for ``keys`` (``key``): what the cache has is not asked for again, and what is new is added to it.

    ``call`` gets a key and returns the body; it is tried up to ``tries`` times. Failures are not cached. Each key is asked once, null keys not at all.
    """
    spark = keys.sparkSession
    schema = "key string, body string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key in frame["key"]:
                body, error = None, None
                for _ in range(tries):
                    try:
                        body, error = call(key), None
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((key, body, error))
            yield pd.DataFrame(out, columns=["key", "body", "error"])

    wanted = keys.where("key is not null").select(F.col("key").cast("string").alias("key")).distinct()
    try:
        have = spark.read.schema(schema).json(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        have = spark.createDataFrame([], schema)
    wanted.join(have.where("error is null").select("key"), "key", "left_anti").mapInPandas(run, schema).write.mode("append").json(cache)
    answers = spark.read.schema(schema).json(cache)
    return answers.join(wanted, "key", "left_semi").groupBy("key").agg(F.max("body").alias("body"), F.when(F.max("body").isNull(), F.max("error")).alias("error"))

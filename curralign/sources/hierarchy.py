"""Trees of curriculum nodes, page texts, model answers and JSON inputs as frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import top_per_group

#: A node of a source tree.
NODE = "struct<id:string,statementNotation:string,description:string,depth:int,parentId:string,ancestorIds:array<string>,listId:string,position:int>"


def node_set(col: Column) -> Column:
    """The nodes of a set whose ``standards`` are an object by id or an array."""
    as_map = F.from_json(F.get_json_object(col, "$.data.standards"), f"map<string,{NODE}>")
    as_list = F.from_json(F.get_json_object(col, "$.data.standards"), f"array<{NODE}>")
    is_list = F.substring(F.ltrim(F.get_json_object(col, "$.data.standards")), 1, 1) == "["
    return F.when(is_list, as_list).otherwise(F.map_values(as_map))


def paged_items(pages: DataFrame, key: str, page_col: str, json_col: str, item: str) -> DataFrame:
    """``key, page, at, item``: the items of landed pages of an offset-paged service, in order."""
    items = F.from_json(F.get_json_object(json_col, "$.items"), f"array<{item}>")
    return pages.select(key, F.col(page_col).alias("page"), F.posexplode(items).alias("at", "item"))


def leaf_depth(nodes: DataFrame, set_col: str) -> DataFrame:
    """``set_col, leaf``: the most frequent depth of nodes with a notation; ties go to the depth seen first."""
    coded = nodes.where("trim(notation) <> ''").groupBy(set_col, "depth").agg(F.count("*").alias("n"), F.min("position").alias("seen"))
    best = coded.groupBy(set_col).agg(F.max(F.struct(F.col("n"), -F.col("seen"), "depth")).alias("m"))
    return best.select(set_col, F.col("m.depth").alias("leaf"))


def flatten_tree(nodes: DataFrame, set_col: str = "set_id") -> DataFrame:
    """``set_col, id, notation, description, domain, cluster``: leaf nodes with the first and the last of their ancestors by depth.

    ``nodes``: ``set_col, id, notation, description, depth, parent, ancestors, position``. A leaf has a notation, the set's leaf depth and no
    coded child; of equal notations the first by position stays.
    """
    leaf = leaf_depth(nodes, set_col)
    coded = nodes.where("trim(notation) <> ''")
    inner = coded.where("parent is not null").select(set_col, F.col("parent").alias("id")).distinct()
    leaves = coded.join(leaf, set_col).where(F.col("depth") == F.col("leaf")).join(inner, [set_col, "id"], "left_anti")
    first = top_per_group(leaves, [set_col, "notation"], [F.col("position"), F.col("id")], 1)
    up = first.select(set_col, "id", F.explode_outer("ancestors").alias("anc"))
    names = nodes.select(set_col, F.col("id").alias("anc"), F.col("description").alias("name"), F.col("depth").alias("d"))
    above = up.join(names, [set_col, "anc"]).groupBy(set_col, "id").agg(F.min_by("name", F.struct("d", "anc")).alias("domain"), F.max_by("name", F.struct("d", "anc")).alias("cluster"), F.count("*").alias("n"))
    return first.join(above, [set_col, "id"], "left").select(set_col, "id", "notation", "description", F.coalesce("domain", F.lit("")).alias("domain"), F.when(F.col("n") > 1, F.col("cluster")).alias("cluster"))


def fixed_roles(nodes: DataFrame, set_col: str = "set_id") -> tuple[DataFrame, DataFrame]:
    """(standards, sub_standards) of a tree whose depth 0 is the domain, 1 the cluster, 2 the standard and 3 its parts."""
    def level(d: int) -> DataFrame:
        return nodes.where(F.col("depth") == d).select(set_col, F.col("id").alias(f"id{d}"), F.col("description").alias(f"text{d}"), F.col("parent").alias(f"id{d - 1}" if d else "above"))

    std = nodes.where("depth = 2").withColumn("id1", F.col("parent")).join(level(1), [set_col, "id1"], "left").join(level(0), [set_col, "id0"], "left")
    standards = std.select(set_col, "id", "notation", "description", F.coalesce("text0", F.lit("")).alias("domain"), F.col("text1").alias("cluster"))
    w = Window.partitionBy(set_col, "parent").orderBy("position", "id")
    subs = nodes.where("depth = 3").select(set_col, "id", F.col("parent").alias("parent_id"), F.col("description").alias("text"), F.row_number().over(w).alias("position"))
    return standards, subs.join(standards.select(set_col, F.col("id").alias("parent_id")), [set_col, "parent_id"], "left_semi")


def coded_rows(nodes: DataFrame, pattern: str, domains: list[tuple[str, str]], default: str) -> DataFrame:
    """Nodes whose notation matches a code pattern, with the domain of the first code that begins one of its parts."""
    domain = None
    for code, name in domains:
        test = F.col("notation").rlike(rf"(?:^|-){code}")
        domain = F.when(test, name) if domain is None else domain.when(test, name)
    return nodes.where(F.col("notation").rlike(pattern)).withColumn("domain", F.lit(default) if domain is None else domain.otherwise(default))


def dominant_document(sets: DataFrame, least: int = 5) -> DataFrame:
    """Of each jurisdiction the sets of the document with most sets, if it has ``least``; else all sets. Of these the newest for each grade, and all for HS.

    ``sets``: ``jurisdiction, document, set_id, grade, year``. Documents with as many sets are decided by name.
    """
    counts = sets.groupBy("jurisdiction", "document").agg(F.count("*").alias("n"))
    top = top_per_group(counts, ["jurisdiction"], [F.col("n").desc(), F.col("document")], 1).where(F.col("n") >= least).select("jurisdiction", F.col("document").alias("top"))
    kept = sets.join(top, "jurisdiction", "left").where(F.col("top").isNull() | (F.col("document") == F.col("top"))).drop("top")
    newest = top_per_group(kept.where("grade <> 'HS'"), ["jurisdiction", "grade"], [F.col("year").desc_nulls_last(), F.col("set_id")], 1)
    return newest.unionByName(kept.where("grade = 'HS'"))


def last_header(col: Column, pattern: str) -> Column:
    """The last header on a page that matches, null for none."""
    return F.try_element_at(F.regexp_extract_all(col, F.lit(pattern), 0), F.lit(-1))


def extracted_rows(texts: DataFrame, call: Callable[[list[str]], list[str]], schema: str, batch: int = 20) -> DataFrame:
    """Rows that a model finds in texts: ``id`` and one row for each element of the JSON array in its answer.

    ``call`` takes a list of texts and returns as many answers; it is the only place where a service is called, in batches
    of ``batch``. Answers without a JSON array give no rows.
    """
    from ..functions.text import json_body

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({"id": part["id"].to_numpy(), "answer": call([t or "" for t in part["text"]])})

    answers = texts.select(F.col("id").cast("string"), "text").mapInPandas(run, "id string, answer string")
    return answers.select("id", F.posexplode(F.from_json(json_body(F.col("answer")), f"array<struct<{schema}>>")).alias("at", "row")).select("id", "at", "row.*")


def embedded(texts: DataFrame, call: Callable[[list[str]], list[list[float]]], batch: int = 20, tries: int = 3) -> DataFrame:
    """``id, vec``: vectors of a model for texts, in batches, each tried up to ``tries`` times with a growing pause."""
    import time

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                for n in range(1, tries + 1):
                    try:
                        vectors = call([t or "" for t in part["text"]])
                        break
                    except Exception:
                        if n == tries:
                            raise
                        time.sleep(n)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vec": [[float(x) for x in v] for v in vectors]})

    return texts.select(F.col("id").cast("string"), "text").mapInPandas(run, "id string, vec array<float>")


def hashed_ngrams(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for an embedding model in tests: counts of hashed letter trigrams. It knows nothing of meaning."""
    import zlib

    def call(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for i in range(max(1, len(t) - 2)):
                v[zlib.crc32(t[i : i + 3].lower().encode()) % dim] += 1.0
            out.append(v)
        return out

    return call


def last_labels(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``key, label, reason`` of JSON lines in one or several places, the later ones last; the last line of a key counts, other lines and unknown labels do not."""
    rows = None
    for turn, path in enumerate([paths] if isinstance(paths, str) else paths):
        one = spark.read.schema("key string, label string, reason string").json(path).select("*", F.lit(turn).alias("turn"), F.monotonically_increasing_id().alias("at"))
        rows = one if rows is None else rows.unionByName(one)
    return top_per_group(rows.where("key is not null"), ["key"], [F.col("turn").desc(), F.col("at").desc()], 1).drop("turn").where(F.col("label").isin("HARD", "SOFT", "NONE")).drop("at")


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents, one row each (or for each element of a top-level array)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def decoded_vectors(df: DataFrame, blob: str, dim: int) -> DataFrame:
    """``df`` with ``vec``: little-endian 32-bit floats of a binary column; null where the length does not fit. One buffer is read for each batch."""
    import numpy as np
    import pyarrow as pa

    kept = [c for c in df.columns if c != "vec"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(blob).to_pylist()
            good = [b is not None and len(b) == 4 * dim for b in blobs]
            flat = np.frombuffer(b"".join(b for b, g in zip(blobs, good, strict=True) if g), dtype="<f4")
            ends = np.concatenate([[0], np.cumsum(good)]).astype(np.int32) * dim
            vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array([not g for g in good]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), vec], names=[*kept, "vec"])

    schema = df.select(*kept).schema.add("vec", T.ArrayType(T.FloatType()))
    return df.select(*kept).mapInArrow(read, schema)


def encoded_vectors(df: DataFrame, vec: str, blob: str) -> DataFrame:
    """``df`` with ``blob``: the vector column as little-endian 32-bit floats; null for null."""
    import numpy as np
    import pyarrow as pa

    kept = [c for c in df.columns if c != blob]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if v is None else np.asarray(v, dtype="<f4").tobytes() for v in batch.column(vec).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.binary())], names=[*kept, blob])

    schema = df.select(*kept).schema.add(blob, T.BinaryType())
    return df.select(*kept).mapInArrow(write, schema)

"""Sources and sinks: index documents, keyed lookups, image archives, label lists, result documents."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankwell.operators.order import numbered

IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tiff")
ARCHIVE_SUFFIXES = (".jpeg", ".jpg", ".png")


def elements(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """A Parquet table without the excluded columns."""
    return spark.read.parquet(path).drop(*(exclude or []))


def text_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text."""
    return spark.read.csv(path, header=True, inferSchema=False)


def useful(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns that exist, in the given order, each once."""
    return df.select(*dict.fromkeys(c for c in columns if c in df.columns))


def has_suffix(name: Column, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> Column:
    """Whether a file name ends in one of the suffixes, in any case."""
    return F.lower(name).rlike("(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$")


def images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """Rows (element_id, content) of a folder's image files; the id is the file's name."""
    d = spark.read.format("binaryFile").load(path)
    return d.filter(has_suffix(F.col("path"), suffixes)).select(F.substring_index("path", "/", -1).alias("element_id"), "content")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row at a time: the files of the tar archives within each tar archive."""
    for b in batches:
        for content in b.column("content"):
            with tarfile.open(fileobj=io.BytesIO(content.as_py())) as outer:
                for inner in outer:
                    if not (inner.isfile() and inner.name.lower().endswith(".tar")):
                        continue
                    name = inner.name.rsplit("/", 1)[-1][: -len(".tar")]
                    with tarfile.open(fileobj=outer.extractfile(inner)) as files:
                        for f in files:
                            if f.isfile() and f.name.lower().endswith(ARCHIVE_SUFFIXES):
                                data = files.extractfile(f).read()
                                yield pa.RecordBatch.from_pydict({"class_name": [name], "name": [f.name.rsplit("/", 1)[-1]], "content": [data]}, _MEMBER)


_MEMBER = pa.schema([("class_name", pa.string()), ("name", pa.string()), ("content", pa.binary())])


def nested_archive(spark: SparkSession, path: str) -> DataFrame:
    """Rows (class_name, name, content) of the image files in the archives within the archives at `path`."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_members, "class_name string, name string, content binary")


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows (name, idx): from a JSON object of numbers, or from a text file whose lines are numbered from 0.

    A label list names classes, so it is small; the file is read as one row.
    """
    whole = spark.read.text(path, wholetext=True)
    if path.lower().endswith(".json"):
        pairs = whole.select(F.explode(F.from_json("value", "map<string,int>")).alias("name", "idx"))
        return pairs.select("name", F.col("idx").cast("long").alias("idx"))
    lines = F.filter(F.transform(F.split("value", "\r?\n"), F.trim), lambda x: x != "")
    return whole.select(F.posexplode(lines).alias("idx", "name")).select("name", F.col("idx").cast("long").alias("idx"))


def number_or_zero(text: Column) -> Column:
    """A number as text, 0.0 if it is none."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))


def json_number_or_zero(doc: Column, field: str) -> Column:
    """A number in a JSON document, 0.0 if it is absent or none."""
    return F.coalesce(F.get_json_object(doc, f"$.{field}").try_cast("double"), F.lit(0.0))


def last_wins(results: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with an equal key the one of the largest order."""
    rest = [c for c in results.columns if c not in (key, order)]
    best = results.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("m"))
    return best.select(key, *(F.col(f"m.{c}").alias(c) for c in rest))


def dense_index(df: DataFrame, column: str) -> DataFrame:
    """Rows (name, idx): the distinct values in order, numbered from 0. The values name classes, so they are few."""
    names = df.select(F.col(column).alias("name")).filter("name is not null").distinct()
    return names.select("name", (F.row_number().over(W.orderBy("name")) - 1).cast("long").alias("idx"))


def index_document(root: dict) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """The node and member rows of a nested index document, whose inner nodes have children and whose leaves have ids.

    Third, the leaves (leaf_id, children) that refer to a table or a CSV file instead; their size is 0 here.
    """
    nodes, members, far, todo = [], [], [], [(root, None, 0, [])]
    while todo:
        node, parent, ordinal, path = todo.pop()
        own, children = len(nodes), node["children"]
        refers = isinstance(children, str | dict)
        inner = not refers and bool(children) and isinstance(children[0], dict)
        nodes.append((own, parent, ordinal, len(path), path, not inner, 0 if inner or refers else len(children), node.get("centroid")))
        if refers:
            far.append((own, children))
        elif inner:
            todo += [(c, own, i, [*path, i]) for i, c in reversed(list(enumerate(children)))]
        else:
            members += [(own, str(x), i) for i, x in enumerate(children)]
    return nodes, members, far


NODES = "node_id int, parent_id int, ordinal int, depth int, path array<int>, is_leaf boolean, size bigint, centroid array<double>"
MEMBERS = "leaf_id int, element_id string, ord bigint"


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and members of an index document. A leaf may instead name a CSV file, whose first column is read as ids.

    Such a document is one JSON value, so it is read on the driver; leaves of many ids refer to a table or a CSV file.
    """
    root = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return import_index(spark, root)


def import_index(spark: SparkSession, root: dict) -> tuple[DataFrame, DataFrame]:
    """Nodes and members of an index document. Ids that leaves refer to stay in Spark, where their sizes are counted."""
    nodes, members, far = index_document(root)
    own, held = spark.createDataFrame(nodes, NODES), spark.createDataFrame(members, MEMBERS)
    if not far:
        return own, held
    tables, found = {}, []
    for leaf, ref in far:
        if isinstance(ref, dict):
            tables.setdefault(ref["table"], []).append((leaf, ref["leaf_id"]))
            continue
        first = spark.read.csv(ref, header=True, inferSchema=False)
        ids = first.select(F.col(f"`{first.columns[0]}`").alias("element_id"), F.monotonically_increasing_id().alias("at"))
        found.append(numbered(ids, [F.asc("at")]).select(F.lit(leaf).alias("leaf_id"), "element_id", (F.col("rn") - 1).alias("ord")))
    for path, leaves in tables.items():
        names = spark.createDataFrame(leaves, "own int, leaf_id int")
        found.append(spark.read.parquet(path).join(names, "leaf_id").select(F.col("own").alias("leaf_id"), "element_id", "ord"))
    there = reduce(DataFrame.unionByName, found)
    sizes = there.groupBy(F.col("leaf_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))
    counted = own.join(sizes, "node_id", "left").withColumn("size", F.coalesce("n", "size")).select(own.columns)
    return counted, held.unionByName(there)


def export_index(nodes: DataFrame, members: DataFrame, path: str | None = None) -> dict:
    """The nested document of an index: with a path, Spark writes the members there and each leaf refers to them.

    Without one, all ids are in the document, so the index has to be small enough for one JSON value.
    """
    rows = {r["node_id"]: r for r in nodes.collect()}
    if path:
        members.write.parquet(path)
        held = lambda i: {"table": path, "leaf_id": i}
    else:
        own = {r["leaf_id"]: r["ids"] for r in members.groupBy("leaf_id").agg(F.array_sort(F.collect_list(F.struct("ord", "element_id"))).alias("ids")).collect()}
        held = lambda i: [x["element_id"] for x in own.get(i, [])]
    out = {i: {"children": held(i) if r["is_leaf"] else []} | ({"centroid": r["centroid"]} if r["centroid"] else {}) for i, r in rows.items()}
    for i, r in sorted(rows.items(), key=lambda x: x[1]["ordinal"]):
        if r["parent_id"] is not None:
            out[r["parent_id"]]["children"].append(out[i])
    return next(out[i] for i, r in rows.items() if r["parent_id"] is None)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

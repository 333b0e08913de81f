"""RDF/XML as a batch data source: spark.read.format('rdfxml').load(path) gives triples.

Files are read one per task with a streaming parser that forgets what it has emitted, so a task's memory
doesn't grow with the file. Blank nodes are named per file.
"""

from __future__ import annotations

import glob
import os
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML = "{http://www.w3.org/XML/1998/namespace}"
SCHEMA = StructType([StructField(c, StringType()) for c in ("s", "p", "o", "o_kind", "lang", "datatype", "file")])


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


def parse(path: str) -> Iterator[tuple]:
    """(s, p, o, o_kind, lang, datatype) of one RDF/XML file."""
    base, blanks = "", 0

    def resolve(ref: str) -> str:
        return base + ref if ref.startswith("#") or not ref else ref

    def subject(e: ET.Element) -> str:
        nonlocal blanks
        for attr, make in (("about", resolve), ("ID", lambda x: f"{base}#{x}"), ("nodeID", lambda x: f"_:{x}")):
            if (v := e.get(RDF + attr)) is not None:
                return make(v)
        blanks += 1
        return f"_:{os.path.basename(path)}-{blanks}"

    def node(e: ET.Element) -> tuple[str, list[tuple]]:
        s = subject(e)
        out = []
        if e.tag != RDF + "Description":
            out.append((s, _name(RDF + "type"), _name(e.tag), "uri", None, None))
        for p in e:
            name = _name(p.tag)
            if (r := p.get(RDF + "resource")) is not None:
                out.append((s, name, resolve(r), "uri", None, None))
            elif (r := p.get(RDF + "nodeID")) is not None:
                out.append((s, name, f"_:{r}", "other", None, None))
            elif len(p):
                for child in p:
                    o, more = node(child)
                    out.append((s, name, o, "other" if o.startswith("_:") else "uri", None, None))
                    out += more
            else:
                out.append((s, name, p.text or "", "literal", p.get(XML + "lang"), p.get(RDF + "datatype")))
        return s, out

    depth = 0
    for event, e in ET.iterparse(path, events=("start", "end")):
        if event == "start":
            depth += 1
            if depth == 1:
                base = e.get(XML + "base", "")
        else:
            depth -= 1
            if depth == 1:
                yield from node(e)[1]
                e.clear()


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        for row in parse(partition.path):
            yield (*row, partition.path)


class RdfXml(DataSource):
    """One row per triple. `path` is a file, a folder or a pattern on a file system every executor sees."""

    @classmethod
    def name(cls) -> str:
        return "rdfxml"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"].removeprefix("file://")
        paths = sorted(glob.glob(os.path.join(path, "*.owl"))) if os.path.isdir(path) else sorted(glob.glob(path))
        return _Reader(paths)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(RdfXml)
    return spark.read.format("rdfxml").load(path)


def ontology_files(folder: str, pair: str) -> tuple[str, str]:
    """(source, target) of the two ontology files of a folder; the source is the one named after the pair's first part."""
    files = sorted(glob.glob(os.path.join(folder, "*.owl")))
    if len(files) != 2:
        raise ValueError(f"{len(files)} ontologies in {folder}, expected 2")
    first = pair.lower().split("-")[0]
    src = next((f for f in files if first in os.path.basename(f).lower()), files[0])
    return src, next(f for f in files if f != src)


def read_ontology_pair(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Triples of both files, told apart by `side`."""
    a, b = read_triples(spark, source).withColumn("side", F.lit("src")), read_triples(spark, target).withColumn("side", F.lit("tgt"))
    return a.unionByName(b)

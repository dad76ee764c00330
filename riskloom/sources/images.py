"""Package databases inside saved container images: archives of layers, read as streams."""

from __future__ import annotations

import tarfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import packages as P
from ..shipping import ship
from .stores import opened

#: The files of an image that say what is installed, and which system it is.
DPKG, APK, OS_RELEASE, ALPINE = "var/lib/dpkg/status", "lib/apk/db/installed", "etc/os-release", "etc/alpine-release"
WANTED = (DPKG, APK, OS_RELEASE, ALPINE)
#: Bytes that are read at a time.
STEP = 1 << 20


class _Unpacked:
    """A stream of a member's bytes, unpacked if they are gzip data; holds one step at a time."""

    def __init__(self, source):
        self.source, self.held = source, b""
        first = source.read(STEP)
        self.unpack = zlib.decompressobj(wbits=31) if first[:2] == b"\x1f\x8b" else None
        self._take(first)

    def _take(self, data: bytes) -> None:
        self.held += self.unpack.decompress(data, STEP) if self.unpack else data

    def read(self, size: int) -> bytes:
        while len(self.held) < size:
            if self.unpack and self.unpack.unconsumed_tail:
                self._take(self.unpack.unconsumed_tail)
                continue
            if self.unpack and self.unpack.eof and self.unpack.unused_data:
                rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(wbits=31)
                if rest[:2] != b"\x1f\x8b":
                    self.unpack, self.source = None, _Empty()
                    break
                self._take(rest)
                continue
            data = self.source.read(STEP)
            if not data:
                break
            self._take(data)
        out, self.held = self.held[:size], self.held[size:]
        return out


class _Empty:
    def read(self, size: int = -1) -> bytes:
        return b""


def _members(stream, every: bool = False):
    """Regular files of an archive in their order, with every all its entries; what is no archive, or breaks off, ends there."""
    try:
        with tarfile.open(fileobj=stream, mode="r|") as archive:
            for member in archive:
                if member.isreg() or every:
                    yield member.name, archive.extractfile(member) if member.isreg() else _Empty()
                archive.members = []  # else all headers stay in memory
    except (tarfile.TarError, zlib.error, EOFError):
        return


def databases(stream):
    """(layer, place, path, content) of the wanted files of a saved image: layers are its files that are archives themselves, packed or not.

    A wanted name that is no regular file counts as an empty file. What follows a broken place of a layer isn't seen, other layers are.
    """
    for layer, (_, inner) in enumerate(_members(stream)):
        try:
            for place, (name, file) in enumerate(_members(_Unpacked(inner), every=True)):
                path = name.lstrip("./")
                if path in WANTED:
                    yield layer, place, path, file.read().decode("utf-8", "replace")
        except (zlib.error, EOFError):
            continue


@dataclass
class _Image(InputPartition):
    uri: str


class _Reader(DataSourceReader):
    def __init__(self, uris: list[str]):
        self.uris = uris

    def partitions(self):
        return [_Image(u) for u in self.uris]

    def read(self, partition: _Image):
        system, path = opened(partition.uri)
        with system.open_input_stream(path) as stream:
            for row in databases(stream):
                yield (partition.uri, *row)


class SavedImages(DataSource):
    """Format saved_images: option paths, URIs of saved images parted by line feeds; a partition an image."""

    @classmethod
    def name(cls) -> str:
        return "saved_images"

    def schema(self) -> str:
        return "image string, layer int, place int, path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([u for u in self.options.get("paths", "").split("\n") if u])


def image_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """(image, layer, place, path, content): the wanted files of all layers of saved images, named one by one."""
    ship(spark)
    spark.dataSource.register(SavedImages)
    return spark.read.format("saved_images").option("paths", "\n".join(uris)).load()


def image_files_of(images: DataFrame) -> DataFrame:
    """The same of a table of images(image): the URIs stay in the table, and its partitions are the tasks."""
    ship(images.sparkSession)

    def run(batches):
        for batch in batches:
            for uri in batch.column("image").to_pylist():
                system, path = opened(uri)
                with system.open_input_stream(path) as stream:
                    for layer, place, name, content in databases(stream):
                        yield pa.RecordBatch.from_pydict({"image": [uri], "layer": pa.array([layer], pa.int32()), "place": pa.array([place], pa.int32()), "path": [name], "content": [content]})

    return images.select("image").where("image is not null").mapInArrow(run, "image string, layer int, place int, path string, content string")


def installed(files: DataFrame) -> DataFrame:
    """(image, name, version, ecosystem) of image_files(): the last layer's file counts for each path, the later one of a layer.

    A dpkg database goes before an apk one. Debian and Ubuntu take their version from os-release, Alpine from alpine-release;
    without that an apk package's ecosystem is Alpine. Names that hide files of lower layers have no effect on databases.
    """
    last = files.groupBy("image", "path").agg(F.max_by("content", F.struct("layer", "place")).alias("content"))
    one = lambda path: F.max(F.when(F.col("path") == path, F.col("content")))
    rows = last.groupBy("image").agg(one(DPKG).alias("dpkg"), one(APK).alias("apk"), one(OS_RELEASE).alias("os"), one(ALPINE).alias("alpine"))
    minor = F.regexp_extract(F.trim("alpine"), r"^([^.]*\.[^.]*)", 1)
    dpkg = rows.where("coalesce(dpkg, '') <> ''").select("image", F.col("dpkg").alias("content"), P.ecosystem(F.coalesce("os", F.lit(""))).alias("ecosystem"))
    apk = rows.where("coalesce(dpkg, '') = '' and coalesce(apk, '') <> ''").select("image", F.col("apk").alias("content"), F.when(F.coalesce(minor, F.lit("")) == "", "Alpine").otherwise(F.concat(F.lit("Alpine:v"), minor)).alias("ecosystem"))
    return P.dpkg_packages(dpkg, "image", "ecosystem").unionByName(P.apk_packages(apk, "image", "ecosystem")).select("image", "name", "version", "ecosystem")

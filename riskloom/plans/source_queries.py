"""Registered queries over files that Spark writes from the driver's tables and reads again: source trees and saved images."""

from __future__ import annotations

import io
import tarfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import checkpointed, shared_folder
from ..shipping import ship
from ..sources import images, trees
from ..sources.derived import CODE_LINES_SQL, code_lines
from ..sources.stores import opened
from .queries import query, table

IGNORE_FILE, IGNORED = ".scanignore", "# written with the tree\n\n*.tf\nsrc/main_4.go\ngenerated/\n"


def _written(rows: DataFrame, root: str) -> DataFrame:
    """(path) of rows(path, content binary), each written below root by its task."""
    ship(rows.sparkSession)

    def run(batches):
        system, top = opened(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                full = f"{top}/{path}"
                system.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(full) as out:
                    out.write(content)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path")})

    return checkpointed(rows.select("path", "content").mapInArrow(run, "path string"))


#: Files of every 11th kind stand in a folder that is skipped, a generated one, or a hidden one; every 13th has a zero byte.
_PLACE = "case when file % 11 = 5 then 'node_modules/' when file % 11 = 6 then 'generated/' when file % 11 = 7 then '.hidden/' else '' end"


@query(f"""with {CODE_LINES_SQL}, f as (select regexp_extract(path, '([0-9]+)[^0-9]*$', 1)::bigint as file, path, string_agg(line, chr(10) order by line_no) as content, count(*) as n_lines from code_lines group by path),
p as (select {_PLACE} || path as path, content, n_lines, file from f where file % 13 <> 4)
select path, n_lines, sha256(content) as digest from p where not starts_with(path, 'node_modules/') and not starts_with(path, 'generated/') and not ends_with(path, '.tf') and path <> 'src/main_4.go'""")
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source lines as a tree of files, walked and read back with the tree's own ignore file."""
    root = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    rows = code_lines(spark, sf_dir).groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("lines"))
    rows = rows.withColumn("file", F.regexp_extract("path", r"([0-9]+)[^0-9]*$", 1).cast("long"))
    content = F.concat(F.array_join("lines", "\n"), F.when(F.col("file") % 13 == 4, "\0").otherwise("")).cast("binary")
    files = rows.select(F.concat(F.expr(_PLACE), F.col("path")).alias("path"), content.alias("content"))
    own = spark.createDataFrame([(IGNORE_FILE, IGNORED.encode())], "path string, content binary")
    _written(files.unionByName(own), root).count()
    found = trees.source_files(spark, root, trees.read_ignore(root, IGNORE_FILE)).where(F.col("path") != IGNORE_FILE)
    lines = trees.source_lines(found).groupBy("path").agg(F.count("*").alias("n_lines"))
    return found.join(lines, "path").select("path", "n_lines", F.sha2("content", 256).alias("digest"))


def _archive(entries: list[tuple[str, bytes]], packed: bool = False) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz" if packed else "w") as made:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            made.addfile(info, io.BytesIO(data))
    return out.getvalue()


def _saved(batches):
    """An image of (image, layers): each layer an archive with its files, every second one packed, between a manifest and settings."""
    for batch in batches:
        for image, layers in zip(batch.column("image").to_pylist(), batch.column("layers").to_pylist(), strict=True):
            inner = [(f"{k:04d}/layer.tar", _archive([(f["name"], f["content"].encode()) for f in layer["files"]], packed=k % 2 == 1)) for k, layer in enumerate(layers)]
            yield pa.RecordBatch.from_pydict({"path": [f"{image}.tar"], "content": pa.array([_archive([("manifest.json", b"[]"), *inner, ("repositories", b"")])], pa.binary())})


@query("""with p as (select p_partkey as k, p_partkey // 40 as image, p_partkey % 40 // 20 as layer, p_size from part), db as (select *, image % 3 = 0 as alpine, max(layer) over (partition by image) as last from p)
select 'image-' || image as image, 'lib' || k as name, '1.' || p_size as version, case when alpine then 'Alpine:v3.' || image % 9 when image % 3 = 1 then 'Debian:12' else 'Ubuntu:22.04' end as ecosystem from db where layer = last and (alpine or k % 6 <> 0)""")
def image_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty parts are an image, twenty of them a layer with its own database; only the last layer's counts. Names start with ./ in every second image."""
    root = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    image, layer = F.expr("p_partkey div 40"), F.expr("p_partkey % 40 div 20").cast("int")
    alpine = image % 3 == 0
    dpkg = F.concat(F.lit("Package: lib"), text(k), F.lit("\nStatus: install ok "), F.when(k % 6 == 0, "not-installed").otherwise("installed"), F.lit("\nVersion: 1."), text(F.col("p_size")), F.lit("\n"))
    apk = F.concat(F.lit("C:Q1\nP:lib"), text(k), F.lit("\nV:1."), text(F.col("p_size")), F.lit("\n"))
    rows = table(spark, sf_dir, "part").select(image.alias("image"), layer.alias("layer"), alpine.alias("alpine"), F.struct(k.alias("k"), F.when(alpine, apk).otherwise(dpkg).alias("p")).alias("p"))
    rows = rows.groupBy("image", "layer", "alpine").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["p"]), "\n").alias("database"))
    dot = F.when(F.col("image") % 2 == 0, "./").otherwise("")
    file = lambda name, content: F.struct(F.concat(dot, name if not isinstance(name, str) else F.lit(name)).alias("name"), content.alias("content"))
    system = F.when(F.col("alpine"), F.concat(F.lit("3."), text(F.col("image") % 9), F.lit(".2\n"))).when(F.col("image") % 3 == 1, F.lit('ID=debian\nVERSION_ID="12"\n')).otherwise(F.lit('ID=ubuntu\nVERSION_ID="22.04"\n'))
    names = F.when(F.col("alpine"), images.APK).otherwise(images.DPKG), F.when(F.col("alpine"), images.ALPINE).otherwise(images.OS_RELEASE)
    layers = rows.withColumn("files", F.array(file("usr/bin/x", F.lit("binary")), file(names[0], F.col("database")), file(names[1], system), file("var/lib/dpkg/.wh.status", F.lit(""))))
    layers = layers.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("layer", "files"))), lambda x: F.struct(x["files"].alias("files"))).alias("layers"))
    ship(spark)
    tars = layers.select(F.concat(F.lit("image-"), text(F.col("image"))).alias("image"), "layers").mapInArrow(_saved, "path string, content binary")
    saved = _written(tars, root).select(F.concat(F.lit(f"{root}/"), F.col("path")).alias("image"))
    return images.installed(images.image_files_of(saved)).withColumn("image", F.regexp_extract("image", r"([^/]*)\.tar$", 1))

"""Imports: archives of corpora, kinds of files, token confidences, page manifests, catalogues of datasets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import IMAGES, LEVELS

#: Members of one archive and their bytes in all, inflated; an archive with more is refused whole.
MAX_MEMBERS, MAX_BYTES = 10_000, 1 << 30
MEMBER = "archive string, name string, content binary, error string"


def file_kind(name: Column) -> Column:
    """image, a level of ground truth by the longest suffix that fits, or other."""
    low = F.lower(name)
    out = None
    for kind, suffix in sorted([(k, s) for k, s in LEVELS.items()] + [("image", f".{i}") for i in IMAGES], key=lambda x: -len(x[1])):
        test = low.endswith(suffix)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def file_stem(name: Column) -> Column:
    """The name without folders and without the suffix that tells its kind."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    suffixes = sorted([*LEVELS.values(), *(f".{i}" for i in IMAGES)], key=lambda s: -len(s))
    return F.regexp_replace(base, "(?i)(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$", "")


def archive_members(archives: DataFrame) -> DataFrame:
    """The files of ZIP archives (path, content): archive, name, content; one row with an error for an archive that is refused.

    Folders, hidden files and names that lead out of the archive are left out. Archives are read one by one, so many
    are read side by side, and the content of a member is inflated only as far as the archive's bound allows.
    """
    schema = pa.schema([("archive", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
    row = lambda *values: pa.RecordBatch.from_pylist([dict(zip(schema.names, values, strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as archive:
                        members = [m for m in archive.infolist() if not m.is_dir() and not m.filename.startswith(("/", "\\")) and not any(p == ".." or p.startswith((".", "__MACOSX")) for p in m.filename.replace("\\", "/").split("/"))]
                        if len(members) > MAX_MEMBERS or sum(m.file_size for m in members) > MAX_BYTES:
                            yield row(path, None, None, "too large")
                            continue
                        for m in members:
                            yield row(path, m.filename, archive.read(m), None)
                except (zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    yield row(path, None, None, str(e) or type(e).__name__)

    return archives.select("path", "content").mapInArrow(run, MEMBER)


def archive_corpus(archives: DataFrame) -> DataFrame:
    """archive, doc_id, has_image and a column for the text of each level, from the members of ZIP archives."""
    files = archive_members(archives).where("name IS NOT NULL").select("archive", file_stem(F.col("name")).alias("doc_id"), file_kind(F.col("name")).alias("kind"), "content")
    text = lambda kind: F.max(F.when(F.col("kind") == kind, F.decode("content", "UTF-8"))).alias(kind)
    return files.where("kind <> 'other'").groupBy("archive", "doc_id").agg(F.bool_or(F.col("kind") == "image").alias("has_image"), *[text(k) for k in LEVELS])


def pairing(files: DataFrame) -> DataFrame:
    """paired, images without a text and texts without an image, from doc_id, has_image and gt."""
    has = F.col("gt").isNotNull()
    return files.agg(F.count_if(F.col("has_image") & has).alias("paired"), F.count_if(F.col("has_image") & ~has).alias("image_only"), F.count_if(~F.col("has_image") & has).alias("text_only"))


def xml_level(xml: Column) -> Column:
    """alto or page by the name of the root element; null for other documents."""
    root = F.lower(F.regexp_extract(xml, r"(?s)^\s*(?:<\?.*?\?>|<!--.*?-->|\s)*<(?:[\w.-]+:)?([\w.-]+)", 1))
    return F.when(root == "alto", "alto").when(root == "pcgts", "page")


def alto_version(xml: Column) -> Column:
    """2, 3 or 4 by the name space of an ALTO document, 0 without one; null for other documents."""
    found = F.regexp_extract(xml, r"loc\.gov/standards/alto/ns-v(\d)", 1)
    return F.when(xml_level(xml) == "alto", F.when(found == "", 0).otherwise(F.try_to_number(found, F.lit("9")).cast("int")))


def confidences(json: Column) -> Column:
    """Tokens and their confidences (0 to 1) of a sidecar; values above 1 are percents, tokens without text or value go."""
    read = F.from_json(json, "array<struct<token:string,confidence:double>>")
    share = lambda x: F.when(x["confidence"] > 1, x["confidence"] / 100).otherwise(x["confidence"])
    good = F.filter(read, lambda x: (F.trim(x["token"]) != "") & x["confidence"].isNotNull() & (x["confidence"] >= 0) & (x["confidence"] <= 100))
    return F.transform(good, lambda x: F.struct(x["token"].alias("token"), share(x).alias("confidence")))


_IMAGE = "struct<`@id`:string,id:string>"
_V2 = f"struct<sequences:array<struct<canvases:array<struct<`@id`:string,label:string,width:int,height:int,images:array<struct<resource:{_IMAGE}>>>>>>>"
_V3 = f"struct<items:array<struct<id:string,label:string,width:int,height:int,items:array<struct<items:array<struct<body:{_IMAGE}>>>>>>>"


def canvases(manifest: Column) -> Column:
    """The pages (id, label, width, height, image) of a page manifest of version 2 or 3, in order; null if it is broken."""
    first = lambda xs: F.get(xs, F.lit(0))
    page = lambda c, key, image: F.struct(c[key].alias("id"), c["label"].alias("label"), c["width"].alias("width"), c["height"].alias("height"), F.coalesce(image["@id"], image["id"]).alias("image"))
    old = F.transform(first(F.from_json(manifest, _V2)["sequences"])["canvases"], lambda c: page(c, "@id", first(c["images"])["resource"]))
    new = F.transform(F.from_json(manifest, _V3)["items"], lambda c: page(c, "id", first(first(c["items"])["items"])["body"]))
    return F.coalesce(old, new)


FIELDS = ("title", "description", "authors", "period", "licence")


def search_catalogue(entries: DataFrame, text: str = "", language: str | None = None, script: str | None = None) -> DataFrame:
    """Entries whose fields hold every word of text, in any case, and that have the language and script asked for."""
    whole = F.lower(F.concat_ws(" ", *FIELDS))
    for word in text.lower().split():
        entries = entries.where(F.contains(whole, F.lit(word)))
    for column, wanted in (("languages", language), ("scripts", script)):
        if wanted:
            entries = entries.where(F.array_contains(F.transform(column, F.lower), wanted.lower()))
    return entries


def catalogue_values(entries: DataFrame, column: str) -> DataFrame:
    """The distinct values of an array column of the catalogue, and how many entries have each."""
    return entries.select(F.explode(F.array_distinct(column)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("entries"))


def merged_datasets(known: DataFrame, found: DataFrame) -> DataFrame:
    """Datasets by id: the known entry of each, or else the found one."""
    return known.unionByName(found.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"]))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of the images of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(IMAGES)}}}").option("recursiveFileLookup", "true").load(folder).select("path", "content")

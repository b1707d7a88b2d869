"""Files as tables: directory scans, text lines, archive entries."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, path: str, glob: str | None = "*.{pdf,docx,PDF,DOCX}", recursive: bool = True, max_bytes: int | None = None) -> DataFrame:
    """Rows (path, modificationTime, length, content); a size bound is pushed to the listing, before contents are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    return df.where(F.col("length") <= max_bytes) if max_bytes is not None else df


def scan_lines(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines of texts with line_no from 0."""
    return df.select(*keys, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line_no", "line"))


def content_policy(html: Column) -> Column:
    """A page's content security policy as a map of directives to tokens; null without one."""
    spelt = F.regexp_extract(html, r"""(?s)<meta[^>]*http-equiv="Content-Security-Policy"[^>]*content="([^"]*)\"""", 1)
    parts = F.filter(F.transform(F.split(spelt, ";"), lambda p: F.trim(p)), lambda p: p != "")
    words = F.transform(parts, lambda p: F.split(p, r"\s+"))
    pairs = F.transform(words, lambda w: F.struct(w[0].alias("key"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("value")))
    return F.when(spelt != "", F.map_from_entries(pairs))


ENTRIES = "entries array<string>, content_types string, document binary, relations string, uncompressed long, largest long, images int, error string"


def zip_directory(files: DataFrame, id_col: str = "id", content_col: str = "content", limit: int = 1 << 27) -> DataFrame:
    """Per archive its entry names and the parts that gates and readers need; entries is null for what is no archive.

    Sizes come from the directory. A needed part over ``limit`` bytes is not inflated: the
    archive's error tells of it.
    """
    kind = dict(files.dtypes)[id_col]

    def part(z: zipfile.ZipFile, names: set[str], name: str) -> bytes | None:
        if name in names and z.getinfo(name).file_size > limit:
            raise ValueError(f"the part {name} is over the limit of {limit} bytes")
        return z.read(name) if name in names else None

    def scan(batches):
        for batch in batches:
            rows = []
            for content in batch.column(content_col).to_pylist():
                names = None
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        infos = z.infolist()
                        names = {i.filename for i in infos}
                        types, relations = part(z, names, "[Content_Types].xml"), part(z, names, "word/_rels/document.xml.rels")
                        rows.append((sorted(names), types.decode("utf-8", "replace") if types is not None else None, part(z, names, "word/document.xml"), relations.decode("utf-8", "replace") if relations else None, sum(i.file_size for i in infos), max((i.file_size for i in infos), default=0), sum(i.filename.startswith("word/media/") for i in infos), None))
                except Exception as e:  # one file must not end the job
                    rows.append((sorted(names) if names else None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]))
            types_ = [pa.list_(pa.string()), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(types_)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(columns, types_, strict=True))], names=[id_col, *(c.split(" ")[0] for c in ENTRIES.split(", "))])

    return files.select(id_col, content_col).mapInArrow(scan, f"{id_col} {kind}, {ENTRIES}")

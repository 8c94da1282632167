"""File sources: served index, delimited files, images, font folders, checksums, paged records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FONT_SUFFIXES = ("ttf", "otf", "woff", "woff2")


def load_served(spark: SparkSession, path: str) -> DataFrame:
    """(family, script, weight, style) of a served index; font keys are a weight and an optional ``i``."""
    schema = "familyMetadataList array<struct<family:string,primaryScript:string,fonts:map<string,string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("familyMetadataList").alias("f"))
    keys = rows.select("f.family", F.coalesce("f.primaryScript", F.lit("")).alias("script"), F.explode(F.map_keys("f.fonts")).alias("key")).where(F.col("key").rlike(r"^\d+i?$"))
    return keys.select("family", "script", F.regexp_extract("key", r"^(\d+)", 1).cast("int").alias("weight"), F.when(F.col("key").endswith("i"), "italic").otherwise("normal").alias("style")).distinct()


def load_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Quoted fields with doubled quotes and line breaks; rows that start with # are left out; a byte order mark is no data."""
    reader = spark.read.options(header=schema is None, multiLine=True, quote='"', escape='"', comment="#", encoding="UTF-8", ignoreLeadingWhiteSpace=False)
    return (reader.schema(schema) if schema else reader).csv(path)


def load_vectors_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector) of lines of tab-separated numbers; the id is the line's place, so the file is read as one text."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\\s+$", ""), "\r?\n")).alias("id", "line"))
    return lines.select(F.col("id").cast("long"), F.split("line", "\t").cast("array<double>").alias("vector"))


def load_names_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(name, variant, category, family): the family is the name without its variant suffix."""
    rows = spark.read.options(sep="\t", header=True).csv(path)
    cut = F.when(F.col("name").endswith(F.concat(F.lit(" "), F.col("variant"))), F.expr("substring(name, 1, length(name) - length(variant) - 1)"))
    return rows.withColumn("family", F.coalesce(cut, F.col("name")))


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def scan_fonts(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of font files below a folder, outside ``corpus`` and ``.cache``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*FONT_SUFFIXES) & ~F.col("path").rlike(r"/(corpus|\.cache)/")).select("path", "length", "content")


def scan_images(spark: SparkSession, root: str, suffix: str = "png") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", True).load(root).select("path", "content")


def font_rows(files: DataFrame, reader) -> DataFrame:
    """Typed names, metrics and variation axes of font files through ``reader(bytes) -> dict``; a file that fails keeps its error."""
    import pandas as pd

    fields = "family string, subfamily string, weight int, mac_style int, selection int, fixed_pitch int, panose array<int>, axes array<struct<tag:string,low:double,default:double,high:double>>, error string"

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch["content"]:
                try:
                    rows.append({"error": None} | reader(bytes(raw)))
                except Exception as error:  # noqa: BLE001  any broken file is a row with an error
                    rows.append({"error": f"{type(error).__name__}: {error}"})
            frame = pd.DataFrame(rows, columns=["family", "subfamily", "weight", "mac_style", "selection", "fixed_pitch", "panose", "axes", "error"]).astype(object)
            frame.insert(0, "path", batch["path"].to_numpy())
            yield frame.where(frame.notna(), None)

    return files.select("path", "content").mapInPandas(run, f"path string, {fields}")


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, ok) of expected (name, sha256) against files; a missing file is not ok."""
    have = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("_have"))
    return expected.join(have, "name", "left").select("name", F.coalesce(F.col("_have") == F.col("sha256"), F.lit(False)).alias("ok"))


def changed_since(files: DataFrame, stamp) -> DataFrame:
    """Files of a reader with metadata that were modified after a time."""
    return files.where(F.col("_metadata.file_modification_time") > F.lit(stamp))


class _Page(InputPartition):
    def __init__(self, offset: int):
        self.offset = offset


class PagedSource(DataSource):
    """Batch source over ``fetch(offset, limit) -> list of tuples``.

    With a known ``count`` pages are read in parallel, a partition each. Without one (None) a single task asks
    for page after page until one is short, since only the last page tells that it is the last.
    """

    fetch = None
    count: int | None = None
    limit = 1000
    fields = "value string"

    @classmethod
    def of(cls, name: str, fetch, schema: str, count: int | None = None, limit: int = 1000) -> type[PagedSource]:
        return type(f"Paged_{name}", (cls,), {"fetch": staticmethod(fetch), "count": count, "fields": schema, "limit": limit, "name": classmethod(lambda _: name)})

    def schema(self) -> str:
        return self.fields

    def reader(self, schema) -> DataSourceReader:
        fetch, count, limit = type(self).fetch, type(self).count, type(self).limit

        class Reader(DataSourceReader):
            def partitions(self):
                return [_Page(-1)] if count is None else [_Page(at) for at in range(0, max(count, 1), limit)]

            def read(self, partition):
                if partition.offset >= 0:
                    yield from fetch(partition.offset, limit)
                    return
                at, page = 0, None
                while page is None or len(page) == limit:
                    page = list(fetch(at, limit))
                    yield from page
                    at += limit

        return Reader()


class UnexpectedStatus(OSError):
    """An HTTP answer that isn't a success."""


def fetch_text(url: str, opener=None, timeout: float = 60.0) -> str:
    """The text of a GET; any status outside 200 to 299 is an error. ``opener(url, timeout)`` gives (status, bytes)."""

    def plain(address: str, seconds: float) -> tuple[int, bytes]:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(address, timeout=seconds) as answer:
                return answer.status, answer.read()
        except urllib.error.HTTPError as error:
            return error.code, b""

    status, body = (opener or plain)(url, timeout)
    if not 200 <= status < 300:
        raise UnexpectedStatus(f"{url}: HTTP {status}")
    return body.decode("utf-8")


def fetch_pages(urls: DataFrame, opener=None) -> DataFrame:
    """(url, html, error) of rows (url): pages are fetched where the rows lie; one that fails keeps its error."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, fetch_text(url, opener), None))
                except (OSError, ValueError) as error:
                    rows.append((url, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["url", "html", "error"])

    return urls.select("url").mapInPandas(run, "url string, html string, error string")


def cached(path: str | None, cache: str, download) -> str:
    """The path of a source: the one given, else the cache, which ``download()`` (bytes) fills where it is missing."""
    import os

    if path:
        return path
    if not os.path.exists(cache):
        os.makedirs(os.path.dirname(cache) or ".", exist_ok=True)
        data, part = download(), f"{cache}.part"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, cache)  # a broken download never looks like a cache
    return cache


def checked(spark: SparkSession, root: str, expected: dict[str, str], download) -> DataFrame:
    """Files of a folder by name, those that are missing downloaded, all of them with the expected sha256 or an error.

    ``expected`` maps names to checksums, ``download(name)`` gives bytes.
    """
    import os

    for name in sorted(expected):
        cached(None, os.path.join(root, name), lambda name=name: download(name))
    files = spark.read.format("binaryFile").load([os.path.join(root, n) for n in sorted(expected)])
    wrong = verify_checksums(files, spark.createDataFrame(sorted(expected.items()), "name string, sha256 string")).where("not ok")
    if bad := [r["name"] for r in wrong.collect()]:  # one row a listed file
        raise ValueError(f"checksums differ: {', '.join(sorted(bad))}")
    return files


def resolve_root(given: str | None, candidates: list[str], marker: str) -> str:
    """The folder given, else the first candidate that holds the marker file; neither is an error that names what was tried."""
    import os

    for root in [given] if given else candidates:
        if os.path.exists(os.path.join(root, marker)):
            return root
    raise FileNotFoundError(f"no {marker} below {given or ', '.join(candidates)}")


def revision(root: str) -> str | None:
    """The commit that a checkout stands at, None where that can't be told."""
    import subprocess

    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=30).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        return None


def decode_image(raw: bytes, channels: int = 3):
    """(height, width, channels) bytes of a PNG with 8-bit gray, RGB or RGBA pixels and no interlacing."""
    import struct
    import zlib

    import numpy as np

    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        head, data = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head, data + body if kind == b"IDAT" else data
        at += 12 + size
    width, height, depth, color, _, _, interlaced = head
    samples = {0: 1, 2: 3, 6: 4}.get(color)
    if depth != 8 or interlaced or samples is None:
        raise ValueError(f"PNG with {depth} bits, color type {color}")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * samples)
    out = np.zeros((height, width * samples), np.uint8)
    above = np.zeros(width * samples, np.int64)
    for y, line in enumerate(lines):
        kind, row = int(line[0]), line[1:].astype(np.int64)
        if kind in (0, 2):
            row = row + above if kind == 2 else row
        else:
            for x in range(len(row)):
                a, b, c = (row[x - samples] if x >= samples else 0), above[x], (above[x - samples] if x >= samples else 0)
                if kind == 4:
                    p = a + b - c
                    best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                row[x] = (row[x] + (a if kind == 1 else (a + b) // 2 if kind == 3 else best)) & 0xFF
        above = row & 0xFF
        out[y] = above
    image = out.reshape(height, width, samples)
    image = np.repeat(image, 3, axis=2) if samples == 1 else image[:, :, :3]
    return image[:, :, :1] if channels == 1 else image


def image_pixels(files: DataFrame) -> DataFrame:
    """(path, height, width, pixels, error) of image files (path, content): RGB bytes row by row; a broken file keeps its error."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path, raw in zip(batch["path"], batch["content"]):
                try:
                    image = decode_image(bytes(raw))
                    rows.append((path, image.shape[0], image.shape[1], image.tobytes(), None))
                except Exception as error:  # noqa: BLE001  any broken file is a row with an error
                    rows.append((path, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "pixels", "error"]).astype(object)

    return files.select("path", "content").mapInPandas(run, "path string, height int, width int, pixels binary, error string")


def load_quantized(spark: SparkSession, path: str, dim: int, scales: list[float]) -> DataFrame:
    """(id, q, scale) of a file of signed bytes, ``dim`` a row, and a scale a row; the file is cut into records where it lies."""
    rows = spark.sparkContext.binaryRecords(path, dim).zipWithIndex()  # the only reader of fixed-length records
    frame = rows.map(lambda r: (r[1], [b - 256 if b > 127 else b for b in r[0]])).toDF("id long, q array<tinyint>")
    known = spark.createDataFrame(list(enumerate(map(float, scales))), "id long, scale double")
    return frame.join(known, "id")

"""Corpus sinks: vectors and catalog with sidecars, manifests, HTML sheets, guarded writes."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import tarfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V


#: folder names by which files are copied to other machines on their own
SYNCED = ("dropbox", "onedrive", "google drive", "googledrive", "icloud", "icloud drive", "mobile documents")


def refuse(path: str, forbidden: tuple[str, ...] = (), checkouts: bool = False) -> None:
    """No write below a forbidden root; with ``checkouts`` false, none inside a checkout or a folder that is synced elsewhere.

    Paths are compared as they resolve, so neither ``..`` nor a link gets around a guard. Paths of other stores
    than files are only compared with the forbidden roots.
    """
    local = path.startswith(("/", "file:"))
    plain = lambda p: os.path.realpath(p.removeprefix("file://").removeprefix("file:")) if local else p.rstrip("/")
    clean = plain(path)
    for root in forbidden:
        if (clean + "/").startswith(plain(root).rstrip("/") + "/"):
            raise ValueError(f"{path} lies in {root}")
    if not local or checkouts:
        return
    parts = Path(clean)
    for folder in (parts, *parts.parents):
        if os.path.exists(folder / ".git"):  # false too for a folder that can't be searched, below which nothing can be written
            raise ValueError(f"{path} lies in the checkout {folder}")
        if folder.name.lower() in SYNCED:
            raise ValueError(f"{path} lies in the synced folder {folder}")


def catalog_rows(corpus: DataFrame) -> DataFrame:
    """Served catalog rows: label, search text, features rounded half to even or null."""
    return corpus.select(
        "id", "family", T.label_of(F.col("family"), F.col("weight"), F.col("style")).alias("label"), "weight", "style", "category", "source", "eligible",
        *[F.bround(c, 4).alias(c) for c in ("legibility", "xh", "width")],
        F.lower(F.concat_ws(" ", "family", F.col("weight").cast("string"), "style", "category")).alias("search"),
    )


def write_json(path: str, document) -> None:
    """A document as indented UTF-8 JSON with a line end, its folder made where it is missing."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(document, indent=2, ensure_ascii=False) + "\n")


def _quantized(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("scale", V.quantize_scale(F.col("unit"))).select("id", "source", V.quantize(F.col("unit"), F.col("scale")).alias("q"), "scale")


def emit(corpus: DataFrame, path: str, version: dict[str, str], forbidden: tuple[str, ...] = (), projection=None) -> None:
    """Write catalog, quantized vectors, a one-row version table and, if given, the projection; an existing corpus is never overwritten."""
    refuse(path, forbidden)
    _quantized(corpus).write.mode("errorifexists").partitionBy("source").parquet(f"{path}/vectors")
    catalog_rows(corpus).write.mode("errorifexists").parquet(f"{path}/catalog")
    if projection is not None:
        projection.write(corpus.sparkSession, f"{path}/pca")
        version = {**version, "pca": projection.identity}
    counts = corpus.agg(F.count("*").alias("count"), F.max(F.size("unit")).alias("dim"), F.count_if(F.col("source") == "local").alias("houseFaces"))
    counts.withColumns({k: F.lit(v) for k, v in version.items()}).withColumn("v", F.lit(1)).coalesce(1).write.mode("errorifexists").json(f"{path}/version")


def emit_private(delta: DataFrame, path: str, projection, public: str, forbidden: tuple[str, ...] = ()) -> None:
    """Write a private corpus beside a public one: rows of source 'private' projected by the public corpus' own projection.

    A projection of another identity than the one that the public corpus was written with is an error.
    """
    refuse(path, forbidden)
    known = delta.sparkSession.read.json(f"{public}/version").first()["pca"]
    if projection.identity != known:
        raise ValueError(f"projection {projection.identity[:12]} is not the public {known[:12]}")
    emit(delta.withColumn("source", F.lit("private")), path, {"publicPca": known}, forbidden, projection)


def projection_fixture(vectors: DataFrame, vector: str, projection, k: int = 16) -> DataFrame:
    """(id, embedding, projected): evenly spaced rows with their projections, both rounded to six digits."""
    from ..operators.evaluate import evenly_spaced
    from ..operators.learn import pca_project

    some = pca_project(evenly_spaced(vectors.select("id", vector), "id", k), vector, projection)
    rounded = lambda c: F.transform(c, lambda x: F.round(x.cast("double"), 6))
    return some.select("id", rounded(vector).alias("embedding"), rounded("projected").alias("projected"))


def pair_graph(edges: DataFrame, seeds: DataFrame, candidates: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(graph, cases): heading to sorted partners, and the rounded score of every (seed, candidate) for runtimes to agree with.

    ``seeds`` and ``candidates`` have (id), a few each; ``scores`` has (h_id, id, score).
    """
    graph = edges.groupBy("heading").agg(F.array_sort(F.collect_set("partner")).alias("partners"))
    cases = scores.join(F.broadcast(seeds.select(F.col("id").alias("h_id"))), "h_id", "left_semi").join(F.broadcast(candidates.select("id")), "id", "left_semi")
    return graph, cases.select("h_id", "id", F.round("score", 6).alias("score"))


def load_corpus(spark, path: str) -> DataFrame:
    """Catalog rows with unit vectors from an emitted corpus."""
    from ..operators.corpus import with_unit

    vectors = spark.read.parquet(f"{path}/vectors").select("id", V.dequantize(F.col("q"), F.col("scale")).alias("vector"), "scale")
    return with_unit(spark.read.parquet(f"{path}/catalog").join(vectors, "id"), "vector").drop("vector")


def backfill(catalog: DataFrame, features: DataFrame) -> DataFrame:
    """Catalog with xh and width replaced where a feature row has them; vectors are not touched."""
    f = features.select("id", F.col("xh").alias("_xh"), F.col("width").alias("_width"))
    return catalog.join(f, "id", "left").withColumns({"xh": F.coalesce("_xh", "xh"), "width": F.coalesce("_width", "width")}).drop("_xh", "_width")


def aligned_features(catalog: DataFrame, rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, missing): one feature row for each catalog row, by id; a row without a render keeps its x-height and has nulls else.

    ``rendered`` has (id, xh, contrast, aperture, o_aspect); ``missing`` is one row with the number of rows without one.
    """
    f = rendered.select("id", F.col("xh").alias("_xh"), "contrast", "aperture", "o_aspect", F.lit(True).alias("_there"))
    both = catalog.select("id", "xh").join(f, "id", "left")
    return both.select("id", F.coalesce("_xh", "xh").alias("xh"), "contrast", "aperture", "o_aspect"), both.agg(F.count_if(F.col("_there").isNull()).alias("missing"))


def remembered(spark, path: str, ids: DataFrame, make) -> DataFrame:
    """``make()`` (rows with id) as written below ``path``, made anew only where the wanted ids aren't those of the last time.

    The ids are compared by count and hash, and the new rows are put in place once they are complete.
    """
    wanted = table_hash(ids.select("id"), "id")
    if os.path.exists(f"{path}/ids") and open(f"{path}/ids", encoding="utf-8").read() == wanted:
        return spark.read.parquet(f"{path}/rows-{wanted[:40]}")
    make().write.mode("overwrite").parquet(f"{path}/rows-{wanted[:40]}")
    with open(f"{path}/ids.part", "w", encoding="utf-8") as out:
        out.write(wanted)
    os.replace(f"{path}/ids.part", f"{path}/ids")
    return spark.read.parquet(f"{path}/rows-{wanted[:40]}")


def replace_source(rows: DataFrame, path: str, source: str) -> None:
    """Put a source's block in place of its old one; the other sources' files stay. Running it twice changes nothing."""
    rows.where(F.col("source") == source).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def manifest(files: DataFrame) -> DataFrame:
    """(name, bytes, sha256) sorted by name: the same for the same contents."""
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("name")


def size_report(files: DataFrame) -> DataFrame:
    """(name, bytes, gzip) of every file, and their total as name null; the compressed size is that of a fixed level and no time stamp."""

    @F.pandas_udf("long")
    def packed(contents: pd.Series) -> pd.Series:
        return contents.map(lambda raw: len(gzip.compress(bytes(raw), 9, mtime=0)))

    each = files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.length("content").cast("long").alias("bytes"), packed("content").alias("gzip"))
    return each.unionByName(each.agg(F.lit(None).cast("string").alias("name"), F.sum("bytes").alias("bytes"), F.sum("gzip").alias("gzip")))


def build_archive(root: str, path: str) -> list[dict]:
    """A tar.gz of a folder that is the same for the same contents: members by name, no times or owners; its (name, bytes, sha256) rows."""
    names = sorted(str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file())
    rows = []
    with open(path, "wb") as raw, gzip.GzipFile(filename="", fileobj=raw, mode="wb", mtime=0) as packed, tarfile.open(fileobj=packed, mode="w", format=tarfile.USTAR_FORMAT) as out:
        for name in names:
            member = tarfile.TarInfo(name)
            member.size, member.mtime, member.mode = os.path.getsize(os.path.join(root, name)), 0, 0o644
            digest = hashlib.sha256()
            with open(os.path.join(root, name), "rb") as source:
                out.addfile(member, source)
                source.seek(0)
                while block := source.read(1 << 20):
                    digest.update(block)
            rows.append({"name": name, "bytes": member.size, "sha256": digest.hexdigest()})
    return rows


def write_lock(path: str, tag: str, archive: str, members: list[dict]) -> dict:
    """A release's lock: tag, the archive's hash and size, and its members."""
    with open(archive, "rb") as source:
        digest = hashlib.file_digest(source, "sha256").hexdigest()
    lock = {"tag": tag, "archive": os.path.basename(archive), "sha256": digest, "bytes": os.path.getsize(archive), "members": members}
    write_json(path, lock)
    return lock


def table_hash(df: DataFrame, key: str) -> str:
    """One hash of a table that doesn't depend on its partitions: sum of row hashes, and the number of rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in range(4)]
    return "-".join(str(x) for x in df.agg(F.count(key).alias("n"), *parts).first())


def sheet(rows: DataFrame) -> DataFrame:
    """(heading, html): one escaped section a heading with its partners in order."""
    line = F.concat(F.lit("<li>"), T.escape_html(F.col("partner")), F.lit("</li>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]), "")
    return rows.groupBy("heading").agg(body.alias("_body")).select("heading", F.concat(F.lit("<section><h2>"), T.escape_html(F.col("heading")), F.lit("</h2><ul>"), F.col("_body"), F.lit("</ul></section>")).alias("html"))


def sheet_head(instances: DataFrame) -> DataFrame:
    """(kind, html): one font-face for each own (family, weight, style) with a file, one stylesheet link for each css2 fragment of the others."""
    cuts = instances.dropDuplicates(["family", "weight", "style"])
    own = F.concat(F.lit('@font-face{font-family:"'), T.escape_html(F.col("family")), F.lit('";font-weight:'), F.col("weight").cast("string"), F.lit(";font-style:"), F.col("style"), F.lit(';src:url("'), T.escape_html(F.col("file")), F.lit('")}'))
    link = F.concat(F.lit('<link rel="stylesheet" href="https://fonts.googleapis.com/css2?family='), T.escape_html(F.col("css2")), F.lit('&amp;display=swap">'))
    faces = cuts.where("file is not null").select(F.lit("face").alias("kind"), own.alias("html"))
    return faces.unionByName(cuts.where("file is null and css2 is not null").select(F.lit("link").alias("kind"), link.alias("html")).distinct())

import datetime
import hashlib
import json
import os
import struct
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomrank.operators import integrity as I
from loomrank.operators import learn as L
from loomrank.operators.corpus import with_unit
from loomrank.sources import sinks, tables, textproto
from loomrank.streaming import incremental

LANTERN = """
designer: "Nobody #1"
  # a comment between fields
category: "HANDWRITING"
name: "Lantern \\"Night\\" Script"
axes { tag: "opsz" min_value: 8 max_value: 72.5 }
axes { tag: "slnt" min_value: -10 max_value: 0 }
subsets: "greek"
fonts {
  post_script_name: "LanternNight-Thin"
  full_name: "Lantern {Night} Thin: \\\\ one"
  filename: "LanternNight-Thin.otf"
  weight: 250
}
registry_default_overrides { key: "opsz" value: 12.0 }
"""


def test_textproto_to_family(spark, tmp_path):
    for folder, text in (("zeta/lantern", LANTERN), ("alpha/plain", 'name: "Plain" fonts { filename: "Plain[slnt,opsz].ttf" style: "oblique" } subsets: "a" subsets: "b"')):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "METADATA.pb").write_text(text)
    plain, lantern = textproto.normalize_family(textproto.load_catalog(spark, f"{tmp_path}/*/*/METADATA.pb")).collect()
    assert plain["dir"].endswith("/alpha/plain") and plain["variable"] and plain["category"] is None and plain["subsets"] == ["a", "b"] and plain["axes"] == []
    assert (lantern["family"], lantern["category"], lantern["variable"]) == ('Lantern "Night" Script', "handwriting", False)
    assert [tuple(x) for x in lantern["axes"]] == [("opsz", 8.0, 72.5), ("slnt", -10.0, 0.0)] and lantern["subsets"] == ["greek"]
    font = lantern["fonts"][0]
    assert (font["full_name"], font["weight"], font["style"]) == ("Lantern {Night} Thin: \\ one", 250, "normal")


def test_textproto_is_tolerant():
    assert textproto.parse('a: 1 a: 2.5 b { c: "x\\n\\"y\\"" } } stray') == {"a": [1, 2.5], "b": {"c": 'x\n"y"'}}
    assert textproto.parse("") == {} and textproto.parse("# only\n  # comments") == {}
    assert textproto.parse("m { a: X } m { a: Y }") == {"m": [{"a": "X"}, {"a": "Y"}]}


def test_family_defaults_and_nulls(spark):
    df = spark.createDataFrame([(1, 'name: "A" category: ODD fonts { filename: "a.ttf" }'), (2, None), (3, "")], "k int, value string")
    rows = {r["k"]: r for r in textproto.normalize_family(textproto.parse_families(df, carry=("k",))).collect()}
    assert rows[1]["category"] == "odd" and rows[1]["fonts"][0]["weight"] == 400 and rows[1]["fonts"][0]["style"] == "normal" and not rows[1]["variable"]
    assert rows[2]["family"] is None and rows[3]["family"] is None


def test_lists_of_one_and_json_documents(spark, tmp_path):
    lists = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "v array<string>")
    assert [r["x"] for r in lists.select(textproto.first(F.col("v"), "none").alias("x")).collect()] == ["a", "none", "none"]
    sinks.write_json(str(tmp_path / "deep" / "d.json"), {"name": "é", "rows": [{"id": 1}, {"id": 2}]})
    assert [tuple(r) for r in tables.load_json(spark, str(tmp_path / "deep" / "d.json"), "name string, rows array<struct<id:long>>").selectExpr("name", "size(rows)").collect()] == [("é", 2)]


def test_served_index(spark, tmp_path):
    doc = {"familyMetadataList": [{"family": "A", "primaryScript": "Jpan", "fonts": {"400": {}, "700i": {}, "x1": {}}}, {"family": "B", "fonts": {"400": {}}}]}
    (tmp_path / "served.json").write_text(json.dumps({"familyMetadataList": [{**f, "fonts": {k: "" for k in f["fonts"]}} for f in doc["familyMetadataList"]]}))
    rows = sorted(map(tuple, tables.load_served(spark, str(tmp_path / "served.json")).collect()))
    assert rows == [("A", "Jpan", 400, "normal"), ("A", "Jpan", 700, "italic"), ("B", "", 400, "normal")]


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,uses\n# left out\n"Two ""quoted""\nlines",3\nlast,4')
    assert sorted(map(tuple, tables.load_csv(spark, str(tmp_path / "a.csv")).collect())) == [('Two "quoted"\nlines', "3"), ("last", "4")]
    (tmp_path / "ragged.csv").write_text('a,b,c\r\n1\r\n2,"x,\ry"\r\n3,4,5,6\r\n7,8,last')
    ragged = tables.load_csv(spark, str(tmp_path / "ragged.csv"), "a string, b string, c string").where("a <> 'a'").orderBy("a")
    assert [tuple(r) for r in ragged.collect()] == [("1", None, None), ("2", "x,\ry", None), ("3", "4", "5"), ("7", "8", "last")]
    (tmp_path / "v.tsv").write_text("1.0\t2.0\n3.5\t-1\n")
    assert [tuple(r) for r in tables.load_vectors_tsv(spark, str(tmp_path / "v.tsv")).orderBy("id").collect()] == [(0, [1.0, 2.0]), (1, [3.5, -1.0])]
    (tmp_path / "m.tsv").write_text("name\tvariant\tcategory\nRound Bold\tBold\tsans\nPlain\tregular\tserif\n")
    assert [r["family"] for r in tables.load_names_tsv(spark, str(tmp_path / "m.tsv")).orderBy("name").collect()] == ["Plain", "Round"]


def test_font_folder_checksums_and_manifest(spark, tmp_path):
    for path in ("fonts/a.TTF", "fonts/deep/b.woff2", "fonts/corpus/c.ttf", "fonts/readme.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(path.encode())
    files = tables.scan_fonts(spark, str(tmp_path / "fonts"))
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()) == ["a.TTF", "b.woff2"]
    sha = hashlib.sha256(b"fonts/a.TTF").hexdigest()
    expected = spark.createDataFrame([("a.TTF", sha), ("b.woff2", "0"), ("none", "1")], "name string, sha256 string")
    assert dict(map(tuple, tables.verify_checksums(files, expected).collect())) == {"a.TTF": True, "b.woff2": False, "none": False}
    assert [tuple(r) for r in sinks.manifest(files).collect()][0] == ("a.TTF", 11, sha)
    assert tables.font_rows(files, lambda raw: {"family": raw.decode()[:5]} if raw.endswith(b"F") else {}["x"]).where("error is null").first()["family"] == "fonts"
    axes = [{"tag": "wght", "low": 100.0, "default": 400.0, "high": 900.0}]
    row = tables.font_rows(files, lambda raw: {"weight": 250, "panose": [2, 5], "axes": axes}).first()
    assert row["axes"][0].asDict() == axes[0] and row["panose"] == [2, 5] and row["family"] is None and row["error"] is None


def test_paged_source(spark):
    page = lambda at, n: [(f"v{i}",) for i in range(at, min(at + n, 25))]
    for name, count, limit in (("numbers", 25, 10), ("unknown", None, 10), ("even", None, 5), ("short", None, 100)):
        spark.dataSource.register(tables.PagedSource.of(name, page, "value string", count, limit))
        assert sorted(r["value"] for r in spark.read.format(name).load().collect()) == sorted(f"v{i}" for i in range(25))


def test_fetched_cached_and_checked(spark, tmp_path):
    answers = {"http://a": (200, "é".encode()), "http://b": (404, b""), "http://c": (301, b"x")}
    opener = lambda url, _: answers[url]
    assert tables.fetch_text("http://a", opener) == "é"
    for url in ("http://b", "http://c"):
        with pytest.raises(tables.UnexpectedStatus, match=url):
            tables.fetch_text(url, opener)
    rows = {r["url"]: r for r in tables.fetch_pages(spark.createDataFrame([(u,) for u in answers], "url string"), opener).collect()}
    assert rows["http://a"]["html"] == "é" and "404" in rows["http://b"]["error"] and rows["http://c"]["html"] is None
    calls = []
    make = lambda: calls.append(1) or b"data"
    cache = str(tmp_path / "deep" / "c.csv")
    assert tables.cached("/given", cache, make) == "/given" and not calls
    assert tables.cached(None, cache, make) == tables.cached(None, cache, make) == cache and len(calls) == 1
    good = {"x": hashlib.sha256(b"x!").hexdigest()}
    assert tables.checked(spark, str(tmp_path / "f"), good, lambda n: f"{n}!".encode()).count() == 1
    with pytest.raises(ValueError, match="y"):
        tables.checked(spark, str(tmp_path / "f"), {**good, "y": good["x"]}, lambda n: f"{n}!".encode())


def test_roots_and_revisions(tmp_path):
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "mark").write_text("")
    roots = [str(tmp_path / n) for n in ("one", "two")]
    assert tables.resolve_root(None, roots, "mark") == roots[1] == tables.resolve_root(roots[1], [], "mark")
    for given, some in ((roots[0], roots), (None, roots[:1])):
        with pytest.raises(FileNotFoundError):
            tables.resolve_root(given, some, "mark")
    assert tables.revision(str(tmp_path)) is None


def test_images(spark, tmp_path):
    rng = np.random.default_rng(0)

    def png(image, color, filters):
        """A PNG with a given filter for each row."""
        high, wide, n = image.shape
        lines, flat = b"", image.reshape(high, wide * n).astype(int)
        for y, kind in zip(range(high), filters):
            up = flat[y - 1] if y else np.zeros(wide * n, int)
            left, corner = np.concatenate([np.zeros(n, int), flat[y][:-n]]), np.concatenate([np.zeros(n, int), up[:-n]])
            p = left + up - corner
            paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
            lines += bytes([kind]) + ((flat[y] - [0, left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes()
        chunk = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, color, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

    rgb, gray, alpha = rng.integers(0, 256, (5, 4, 3)), rng.integers(0, 256, (5, 3, 1)), rng.integers(0, 256, (5, 2, 4))
    for name, image, color in (("rgb", rgb, 2), ("gray", gray, 0), ("alpha", alpha, 6)):
        (tmp_path / f"{name}.png").write_bytes(png(image, color, [0, 1, 2, 3, 4]))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r["path"].rsplit("/", 1)[1][:-4]: r for r in tables.image_pixels(tables.scan_images(spark, str(tmp_path))).collect()}
    assert bytes(got["rgb"]["pixels"]) == rgb.astype(np.uint8).tobytes() and (got["rgb"]["height"], got["rgb"]["width"]) == (5, 4)
    assert bytes(got["gray"]["pixels"]) == np.repeat(gray, 3, axis=2).astype(np.uint8).tobytes() and bytes(got["alpha"]["pixels"]) == alpha[:, :, :3].astype(np.uint8).tobytes()
    assert got["broken"]["pixels"] is None and "PNG" in got["broken"]["error"]


def test_quantized_file_and_changed_files(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(np.array([[127, -127, 0], [1, -1, -128]], np.int8).tobytes())
    rows = {r["id"]: (r["q"], r["scale"]) for r in tables.load_quantized(spark, str(tmp_path / "v.bin"), 3, [0.5, 2.0]).collect()}
    assert rows == {0: ([127, -127, 0], 0.5), 1: ([1, -1, -128], 2.0)}
    (tmp_path / "d").mkdir()
    for name, at in (("old", 1_000_000_000), ("new", 2_000_000_000)):
        (tmp_path / "d" / name).write_text(name)
        os.utime(tmp_path / "d" / name, (at, at))
    files = tables.changed_since(spark.read.text(str(tmp_path / "d")), datetime.datetime(2020, 1, 1))
    assert [r["value"] for r in files.select("value").collect()] == ["new"]


@pytest.fixture()
def corpus(spark):
    rows = [(i, f"Fam {i % 3}", 400 + 100 * (i % 2), "italic" if i % 2 else "normal", "serif", "local" if i % 4 == 3 else "google", True, 0.5, None, 0.123456, [float(i + 1), 1.0, -2.0]) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, family string, weight int, style string, category string, source string, eligible boolean, legibility double, xh double, width double, vector array<double>")
    return with_unit(df, "vector").drop("vector")


def test_emit_and_load(spark, corpus, tmp_path):
    path = str(tmp_path / "out")
    sinks.emit(corpus, path, {"backbone": "stub"})
    back = sinks.load_corpus(spark, path)
    joined = back.join(corpus.select("id", F.col("unit").alias("was")), "id").collect()
    assert len(joined) == 8 and all(abs(a - b) < 0.01 for r in joined for a, b in zip(r["unit"], r["was"]))
    assert spark.read.json(f"{path}/version").first()["houseFaces"] == 2
    row = back.where("id = 1").first()
    assert (row["label"], row["width"], row["xh"], row["search"]) == ("Fam 1 500 Italic", 0.1235, None, "fam 1 500 italic serif")
    with pytest.raises(Exception, match="exists"):
        sinks.emit(corpus, path, {})
    for bad in ("/data/site/x", "/data/other/../site", "/data/site"):
        with pytest.raises(ValueError):
            sinks.emit(corpus, bad, {}, forbidden=("/data/site",))
    sinks.refuse("/data/sites/x", ("/data/site",))
    (tmp_path / "tree" / ".git").mkdir(parents=True)
    (tmp_path / "Dropbox" / "a").mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "tree")
    for bad in ("tree/out/deep", "link/out", "Dropbox/a/out"):
        with pytest.raises(ValueError):
            sinks.refuse(str(tmp_path / bad))


def test_private_corpus_keeps_the_public_projection(spark, corpus, tmp_path):
    rng = np.random.default_rng(2)
    model, other = (L.Projection(rng.standard_normal(3), rng.standard_normal((3, 3))) for _ in range(2))
    public, private = str(tmp_path / "public"), str(tmp_path / "private")
    sinks.emit(corpus, public, {"backbone": "stub"}, projection=model)
    back = L.Projection.read(spark, f"{public}/pca")
    assert back.identity == model.identity and np.array_equal(back.components, model.components)
    with pytest.raises(ValueError, match="not the public"):
        sinks.emit_private(corpus, private, other, public)
    sinks.emit_private(corpus.where("id < 3"), private, model, public)
    assert {r["source"] for r in spark.read.parquet(f"{private}/vectors").collect()} == {"private"}
    assert I.projection_drift(spark, {"public": public, "private": private}).count() == 0
    sinks.emit(corpus, str(tmp_path / "third"), {}, projection=other)
    assert [r["corpus"] for r in I.projection_drift(spark, {"public": public, "third": str(tmp_path / "third")}).collect()] == ["third"]
    assert I.missing_files(public, ("vectors", "catalog", "version", "pca", "lock.json")) == ["lock.json"]
    fixture = sinks.projection_fixture(corpus, "unit", model, 4).orderBy("id").collect()
    assert [r["id"] for r in fixture] == [0, 2, 4, 6]
    units = {r["id"]: np.array(r["unit"]) for r in corpus.collect()}
    assert all(np.abs((units[r["id"]] - model.mean) @ model.components.T - r["projected"]).max() < 1e-6 for r in fixture)


def test_archive_lock_report_and_graph(spark, tmp_path):
    root = tmp_path / "site"
    (root / "data").mkdir(parents=True)
    (root / "b.json").write_text("b" * 5000)
    (root / "data" / "a.bin").write_bytes(b"a")
    rows = sinks.build_archive(str(root), str(tmp_path / "1.tar.gz"))
    os.utime(root / "b.json", (1, 1))
    assert sinks.build_archive(str(root), str(tmp_path / "2.tar.gz")) == rows and (tmp_path / "1.tar.gz").read_bytes() == (tmp_path / "2.tar.gz").read_bytes()
    assert [(r["name"], r["bytes"]) for r in rows] == [("b.json", 5000), ("data/a.bin", 1)]
    with tarfile.open(tmp_path / "1.tar.gz") as archive:
        assert archive.getnames() == ["b.json", "data/a.bin"] and archive.extractfile("data/a.bin").read() == b"a"
    lock = sinks.write_lock(str(tmp_path / "deep" / "lock.json"), "v1", str(tmp_path / "1.tar.gz"), rows)
    text = (tmp_path / "deep" / "lock.json").read_text()
    assert json.loads(text) == lock and text.endswith("}\n") and lock["sha256"] == hashlib.sha256((tmp_path / "1.tar.gz").read_bytes()).hexdigest()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root))
    report = {r["name"]: (r["bytes"], r["gzip"]) for r in sinks.size_report(files).collect()}
    assert report["b.json"][0] == 5000 > report["b.json"][1] and report[None] == tuple(sum(v[i] for k, v in report.items() if k) for i in (0, 1))
    edges = spark.createDataFrame([(1, 3), (1, 2), (1, 2), (4, 2)], "heading long, partner long")
    scores = spark.createDataFrame([(1, 2, 0.12345678), (1, 3, 1.0), (4, 2, 2.0)], "h_id long, id long, score double")
    graph, cases = sinks.pair_graph(edges, spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(2,)], "id long"), scores)
    assert {r["heading"]: r["partners"] for r in graph.collect()} == {1: [2, 3], 4: [2]} and [tuple(r) for r in cases.collect()] == [(1, 2, 0.123457)]


def test_aligned_and_remembered(spark, tmp_path):
    catalog = spark.createDataFrame([(0, 0.4), (1, 0.5), (2, None)], "id long, xh double")
    rendered = spark.createDataFrame([(1, 0.6, 0.1, 0.2, 1.0)], "id long, xh double, contrast double, aperture double, o_aspect double")
    rows, missing = sinks.aligned_features(catalog, rendered)
    assert sorted(map(tuple, rows.collect())) == [(0, 0.4, None, None, None), (1, 0.6, 0.1, 0.2, 1.0), (2, None, None, None, None)] and missing.first()["missing"] == 2
    calls = []
    make = lambda n: lambda: calls.append(n) or spark.range(n)
    for n, want in ((5, 1), (5, 1), (6, 2), (6, 2), (5, 3)):
        assert sinks.remembered(spark, str(tmp_path / "cache"), spark.range(n), make(n)).count() == n and len(calls) == want


def test_sheet_head(spark):
    rows = [("A", 400, "normal", "a.ttf", None)] * 2 + [("A", 700, "normal", "b.ttf", None), ("B & C", 400, "normal", None, "B+%26+C:wght@400"), ("B & C", 700, "normal", None, "B+%26+C:wght@400"), ("D", 400, "normal", None, None)]
    head = [tuple(r) for r in sinks.sheet_head(spark.createDataFrame(rows, "family string, weight int, style string, file string, css2 string")).collect()]
    assert len([h for h in head if h[0] == "face"]) == 2 and [h[1] for h in head if h[0] == "link"] == ['<link rel="stylesheet" href="https://fonts.googleapis.com/css2?family=B+%26+C:wght@400&amp;display=swap">']


def test_replace_source_is_idempotent(spark, corpus, tmp_path):
    path = str(tmp_path / "block")
    for source in ("google", "local"):
        sinks.replace_source(corpus.select("id", "source"), path, source)
    sinks.replace_source(corpus.where("id > 3").select("id", "source"), path, "local")
    sinks.replace_source(corpus.where("id > 3").select("id", "source"), path, "local")
    rows = spark.read.parquet(path)
    assert rows.where("source = 'google'").count() == 6 and [r["id"] for r in rows.where("source = 'local'").collect()] == [7]


def test_backfill_sheet_and_table_hash(spark, corpus):
    features = spark.createDataFrame([(0, 0.7, None)], "id long, xh double, width double")
    row = sinks.backfill(sinks.catalog_rows(corpus), features).where("id = 0").first()
    assert (row["xh"], row["width"]) == (0.7, 0.1235)
    rows = spark.createDataFrame([("A & B", 2, "<x>"), ("A & B", 1, "y")], "heading string, position int, partner string")
    assert sinks.sheet(rows).first()["html"] == "<section><h2>A &amp; B</h2><ul><li>y</li><li>&lt;x&gt;</li></ul></section>"
    small = corpus.drop("unit")
    assert sinks.table_hash(small, "id") == sinks.table_hash(small.repartition(5), "id") != sinks.table_hash(small.where("id > 0"), "id")


def test_streams(spark, corpus, tmp_path):
    source, out, block = (str(tmp_path / x) for x in ("in", "out", "block"))
    schema = "id long, source string"
    corpus.where("id < 4").select("id", "source").coalesce(1).write.parquet(source)
    project = lambda df: df.withColumn("twice", F.col("id") * 2)
    incremental.stream_corpus(spark, source, schema, project, out, str(tmp_path / "c1")).awaitTermination(60)
    corpus.where("id >= 4").select("id", "source").coalesce(1).write.mode("append").parquet(source)
    incremental.stream_corpus(spark, source, schema, project, out, str(tmp_path / "c1")).awaitTermination(60)
    assert sorted(r["twice"] for r in spark.read.parquet(out).collect()) == list(range(0, 16, 2))
    incremental.stream_blocks(spark, source, schema, block, str(tmp_path / "c2")).awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(block).collect()) == [3, 7]


def test_guard_passes_folders_that_cannot_be_searched(monkeypatch):
    import os

    stat = os.stat

    def closed(path, *rest, **more):
        if str(path) == "/data/sites/x/.git":
            raise PermissionError(13, "Permission denied", str(path))
        return stat(path, *rest, **more)

    monkeypatch.setattr(os, "stat", closed)
    sinks.refuse("/data/sites/x", ("/data/site",))

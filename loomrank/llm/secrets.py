"""Secret scan with character Markov models, by DataFrame functions alone.

Three rules find the base spans (kinds ``assign``, ``access``, ``hex``). The method adds spans of kind
``random``: of every maximal run of token characters that holds a letter and a digit and is likelier under a
first order character model of random strings than under one of ordinary identifiers, by a log-likelihood
ratio of at least ``THRESHOLD``, the parts that no base span covers. Both models are trained from labelled
samples: generated random strings and composed identifiers, and the words without digits of all documents.
An added span never overlaps a base span. Offsets are code points, the end is exclusive.

Arrays of spans are made from lengths by sums over blocks, and texts are cut block by block, so the work on
a text grows with its length and its number of matches, not with their product.

Results for odd input: a null text counts as empty and has no span; repeated rows are scanned each; an
empty table gives an empty result (the models then rest on the generated samples); other columns are
ignored by ``find_secrets`` and kept by ``redact``, whatever their names. Whole texts are scanned whatever
their length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import free_name

#: The three base rules and the least length of what they keep.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12

#: characters of the models; a character's number is its place here
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: natural log of the odds a run has to reach, about 60,000 to 1 against chance
THRESHOLD = 11.0
#: words of documents that train the identifier model
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]{6,}(?![A-Za-z0-9+/_=-])"
#: strings of each generated kind
GENERATED = 1_500
SMOOTHING = 0.5
#: Entries of an array that are summed together, and characters of a text that are cut together.
BLOCK, CUT = 256, 4_096

_KINDS = ("assign", "access", "hex", "random")
_PARTS = "get set user name list item file path data index count value table token cache node time date type page total first last read write parse build make load open close start stop max min order line key map row column test config default handler manager service request response session context buffer stream".split()


def _random_strings(spark: SparkSession) -> DataFrame:
    ids = spark.range(GENERATED)
    code = F.base64(F.unhex(F.sha2(F.concat(F.lit("r"), F.col("id").cast("string")), 256)))
    plain = F.regexp_replace(code, "[+/=]", "")
    kinds = F.array(F.substring(code, 1, 40), F.substring(plain, 1, 32), F.substring(F.upper(plain), 1, 24), F.substring(F.lower(plain), 1, 28), F.substring(F.sha2(F.concat(F.lit("h"), F.col("id").cast("string")), 256), 1, 40))
    return ids.select(F.explode(kinds).alias("s"), F.lit(1).alias("label"))


def _identifiers(spark: SparkSession) -> DataFrame:
    words = F.array(*[F.lit(p) for p in _PARTS])
    pick = lambda salt: (F.col("id") * 9 + salt) * 48_271 % 2_147_483_647  # noqa: E731  a counter's number, the same on every engine
    word = lambda salt: F.element_at(words, (pick(salt) % len(_PARTS) + 1).cast("int"))
    four = [word(i) for i in range(4)]
    number = (pick(8) % 1000).cast("string")
    kinds = F.array(F.concat_ws("_", *four), F.concat_ws("-", *four), F.concat(four[0], *[F.initcap(w) for w in four[1:]]), F.upper(F.concat_ws("_", *four)), F.concat_ws("/", *four), F.concat(F.concat_ws("_", *four), F.lit("_"), number))
    return spark.range(GENERATED).select(F.explode(kinds).alias("s"), F.lit(0).alias("label"))


def _corpus_words(docs: DataFrame) -> DataFrame:
    """(s, label 0, n): the distinct words of all documents and how often they stand there."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("s"))
    return words.groupBy("s").agg(F.count("*").alias("n")).where(~F.col("s").rlike(HEX)).select("s", F.lit(0).alias("label"), "n")


def ratio_table(samples: DataFrame) -> list[float]:
    """Log ratio of the transition probabilities (random over ordinary) for each pair of characters.

    ``samples`` has (s, label 0/1, n); the table has one entry for each pair of the alphabet and no more.
    """
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    pairs = samples.where(F.length("s") >= 2).select("label", "s", "n", at.alias("i")).select("label", "n", F.expr("substring(s, i, 1)").alias("x"), F.expr("substring(s, i + 1, 1)").alias("y"))
    counts = {(r["label"], r["x"], r["y"]): r["n"] for r in pairs.groupBy("label", "x", "y").agg(F.sum("n").alias("n")).where(F.lit(ALPHABET).contains(F.col("x")) & F.lit(ALPHABET).contains(F.col("y"))).collect()}
    k, table = len(ALPHABET), []
    sums = {(label, x): sum(counts.get((label, x, y), 0) for y in ALPHABET) for label in (0, 1) for x in ALPHABET}
    for x in ALPHABET:
        for y in ALPHABET:
            p = [(counts.get((label, x, y), 0) + SMOOTHING) / (sums[label, x] + SMOOTHING * k) for label in (0, 1)]
            table.append(round(math.log(p[1] / p[0]), 6))
    return table


def train(docs: DataFrame) -> list[float]:
    spark = docs.sparkSession
    made = _random_strings(spark).unionByName(_identifiers(spark)).withColumn("n", F.lit(1).cast("long"))
    return ratio_table(made.unionByName(_corpus_words(docs)))


def log_ratio(run: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a string of alphabet characters."""
    ratios = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.element_at(ratios, (a - 1) * len(ALPHABET) + b))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _none(kind: str = _SPANS) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body's lambdas name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """The sum of an int array up to and with each entry.

    An aggregate that grows an array copies it at every step, so sums are made in blocks of ``BLOCK`` entries
    and shifted by the sums of the blocks before.
    """
    empty = _none("array<int>")

    def sums(block: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.aggregate(block, begin, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))

    def shifted(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        before = F.aggregate(blocks, begin, lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, before, lambda b, s: F.transform(b["out"], lambda x: x + s)))

    def blocked(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), last), lambda b: sums(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), shifted)

    return _let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(empty))


def _placed(gaps: str, hits: str, keep: Column, rank: int) -> Column:
    """Spans of a pattern's matches from the texts between and in them; gaps has one entry more than hits."""
    sizes = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), F.zip_with(hits, keep, lambda h, k: F.struct(F.char_length(h).alias("n"), k.alias("keep"))), lambda g, h: F.struct((F.char_length(g) + h["n"]).alias("step"), h["n"].alias("n"), h["keep"].alias("keep")))
    span = lambda s, end: F.struct((end - s["n"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(_KINDS[rank]).alias("kind"), s["keep"].alias("keep"))
    spans = _let(sizes, lambda s: F.zip_with(s, running(s["step"]), span))
    return F.transform(F.filter(spans, lambda s: s["keep"]), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])).cast(_SPANS)


def _matches(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds <name>_hits and <name>_gaps; both are null where the pattern doesn't occur."""
    there = F.col(text).rlike(pattern)
    df = df.withColumn(f"{name}_there", there)
    return df.withColumns({f"{name}_hits": F.when(F.col(f"{name}_there"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), f"{name}_gaps": F.when(F.col(f"{name}_there"), F.split(text, pattern, -1))})


def _segments(events: Column) -> Column:
    """From (at, cover, inside) steps: the stretches between them as (start, end, cover, inside), without empty ones."""

    def between(e: Column) -> Column:
        own = F.zip_with(F.zip_with(e["at"], running(e["cover"]), lambda at, c: F.struct(at.alias("start"), c.alias("cover"))), running(e["inside"]), lambda s, i: F.struct(s["start"].alias("start"), s["cover"].alias("cover"), i.alias("inside")))
        ended = F.zip_with(own, F.slice(e["at"], F.lit(2), F.size(e)), lambda s, end: F.struct(s["start"].alias("start"), end.alias("end"), s["cover"].alias("cover"), s["inside"].alias("inside")))
        return F.filter(ended, lambda s: s["end"] > s["start"])

    return _let(F.array_sort(events), between)


def _steps(spans: Column, cover: int, inside: int) -> Column:
    """Where spans begin and end."""
    step = lambda at, sign: F.struct(at.alias("at"), F.lit(sign * cover).alias("cover"), F.lit(sign * inside).alias("inside"))
    return F.concat(F.transform(spans, lambda s: step(s["start"], 1)), F.transform(spans, lambda s: step(s["end"], -1)))


def _uncovered(runs: str, base: str) -> Column:
    """The parts of the spans ``runs`` that no span of ``base`` covers."""
    parts = F.filter(_segments(F.concat(_steps(F.col(base), 1, 0), _steps(F.col(runs), 0, 1))), lambda s: (s["cover"] == 0) & (s["inside"] > 0))
    spans = F.transform(parts, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit(_KINDS[3]).alias("kind"))).cast(_SPANS)
    return F.when(F.size(runs) > 0, spans).otherwise(_none())


def with_spans(docs: DataFrame, table: list[float], text_col: str = "text", out: str = "_secret") -> DataFrame:
    """``docs`` with two columns: <out>_base and <out>_all, sorted arrays of (start, rank, end, kind).

    No column of ``docs`` may begin with ``out``.
    """
    text = f"{out}_text"
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("random", RUN)):
        df = _matches(df, text, f"{out}_{name}", pattern)
    always = lambda c: F.transform(c, lambda x: F.lit(True))
    values = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= ASSIGN_VALUE)
    likely = F.transform(f"{out}_random_hits", lambda x: F.when(x.rlike("[0-9]") & x.rlike("[A-Za-z]"), log_ratio(x, table) >= THRESHOLD).otherwise(F.lit(False)))
    for rank, keep in enumerate((values, always(F.col(f"{out}_access_hits")), always(F.col(f"{out}_hex_hits")), likely)):
        name = f"{out}_{_KINDS[rank]}"
        df = df.withColumn(name, F.when(F.col(f"{name}_there"), _placed(f"{name}_gaps", f"{name}_hits", keep, rank)).otherwise(_none()))
    df = df.withColumn(f"{out}_base", F.array_sort(F.concat(f"{out}_assign", f"{out}_access", f"{out}_hex")))
    df = df.withColumn(f"{out}_all", F.array_sort(F.concat(F.col(f"{out}_base"), _uncovered(f"{out}_random", f"{out}_base"))))
    return df.drop(text, *[f"{out}_{k}{part}" for k in _KINDS for part in ("", "_there", "_hits", "_gaps")])


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, found array<struct<start,rank,end,kind>>)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = with_spans(rows, train(rows))
    count = lambda k: F.size(F.filter("_secret_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined("_secret_base"), 256).alias("base_sha256"), _joined("_secret_all").alias("spans"), F.col("_secret_all").alias("found"))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """A text with every stretch that spans cover replaced by ``mark``."""
    cuts = lambda blocks: F.transform(F.sequence(F.lit(0), F.size(blocks)), lambda b: F.struct((b * CUT).alias("at"), F.lit(0).alias("cover"), F.lit(0).alias("inside")))
    first = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("cover"), F.lit(0).alias("inside")))

    def piece(blocks: Column, s: Column, before: Column) -> Column:
        plain = F.substring(F.element_at(blocks, F.floor(s["start"] / CUT).cast("int") + 1), s["start"] % CUT + 1, s["end"] - s["start"])
        return F.when(s["cover"] == 0, plain).when(before["cover"] == 0, F.lit(mark)).otherwise(F.lit(""))

    def put(x: Column) -> Column:
        before = F.slice(F.concat(first, x["cut"]), F.lit(1), F.size(x["cut"]))
        return F.array_join(F.zip_with(x["cut"], before, lambda s, b: piece(x["blocks"], s, b)), "")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    return _let(blocks, lambda b: _let(F.struct(b.alias("blocks"), _segments(F.concat(_steps(spans, 1, 0), cuts(b))).alias("cut")), put))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every stretch of text that spans cover replaced by ``mark``; texts without a span and nulls stay as they are."""
    out = free_name(docs, "_secret")
    found = with_spans(docs, train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))), text_col, out)
    cut = _without(F.col(text_col), F.col(f"{out}_all"), mark)
    return found.withColumn(text_col, F.when(F.size(f"{out}_all") > 0, cut).otherwise(F.col(text_col))).select(*docs.columns)

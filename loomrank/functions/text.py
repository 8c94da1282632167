"""String, HTML and name functions as Column expressions (common regular-expression subset of Java and RE2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain(s: Column) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(s), "[^a-z0-9]+", "")


def label_of(family: Column, weight: Column, style: Column) -> Column:
    return F.concat(family, F.lit(" "), weight.cast("string"), F.when(style == "italic", " Italic").otherwise(""))


def css2_fragment(family: Column, weight: Column, style: Column, has_italic: Column) -> Column:
    name = F.replace(family, F.lit(" "), F.lit("+"))
    axis = F.when(has_italic, F.concat(F.lit(":ital,wght@"), F.when(style == "italic", "1").otherwise("0"), F.lit(","), weight.cast("string")))
    return F.concat(name, F.coalesce(axis, F.concat(F.lit(":wght@"), weight.cast("string"))))


def strip_tags(html: Column) -> Column:
    text = F.regexp_replace(html, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escape_html(s: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(char), F.lit(entity))
    return s


def headings(html: Column) -> Column:
    """Inner texts of h1 to h3."""
    return F.regexp_extract_all(html, F.lit(r"<h[1-3][^>]*>([^<]*)</h[1-3]>"), F.lit(1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), F.lit(1))


def families_of_stylesheet(url: Column) -> Column:
    """Family names of a css2 link: decoded, without axis ranges."""
    return F.transform(F.regexp_extract_all(url, F.lit(r"family=([^&:]+)"), F.lit(1)), lambda f: F.url_decode(f))


def css_families(css: Column) -> Column:
    """First family of every font-family declaration, without quotes."""
    return F.transform(F.regexp_extract_all(css, F.lit(r"font-family:\s*([^;}]+)"), F.lit(1)), lambda f: F.trim(F.translate(F.split(f, ",")[0], "\"'", "")))


def pair_headings(text: Column) -> Column:
    """(first, second) of headings such as ``3. Alpha & Beta`` or ``Label: Alpha + Beta``."""
    found = F.regexp_extract_all(text, F.lit(r"(?:\d+\.|[^:<>]+:)\s*([A-Z][\w ]+? [&+] [A-Z][\w ]+)"), F.lit(1))
    return F.transform(found, lambda f: F.transform(F.split(f, r" [&+] "), lambda x: F.trim(x)))


def cleaned_name(raw: Column, parentheses: bool = True) -> Column:
    """A name without entities, doubled spaces and closing marks; with ``parentheses`` false also without what stands in them."""
    name = F.replace(F.replace(raw, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" ")) if parentheses else F.regexp_replace(raw, r"\([^)]*\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[\s\x{A0}]+", " "), "[.,;:!?]+$", ""))


def names_a_cut(word: Column) -> Column:
    """Whether a word names a weight or style."""
    return F.lower(word).rlike(rf"^(?:(?:{'|'.join(K.CUT_PREFIXES)})-+)?(?:{'|'.join(K.CUT_WORDS)})$")


def prefixes_without_qualifiers(name: Column) -> Column:
    """The name, then ever shorter ones while its last word names a cut and another stands before it."""
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    cut = F.aggregate(F.reverse(words), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, w: F.struct((a["n"] + F.when(a["on"] & names_a_cut(w), 1).otherwise(0)).alias("n"), (a["on"] & names_a_cut(w)).alias("on")), lambda a: a["n"])
    lengths = F.filter(F.sequence(F.size(words), F.size(words) - cut, F.lit(-1)), lambda n: n > 0)
    return F.transform(lengths, lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))


def kin(a: Column, b: Column) -> Column:
    """Whether two names share leading words and differ by class words alone."""
    x, y = F.split(F.lower(a), " "), F.split(F.lower(b), " ")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(x), F.size(y))), lambda i: F.slice(x, F.lit(1), i) == F.slice(y, F.lit(1), i)))
    rest = F.concat(F.slice(x, same + 1, F.size(x)), F.slice(y, same + 1, F.size(y)))
    return (same >= 1) & F.forall(rest, lambda w: w.isin(*K.CLASS_WORDS))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def name_words(s: Column) -> Column:
    """Words of a file stem: camel case and non-letters split, lower case."""
    spaced = F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, "[^A-Za-z]+", " ")), " "), lambda w: w != "")


def weight_of_words(s: Column, default: int = 400) -> Column:
    """The first weight word of a name in a fixed order."""
    out = F.lit(default)
    for word, value in reversed((("thin", 100), ("extralight", 200), ("light", 300), ("medium", 500), ("semibold", 600), ("extrabold", 800), ("bold", 700), ("black", 900))):
        out = F.when(F.lower(s).rlike(rf"\b{word}\b"), value).otherwise(out)
    return out


def style_of(name: Column, mac_style: Column, selection: Column) -> Column:
    return F.when(F.lower(name).rlike("italic|oblique") | (mac_style.bitwiseAND(2) != 0) | (selection.bitwiseAND(1) != 0), "italic").otherwise("normal")


def category_guess(fixed_pitch: Column, panose_family: Column, panose_serif: Column) -> Column:
    """monospace, serif or sans-serif from a face's own tables; sans-serif where they tell nothing."""
    text_face = F.coalesce(panose_family == 2, F.lit(False))
    return F.when(F.coalesce(fixed_pitch != 0, F.lit(False)), "monospace").when(text_face & panose_serif.between(2, 10), "serif").otherwise("sans-serif")


def usable_name(value: Column) -> Column:
    """The trimmed name where it has a letter or digit, else null."""
    return F.when(value.rlike(r"[\p{L}\p{N}]"), F.trim(value))


def family_name(records: Column, folder: Column, stem: Column) -> Column:
    """The first usable of a face's name records, else its folder, else its file's stem as it is."""
    named = F.transform(records, usable_name)
    return F.coalesce(F.try_element_at(F.filter(named, lambda n: n.isNotNull()), F.lit(1)), F.when(usable_name(folder).isNotNull(), folder), usable_name(stem), stem)


def file_qualifier(family: Column, stem: Column, known: tuple[str, ...], cuts: tuple[str, ...]) -> Column:
    """What a file's name says beyond family and cut, as capitalized words; null where any word of it isn't ``known`` or it is x alone."""
    rest = F.filter(F.array_except(name_words(stem), name_words(family)), lambda w: ~w.isin(*cuts))
    said = (F.size(F.array_remove(rest, "x")) > 0) & F.forall(rest, lambda w: w.isin(*known))
    return F.when(said, F.array_join(F.transform(rest, lambda w: F.initcap(w)), " "))

"""Text rules as Column expressions; all of them stay inside the JVM but ``full_fold`` and ``composed``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that carry no topic, words that ask for a chart, kinds of files.
STOPWORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might shall can not no nor so yet both either "
    "neither each few more most other some such than too very just that this these those there their they them what which who whom when where why how all any also into about after before "
    "between through during above below over under again further then once here only own same up out its our your his her we he she it i you my me us him hers ours yours theirs"
).split()
CHART_WORDS = ("chart", "graph", "plot", "visualiz", "visualis", "pie chart", "bar chart", "line chart", "trend", "breakdown", "distribution", "compare", "over time")
SHEET_TYPES, IMAGE_TYPES = ("xlsx", "xls", "csv"), ("jpg", "jpeg", "png", "gif", "webp", "bmp")
MIME_TYPES = {"png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}

#: Latin letters that fold to one plain letter, by the Unicode decomposition.
_FOLDED = {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250) if len([x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)]) == 1 and unicodedata.normalize("NFKD", chr(c)) != chr(c)}


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """The canonical composition (NFC), which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def cleaned(text: Column) -> Column:
    """Without replacement characters, control characters (tab and line ends stay) and stray backslashes."""
    out = F.regexp_replace(text, "\ufffd", "")
    out = F.regexp_replace(out, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", "")
    return F.regexp_replace(out, r"\\(?![\\ntbrfux])", "")


def plain(text: Column) -> Column:
    """Whether a text holds nothing that cleaning or composition could change: below U+0300 nothing composes.

    One range and a few letters, as a class of many ranges takes many times as long.
    """
    return ~(text.rlike("[^\\n\\t\\r\\x20-\\u02ff]") | F.contains(text, F.lit("\\")) | F.contains(text, F.lit("\x7f")))


def sanitised(text: Column) -> Column:
    """Cleaned, and composed by a vectorised function."""
    return composed(cleaned(text))


def folded(text: Column) -> Column:
    """Small letters without accents, only letters, digits, dots and dashes, one space apart.

    Accents of Latin letters; ``full_fold`` decomposes any script.
    """
    plain = F.translate(F.lower(text), "".join(_FOLDED), "".join(_FOLDED.values()))
    plain = F.regexp_replace(plain, "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9\\s.-]", " "), "\\s+", " "))


@F.pandas_udf(StringType())
def full_fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition of any script, without the marks."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t.lower()) if not "̀" <= c <= "ͯ"))


def search_folded(text: Column) -> Column:
    """``folded``, of compatibility characters (ligatures, full-width letters, other scripts' marks) too.

    Only texts with letters beyond Latin-1 and Latin Extended-A leave the JVM to be decomposed.
    """
    odd = F.when(text.rlike("[^\\x00-\\u017f]"), text)
    return folded(F.coalesce(full_fold(odd), text))


def tokens(text: Column) -> Column:
    """Search tokens: folded words of more than two characters."""
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), " "), lambda w: F.length(w) > 2)


def keywords(text: Column) -> Column:
    """Topic words: runs of ASCII word characters, longer than three, no stop words."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\W+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOPWORDS))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


# The patterns below are fixed values: they define what is a sentence, markup and a page.


def sentences(text: Column) -> Column:
    return F.split(text, r"""(?<=[.?!])\s+(?=[A-Z0-9"'(])""")


def nonblank_words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def page_count(text: Column, words_per_page: int = 400) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.size(nonblank_words(text)) / words_per_page)).cast("long")


def read_minutes(text: Column) -> Column:
    return F.ceil(F.size(F.split(text, " ")) / 200).cast("long")


def up_to_page(text: Column, page: int, words_per_page: int = 400) -> Column:
    return F.array_join(F.slice(nonblank_words(text), 1, page * words_per_page), " ")


def context_line(text: Column, size: int = 600) -> Column:
    return F.regexp_replace(F.substring(text, 1, size), r"\n+", " ")


def ocr_cleaned(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "\f", "\n"), "[ \\t]+\\n", "\n")
    return F.regexp_replace(F.regexp_replace(out, "\\n{3,}", "\n\n"), "^\\s+|\\s+$", "")


def without_markdown(text: Column) -> Column:
    out = F.regexp_replace(text, "```[\\s\\S]*?```", "")
    for pattern, to in (("`([^`]*)`", "$1"), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"#+\s?", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r">\s?", "")):
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, "^\\s+|\\s+$", "")


def line_kind(line: Column) -> Column:
    """Block kind of a line of light markup: heading, bullet, number, blank or text."""
    return F.when(F.rlike(line, F.lit(r"^#{1,6}\s")), "heading").when(F.rlike(line, F.lit(r"^\s*[-*]\s")), "bullet").when(F.rlike(line, F.lit(r"^\s*\d+\.\s")), "number").when(F.trim(line) == "", "blank").otherwise("text")


def slug(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(out == "", "chart").otherwise(F.coalesce(out, F.lit("chart")))


def human_size(size: Column) -> Column:
    """1024 steps, two decimals without trailing zeros."""
    step = F.when(size < 1024, 0).when(size < 1024**2, 1).when(size < 1024**3, 2).otherwise(3)
    shown = F.format_string("%.2f", F.round(size / F.pow(F.lit(1024.0), step), 2))
    short = F.regexp_replace(F.regexp_replace(shown, "0+$", ""), "\\.$", "")
    return F.when(size == 0, "0 Bytes").otherwise(F.concat_ws(" ", short, F.element_at(F.array(*map(F.lit, ("Bytes", "KB", "MB", "GB"))), step + 1)))


def relative_day(at: Column, now: Column) -> Column:
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)
    return F.when(days == 0, "Today").when(days == 1, "Yesterday").when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(at, "MMM d, yyyy"))


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def file_route(name: Column) -> Column:
    """Which reader a file goes to; the case of its ending does not matter."""
    e = extension(name)
    return F.when(e.isin(*SHEET_TYPES), "spreadsheet").when(e == "pdf", "pdf").when(e == "txt", "text").when(e == "docx", "docx").when(e.isin(*IMAGE_TYPES), "image").otherwise("unsupported")


def mime_type(name: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair]), extension(name)), F.lit("image/jpeg"))


def wants_chart(question: Column) -> Column:
    return F.exists(F.array(*map(F.lit, CHART_WORDS)), lambda w: F.contains(F.lower(question), w))


def asks_for_topics(question: Column) -> Column:
    return F.rlike(question, F.lit("(?i)topic|cluster|categor|group"))


def figure_text(caption: Column, seen: Column) -> Column:
    """The searchable text of a figure: its caption and what can be read in it."""
    return F.concat(F.lit("[Figure Analysis]\n"), F.coalesce(caption, F.lit("")), F.lit("\n\n[OCR Text]\n"), F.coalesce(F.nullif(seen, F.lit("")), F.lit("(no text detected)")))


def preview(text: Column) -> Column:
    """One line of a text in light markup, for lists."""
    out = text
    for pattern, to in (("(?m)^#{1,4}\\s+", ""), ("(?m)^[-*]\\s+", ""), ("(?m)^\\d+[.)]\\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), ("\\n+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def finite(value: Column) -> Column:
    """A number as the web reads it: blank is 0, true 1, hexadecimal allowed, else null."""
    t = F.trim(value)
    number = t.try_cast("double")
    hexadecimal = F.conv(F.substring(t, 3, 16), 16, 10).try_cast("double")
    out = F.when(t == "", 0.0).when(t == "true", 1.0).when(t == "false", 0.0).when(F.rlike(t, F.lit("^0[xX][0-9a-fA-F]{1,15}$")), hexadecimal).when(F.rlike(t, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), number)
    return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)


def error_text(message: Column, size: int = 2000) -> Column:
    return F.substring(message, 1, size)


def image_text(description: Column, read: Column) -> Column:
    """What is indexed of an uploaded image."""
    return F.concat(F.lit("[Image Analysis]\n"), description, F.lit("\n\n[OCR Text]\n"), F.coalesce(F.nullif(F.trim(read), F.lit("")), F.lit("(no text detected)")))


def storage_text(size: Column) -> Column:
    """``512 MB`` below a gigabyte, else ``1.5 GB``; both rounded half up."""
    mb = size / (1024 * 1024)
    return F.when(mb < 1024, F.concat(F.floor(mb + 0.5).cast("string"), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", F.round(mb / 1024, 1)), F.lit(" GB")))


# Icons by file ending.
ICONS = {
    "FileText": ("pdf", "doc", "docx", "txt"), "Sheet": ("csv", "xlsx", "xls"), "Image": ("jpg", "jpeg", "png", "gif", "webp", "bmp"), "Video": ("mp4", "avi", "mov"), "Music": ("mp3", "wav"),
}


def icon(name: Column) -> Column:
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.coalesce(*[F.when(ending.isin(*endings), name_) for name_, endings in ICONS.items()], F.lit("File"))


def figure_key(user: Column, project: Column, document: Column, figure: Column) -> Column:
    return F.concat(F.concat_ws("/", F.lit("uploads"), user, project, document, F.lit("figures"), figure), F.lit(".png"))


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def up_to_share(text: Column, page: Column, pages: Column) -> Column:
    """The text up to a page where only the number of pages is known: that share of its characters, rounded up."""
    return F.substr(text, F.lit(1), F.ceil(F.length(text) * F.least(page, pages) / pages).cast("int"))


def cited_parts(answer: Column, names: Column) -> Column:
    """The answer cut at the file names given: structs (part, cited), names kept as parts of their own.

    Where several names begin at one place the first of the list counts. Names are taken
    literally: each is replaced by a pair of marks around its place in the list.
    """
    pattern = F.concat(F.lit("("), F.array_join(F.transform(names, lambda n: F.concat(F.lit("\\Q"), n, F.lit("\\E"))), "|"), F.lit(")"))
    marked = F.when(F.size(names) > 0, F.regexp_replace(answer, pattern, F.lit("\x02$1\x02"))).otherwise(answer)
    return F.transform(F.split(marked, "\x02"), lambda part, k: F.struct(part.alias("part"), (k % 2 == 1).alias("cited")))


def markdown_blocks(content: Column) -> Column:
    """Blocks of light markup as structs (kind, items): lines that follow each other and are of one kind are one block.

    Headings stand alone, blank lines only end a block, and a block of text is one item, its lines a space apart.
    """
    lines = F.transform(F.split(content, "\n"), lambda x: F.struct(line_kind(x).alias("kind"), F.trim(F.regexp_replace(x, r"^\s*(#{1,6}|[-*]|\d+\.)\s+", "")).alias("text"), F.trim(x).alias("raw")))
    empty = F.array().cast("array<struct<kind:string,items:array<string>>>")

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        item = F.when(x["kind"] == "text", x["raw"]).otherwise(x["text"])
        fresh = F.concat(done, F.array(F.struct(x["kind"].alias("kind"), F.array(item).alias("items"))))
        joined = F.when(x["kind"] == "text", F.array(F.concat(last["items"][0], F.lit(" "), item))).otherwise(F.concat(last["items"], F.array(item)))
        same = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(x["kind"].alias("kind"), joined.alias("items"))))
        return F.when((F.size(done) > 0) & (x["kind"] == last["kind"]) & ~x["kind"].isin("heading"), same).otherwise(fresh)

    return F.filter(F.aggregate(lines, empty, step), lambda b: b["kind"] != "blank")

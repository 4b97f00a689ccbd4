"""One consistent form for texts that look the same: a longest-match transducer over grapheme clusters.

The transducer is compiled once, before any text is seen, from the Unicode tables: what each character is taken apart into (compatibility and width forms, accents, look-alike letters,
blanks, nothing for invisible ones), the combining class of each mark, and what each letter and mark compose. A cluster is a character with everything after
it that may merge into it (marks, invisible characters, conjoining letters, half-width voice marks), the longest such run, or a lone character whose form differs from itself. One
pass copies everything else and sends each cluster through the tables; the compilation fails if any form of a character or of a composing pair is not its own form.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.plans.lineage import store

# Letters of other scripts drawn like a Latin letter.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y",
    "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
}
GREEK = {"Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J", "ο": "o", "ϳ": "j"}
# Ignorable characters outside the format category, and format characters that are drawn.
IGNORABLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, [*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
DRAWN = "؀؁؂؃؄؅۝܏࢐࢑࣢\U000110bd\U000110cd"
LINE_BREAKS = "\n\x0b\x0c\r\x85  "

LOOKALIKES = CYRILLIC | GREEK
_TABLE = str.maketrans(LOOKALIKES)


def invisible(c: str) -> bool:
    """A character without a visible mark that is neither a blank nor a line break."""
    if c in LINE_BREAKS or c == "\t":
        return False
    return c in IGNORABLE or (unicodedata.category(c) in ("Cf", "Cc") and c not in DRAWN)


def blank(c: str) -> bool:
    """Any kind of blank; line breaks are none."""
    return c in "\t⠀" or unicodedata.category(c) == "Zs"


def form(cluster: str) -> str:
    """The consistent form of a piece of text, worked out in full."""
    seen = "".join(c for c in cluster if not invisible(c))
    parts = unicodedata.normalize("NFKD", seen)
    parts = "".join(" " if blank(c) else c for c in parts if not invisible(c))
    return unicodedata.normalize("NFC", parts.translate(_TABLE))


def _ranges(points: list[int]) -> str:
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(re.escape(chr(points[i])) + ("-" + re.escape(chr(points[j])) if j > i else ""))
        i = j + 1
    return "".join(out)


class Tables:
    """The compiled mapping."""

    def __init__(self, points: list[int]):
        self.parts: dict[str, str] = {}  # a character that is not left as it is, taken apart
        self.rank: dict[str, int] = {}  # combining classes but 0
        self.pairs: dict[str, str] = {}  # two characters and what they compose
        for c in map(chr, points):
            apart = "" if invisible(c) else "".join(" " if blank(x) else x for x in unicodedata.normalize("NFKD", c) if not invisible(x)).translate(_TABLE)
            if apart != c:
                self.parts[c] = apart
            if k := unicodedata.combining(c):
                self.rank[c] = k
            split = unicodedata.decomposition(c)
            if split and not split.startswith("<") and len(two := "".join(chr(int(x, 16)) for x in split.split())) == 2 and unicodedata.normalize("NFC", c) == c:
                self.pairs[two] = c

    def composed(self, a: str, b: str) -> str | None:
        x, y = ord(a), ord(b)
        # Where the conjoining letters and the syllables made of them begin, and how many there are.
        if 0x1100 <= x < 0x1113 and 0x1161 <= y < 0x1176:
            return chr(0xAC00 + ((x - 0x1100) * 21 + y - 0x1161) * 28)
        if 0xAC00 <= x < 0xD7A4 and not (x - 0xAC00) % 28 and 0x11A8 <= y < 0x11C3:
            return chr(x + y - 0x11A7)
        return self.pairs.get(a + b)

    def form(self, cluster: str) -> str:
        """The form of a cluster: taken apart, marks in the order of their classes, composed."""
        marks = "".join(self.parts.get(c, c) for c in cluster)
        out: list[str] = []
        starter, low = -1, 0
        for c in self._ordered(marks):
            rank = self.rank.get(c, 0)
            # A mark meets its letter unless one of its own class, or a letter, stands between.
            if starter >= 0 and (low < rank or starter == len(out) - 1) and (joined := self.composed(out[starter], c)):
                out[starter] = joined
                continue
            if not rank:
                starter = len(out)
            low = rank
            out.append(c)
        return "".join(out)

    def _ordered(self, text: str) -> list[str]:
        out = list(text)
        i = 0
        while i < len(out):
            j = i
            while j < len(out) and out[j] in self.rank:
                j += 1
            if j - i > 1:
                out[i:j] = sorted(out[i:j], key=self.rank.__getitem__)
            i = j + 1
        return out


class _Forms(dict):
    """Clusters that were met, bounded whatever the texts hold."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, cluster: str) -> str:
        found = self.tables.form(cluster)
        if len(self) < 1 << 20 and len(cluster) <= 64:
            self[cluster] = found
        return found


@cache
def _compiled() -> tuple[re.Pattern, re.Pattern, _Forms]:
    """The runs that trail a character, the characters that change by themselves, and the mapping."""
    # Ranges of ideographs, syllables, surrogates and planes without characters whose form differs from themselves.
    alone = [(0x3400, 0xA000), (0xAC00, 0xD7A4), (0xD800, 0xF900), (0x17000, 0x18E00), (0x20000, 0x2F800), (0x30000, 0x323B0), (0x323B0, 0xE0000), (0xE1000, 0x110000)]
    ends = [0, *(x for pair in alone for x in pair)]
    points = [p for low, high in zip(ends[::2], [*ends[1::2], 0x110000], strict=True) for p in range(low, high)]
    tables = Tables(points)
    second = {two[1] for two in tables.pairs}
    trail, odd = [], []
    for p in points:
        c = chr(p)
        base = unicodedata.normalize("NFKD", c)
        if invisible(c) or unicodedata.combining(base[0]) or base[0] in second or 0x1160 <= ord(base[0]) < 0x1200:
            trail.append(p)
        elif tables.form(c) != c:
            odd.append(p)
    marks = sorted({two[1] for two in tables.pairs})
    for x in [*map(chr, trail), *map(chr, odd), *tables.pairs, *(c + m for c in LOOKALIKES for m in marks)]:
        if tables.form(f := tables.form(x)) != f:
            raise ValueError(f"the mappings of {x!r} contradict each other")
    # A class of characters is quick only within the first plane, so all beyond it count as trailing: their clusters are longer than they need be, their forms the same.
    first = lambda x: _ranges([p for p in x if p < 0x10000])
    return re.compile(f"[{first(trail)}\U00010000-\U0010ffff]+"), re.compile(f"[{first(odd)}]"), _Forms(tables)


_ASCII_ODD = re.compile(r"[\x00-\x09\x0e-\x1f\x7f]")


def consistent(text: str) -> str:
    """The consistent form: invisible characters gone, compatibility and width forms plain, every blank a plain blank, accents composed, look-alike
    letters Latin. Letter case, accents, digits, punctuation, line breaks and the number of blanks stay. A form is its own form."""
    if text.isascii():
        return _ASCII_ODD.sub(lambda m: " " if m[0] == "\t" else "", text) if _ASCII_ODD.search(text) else text
    trailing, single, forms = _compiled()
    out, done = [], 0
    for m in trailing.finditer(text):
        base = max(m.start() - 1, done)  # a cluster is what trails and the character before it
        out += (single.sub(lambda x: forms[x[0]], text[done:base]), forms[text[base : m.end()]])
        done = m.end()
    out.append(single.sub(lambda x: forms[x[0]], text[done:]))
    return "".join(out)


def consistent_texts(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form) of every row. A null text has a null form, an empty one an empty form; repeated rows stay repeated; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if x is None else consistent(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(done, pa.string())], ["id", "form"])

    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return named.mapInArrow(run, "id long, form string")


def text_prints(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, form, text) of every row with a text and an id: 128-bit hashes of the consistent form and of the stored text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([short(consistent(x)) for x in texts], pa.binary()), pa.array([short(x) for x in texts], pa.binary())], ["id", "form", "text"])

    named = rows.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return named.filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "id long, form binary, text binary")


def same_looking(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows whose stored texts differ and whose consistent forms are equal; each pair once.

    Null texts and null ids are no case, the empty text is a text like any other, repeated rows count once. Rows of one stored text are never
    compared with each other: only the differing texts of a form are paired, then each is replaced by the ids that hold it.
    """
    prints = store(text_prints(rows, id_column, text_column), "prints")
    texts = prints.select("form", "text").distinct()
    several = texts.groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    texts = texts.join(several, "form")
    one = texts.select("form", F.col("text").alias("t1"))
    two = texts.select("form", F.col("text").alias("t2"))
    pairs = one.join(two, "form").filter("t1 < t2").select("t1", "t2")
    holders = prints.join(several, "form", "left_semi").select("id", "text").distinct()
    x = holders.select(F.col("id").alias("x"), F.col("text").alias("t1"))
    y = holders.select(F.col("id").alias("y"), F.col("text").alias("t2"))
    both = pairs.join(x, "t1").join(y, "t2").filter("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def look_alike_classes(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(class_id, n_documents, n_texts): a row for each consistent form that several different stored texts have, named by the smallest id, with the number of ids and of texts.

    What same_looking() pairs, without the pairs: a form that a third of all rows share is one row, counted before anything is shuffled by it.
    """
    prints = text_prints(rows, id_column, text_column).groupBy("form", "text").agg(F.min("id").alias("id"), F.count_distinct("id").alias("n"))
    one = prints.groupBy("form").agg(F.min("id").alias("class_id"), F.sum("n").alias("n_documents"), F.count("*").alias("n_texts"))
    return one.filter("n_texts > 1").select("class_id", "n_documents", "n_texts")

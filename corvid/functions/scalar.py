"""Column functions of the engine: vectors, text spans, tokens, XML, intervals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length, empty ones and those of norm 0."""
    n = norm(a) * norm(b)
    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (n > 0)
    return F.when(fine, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_similarity(a: Column, b: Column) -> Column:
    """1 / (1 + squared Euclidean distance)."""
    return 1 / (1 + F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


#: The code points of the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_unicode(x: Column, side: str = "both") -> Column:
    """Without white space at both ends or at the left one."""
    return (F.ltrim if side == "left" else F.btrim)(x, F.lit(WHITE_SPACE))


def tokens(x: Column) -> Column:
    """Lower-case ASCII alphanumeric runs."""
    return F.array_remove(F.split(F.lower(x), "[^a-z0-9]+"), "")


def estimated_tokens(x: Column) -> Column:
    return F.floor(F.length(x) / 4)


def xml_escape(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def xml_unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def counted_tokens(x: Column) -> Column:
    """Tokens of a text where no vocabulary is at hand: a tenth more than a quarter of its characters, rounded up."""
    return F.when(F.length(x) > 0, F.ceil((F.ceil(F.length(x) / 4) * 11) / 10)).otherwise(F.lit(0)).cast("long")


def embed(text: Column, dimension: int = 64) -> Column:
    """A deterministic embedder: counts of words by FNV-1a of their UTF-8 bytes modulo ``dimension``, scaled to length 1; a null text
    or one without words is all zeros. An Arrow function, as any model's would be; a task remembers the places of words."""
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        import re

        import numpy as np

        word, places = re.compile(r"[^\W_]+"), {}

        def place(w: str) -> int:
            h = 0xCBF29CE484222325  # fixed values of FNV-1a
            for b in w.encode():
                h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            places[w] = h % dimension
            return places[w]

        def one(t: str | None) -> list[float]:
            found = [places[w] if w in places else place(w) for w in word.findall((t or "").lower())]
            counts = np.bincount(np.array(found, int), minlength=dimension).astype(float)
            return (counts / (np.sqrt((counts * counts).sum()) or 1.0)).tolist()

        return texts.map(one)

    return run(text)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))

"""Cleaning and encoding of labels and page texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Labels that stand for "nothing readable", compared in lower case.
UNREADABLE = ("unreadable", "nan", "none", "null", "", "#", "?")
#: Printable ASCII, the default alphabet; with the blank it has 96 classes.
PRINTABLE = "".join(map(chr, range(32, 127)))
SPACES = r"(?U)[\s\x1c-\x1f]+"


def collapse(text: Column) -> Column:
    """White space of any kind, in any number, becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def sanitise_label(label: Column, strict: bool = False) -> Column:
    """A label that fits one line of a manifest; null, or with `strict` an error, if nothing is left."""
    clean = F.nullif(collapse(label), F.lit(""))
    return F.coalesce(clean, F.raise_error(F.lit("a label is empty")).cast("string")) if strict else clean


class Charset:
    """An ordered alphabet; classes are 1-based, 0 is the blank."""

    def __init__(self, alphabet: str = PRINTABLE, lowercase: bool = False):
        if lowercase:
            alphabet = "".join(dict.fromkeys(alphabet.lower()))
        if not alphabet:
            raise ValueError("the alphabet is empty")
        if len(set(alphabet)) != len(alphabet):
            raise ValueError("the alphabet repeats a character")
        self.alphabet, self.lowercase = alphabet, lowercase

    @property
    def num_classes(self) -> int:
        return len(self.alphabet) + 1

    def token(self, index: int) -> str:
        return "" if index == 0 else self.alphabet[index - 1]

    def normalize(self, text: Column) -> Column:
        return F.lower(collapse(text)) if self.lowercase else collapse(text)

    def characters(self, text: Column) -> Column:
        return F.filter(F.split(self.normalize(text), ""), lambda c: c != "")

    def _letters(self) -> Column:
        return F.array(*[F.lit(c) for c in self.alphabet])

    def unsupported(self, text: Column) -> Column:
        """Sorted distinct characters outside the alphabet."""
        return F.array_sort(F.array_except(self.characters(text), self._letters()))

    def is_encodable(self, text: Column) -> Column:
        return F.size(self.unsupported(text)) == 0

    def encode(self, text: Column, strict: bool = False) -> Column:
        """Classes of the characters; others are dropped or, with `strict`, an error."""
        codes = F.create_map(*[x for i, c in enumerate(self.alphabet) for x in (F.lit(c), F.lit(i + 1))])
        found = F.transform(self.characters(text), lambda c: F.element_at(codes, c))
        if strict:
            found = F.when(F.exists(found, lambda i: i.isNull()), F.raise_error(F.lit("a character is outside the alphabet")).cast("array<int>")).otherwise(found)
        return F.filter(found, lambda i: i.isNotNull())

    def encoded_length(self, text: Column) -> Column:
        """The size of encode(), without making the array."""
        inside = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in self.alphabet)
        return F.length(F.regexp_replace(self.normalize(text), f"[^{inside}]", ""))

    def decode(self, indices: Column) -> Column:
        """The text of classes; blanks and unknown classes are skipped, nothing is merged."""
        known = F.filter(indices, lambda i: (i > 0) & (i < self.num_classes))
        return F.array_join(F.transform(known, lambda i: F.element_at(self._letters(), i)), "")


def nfkc(text: Column) -> Column:
    """Compatibility composition; only texts beyond ASCII reach Python, in Arrow batches."""
    import unicodedata

    @F.pandas_udf(StringType())
    def compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(compose(F.when(~text.rlike(r"^[\x00-\x7F]*$"), text)))


def normalize_text(text: Column, lower: bool = False, whitespace: bool = True, alnum_only: bool = False, compose: bool = True) -> Column:
    """In this order: NFKC, white space, ASCII letters and digits only, lower case."""
    if compose:
        text = nfkc(text)
    if whitespace:
        text = collapse(text)
    if alnum_only:
        text = F.regexp_replace(text, r"[^0-9a-zA-Z]+", "")
    return F.lower(text) if lower else text


# What a word-level tokeniser's spaces look like, in the order of undoing; only white space changes.
DETOKENISE = (
    (r"(\d)\s+\.\s+(\d)", "$1.$2"),  # 51 . 25
    (r"\s+([,;:!?%])", "$1"),
    (r"\s+\.", "."),
    (r"([(\[{$])\s+", "$1"),
    (r"\s+([)\]}])", "$1"),
    (r"(\w)\s*'\s*(\w)", "$1'$2"),  # don ' t
    (r"(\w)\s+-\s+(\w)", "$1-$2"),
    (r"(\d),\s+(\d)", "$1,$2"),  # 1, 250
    (r"[ \t]{2,}", " "),
)


def detokenize(text: Column, mode: str = "detokenize") -> Column:
    """Undoes the spaces of word-level tokenisers, line by line."""
    if mode == "none":
        return text
    if mode != "detokenize":
        raise ValueError(f"unknown mode {mode!r}")

    def line(t: Column) -> Column:
        for pattern, put in DETOKENISE:
            t = F.regexp_replace(t, "(?U)" + pattern, put)
        return F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def clip_label(text: Column, alphabet: str = PRINTABLE, most: int = 76, least: int = 3) -> Column:
    """Only characters of the alphabet, at most `most`; cut at the last space unless less than `least` would stay."""
    inside = "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in alphabet)
    clean = collapse(F.regexp_replace(text, f"[^{inside}]", ""))
    head = F.substring(clean, 1, most)
    space = F.when(F.locate(" ", head) == 0, -1).otherwise(F.length(head) - F.locate(" ", F.reverse(head)))
    cut = F.when(space >= least, F.substring(head, F.lit(1), space)).otherwise(head)
    return F.trim(F.when(F.length(clean) > most, cut).otherwise(clean))


def safe_filename(name: Column, fallback: str = "extracted-text", most: int = 60) -> Column:
    clean = F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"[^A-Za-z0-9._-]+", "-")
    clean = F.regexp_replace(F.substring(F.regexp_replace(clean, r"^[-._]+|[-._]+$", ""), 1, most), r"[-._]+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def line_endings(text: Column, ending: str = "\r\n", mark: bool = False) -> Column:
    """One kind of line ending; a byte order mark in front if asked for."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n", ending)
    return F.concat(F.lit("﻿"), clean) if mark else clean


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def text_counts(text: Column) -> Column:
    """struct(characters, words, lines)."""
    words = F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))
    return F.struct(F.length(text).alias("characters"), words.alias("words"), F.when(text == "", 0).otherwise(F.size(F.split(text, "\n"))).alias("lines"))


def line_image_path(line_id: Column) -> Column:
    """a01-000u-00 -> lines/a01/a01-000u/a01-000u-00.png"""
    form = F.regexp_extract(line_id, r"^(.*)-[^-]*$", 1)
    return F.concat(F.lit("lines/"), F.substring_index(line_id, "-", 1), F.lit("/"), form, F.lit("/"), line_id, F.lit(".png"))

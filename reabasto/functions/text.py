"""Text, number and date normalisation as Column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _reductions() -> tuple[str, str]:
    """Every lower-case letter that decomposes to one letter and marks, and that letter."""
    accented, plain = [], []
    for code in range(0x80, sys.maxunicode + 1):
        letter = chr(code)
        if not letter.isalpha() or letter.lower() != letter or unicodedata.category(letter) == "Lo" and code > 0xFF:
            continue
        bare = [c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)]
        if len(bare) == 1 and bare[0] != letter and bare[0].isalpha():
            accented.append(letter)
            plain.append(bare[0])
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _reductions()
_NOT_ALPHANUMERIC = r"[^\p{L}\p{N}]"


def strip_accents(col: Column) -> Column:
    """Lower-case accented letters to plain ones; combining marks are dropped. Text of single bytes has none."""
    stripped = F.regexp_replace(F.translate(col, ACCENTED, PLAIN), r"\p{M}", "")
    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(stripped)


def _base_label(col: Column) -> Column:
    return strip_accents(F.lower(F.trim(col)))


def label_compact(col: Column) -> Column:
    """Header key for reports: letters and digits only."""
    return F.regexp_replace(_base_label(F.coalesce(col, F.lit(""))), _NOT_ALPHANUMERIC, "")


def _underscored(col: Column, separators: str) -> Column:
    joined = F.regexp_replace(col, separators, "_")
    return F.regexp_replace(F.regexp_replace(joined, "_+", "_"), "^_|_$", "")


def label_upload(col: Column) -> Column:
    """Header key for uploads: `?()%$` dropped, blank and `- / .` to one underscore."""
    kept = F.regexp_replace(_base_label(F.coalesce(col, F.lit(""))), r"[?()%$]", "")
    return _underscored(kept, r"[ \-/.]")


def label_sheet(col: Column) -> Column:
    """Header key for the post-sale sheet: also the degree signs become underscores."""
    return _underscored(_base_label(F.coalesce(col, F.lit(""))), r"[ \-/.°]")


def blank_to_null(col: Column) -> Column:
    text = F.trim(col)
    return F.when(text != "", text)


def to_date_multi(col: Column) -> Column:
    """Day from `dd/MM/yyyy`, ISO (first ten characters) or a spreadsheet serial."""
    text = F.trim(col.cast("string"))
    serial = text.try_cast("double")
    from_serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))
    return F.coalesce(
        F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(text, "d/M/yyyy")),
        F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-M-d")),
        F.when(serial.between(20000, 80000), from_serial),
    )


def to_int(col: Column) -> Column:
    """Whole number, fraction cut off; anything else is null."""
    return F.trim(col.cast("string")).try_cast("double").try_cast("long")


def locale_number(col: Column) -> Column:
    """Decimal comma allowed; with a comma present every dot is a thousands mark."""
    text = F.trim(col.cast("string"))
    plain = F.when(
        text.contains(","), F.replace(F.replace(text, F.lit(".")), F.lit(","), F.lit("."))
    ).otherwise(text)
    return plain.try_cast("double")


def upload_number(col: Column, currency: bool = True) -> Column:
    """Number typed by a user: optional `$`/`%`; dots go only when a comma is there too."""
    text = F.trim(col.cast("string"))
    if currency:
        text = F.trim(F.regexp_replace(text, r"[$%]", ""))
    return locale_number(text)


def to_bool(col: Column) -> Column:
    text = F.lower(F.trim(col.cast("string")))
    return F.when(text.isin("si", "sí", "true", "verdadero", "1", "x"), F.lit(True)).when(
        text.isin("no", "false", "falso", "0"), F.lit(False)
    )


def to_int_round(col: Column) -> Column:
    """Number to whole number, halves to the even neighbour."""
    return F.bround(upload_number(col), 0).cast("long")


def part_product_type(col: Column, canonical: str = "REPUESTOS") -> Column:
    return F.when(F.lower(col).contains("repuesto"), F.lit(canonical)).otherwise(col)


def strip_branch_prefix(col: Column) -> Column:
    return F.regexp_replace(col, r"^\d{1,2}\s+", "")


def like_any(needle: str, *cols: Column) -> Column:
    """True when any column holds `needle`, ignoring case; null columns do not match."""
    pattern = "%" + needle.replace("\\", "\\\\") + "%"
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(col.ilike(pattern), F.lit(False))
    return hit

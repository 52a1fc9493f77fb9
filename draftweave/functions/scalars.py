"""Column expressions for identifiers, numbers and text.

Untyped JSON scalars travel as a pair of columns: the text and its *kind*
(``null``, ``bool``, ``int``, ``float``, ``string``, ``object``, ``array``),
because the kind changes the answer: the number 3.0 is item "3" while the
text "3.0" is ambiguous.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTEGER_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"(?i)^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|inf|infinity|nan)$"
DIGIT_RUN = r"(?U)\d+"
HEADER_SPACE = r"(?U)\s+"


# Every character that Unicode counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Remove all surrounding whitespace, not only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


trimmed = strip


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


@cache
def decimal_digits() -> tuple[str, str]:
    """Every decimal digit outside ASCII, and the ASCII digit of each."""
    found = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def ascii_digits(c: Column) -> Column:
    """Rewrite the decimal digits of other scripts to ASCII; plain text is left alone."""
    return F.when(c.rlike(r"(?U)(?=[^\x00-\x7F])\d"), F.translate(c, *decimal_digits())).otherwise(c)


# --- kinds of untyped scalars -------------------------------------------------


# Type names of parsed JSON, without their parameters, and the kinds they stand for.
# Whole numbers beyond 64 bits parse as DECIMAL(n,0) and are integers.
VARIANT_KINDS = {
    "STRING": "string", "BIGINT": "int", "VOID": "null", "BOOLEAN": "bool", "DECIMAL": "float",
    "DOUBLE": "float", "FLOAT": "float", "OBJECT": "object", "ARRAY": "array",
    **{f"DECIMAL({n},0)": "int" for n in (19, *range(20, 40))},
}


def kind_of_type(shape: Column) -> Column:
    """Kind of a type name as ``schema_of_variant`` gives it."""
    names = F.create_map(*[F.lit(x) for pair in VARIANT_KINDS.items() for x in pair])
    bare = F.substring_index(F.substring_index(shape, "<", 1), "(", 1)
    return F.coalesce(F.try_element_at(names, shape), F.try_element_at(names, bare))


def variant_kind(v: Column) -> Column:
    """Kind of a VARIANT value; SQL null (a missing key) gives SQL null.

    Spells out the type of all that the value holds: for large objects and
    arrays ask :func:`is_object` first.
    """
    return kind_of_type(F.schema_of_variant(v))


def is_object(v: Column) -> Column:
    """Whether a VARIANT value is an object; false for SQL null."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def variant_text(v: Column) -> Column:
    """Text of a VARIANT scalar (null for missing and JSON null)."""
    return F.try_variant_get(v, "$", "string")


def scalar_repr(text: Column, kind: Column) -> Column:
    """Text of a scalar as messages show it: True, None, 3.0."""
    return (
        F.when(text.isNull() | (kind == "null"), "None")
        .when(kind == "bool", F.initcap(text))
        .when((kind == "float") & text.rlike(r"^[+-]?\d+$"), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def variant_field(v: Column, name: str) -> Column:
    """Field of a VARIANT object; SQL null when the key is missing."""
    return F.try_variant_get(v, f"$.{name}", "variant")


def computed(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns as the output of a generator of one row.

    Later filters and projections then read finished values. Over a plain
    projection the optimizer would copy long expressions into every filter, and
    derive constraints for each combination of aliases.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    kept = [F.col(c) for c in frame.columns if c not in columns]
    return frame.select(*kept, F.inline(F.array(row)))


#: Columns that one generator adds: its code is one method, and the JVM compiles none above 8,000 bytes.
FIELDS_AT_ONCE = 4


def with_fields(frame: DataFrame, source: str, names: Sequence[str], prefix: str = "", texts: Sequence[str] | None = None) -> DataFrame:
    """Add text and kind of named fields of a VARIANT column: ``<prefix><name>``, ``<prefix><name>_kind``.

    ``texts`` names the fields whose text is wanted, all by default. The object
    is walked once for texts and once for values, not once a field.
    """
    texts = [n for n in names if texts is None or n in texts]
    decoded = {"_values": F.try_variant_get(source, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")}
    if texts:
        decoded["_texts"] = F.try_variant_get(source, "$", f"struct<{','.join(f'{n}:string' for n in texts)}>")
    rows = computed(frame, decoded)
    rows = computed(rows, {f"{prefix}{n}_kind": F.schema_of_variant(F.col("_values")[n]) for n in names})
    out = {f"{prefix}{n}": F.col("_texts")[n] for n in texts}
    rows = rows.select(*[c for c in rows.columns if c not in ("_values", "_texts", *out)], *[c.alias(n) for n, c in out.items()])
    for i in range(0, len(names), FIELDS_AT_ONCE):
        rows = computed(rows, {f"{prefix}{n}_kind": kind_of_type(F.col(f"{prefix}{n}_kind")) for n in names[i:i + FIELDS_AT_ONCE]})
    return rows


# --- identifiers --------------------------------------------------------------


def normalize_identifier(text: Column, kind: Column | str = "string") -> Column:
    """Canonical identifier, or null when the value is ambiguous (P-01)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    # Plain numbers, the common case, need one test; a whole-text pattern finds
    # the only digit run of anything else.
    run = F.regexp_extract(text, r"(?U)^\D*(\d+)\D*$", 1)
    from_text = F.when(text.rlike("^[1-9][0-9]*$"), text).otherwise(
        F.when(run != "", F.regexp_replace(ascii_digits(run), "^0+(?=[0-9])", ""))
    )
    number = text.try_cast("double")
    from_float = F.when(
        number == F.floor(number), number.try_cast("decimal(38,0)").cast("string")
    )
    return (
        F.when(kind == "string", from_text)
        .when(kind == "int", F.when(text.rlike(r"^[+-]?0+$"), "0").otherwise(text))
        .when(kind == "float", from_float)
    )


def key_order(key: Column) -> list[Column]:
    """Ascending numeric order of canonical keys of any length (O-01)."""
    negative = key.startswith("-")
    return [
        F.when(negative, -F.length(key)).otherwise(F.length(key)),
        F.when(negative, F.translate(key, "0123456789", "9876543210")).otherwise(key),
    ]


def zero_filled(n: Column, width: int) -> Column:
    """Decimal text of a count, zeros in front up to a width and never cut."""
    text = n.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def component_id(seq: Column) -> Column:
    """``cmp_001``, widening past 999 (P-14)."""
    return F.concat(F.lit("cmp_"), zero_filled(seq, 3))


def exact_component_id(item_number: Column) -> Column:
    """``cmp_`` + zero-filled digits, or the raw text (P-15)."""
    padded = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), 3 - F.length(item_number))), item_number)
    return F.concat(F.lit("cmp_"), F.when(item_number.rlike(r"(?U)^\d+$"), padded).otherwise(item_number))


def document_id(path: Column) -> Column:
    """``doc_`` + 8 hex digits of the path's hash: reruns agree (P-26)."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(path.cast("binary"), 256), 1, 8))


def page_id(number: Column) -> Column:
    return F.concat(F.lit("page_"), zero_filled(number, 3))


def place(*parts: Column | str) -> Column:
    """Ordinal over all pages of a document: page number, page, then the given parts.

    Pages whose id ends in no number come first, by id.
    """
    number = F.regexp_extract("page_id", r"([0-9]+)$", 1).try_cast("decimal(38,0)")
    named = {f"p{i}": F.col(p) if isinstance(p, str) else p for i, p in enumerate(parts)}
    return F.struct(
        F.coalesce(number, F.lit(-1).cast("decimal(38,0)")).alias("page_number"), F.col("page_id").alias("page_id"),
        *[c.alias(n) for n, c in named.items()],
    )


# --- numbers ------------------------------------------------------------------


def safe_int(text: Column, kind: Column | str = "string") -> Column:
    """Integer reading of an untyped scalar, or null (P-02)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    stripped = ascii_digits(strip(text))
    number = text.try_cast("double")
    return (
        F.when(kind == "int", text.try_cast("bigint"))
        .when((kind == "float") & (number == F.floor(number)), number.try_cast("bigint"))
        .when((kind == "string") & stripped.rlike(INTEGER_TEXT), stripped.try_cast("bigint"))
    )


def safe_float(text: Column, kind: Column | str = "string") -> Column:
    """Float reading of an untyped scalar, or null (P-03)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    stripped = ascii_digits(strip(text))
    return (
        F.when(kind.isin("int", "float"), text.try_cast("double"))
        .when((kind == "string") & stripped.rlike(FLOAT_TEXT), stripped.try_cast("double"))
    )


def clamp_confidence(text: Column, kind: Column | str = "string") -> Column:
    """Confidence in [0, 1]; missing or unreadable gives 0 (P-04)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    value = F.when(kind == "bool", F.when(text == "true", 1.0).otherwise(0.0)).otherwise(
        safe_float(text, kind)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def is_valid_confidence(text: Column, kind: Column | str) -> Column:
    """Already a number within [0, 1] (P-05)."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.coalesce(
        kind.isin("int", "float") & text.try_cast("double").between(0.0, 1.0), F.lit(False)
    )


def is_low_confidence(score: Column, threshold: float) -> Column:
    return score < F.lit(float(threshold))


def two_decimals(x: Column) -> Column:
    """Two-decimal text; exact ties (multiples of 1/8) go to the even cent."""
    cents = x * 100
    tie = (cents - F.floor(cents)) == 0.5
    exact = x * 8 == F.floor(x * 8)
    rounded = F.when(tie & ~exact, F.floor(cents) + 1).otherwise(F.rint(cents))
    return F.format_string("%.2f", rounded / 100)


def low_confidence_warning(label: Column | str, identifier: Column, score: Column) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(
        F.lit("Low confidence extraction for "), label, F.lit(" "), identifier,
        F.lit(" (confidence="), two_decimals(score), F.lit(")"),
    )


def combine_confidence(bom: Column, callout: Column) -> Column:
    """Lower of the two, the only one, or null (P-12)."""
    return F.least(bom, callout)


# --- text cells ---------------------------------------------------------------


def clean_cell(c: Column) -> Column:
    """Null to empty, whitespace runs to one space, trimmed (P-08)."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), HEADER_SPACE, " "))


def digit_run(c: Column) -> Column:
    """First digit run of a cell, empty without one."""
    return F.regexp_extract(clean_cell(c), DIGIT_RUN, 0)


def extract_item_no(c: Column) -> Column:
    """First digit run as text, zeros kept (P-09)."""
    return blank_to_null(digit_run(c))


def extract_qty(c: Column) -> Column:
    """First digit run as an integer (P-10)."""
    return ascii_digits(digit_run(c)).try_cast("bigint")


def get_cell(cells: Column, index: Column) -> Column:
    """Cell at an index, null when the index is null or past the end (P-11)."""
    return F.get(cells, index)


def has_alphanumeric(c: Column) -> Column:
    # Most words begin with a plain letter or digit and need no pattern.
    first = F.substring(c, 1, 1)
    plain = first.between("0", "9") | first.between("A", "Z") | first.between("a", "z")
    return plain | c.rlike(r"[\p{L}\p{N}]")


# --- files and views ----------------------------------------------------------


def normalize_file_type(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"^\.+", "")


# Substring tests in order, and the code each one stands for.
ERROR_CODES = [
    (["unsupported file type"], "UNSUPPORTED_FORMAT"),
    (["empty"], "EMPTY_FILE"),
    (["does not exist"], "FILE_NOT_FOUND"),
    (["not a valid pdf", "not a pdf"], "INVALID_PDF"),
    (["not a png", "not a jpeg", "valid"], "CORRUPT_IMAGE"),
]


def validation_error_code(message: Column) -> Column:
    """Stable code for a validation message (P-22)."""
    text = F.lower(message)
    code = F.lit("VALIDATION_FAILED")
    for needles, name in reversed(ERROR_CODES):
        hit = F.lit(False)
        for needle in needles:
            hit = hit | text.contains(needle)
        code = F.when(hit, name).otherwise(code)
    return code


def parse_grid_size(text: Column, default: tuple[int, int] = (2, 2)) -> Column:
    """``"2x3"`` to a (rows, cols) struct; blank gives the default (P-23)."""
    raw = F.regexp_replace(F.lower(strip(F.coalesce(text, F.lit("")))), " ", "")
    rows = F.regexp_extract(raw, r"^([+-]?\d+)x([+-]?\d+)$", 1).try_cast("int")
    cols = F.regexp_extract(raw, r"^([+-]?\d+)x([+-]?\d+)$", 2).try_cast("int")
    failure = F.raise_error(F.concat(F.lit("Invalid grid size: "), text)).cast("int")
    good = (rows >= 1) & (cols >= 1)
    return F.struct(
        F.when(raw == "", default[0]).when(good, rows).otherwise(failure).alias("rows"),
        F.when(raw == "", default[1]).when(good, cols).otherwise(failure).alias("cols"),
    )


def display_name(description: Column, part_name: Column) -> Column:
    return F.coalesce(
        blank_to_null(strip(description)), blank_to_null(part_name), F.lit("(unidentified part)")
    )


def badge(status: Column) -> Column:
    return (
        F.when(status == "linked", "matched")
        .when(status == "review_required", "warning")
        .when(status.isin("missing_callout", "missing_bom_item", "invalid"), "missing")
        .otherwise("warning")
    )


def confidence_percent(score: Column) -> Column:
    """Whole percent, halves up (P-19)."""
    return F.floor(score * 100 + 0.5).cast("int")


def display_label(bubble_number: Column, item_number: Column) -> Column:
    return F.coalesce(bubble_number, item_number, F.lit("—"))


def issue_label(item_number: Column, bubble_number: Column, component: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("Item "), blank_to_null(item_number)),
        F.concat(F.lit("Bubble "), blank_to_null(bubble_number)),
        component,
    )

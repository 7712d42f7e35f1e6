"""Column expressions that clean raw values; all give NULL, never an error, for what cannot be read."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bare_letters() -> tuple[str, str]:
    """Letters of the Latin blocks with the one ASCII character that their compatibility form keeps without marks; marks last, without any."""
    found = {}
    for code in [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare.isascii():
            found[chr(code)] = bare
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


_LETTERS, _BARE = _bare_letters()


def plain_text(x: Column) -> Column:
    """Upper case without marks, only A-Z, 0-9 and single spaces, words in their order; empty for NULL. Letters beyond the Latin blocks
    and those that stand for several become spaces."""
    bare = F.upper(F.translate(F.coalesce(x, F.lit("")), _LETTERS, _BARE))
    return F.trim(F.regexp_replace(bare, "[^A-Z0-9]+", " "))


def bare_upper(x: Column) -> Column:
    """Upper case without marks, with single spaces; other characters stay."""
    return F.trim(F.regexp_replace(F.upper(F.translate(x, _LETTERS, _BARE)), r"\s+", " "))


#: What ``\\s`` is in Spark's expressions.
SPACES = " \t\n\x0b\f\r"
_TO_BARE = str.maketrans(_LETTERS[:len(_BARE)], _BARE, _LETTERS[len(_BARE):])


def bare(x: str) -> str:
    """bare_upper of a Python text."""
    return re.sub(f"[{SPACES}]+", " ", x.translate(_TO_BARE).upper()).strip(" ")


def first_letters(bare: set[str]) -> str:
    """A pattern of texts whose bare_upper begins with one of these characters."""
    found = sorted(bare | {x.lower() for x in bare} | {c for c, b in zip(_LETTERS, _BARE, strict=False) if b.upper() in bare})
    blank = "".join(f"\\u{ord(c):04x}" for c, b in zip(_LETTERS, _BARE, strict=False) if b == " ")
    return rf"^[\s{blank}\u0300-\u036f]*[" + "".join(f"\\u{ord(c):04x}" for c in found) + "]"


def sorted_words(x: Column) -> Column:
    """plain_text with its words sorted: a name whatever the order of its parts."""
    return F.array_join(F.array_sort(F.split(plain_text(x), " ")), " ")


def first_filled(*values: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def document(x: Column) -> tuple[Column, Column]:
    """(cnpj, cpf): 14 digits are a company's, 11 a person's, others neither."""
    d = digits(x)
    return F.when(F.length(d) == 14, d), F.when(F.length(d) == 11, d)


def decimal_br(x: Column, kind: str = "decimal(38,2)") -> Column:
    """1.234,56 as a decimal; a plain decimal point also reads."""
    return F.when(F.contains(x, F.lit(",")), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(x).try_cast(kind)


def date_of(x: Column) -> Column:
    """ISO dates and times, DD/MM/YYYY, YYYYMMDD; 00000000 is NULL."""
    iso = F.substring(x, 1, 10).try_cast("date")
    return F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}"), iso).when(x.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.concat_ws("-", F.substring(x, 7, 4), F.substring(x, 4, 2), F.substring(x, 1, 2)).try_cast("date")).when(x.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)).try_cast("date"))


def quantity(x: Column) -> Column:
    """A resource quantity in units: u and m are millionths and thousandths, Ki to Ti powers of 1024."""
    number = F.nullif(F.regexp_extract(x, r"^([0-9.]+)", 1), F.lit("")).try_cast("double")
    unit = F.regexp_extract(x, r"([A-Za-z]*)$", 1)
    scale = F.create_map(*[F.lit(v) for p in {"": 1.0, "u": 1e-6, "m": 1e-3, "Ki": 1024.0, "Mi": 1024.0**2, "Gi": 1024.0**3, "Ti": 1024.0**4}.items() for v in p])
    return number * scale[unit]


def control_number(x: Column) -> tuple[Column, Column, Column]:
    """company, year and sequence of 'cnpj-unit-sequence/year'."""
    part = lambda k: F.nullif(F.regexp_extract(x, r"^(\d{14})-\d+-(\d+)/(\d{4})$", k), F.lit(""))
    return part(1), part(3).cast("int"), part(2).cast("int")


def key_of(x: Column) -> Column:
    """A storage key: other characters become _, ends are stripped, 254 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9_.\-]", "_"), r"^[_.\-]+|[_.\-]+$", ""), 1, 254)


def masked(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9*]", "")

"""Scalar text functions as column expressions; none needs Python rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a token, and how many code points make a prefix.
TOKEN = r"[A-Za-z]+|\d+(?:[.,]\d+)?"
PREFIX = 200
NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used; also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, and numbers with at most one fraction, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def numeric_density(bag: Column) -> Column:
    """Share of tokens that begin with a digit; 0 for no tokens."""
    return F.size(F.filter(bag, lambda x: x.rlike(r"^\d"))) / F.greatest(F.size(bag), F.lit(1))


def option_length(texts: Column) -> Column:
    """Mean number of tokens of the options; null without options."""
    lengths = F.transform(texts, lambda x: F.size(tokens(F.coalesce(x, F.lit("")))))
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(texts), F.lit(0))


def prefix(text: Column, length: int = PREFIX) -> Column:
    return F.substring(text, 1, length)


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end; linear in the text, whatever runs it holds."""
    return F.regexp_replace(text, r"(?U)\A\s++|(?<!\s)\s++\z", "")


def norm_text(text: Column) -> Column:
    """Stripped, in lower case, runs of white space as one blank."""
    return F.regexp_replace(F.lower(stripped(text)), r"(?U)\s+", " ")


def norm_value(text: Column) -> Column:
    """A comparable form of an answer value.

    White space, commas and dollar signs are dropped and a trailing full stop is stripped;
    numbers are compared by six significant digits, other text as it stands. ``nan`` and
    the infinities count as numbers; digits outside ASCII do not.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[\s,$]", ""), r"(?<!\.)\.++\z", "")

    def key(p: Column) -> Column:
        number = F.when(p.rlike(NUMBER), F.translate(p, "_", "").try_cast("double"))
        return let(
            number,
            lambda n: F.when(n == 0, "0")
            .when(n.isNotNull(), F.format_string("%.5e", n))
            .when(p.rlike(r"^[+-]?nan$"), "nan")
            .when(p.rlike(r"^\+?inf(inity)?$"), "inf")
            .when(p.rlike(r"^-inf(inity)?$"), "-inf")
            .otherwise(p),
        )

    return let(plain, key)


def strip_think(text: Column) -> Column:
    """Without think blocks; an open one reaches to the end."""
    return F.regexp_replace(text, r"(?sd)<think>.*?(?:</think>|$)", "")


def word_count(text: Column) -> Column:
    """Number of words between white space; null for a null text."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def slug(text: Column) -> Column:
    """Lower case, every other run than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def short_sha(text: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def hash_mod(text: Column, modulus: int) -> Column:
    """The SHA-256 as one integer of 256 bits, modulo ``modulus`` (at most 2**58)."""
    digits = F.filter(F.split(F.sha2(text, 256), ""), lambda c: c != "")
    step = lambda a, c: (a * 16 + F.instr(F.lit("0123456789abcdef"), c) - 1) % modulus
    return F.aggregate(digits, F.lit(0).cast("long"), lambda a, c: step(a, c).cast("long"))


def seeded(seed: int, *keys: Column) -> Column:
    """An order that depends only on the seed and the keys."""
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *keys).cast("binary"))


def split_name(split: Column) -> Column:
    return F.lower(F.trim(split))


def infer_split(file_name: Column, case_sensitive: bool = False) -> Column:
    """train, validation (also for ``valid`` and ``dev``), else test, from a file's stem.

    The case-sensitive form gives ``unknown`` where nothing matches.
    """
    stem = F.regexp_replace(F.regexp_replace(file_name, r"^.*/", ""), r"\.[^.]*$", "")
    stem = stem if case_sensitive else F.lower(stem)
    found = F.when(stem.contains("train"), "train").when(stem.contains("valid") | stem.contains("dev"), "validation")
    if case_sensitive:
        return found.when(stem.contains("test"), "test").otherwise("unknown")
    return found.otherwise("test")

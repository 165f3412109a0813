"""One form for texts that look the same.

Folded together are composed and decomposed accents, full-width and half-width
forms, Latin ligatures, invisible characters, kinds of blank, of line end and of
hyphen, and letters of another script with the shape of a Latin letter. Letter
case, accents, digits, raised digits and punctuation stay apart, and so do a tab
and a blank.

Only characters outside ASCII ever change (but for line ends), so a text is cut
into plain pieces and pieces of non-ASCII characters with the ASCII character
before them; only the distinct pieces of the second kind are exploded to
positioned code points. These are joined with a table of decompositions and
look-alikes, whose size is bounded by Unicode itself, marks are ordered by their
combining class behind their base, base and marks are recomposed by a second
such table, and the pieces are put together again.
"""

from __future__ import annotations

import sys
import unicodedata as U
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import cut, digest, pairs_by_key, spread_join

# Letters of other scripts and Latin variants with the shape of a
# basic Latin letter, each followed by that letter.
LOOK_ALIKE = (
    # Cyrillic
    "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW ҮY ӀI ѴV ԌG "
    "аa еe ѕs іi јj оo рp сc уy хx һh ԁd ԛq ԝw үy ӏl ѵv "
    # Greek
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ "
    "οo νv ϲc ϳj "
    # Latin
    "ɑa ɡg ıi ᴄc ᴏo ᴠv ᴡw ᴢz ꜱs "
    # Armenian
    "ՏS ՕO Սu օo ոn սu հh ցg զq "
    # Cherokee
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    # Lisu
    "ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ "
    # Coptic
    "ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲬX ⲟo ⲣp ⲥc "
)
# Code points that show as a hyphen.
HYPHENS = "2010 2011 2043 FE63 FF0D"
# Format characters that are seen, and unseen ones of other categories.
SEEN_FORMATS = "0600 0601 0602 0603 0604 0605 06DD 070F 0890 0891 08E2 110BD 110CD"
UNSEEN = "034F 115F 1160 3164 FFA0"
#: Stands for a joiner between pictographs, which is part of the picture, while a text is worked on.
JOINED = "\ufdd0"
PICTURE = r"\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}"
#: ASCII up to the character before others, or others with that character. Long runs are cut, but never
#: before a mark or an unseen character, however many follow, so that no base is parted from what belongs to it.
PIECES = (
    r"[\x00-\x7F]+(?![^\x00-\x7F])|"
    r"[\x00-\x7F]?[^\x00-\x7F]{1,128}[\p{M}\p{Cf}\x{115F}-\x{11FF}\x{3164}\x{FF9E}-\x{FFA0}]*+"
)


def _points(text: str) -> set[str]:
    return {chr(int(x, 16)) for x in text.split()}


def _class(c: str) -> int:
    """The combining class; vowels and finals of Korean syllables stay with their initial, in this order."""
    return 1 if "\u1160" <= c <= "\u11a7" else 2 if "\u11a8" <= c <= "\u11ff" else U.combining(c)


@lru_cache(maxsize=1)
def tables() -> tuple[list, list]:
    """``(character, its decomposed form, combining classes)`` and ``(decomposed, composed)``."""
    same = {x[0]: x[1] for x in LOOK_ALIKE.split()}
    hyphens, seen, unseen = _points(HYPHENS), _points(SEEN_FORMATS), _points(UNSEEN)

    def simple(c: str) -> str:
        if c in unseen or (U.category(c) == "Cf" and c not in seen):
            return ""
        if c in hyphens:
            return "-"
        if c in "\x85  ":
            return "\n"
        if U.category(c) == "Zs" and c != " ":
            return " "
        kind = U.decomposition(c).partition(" ")[0]
        # Mathematical letters, Latin ligatures and Roman numerals have compatibility forms that look like them.
        if kind in ("<wide>", "<narrow>") or c == "\xb5" or "\U0001d400" <= c <= "\U0001d7ff" or "ﬀ" <= c <= "ﬆ" or "\u2160" <= c <= "\u217f":
            return U.normalize("NFKD", c)
        return U.normalize("NFD", c)

    folds, whole = [], []
    for p in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= p <= 0xDFFF:
            continue
        c = chr(p)
        d = "".join(same.get(x, x) for x in simple(c))
        if d != c or _class(c):
            folds.append((c, list(d), [_class(x) for x in d]))
        n = U.normalize("NFD", c)
        if n != c and U.normalize("NFC", n) == c:
            whole.append((n, c))
    return folds, whole


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    folds, whole = tables()
    text = T.StringType()
    fold = T.StructType().add("c", text).add("form", T.ArrayType(text)).add("class", T.ArrayType(T.IntegerType()))
    compose = T.StructType().add("apart", text).add("whole", text)
    return spark.createDataFrame(folds, fold), spark.createDataFrame(whole, compose)


def fold_pieces(pieces: DataFrame) -> DataFrame:
    """``piece, form`` for the distinct values of ``piece``."""
    folds, whole = (F.broadcast(t) for t in _tables(pieces.sparkSession))
    points = pieces.select("piece", F.posexplode(F.split("piece", "")).alias("at", "c")).where("c <> ''")
    found = points.join(folds, "c", "left").select(
        "piece",
        "at",
        F.coalesce("form", F.array("c")).alias("form"),
        F.coalesce("class", F.array(F.lit(0))).alias("class"),
    )
    # An unseen character leaves a row without one, so that its piece is not lost.
    flat = found.select("piece", "at", F.posexplode_outer(F.arrays_zip("form", "class")).alias("i", "x")).select(
        "piece", "at", "i", F.col("x.form").alias("c"), F.coalesce("x.class", F.lit(0)).alias("class")
    )
    # A mark belongs to the last base before it; the order of marks of a class is kept.
    base = F.sum(F.when((F.col("class") == 0) & F.col("c").isNotNull(), 1).otherwise(0)).over(
        W.partitionBy("piece").orderBy("at", "i")
    )
    apart = (
        flat.withColumn("base", base)
        .groupBy("piece", "base")
        .agg(F.sort_array(F.collect_list(F.struct("class", "at", "i", "c"))).alias("marks"))
        .select("piece", "base", F.expr("array_join(transform(marks, m -> m.c), '')").alias("apart"))
    )
    heads = whole.select(F.col("apart").alias("two"), F.col("whole").alias("head"))
    composed = (
        apart.withColumn("two", F.substring("apart", 1, 2))
        .join(whole, "apart", "left")
        .join(heads, "two", "left")
        .select("piece", "base", F.expr("coalesce(whole, concat(head, substring(apart, 3)), apart)").alias("c"))
    )
    return (
        composed.groupBy("piece")
        .agg(F.expr("array_join(transform(sort_array(collect_list(struct(base, c))), x -> x.c), '')").alias("form"))
    )


def fold(df: DataFrame, id_col: str, text_col: str, out: str = "folded") -> DataFrame:
    """``id_col, text_col, out``: every row with the consistent form of its text.

    A null text has a null form, an empty one an empty form; a text of any
    length is folded as a whole; ids need not be unique; other columns are not carried.
    """
    lines = F.regexp_replace(text_col, "\r\n?", "\n")
    rows = df.select(id_col, text_col, lines.alias("_text")).withColumn(
        "_key", F.when(F.col("_text").rlike(r"[^\x00-\x7F]"), digest(F.col("_text")))
    )
    plain = F.col("_key").isNull()
    # Pieces and forms travel under 16 bytes that stand for their text.
    mixed = rows.where(~plain).dropDuplicates(["_key"])
    kept = F.regexp_replace("_text", rf"([{PICTURE}\x{{FE0F}}])\x{{200D}}(?=[{PICTURE}])", f"$1{JOINED}")
    pieces = mixed.select("_key", F.posexplode(F.regexp_extract_all(kept, F.lit(PIECES), F.lit(0))).alias("at", "piece"))
    special = F.col("piece").rlike(r"[^\x00-\x7F]")
    forms = fold_pieces(pieces.where(special).select("piece").distinct())
    joined = (
        pieces.where(special).join(forms, "piece").select("_key", "at", "form")
        .unionByName(pieces.where(~special).select("_key", "at", F.col("piece").alias("form")))
    )
    rebuilt = joined.groupBy("_key").agg(
        F.expr("array_join(transform(sort_array(collect_list(struct(at, form))), x -> x.form), '')").alias(out)
    ).withColumn(out, F.translate(out, JOINED, "\u200d"))
    whole = spread_join(rows.where(~plain).select("_key", id_col, text_col), rebuilt, "_key", id_col)
    return rows.where(plain).select(id_col, text_col, F.col("_text").alias(out)).unionByName(whole.select(id_col, text_col, out))


def same_look(df: DataFrame, id_col: str, text_col: str, block: int = 4096) -> DataFrame:
    """Pairs of rows with equal forms and unequal texts: ``id_a, id_b``, id_a < id_b.

    Null texts and texts without a visible character have no partner; equal
    texts are no pair with each other, but each is one with every differing text of their form.
    """
    keyed = (
        fold(df, id_col, text_col)
        .where(F.col("folded").rlike(r"(?U)[^\s]"))
        .select(F.col(id_col).alias("id"), digest(F.col("folded")).alias("look"), digest(F.col(text_col)).alias("raw"))
    )
    keyed = cut(keyed.dropDuplicates(["id", "raw"]))
    # Equal texts are one class, so that many copies of a text meet only what differs from them.
    classes = keyed.select("look", "raw").distinct()
    pairs = pairs_by_key(classes, "look", "raw", block).select("a_raw", "b_raw")
    first = spread_join(keyed.select(F.col("raw").alias("a_raw"), F.col("id").alias("x")), pairs, "a_raw", "x")
    return (
        spread_join(keyed.select(F.col("raw").alias("b_raw"), F.col("id").alias("y")), first, "b_raw", "y")
        .where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )


def looks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, look, links``: of every row with a visible text the least id that looks the same, and how many rows look the same but differ.

    The bounded form of ``same_look``: copies are counted, not expanded into pairs.
    Rows with the same id and text are one.
    """
    keyed = cut(
        fold(df, id_col, text_col)
        .where(F.col("folded").rlike(r"(?U)[^\s]"))
        .select(F.col(id_col).alias("id"), digest(F.col("folded")).alias("look"), digest(F.col(text_col)).alias("raw"))
        .dropDuplicates(["id", "raw"])
    )
    texts = keyed.groupBy("look", "raw").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("least"))
    forms = texts.groupBy("look").agg(F.sum("k").alias("all"), F.min("least").alias("first"))
    sizes = spread_join(texts.drop("least"), forms, "look", "raw").select("raw", "first", (F.col("all") - F.col("k")).alias("links"))
    return spread_join(keyed.drop("look"), sizes, "raw", "id").select("id", F.col("first").alias("look"), "links")

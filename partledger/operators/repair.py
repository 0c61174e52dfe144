"""Repair of texts whose bytes were decoded with the wrong character set, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What UTF-8 read as Latin-1 shows: a lead byte followed by continuation bytes, or C1 controls.
SIGNS = r"[Â-ô][\u0080-¿]"


def signs(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SIGNS))


def repaired(df: DataFrame, text: str) -> DataFrame:
    """df with the text decoded anew where it is all Latin-1, shows signs of wrong decoding and has fewer of them afterwards; repaired tells which."""
    fits = ~F.col(text).rlike(r"[^\u0000-ÿ]") & (signs(F.col(text)) > 0)
    tried = df.withColumn("_again", F.when(fits, F.try_validate_utf8(F.encode(F.col(text), "ISO-8859-1").cast("string"))))
    better = F.coalesce(signs(F.col("_again")) < signs(F.col(text)), F.lit(False))
    return tried.withColumn("repaired", better).withColumn(text, F.when(better, F.col("_again")).otherwise(F.col(text))).drop("_again")


#: What Windows-1252 shows for the bytes 80 to 9F, and the control characters of those bytes; five bytes have no character there.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTROLS = "".join(chr(b[0]) for c in WINDOWS for b in [c.encode("cp1252")])
#: UTF-8 of more than one byte, its bytes shown as the characters of Latin-1.
SEQUENCE = (
    "(?:[\u00C2-\u00DF][\u0080-\u00BF]|\u00E0[\u00A0-\u00BF][\u0080-\u00BF]|[\u00E1-\u00EC\u00EE\u00EF][\u0080-\u00BF]{2}|\u00ED[\u0080-\u009F][\u0080-\u00BF]|"
    "\u00F0[\u0090-\u00BF][\u0080-\u00BF]{2}|[\u00F1-\u00F3][\u0080-\u00BF]{3}|\u00F4[\u0080-\u008F][\u0080-\u00BF]{2})+"
)
# Words that lost their last byte before they were kept, and what they were.
TRUNCATED = (("漫步è\u0080", "漫步者"), ("阿思ç¿", "阿思翠"), ("一å\u008a", "一加"), ("喜马拉é\u009b", "喜马拉雅"), ("进行æ\u0097线", "进行无线"), ("这款产å\u0093", "这款产品"), ("通话降å\u0099", "通话降噪"))


def has_controls(text: Column) -> Column:
    """Whether a text has the control characters that UTF-8 read byte by byte leaves."""
    return F.coalesce(text.rlike("[\u0080-\u009f]"), F.lit(False))


def decoded_again(text: Column) -> Column:
    """A text in which UTF-8 that was read as Latin-1 or Windows-1252 is read as UTF-8; everything else stays.

    Characters of Windows-1252 are turned to the bytes' controls, and each run of whole UTF-8 sequences is decoded; between them
    controls become the characters of Windows-1252 again. Texts of other alphabets may stand beside broken ones.
    """
    fixed = text
    for broken, right in TRUNCATED:
        fixed = F.replace(fixed, F.lit(broken), F.lit(right))
    bytes_shown = F.translate(fixed, WINDOWS, CONTROLS)
    runs, others = F.regexp_extract_all(bytes_shown, F.lit(SEQUENCE), F.lit(0)), F.split(bytes_shown, SEQUENCE, -1)
    pieces = F.transform(F.arrays_zip(others, runs), lambda p: F.concat(F.translate(p["0"], CONTROLS, WINDOWS), F.coalesce(F.encode(p["1"], "ISO-8859-1").cast("string"), F.lit(""))))
    out = F.array_join(pieces, "")
    for broken, right in TRUNCATED:
        out = F.replace(out, F.lit(broken), F.lit(right))
    return out


def broken_signs(text: Column) -> Column:
    """How much of a text looks like UTF-8 read byte by byte: whole sequences in Latin-1 or Windows-1252, and controls."""
    return F.regexp_count(F.translate(text, WINDOWS, CONTROLS), F.lit(SEQUENCE)) + F.regexp_count(text, F.lit("[\u0080-\u009f]"))


def repaired_text(text: Column) -> Column:
    """decoded_again where that leaves fewer signs than there were, else the text as it is."""
    again = decoded_again(text)
    return F.when(broken_signs(text) > 0, F.when(broken_signs(again) < broken_signs(text), again).otherwise(text)).otherwise(text)


def repaired_link(link: Column) -> Column:
    """A link whose UTF-8 was read as Latin-1, read as UTF-8; others, and what would be no link then, stay."""
    again = F.when(~link.rlike("[^\u0000-\u00ff]"), F.try_validate_utf8(F.encode(link, "ISO-8859-1").cast("string")))
    return F.when(F.coalesce(again.rlike("^https?://"), F.lit(False)), again).otherwise(link)

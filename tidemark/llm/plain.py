"""Problem 1: one plain form for text that looks the same but differs in its characters.

Compatibility normalisation in composed form, full case folding, mapped white space and removal of
default-ignorable characters, done once per distinct value of an Arrow batch.  Letters and kanji that
stand in for the letter, kana or digit they resemble are put right inside a word or number.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tidemark.llm.arrowed import per_distinct

# Letters of other scripts that look like a Latin letter.
LATIN_FOR = dict(
    zip(
        "АВСЕНІЈКМОРЅТХУаеіјорсухѕԁһԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανικρυ",
        "ABCEHIJKMOPSTXYaeijopcyxsdhqw" "ABEZHIKMNOPTYXoavikpu",
        strict=True,
    )
)
CYRILLIC_FOR = dict(zip("ABCEHIJKMOPSTXYaeijopcyxs", "АВСЕНІЈКМОРЅТХУаеіјорсухѕ", strict=True))
GREEK_FOR = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", strict=True))
# Kanji that look like a katakana.
KANA_FOR = dict(zip("一二八力夕口工卜才匕厶乂", "ーニハカタロエトオヒムメ", strict=True))
# Radicals without a compatibility mapping and their kanji.
KANJI_FOR = dict(zip("⺠⻁⻂⻄⻑⻘⻝⻤⻩⻫⻭⻯⻲", "民虎衣西長青食鬼黄斉歯竜亀", strict=True))
DIGIT_FOR = {**dict.fromkeys("OoОоΟο", "0"), **dict.fromkeys("IlІіΙ", "1")}

BLANK = re.compile("[\\s\u00a0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u2800\u3000\u0085]")
HIDDEN = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180d\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    "\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
    "\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f"
)
PICTURE = (
    "#*0-9©®‼⁉™ℹ←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙"
    "\U0001f000-\U0001faff"
)
#: What may stand inside an emoji: the joiner between two pictures, a selector or tag after one.
INSIDE = "\ufe0e\ufe0f\U000e0020-\U000e007f"
STRAY = re.compile(
    f"(?<![{PICTURE}{INSIDE}\u20e3])[{INSIDE}]"
    f"|(?<![{PICTURE}{INSIDE}])\u200d|\u200d(?![{PICTURE}])"
    f"|(?![\u200d{INSIDE}])[{HIDDEN}]"
)
#: Symbols whose compatibility form reads differently (superscripts, fractions, circled and squared signs).
SYMBOL = re.compile(
    "(["
    + "".join(
        re.escape(chr(o))
        for o in range(0x80, 0x3400)
        if unicodedata.decomposition(chr(o)).startswith(("<super>", "<sub>", "<fraction>", "<circle>", "<square>"))
    )
    + "…‥™℠℃℉№]+)"
)
KANA = "ァ-ヺーヽヾ"
STANDING_KANJI = re.compile(f"(?<=[{KANA}])[{''.join(KANA_FOR)}]+(?=[{KANA}])")
STANDING_DIGIT = re.compile(f"(?<=[0-9])[{''.join(DIGIT_FOR)}]+(?=[0-9])|(?<=[0-9])[ОоΟο]+(?![\\w])")
WORD = re.compile("[A-Za-z\u00aa-\u024f\u0370-\u03ff\u0400-\u052f\u1e00-\u1fff\u0300-\u036f'\u2019]{2,}")
FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f]")
RADICAL = str.maketrans(KANJI_FOR)

TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
LINK = re.compile(r"https?://[!-~]+", re.I)

#: Text in which nothing can need a change, but for the look-alikes that SUSPECT finds.
SETTLED = re.compile(r"[ -~、。「」『』【】・〜々〇ぁ-ゖァ-ヺー一-鿿À-ÖØ-öø-ÿ]*")
SUSPECT = re.compile(f"[{KANA}][{''.join(KANA_FOR)}]+[{KANA}]|[0-9][OoIl]+[0-9]")


def _script(c: str) -> str:
    o = ord(c)
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G"
    return "C" if 0x400 <= o < 0x530 else "L" if c.isalpha() else ""


def _word(m: re.Match) -> str:
    """A word of more than one script, in one, if all letters of the others resemble some of its own."""
    word = m[0]
    if not FOREIGN.search(word):
        return word
    scripts = {_script(c) for c in word} - {""}
    if len(scripts) < 2:
        return word
    into = {c: LATIN_FOR.get(c) for c in word if _script(c) in "CG" and _script(c)}
    if all(into.values()):
        return "".join(into.get(c, c) for c in word)
    for keep, table in (("C", CYRILLIC_FOR), ("G", GREEK_FOR)):
        into = {c: table.get(LATIN_FOR.get(c, c)) for c in word if _script(c) not in (keep, "")}
        if all(into.values()):
            return "".join(into.get(c, c) for c in word)
    return word


def visible(text: str, symbols: bool = True) -> str:
    """``text`` in plain characters, its case, blanks and markup kept.

    With ``symbols=False``, superscripts, fractions and circled signs, which read differently from
    their compatibility form, are kept too.
    """
    if SETTLED.fullmatch(text) and not SUSPECT.search(text):
        return text
    text = BLANK.sub(" ", text)
    text = STRAY.sub("", text)
    if symbols:
        text = unicodedata.normalize("NFKC", text)
    else:
        text = "".join(x if i % 2 else unicodedata.normalize("NFKC", x) for i, x in enumerate(SYMBOL.split(text)))
    text = STRAY.sub("", text.translate(RADICAL))
    text = STANDING_KANJI.sub(lambda m: "".join(KANA_FOR[c] for c in m[0]), text)
    text = STANDING_DIGIT.sub(lambda m: "".join(DIGIT_FOR[c] for c in m[0]), text)
    return unicodedata.normalize("NFC", WORD.sub(_word, text)) if FOREIGN.search(text) else text


def unmarked(text: str) -> str:
    """``text`` without tags, entities and link addresses, each replaced by a blank."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = ENTITY.sub(" ", text)
    return LINK.sub(" ", text) if "://" in text else text


def is_plain(text: str | None) -> bool:
    """False if what a reader sees of ``text`` holds a character that isn't the plain one."""
    if not text:
        return True
    text = unmarked(text)
    return visible(text, symbols=False) == text


def plain(text: str | None) -> str | None:
    """The one form for comparisons: no markup, plain characters, case folded, single blanks. None stays None."""
    if not text:
        return text
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    text = visible(text).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return " ".join(text.split())


@arrow_udf(T.StringType())
def plain_form(values: pa.Array) -> pa.Array:
    return per_distinct(values, plain, pa.string())


@arrow_udf(T.BooleanType())
def has_odd(values: pa.Array) -> pa.Array:
    """True where a text holds a character that isn't plain; null and empty texts give null and False."""
    return per_distinct(values, lambda x: not is_plain(x), pa.bool_())


def normalise(df: DataFrame, *columns: str, suffix: str = "_plain") -> DataFrame:
    """Add ``<column><suffix>`` with the plain form of each text column.

    Null stays null, an empty text stays empty, very long texts are handled whole.  A column of the
    new name that is there already is replaced.
    """
    return df.withColumns({c + suffix: plain_form(df[c]) for c in columns})


def odd_fields(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, field): a row for each of ``columns`` that holds a character that isn't plain."""

    def named(c: str) -> Column:
        return F.when(F.col("_odd_" + c), F.lit(c))

    marked = df.select(key, *(has_odd(df[c]).alias("_odd_" + c) for c in columns))
    fields = F.filter(F.array(*map(named, columns)), lambda x: x.isNotNull())
    return marked.select(key, F.explode(fields).alias("field"))

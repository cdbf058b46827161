"""Problem 10: text decoded with the wrong encoding, found and restored.

Every swap of encodings is a substitution cipher whose symbols are the wrongly decoded units of one letter.
Bigram counts of all texts are the language; expectation-maximisation finds, for each source, how often each
cipher occurs, and for each cipher which letter a symbol stands for, also where a byte was lost.  In the
E-step a run counts as garbled as far as its letters under the cipher are likelier than the run as it is; in the
M-step the shares of the ciphers, the letters of the symbols and the bigrams (garbled runs replaced by their
letters) are counted anew.  The runs are then put right by translating symbol by symbol.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles as S
from tidemark.scratch import stored

#: Buckets of the bigram counts (8 MB) and of the letter counts.
BIGRAMS, LETTERS = 1 << 21, 1 << 16
#: What the share of a cipher in a source starts from and never falls below.
FIRST_SHARE, LEAST_SHARE = 1e-3, 1e-5
ROUNDS = 1
LOST = "�"


def _single(codec: str) -> dict[str, str]:
    """Characters of a one-byte code page and their bytes, as characters below 256."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(codec)] = chr(b)
        except UnicodeDecodeError:
            pass
    return table


#: Western text that was read as cp1252 or Latin-1: bytes cp1252 doesn't define stay as control characters.
_WESTERN = {chr(b): chr(b) for b in range(128, 256)} | _single("cp1252")
WRONG = {"western": _WESTERN, "mac": _single("mac_roman"), "cyrillic": _single("cp1251")}
_U8 = "(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})"
_EUC = "(?:[\xa1-\xa8\xad\xb0-\xf4][\xa1-\xfe]|\x8e[\xa1-\xdf])"
_SJIS = "(?:[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf])"
#: (name, code page the text was read with, encoding it was written in, symbols of the cipher)
CIPHERS = (
    ("utf8_western", "western", "utf-8", _U8),
    ("utf8_mac", "mac", "utf-8", _U8),
    ("utf8_cyrillic", "cyrillic", "utf-8", _U8),
    ("euc_western", "western", "euc_jp", _EUC),
    ("sjis_western", "western", "cp932", _SJIS),
    ("cyrillic_western", "western", "cp1251", "[\xa8\xb8\xc0-\xff]"),
    ("koi8_western", "western", "koi8_r", "[\xa3\xb3\xc0-\xff]"),
)
#: A run of one-byte symbols has two in a row somewhere; words of one letter beside it belong to it.
_PATTERNS = [re.compile(f"(?:{x}+ )*{x}{{2,}}(?: {x}+)*" if name in ("cyrillic_western", "koi8_western") else f"{x}+") for name, _, _, x in CIPHERS]


class _Bytes(dict):
    """A translation of characters to bytes; what the code page lacks becomes 0."""

    def __missing__(self, code: int) -> int:
        self[code] = made = code if code < 128 else 0
        return made


_TABLES = {k: _Bytes(str.maketrans(v)) for k, v in WRONG.items()}
#: Ciphers whose wrong reading has characters of several bytes: (name, wrong reading, encoding, symbols; \x1a is a lost byte).
WIDE = (
    ("utf8_sjis", "cp932", "utf-8", "(?:[\xc2-\xdf][\x80-\xbf\x1a]|[\xe0-\xef](?:[\x80-\xbf][\x80-\xbf\x1a]|\x1a[\x80-\xbf]))"),
    ("euc_sjis", "cp932", "euc_jp", "(?:[\xa1-\xa8\xad\xb0-\xf4][\xa1-\xfe\x1a])"),
    ("utf8_euc", "euc_jp", "utf-8", "(?:[\xe0-\xef](?:[\x80-\xbf][\x80-\xbf\x1a]|\x1a[\x80-\xbf]))"),
)
_WIDE_PATTERNS = [re.compile(f"{symbol}+") for *_, symbol in WIDE]
_TWICE = re.compile(f"{_U8}+")
#: Halfwidth kana right beside a run of euc_sjis that aren't part of it: then it is genuine narrow kana.
_NARROW = re.compile("[ｦ-ﾟ]")
#: A run of euc_sjis without a symbol of the rows of kana, wide digits or punctuation isn't told from narrow kana.
_KANA_ROWS = re.compile("[\xa1\xa3-\xa5]")


def _units(table: dict[str, str]) -> str:
    """The units of UTF-8 of several bytes, in the characters of a code page."""

    def between(low: str, high: str) -> str:
        return "[" + "".join(re.escape(c) for c, b in table.items() if low <= b <= high) + "]"

    rest = between("\x80", "\xbf")
    return f"{between('\xc2', '\xdf')}{rest}|{between('\xe0', '\xef')}{rest}{rest}"


#: A line without any of these holds no run of any cipher: control, private and replacement characters; units of UTF-8;
#: characters that lead in cp932 and hardly occur in genuine text; kana rows of EUC, or many or oddly placed high bytes.
#: Each begins with a character that genuine text seldom holds, so that most places are passed over at once.
SUSPECT = re.compile(
    "(?=[\x80-\xff\ufffd\ue000-\uf8ff" + "".join(re.escape(c) for page in WRONG.values() for c in page) + "繧縺繝縲｡-ﾟ])(?:"
    "[\x80-\x9f\ufffd\ue000-\uf8ff]|"
    + "|".join(map(_units, WRONG.values()))
    + "|[‚ƒ„†‡ˆ‰Š‹ŒŽ˜š›žŸ]|[¡£¤¥][¡-þ]|[¡-þ]{4}|[À-ÿ]{3}|(?<=[一-龠ぁ-ヺ。、])[¡-þ]{2}|[¡-þ]{2}[一-龠ぁ-ヺ。、]"
    + "|(?:(?<=[Ѐ-ӿ])|(?<=[Ѐ-ӿ] ))[À-ÿ]|[À-ÿ] ?[Ѐ-ӿ]|[繧縺繝縲｡｣､･]|(?<=[一-龠])[ｦ-ﾟ][一-龠])"
)

#: Without any of these a line holds no run of the cipher.
_TELLTALES = {"utf8_sjis": re.compile("[\ufffd繧縺繝縲\ue000-\uf8ff]|[一-龠][\x80-\xa0｡-ﾟ]|[\x80-\xa0｡-ﾟ][一-龠]"), "euc_sjis": re.compile("[｡｣､･]"), "utf8_euc": re.compile("\ufffd")}
_FAILED = re.compile("\ufffd+")


def bigram_places(codes: np.ndarray) -> np.ndarray:
    return (S.mixed(codes[:-1] * np.uint64(0x110000) + codes[1:]) % np.uint64(BIGRAMS)).astype(np.int64)


class Language:
    """Letter and bigram counts; likelihoods of a letter after another, backed off to the letter's own."""

    WEIGHT = 2.0

    def __init__(self, counts: np.ndarray) -> None:
        self.pairs, self.letters = (memoryview(np.ascontiguousarray(x)) for x in (counts[:BIGRAMS], counts[BIGRAMS:]))
        self.total = float(counts[BIGRAMS:].sum()) + 1.0
        self.known: dict[str, float] = {}
        self.judged: dict[tuple, list] = {}
        self.between: dict[str, str] = {}
        self.bytes: dict[str, dict[str, str]] = defaultdict(dict)

    def after(self, a: str, b: str) -> float:
        """log P(b | a)."""
        if (known := self.known.get(a + b)) is None:
            i = S.mixed_int(ord(a) * 0x110000 + ord(b)) % BIGRAMS
            second, seen = self.letters[ord(b) % LETTERS], self.letters[ord(a) % LETTERS]
            # no pair is more frequent than its letters: most collisions of the table go no further
            both = min(seen, second, self.pairs[i])
            known = self.known[a + b] = math.log((both + self.WEIGHT * (second + 0.01) / self.total) / (seen + self.WEIGHT))
            if len(self.known) > 500_000:
                self.known.clear()
        return known

    def letter_between(self, a: str, b: str) -> str:
        """The letter of one lost byte, if one is far likelier than all others there; else the replacement character."""
        if (known := self.between.get(a + b)) is None:
            (best, letter), (next_best, _) = sorted(((self.after(a, x) + self.after(x, b), x) for x in _HIGH_LETTERS), reverse=True)[:2]
            known = self.between[a + b] = letter if best > -9 and best - next_best > 1.5 else LOST
        return known

    def likelihood(self, text: str, before: str, behind: str) -> float:
        known, after, a, total = self.known, self.after, before or " ", 0.0
        for b in f"{text}{behind or ' '}":
            p = known.get(a + b)
            total += after(a, b) if p is None else p
            a = b
        return total


def _decoded(raw: str, encoding: str) -> str | None:
    try:
        made = raw.encode("latin-1").decode(encoding)
    except UnicodeDecodeError:
        return None
    return made if all(c.isprintable() or c in "\u3000\xa0\xad\u200b\u200c\u200d\ufeff\n\r\t" or "\x80" <= c < "\xa0" for c in made) else None


def _wide_bytes(line: str, codec: str, known: dict[str, str]) -> tuple[str, list[int]]:
    """The bytes of a line in a code page of several bytes, lost ones as \\x1a, and the character each belongs to."""
    parts, owner = [], []
    for i, c in enumerate(line):
        if (b := known.get(c)) is None:
            try:
                b = c.encode(codec).decode("latin-1")
            except UnicodeEncodeError:
                b = "\x1a" if c == LOST else "\x00"
            known[c] = b
        parts.append(b)
        owner.extend([i] * len(b))
    return "".join(parts), owner


def _fill(symbols: list[str], encoding: str, before: str, language: Language, learned: dict) -> str:
    """Letters of symbols some of which lost a byte: what was learned of the symbol, else the letter that fits best."""
    made = before or " "
    for s in symbols:
        if "\x1a" not in s:
            made += _decoded(s, encoding) or LOST
            continue
        best, at = LOST, -20.0
        for c in learned.get(s) or _letters_of(s, encoding):
            if (p := language.after(made[-1], c)) > at:
                best, at = c, p
        made += best
    return made[1:]


_OPTIONS: dict[tuple[str, str], list[str]] = {}


def _letters_of(symbol: str, encoding: str) -> list[str]:
    if (symbol, encoding) not in _OPTIONS:
        made = (_decoded(symbol.replace("\x1a", chr(b)), encoding) for b in range(0x80, 0xFF))
        _OPTIONS[symbol, encoding] = [c for c in made if c and len(c) == 1]
    return _OPTIONS[symbol, encoding]


def _second(m: re.Match) -> str:
    return _decoded(m[0], "utf-8") or m[0]


class Run:
    """A stretch of text, a cipher, and its letters."""

    __slots__ = ("start", "end", "cipher", "letters", "symbols", "gain")

    def __init__(self, start: int, end: int, cipher: str, letters: str, symbols: list[str]) -> None:
        self.start, self.end, self.cipher, self.letters, self.symbols, self.gain = start, end, cipher, letters, symbols, 0.0

    def moved(self, by: int) -> Run:
        self.start, self.end = self.start + by, self.end + by
        return self


def _judged(language: Language, k: int, raw: str, as_is: str, before: str, behind: str) -> list[tuple[str, str, list[str], float]]:
    """(cipher, letters, symbols, gain) of a run of the ciphers of one byte; remembered, as runs of genuine accents recur."""
    key = (k, raw, before, behind)
    if (known := language.judged.get(key)) is not None:
        return known
    name, page, encoding, symbol = CIPHERS[k]
    found = []
    if (letters := _decoded(raw, encoding)) is not None:
        plain = language.likelihood(as_is, before, behind)
        found.append((name, letters, re.findall(symbol, raw), language.likelihood(letters, before, behind) - plain))
        if name == "utf8_western":
            once = letters.translate(_TABLES[page])
            if (twice := _TWICE.sub(_second, once)) != once:
                found.append(("utf8_western_twice", twice, [], language.likelihood(twice, before, behind) - plain))
    if len(language.judged) > 200_000:
        language.judged.clear()
    language.judged[key] = found
    return found


def _runs(text: str, language: Language, learned: dict, shares: dict[str, float]) -> Iterator[Run]:
    """The runs of a line that are likelier garbled than not under some cipher."""
    views: dict[str, str] = {}
    for k, (_, page, *_rest) in enumerate(CIPHERS):
        if page not in views:
            views[page] = text.translate(_TABLES[page])
        for m in _PATTERNS[k].finditer(views[page]):
            start, end = m.span()
            for name, letters, symbols, gain in _judged(language, k, m[0], text[start:end], text[start - 1 : start], text[end : end + 1]):
                if gain > 0 and (gain := gain + math.log(shares.get(name, FIRST_SHARE))) > 0:
                    run = Run(start, end, name, letters, symbols)
                    run.gain = gain
                    yield run
    for k, (name, page, encoding, symbol) in enumerate(WIDE):
        if _TELLTALES[name].search(text):
            raw, owner = _wide_bytes(text, page, language.bytes[page])
            owner.append(len(text))
            for m in _WIDE_PATTERNS[k].finditer(raw):
                start, end = owner[m.start()], owner[m.end() - 1] + 1
                if m.start() and owner[m.start() - 1] == start or owner[m.end()] == end - 1:  # it begins or ends inside a character
                    continue
                if name == "euc_sjis" and (_NARROW.match(text[start - 1 : start]) or _NARROW.match(text[end : end + 1]) or not _KANA_ROWS.search(m[0])):
                    continue
                symbols = re.findall(symbol, m[0])
                before, behind = text[start - 1 : start], text[end : end + 1]
                run = Run(start, end, name, _fill(symbols, encoding, before, language, learned.get(name, {})), symbols)
                run.gain = language.likelihood(run.letters, before, behind) - language.likelihood(text[start:end], before, behind) + math.log(shares.get(name, FIRST_SHARE))
                if run.gain > 0:
                    yield run


def garbled_runs(text: str, language: Language, shares: dict[str, float], learned: dict) -> list[Run]:
    """The runs of ``text`` that are likelier garbled than not, none overlapping another; a run never spans lines."""
    chosen: list[Run] = []
    at = 0
    for line in text.split("\n"):
        if SUSPECT.search(line):
            taken = bytearray(len(line))
            for run in sorted(_runs(line, language, learned, shares), key=lambda r: -r.gain):
                if not any(taken[run.start : run.end]):
                    taken[run.start : run.end] = b"\x01" * (run.end - run.start)
                    chosen.append(run.moved(at))
            # a character that no decoder but a failing one makes
            chosen += [Run(m.start() + at, m.end() + at, "lost", m[0], [m[0]]) for m in _FAILED.finditer(line) if not any(taken[m.start() : m.end()])]
        at += len(line) + 1
    return sorted(chosen, key=lambda r: r.start)


def translated(text: str, runs: list[Run], language: Language, learned: dict, depth: int = 2) -> str:
    """``text`` with the runs' symbols translated; what is still garbled then is done again, as after two wrong readings."""
    parts, at = [], 0
    for run in runs:
        parts.append(text[at : run.start])
        if run.cipher == "lost":
            before = next((x[-1] for x in reversed(parts) if x), " ")
            parts.append(language.letter_between(before, text[run.end : run.end + 1] or " ") if len(run.letters) == 1 else run.letters)
        else:
            table = learned.get(run.cipher, {})
            direct = len(run.symbols) == len(run.letters)
            parts.append("".join((table.get(s, [c])[0] if "\x1a" not in s else c) for s, c in zip(run.symbols, run.letters, strict=True)) if direct else run.letters)
        at = run.end
    made = "".join([*parts, text[at:]])
    if depth > 1 and made != text and SUSPECT.search(made):
        again = [r for r in garbled_runs(made, language, {}, learned) if r.cipher != "lost"]
        if again:
            return translated(made, again, language, learned, depth - 1)
    return made


_HIGH_LETTERS = [c for c in _single("cp1252") if c.isalpha() or c in "’‘“”–—«»…°"]
_COUNTED = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("text", pa.string()), ("segment", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("kind", pa.int32())])
_PARTS = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("counts", pa.binary()), ("source", pa.string()), ("cipher", pa.string()), ("symbol", pa.string()), ("letter", pa.string()), ("n", pa.float64()), ("kind", pa.int32())])
_PARTS_DDL = "segment int, part int, counts binary, source string, cipher string, symbol string, letter string, n double, kind int"


def _count(texts: list[str], into: np.ndarray) -> None:
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) > 1:
        into[:BIGRAMS] += np.bincount(bigram_places(codes), minlength=BIGRAMS)
    into[BIGRAMS:] += np.bincount((codes % np.uint64(LETTERS)).astype(np.int64), minlength=LETTERS)


def read_documents(df: DataFrame, record: str, text: str, source: str) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, source, text) of the texts that hold symbols of any cipher, stored, and the counts over all texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, part = np.zeros(BIGRAMS + LETTERS, dtype=np.int64), 0
        for b in batches:
            rows = [r for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) if r[2]]
            held: list[str] = []
            size = 0
            for _, _, t in rows:
                held.append(t)
                size += len(t)
                if size > 4_000_000:
                    _count(held, counts)
                    held, size = [], 0
            _count(held, counts)
            if found := [r for r in rows if SUSPECT.search(r[2])]:
                part = found[0][0] % 16
                yield S.batch(_COUNTED, {"doc_id": [r[0] for r in found], "source": [r[1] for r in found], "text": [r[2] for r in found], "kind": [0] * len(found)})
        if packed := S.packed(counts):
            yield S.batch(_COUNTED, {"segment": [i for i, _ in packed], "part": [part] * len(packed), "counts": [c for _, c in packed], "kind": [1] * len(packed)})

    rows = df.where(F.col(record).isNotNull()).select(F.col(record).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    both = stored(rows.mapInArrow(read, "doc_id long, source string, text string, segment int, part int, counts binary, kind int"), "kind")
    return both.where("kind = 0").select("doc_id", "source", "text"), S.summed(both.where("kind = 1").select("segment", "part", "counts"), BIGRAMS + LETTERS).astype(np.int64)



def _expect(docs: DataFrame, counts: np.ndarray, learned: dict) -> DataFrame:
    """One E-step over (doc_id, source, text, _shares)."""
    shared = docs.sparkSession.sparkContext.broadcast((counts.astype(np.int32), learned))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, learned = Language(shared.value[0]), shared.value[1]
        away, back = np.zeros(BIGRAMS + LETTERS, dtype=np.int64), np.zeros(BIGRAMS + LETTERS, dtype=np.int64)
        runs_of: Counter = Counter()
        letters: Counter = Counter()
        before, after, size = [], [], 0
        for b in batches:
            for _, source, text, shares in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                runs_of[source, ""] += 1
                runs = garbled_runs(text, language, dict(shares or []), learned)
                if not runs:
                    continue
                for name in {r.cipher for r in runs}:
                    runs_of[source, name] += 1
                for r in runs:
                    if len(r.symbols) == len(r.letters) and r.cipher != "lost":
                        letters.update((r.cipher, s, c) for s, c in zip(r.symbols, r.letters, strict=True))
                before.append(text)
                after.append(translated(text, runs, language, learned))
                size += len(text)
                if size > 4_000_000:
                    _count(before, away)
                    _count(after, back)
                    before, after, size = [], [], 0
        _count(before, away)
        _count(after, back)
        for kind, table in ((0, away), (1, back)):
            if packed := S.packed(table):
                yield S.batch(_PARTS, {"segment": [i for i, _ in packed], "part": [0] * len(packed), "counts": [c for _, c in packed], "kind": [kind] * len(packed)})
        if runs_of:
            yield S.batch(_PARTS, {"source": [k[0] for k in runs_of], "cipher": [k[1] for k in runs_of], "n": list(map(float, runs_of.values())), "kind": [2] * len(runs_of)})
        if letters:
            yield S.batch(_PARTS, {"cipher": [k[0] for k in letters], "symbol": [k[1] for k in letters], "letter": [k[2] for k in letters], "n": list(map(float, letters.values())), "kind": [3] * len(letters)})

    return docs.mapInArrow(step, _PARTS_DDL)


def _learned(parts: DataFrame) -> dict:
    """For each cipher its symbols' letters, likeliest first; as many rows as the code pages have characters, at most."""
    sums = parts.where("kind = 3").groupBy("cipher", "symbol", "letter").agg(F.sum("n").alias("n"))
    found: dict = defaultdict(lambda: defaultdict(list))
    for r in sums.orderBy("cipher", "symbol", F.desc("n"), "letter").toLocalIterator():
        found[r["cipher"]][r["symbol"]].append(r["letter"])
    return {k: dict(v) for k, v in found.items()}


def _with_shares(docs: DataFrame, shares: DataFrame | None) -> DataFrame:
    if shares is None:
        return docs.select("doc_id", "source", "text", F.lit(None).cast("map<string,double>").alias("_shares"))
    return docs.join(shares.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").select("doc_id", "source", "text", "_shares")


def restore(df: DataFrame, record: str = "doc_id", text: str = "text", source: str = "source", rounds: int = ROUNDS) -> DataFrame:
    """(<record>, source, restored, ciphers): the affected texts with what could be put right, and the ciphers found.

    Symbols whose letter can't be told keep the replacement character.  Null and empty texts are unaffected;
    a null source is a source of its own; rows with a null id are ignored.
    """
    docs, counts = read_documents(df, record, text, source)
    shares, learned, as_read = None, {}, counts
    for _ in range(rounds):
        parts = stored(_expect(_with_shares(docs, shares), counts, learned))
        away, back = (S.summed(parts.where(F.col("kind") == k).select("segment", "part", "counts"), BIGRAMS + LETTERS).astype(np.int64) for k in (0, 1))
        counts = np.maximum(as_read - away + back, 0)
        learned = _learned(parts)
        sums = parts.where("kind = 2").groupBy("source", "cipher").agg(F.sum("n").alias("n"))
        every = sums.where("cipher = ''").select(F.col("source").alias("s"), F.col("n").alias("all"))
        share = sums.where("cipher != ''").join(every, F.col("source").eqNullSafe(F.col("s"))).withColumn("p", F.greatest(F.lit(LEAST_SHARE), F.col("n") / (F.col("all") + 10)))
        shares = share.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("cipher", "p"))).alias("_shares"))
    shared = docs.sparkSession.sparkContext.broadcast((counts.astype(np.int32), learned))
    out = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("restored", pa.string()), ("ciphers", pa.string())])

    def put_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, learned = Language(shared.value[0]), shared.value[1]
        for b in batches:
            rows = []
            for doc, source, text, shares in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if runs := garbled_runs(text, language, dict(shares or []), learned):
                    rows.append((doc, source, translated(text, runs, language, learned), ",".join(sorted({r.cipher for r in runs}))))
            if rows:
                yield S.batch(out, dict(zip(out.names, zip(*rows, strict=True), strict=True)))

    made = _with_shares(docs, shares).mapInArrow(put_right, "doc_id long, source string, restored string, ciphers string")
    return made.withColumnRenamed("doc_id", record)

"""One plain form for texts that look the same (problem 4).

Quick-check properties of the characters, taken from the character database by rule, isolate the unstable
segments of a text: characters with a compatibility form, invisible characters, unusual spaces, letters that
may stand for one of another alphabet, and what canonical composition may join to the character before it
(separate accents of all scripts, voicing marks, conjoining jamo). A JVM regular expression over the unstable
characters passes stable texts by untouched. Only in the others, only the unstable segments are normalized,
each with its boundary context (the starter before a mark, the word around a letter, the words beside a
word), and spliced in between what stays, by position.

Letters that look alike are a short fixed list and, once `use` has been given it, the public confusables data
that Spark's ICU library carries (`lookalikes`). Letters of that data only count inside words that also have
letters of the alphabet they stand in for; whole words are judged by the fixed list.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other alphabets or sorts that look like a basic Latin letter.
LATIN_LOOKALIKES = (
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҮY үy "
    "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ιi ρp υu κk "
    "ոn սu օo հh ցg քp աw զq ՍU ՏS ՕO ԼL "
    "ɑa ɡg ɩi ʏy ꮯc ᴏo ᴄc ᴠv ᴡw ᴢz ɪi Ꭺa"
)
# Cyrillic letters and the Latin letters that look like them.
CYRILLIC_LOOKALIKES = "aа eе oо pр cс yу xх jј AА BВ EЕ KК MМ HН OО PР CС TТ YУ XХ JЈ kк mм tт"

TO_LATIN = {a: b for a, b in LATIN_LOOKALIKES.split()}
TO_CYRILLIC = {a: b for a, b in CYRILLIC_LOOKALIKES.split()}
LINK_OR_MENTION = r"https?://\S+|@\w+|&#?\w{1,31};"
_IGNORED = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" or ord(ch) in _IGNORED


def _odd_space(ch: str) -> bool:
    return ch != " " and unicodedata.category(ch) in ("Zs", "Zl", "Zp")


def _styled(ch: str) -> bool:
    """A wide, styled or joined form. Ordinary signs such as ordinals, powers and ellipses aren't."""
    kind = unicodedata.decomposition(ch).split(" ")[0]
    if kind in ("<wide>", "<narrow>", "<font>"):
        return True
    if kind in ("<compat>", "<circle>", "<square>", "<super>", "<sub>", "<initial>", "<medial>", "<final>", "<isolated>"):
        whole = unicodedata.normalize("NFKC", ch)
        return whole.isalpha() and unicodedata.category(ch)[0] in "L" + "S" * (kind == "<circle>") and ch not in "ªº"
    return False


def _singleton(ch: str) -> bool:
    """A character that canonical normalization alone replaces, such as the Kelvin sign."""
    return unicodedata.normalize("NFC", ch) != ch


@lru_cache(1)
def _special() -> list[str]:
    """Characters beyond ASCII that have a mapping, a canonical class or no shape of their own. Planes 4 to 13 of
    the character database are empty, 15 and 16 private."""
    planes = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)))
    return [ch for ch in planes if unicodedata.decomposition(ch) or unicodedata.combining(ch) or unicodedata.category(ch) in ("Cf", "Zs", "Zl", "Zp") or ord(ch) in _IGNORED]


@lru_cache(1)
def composing() -> frozenset[str]:
    """Characters that may join or change places with what is before them: those of a canonical class other
    than 0, and those whose NFC quick check is Maybe (the second half of a composed pair)."""
    out = {ch for ch in _special() if unicodedata.combining(ch)}
    for ch in _special():
        pair = unicodedata.decomposition(ch)
        if pair and pair[0] != "<" and " " in pair and unicodedata.normalize("NFC", ch) == ch:
            out.add(chr(int(pair.split(" ")[1], 16)))
    return frozenset(out | {chr(cp) for cp in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _as_ranges(chars: set[str]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for cp in sorted(map(ord, chars)):
        if out and out[-1][1] == cp - 1:
            out[-1] = (out[-1][0], cp)
        else:
            out.append((cp, cp))
    return out


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(4)
def unstable_ranges(more: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Ranges of the characters that may be unstable, by rule from the character database; `more` are letters
    that look like others."""
    moved = {ch for ch in _special() if _invisible(ch) or _odd_space(ch) or _styled(ch) or _singleton(ch)}
    return _as_ranges(moved | composing() | set(TO_LATIN) | more | set(map(chr, range(0x370, 0x590))))


def unstable_pattern(more: frozenset[str] = frozenset(), least: int = 10) -> str:
    """A Java regular expression that finds any character that may be unstable.

    It is what is left of the longer stable ranges, tried from the lowest: the matcher then needs one comparison
    for a basic letter, two for an accented one and few for others. What lies between short stable ranges counts
    as unstable here; plain() leaves it as it is."""
    stable, at = [], 0x80
    for a, b in [*unstable_ranges(more), (sys.maxunicode + 1, sys.maxunicode + 1)]:
        if a - at >= least:
            stable.append((at, a - 1))
        at = b + 1
    spans = [f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in stable]
    return "[\\x{80}-\\x{10ffff}" + "".join(f"&&[^{x}]" for x in spans[:2]) + "&&[^" + "".join(spans[2:]) + "]]"


def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Letter -> basic Latin letter of the public confusables data, for letters outside the Latin blocks of
    left-to-right alphabets that aren't ideographs or syllables of them. Empty where Spark comes without its ICU library."""
    try:
        spoof = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        basic = [chr(c) for c in (*range(0x61, 0x7B), *range(0x41, 0x5B))]
        shapes = dict(zip(reversed([spoof.getSkeleton(c) for c in basic]), reversed(basic)))
        planes = map(chr, (*range(0x250, 0x1E00), *range(0x1F00, 0x3400), *range(0xA000, 0xAC00), *range(0xFB00, 0x17000)))
        letters = [ch for ch in planes if unicodedata.category(ch) in ("Lu", "Ll", "Lo") and unicodedata.bidirectional(ch) == "L" and not unicodedata.decomposition(ch)]
        seen = spoof.getSkeleton("\n".join(letters)).split("\n")
    except (TypeError, AttributeError):
        return {}
    return {ch: shapes[k] for ch, k in zip(letters, seen) if k in shapes}


_wide: dict[str, str] = dict(TO_LATIN)


def use(table: dict[str, str]) -> None:
    """Makes this process count the letters of `table` as look-alikes too. The fixed list goes first."""
    wanted = table | TO_LATIN
    if wanted != _wide:
        _wide.clear()
        _wide.update(wanted)
        _word_kind.cache_clear()
        _other.cache_clear()


@lru_cache(1)
def _single_forms() -> dict[int, str]:
    """What each unstable character that needs no context becomes."""
    out = {}
    for a, b in unstable_ranges():
        for ch in map(chr, range(a, b + 1)):
            if _invisible(ch):
                out[ord(ch)] = ""
            elif _odd_space(ch):
                out[ord(ch)] = " "
            elif _styled(ch):
                out[ord(ch)] = unicodedata.normalize("NFKC", ch)
            elif _singleton(ch):
                out[ord(ch)] = unicodedata.normalize("NFC", ch)
    return out


@lru_cache(1)
def _marked() -> re.Pattern:
    """A starter and what may compose with it or stands in order behind it."""
    marks = _class(_as_ranges(set(composing())))
    return re.compile(f"[^{marks}][{marks}]+")


@lru_cache(1)
def _other() -> re.Pattern:
    """Letters for whose sake words are looked at."""
    more = "".join(sorted(re.escape(ch) for ch in _wide))
    return re.compile(f"[ɐ-ʯͰ-\u058f\u13a0-\u13ff\u1d00-\u1d2b\uab30-\uabbf{more}]")


_EMOJI = "[\U0001f000-\U0001faff←-⇿⌀-➿⤀-⥿⬀-⯿〰〽㊗㊙©®‼⁉™ℹ]"
#: An emoji with its selectors, joiners, tags and keycaps; nothing in it is touched.
_EMOJI_RUN = re.compile(f"(?:{_EMOJI}[︎️]?[\U0001f3fb-\U0001f3ff]?[\U000e0020-\U000e007f]*|[0-9#*]️?⃣)(?:‍{_EMOJI}[︎️]?[\U0001f3fb-\U0001f3ff]?)*")
_HELD = re.compile(LINK_OR_MENTION)
_JOINER = re.compile("[‍︎️⃣\U000e0020-\U000e007f]")
_WORD = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
_BREAK = re.compile(r"[.!?\n]")


def _script(ch: str) -> str:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "L"
    if 0x400 <= cp < 0x530:
        return "C"
    return "o" if ch in TO_LATIN else "G" if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000 else "A" if 0x530 <= cp < 0x590 else "x"


def _base(ch: str) -> str:
    return unicodedata.normalize("NFD", ch)[0]


def _turned(word: str, table: dict[str, str]) -> str:
    """The word with the letters of the table replaced, also below their accents."""
    out = []
    for c in word:
        if c not in table and (apart := unicodedata.normalize("NFD", c)) != c and apart[0] in table:
            c = unicodedata.normalize("NFC", table[apart[0]] + apart[1:])
        out.append(table.get(c, c))
    return "".join(out)


@lru_cache(1 << 16)
def _word_kind(word: str) -> tuple[str, str]:
    """(kind, replacement): L or C where the word has letters of its own of that alphabet, l or c
    where all could be either, g where all of another look Latin, o where it is of another alphabet;
    replacement where it is mixed."""
    letters = [c for c in word if c.isalpha()]
    latin = [c for c in letters if _script(c) == "L"]
    cyrillic = [c for c in letters if _script(c) == "C"]
    if len(latin) == len(letters):
        return ("l" if all(_base(c) in TO_CYRILLIC for c in letters) else "L"), word
    to_latin = "".join(c if _script(c) == "L" else TO_LATIN.get(c, c) for c in word)
    all_latin = all(_script(c) == "L" for c in to_latin if c.isalpha())
    if len(cyrillic) == len(letters):
        return ("c" if all_latin else "C"), word
    if cyrillic and latin and len(latin) + len(cyrillic) == len(letters):
        own = [c for c in cyrillic if c not in TO_LATIN]
        if own and all(_base(c) in TO_CYRILLIC for c in latin):
            return "C", "".join(_turned(c, TO_CYRILLIC) if _script(c) == "L" else c for c in word)
        if not own:
            return "L", to_latin
    if all_latin and (latin or len({_script(c) for c in letters}) > 1 or any(_script(c) == "o" and 0x250 <= ord(c) < 0x370 for c in letters)):
        return "L", to_latin
    if latin:
        wide = "".join(c if _script(c) == "L" else _turned(c, _wide) for c in word)
        if all(_script(c) == "L" for c in wide if c.isalpha()):
            return "L", wide
    return ("g" if all_latin else "o"), word


def _letters(parts: list[str]) -> list[str]:
    """The parts of a text with letters of another alphabet or sort replaced, word by word. A word that could
    be of two alphabets follows the nearest words of one before and after it, those of its sentence first."""
    words: list[tuple[int, int, int, str, str, int]] = []  # part, start, end, kind, replacement, sentence
    sentence = 0
    for p, text in enumerate(parts):
        at = 0
        for m in _WORD.finditer(text):
            sentence += bool(_BREAK.search(text, at, m.start()))
            words.append((p, m.start(), m.end(), *_word_kind(m[0]), sentence))
            at = m.end()
        sentence += bool(_BREAK.search(text, at))
    sure = [k for k, w in enumerate(words) if w[3] in "LC"]
    known = {w[3] for w in words} & {"L", "C", "o"}
    out: list[list[str]] = [[] for _ in parts]
    at, p, ahead = 0, 0, 0
    for k, (part, start, end, kind, new, own) in enumerate(words):
        while p < part:
            out[p].append(parts[p][at:])
            p, at = p + 1, 0
        while ahead < len(sure) and sure[ahead] <= k:
            ahead += 1
        if kind in "lcg":
            behind = ahead - 1 - (ahead > 0 and sure[ahead - 1] == k)
            beside = [words[sure[j]] for j in (behind, ahead) if 0 <= j < len(sure)]
            near = [w[3] for w in beside if w[5] == own] or [w[3] for w in beside]
            if near and all(x == "L" for x in near) and kind in "cg" or not near and kind in "cg" and len(new) > 2 and not known:
                new = "".join(TO_LATIN.get(c, c) for c in new)
            elif near and all(x == "C" for x in near) and kind == "l":
                new = _turned(new, TO_CYRILLIC)
        out[part] += [parts[part][at:start], new]
        at = end
    while p < len(parts):
        out[p].append(parts[p][at:])
        p, at = p + 1, 0
    return ["".join(x) for x in out]


def plain(text: str | None) -> str | None:
    """The plain form of a text. Null stays null; links, mentions and emoji stay as they are."""
    if text is None or text.isascii():
        return text
    held = [m.span() for m in _HELD.finditer(text)]
    if _JOINER.search(text):
        edges = [0, *(x for span in held for x in span), len(text)]
        held += [m.span() for a, b in zip(edges[::2], edges[1::2]) for m in _EMOJI_RUN.finditer(text, a, b)]
        held.sort()
    edges = [0, *(x for span in held for x in span), len(text)]
    parts = [text[a:b].translate(_single_forms()) for a, b in zip(edges[::2], edges[1::2])]
    parts = [_marked().sub(lambda m: unicodedata.normalize("NFC", m[0]), p) for p in parts]
    if any(_other().search(p) for p in parts):
        parts = _letters(parts)
    kept = [text[a:b] for a, b in held]
    return "".join(x for pair in zip(parts, [*kept, ""]) for x in pair)


def unstable(text: Column, more: frozenset[str] = frozenset()) -> Column:
    """Whether a text has a character that may be unstable. Null gives false."""
    return F.coalesce(text.rlike(unstable_pattern(more)), F.lit(False))


def plain_forms(df: DataFrame, key: list[str], text: str, only_changed: bool = False) -> DataFrame:
    """(key columns, text, plain): every row's text in its plain form.

    Null gives null, an empty text an empty one, repeated rows repeated results; other columns
    are left out. only_changed keeps the rows whose text, links and mentions aside, differs from
    its plain form, and reads the rest no further than the quick check.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    src = df.select(*key, F.col(text).cast("string").alias("text"))

    table = lookalikes(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(table)
    shaky = unstable(F.col("text"), frozenset(table))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        use(shipped.value)
        for pdf in batches:
            pdf["plain"] = [plain(t) for t in pdf["text"]]
            yield pdf[pdf["plain"] != pdf["text"]] if only_changed else pdf

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in key), "text string, plain string"])
    done = src.where(shaky).mapInPandas(run, schema)
    return done if only_changed else done.unionByName(src.where(~shaky).withColumn("plain", F.col("text")))

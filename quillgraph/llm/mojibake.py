"""Text garbled by a wrong decoding (problem 3).

For every pair of an encoding that the bytes had and one that they were read in, the garbled sequences are computed
beforehand. Of UTF-8 these are the two-character sequences and the first two of longer ones, each with its form in lower
case, for all the readers, in one Aho-Corasick automaton; a matched span is encoded with its reader and decoded as
UTF-8, span by span, again if it had been garbled twice. Of single-byte encodings read in another they are the
characters that letters become, with the kinds of their neighbours where no word holds them, in a second automaton over
the text in classes of letters; the words that hold a sequence vote for a pair, and they and the words with letters that
their language lacks are decoded, while words that are right as they stand, in any language, are left. Pairs are tried
one after the other until nothing garbled is left, so a text may be damaged in several ways. Other scripts that were
read in a single-byte encoding and East Asian ones have too many sequences; their runs are decoded with every pair. What
holds replacement characters, or what no pair decodes to plain words, is reported without an original.

Defined cases: null and empty texts are not garbled; a text that is partly garbled is reported once; rows that repeat
give one result.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Encodings in which UTF-8 or other bytes are read by mistake.
READERS = ["cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp866", "cp1253", "cp1254"]
#: What Latin text was written in, against the readers.
LATIN = ["cp1252", "mac_roman", "cp850", "cp437", "cp1250"]
#: What other scripts were written in.
OTHER = ["cp1251", "koi8_r", "cp866", "iso8859_5", "iso8859_7", "cp1253", "cp1256", "iso8859_6", "gb18030", "big5", "shift_jis", "euc_jp", "euc_kr"]
#: What Cyrillic text was written and read in.
CYRILLIC = ["cp1251", "koi8_r", "cp866"]
#: Signs that stand between letters in right text, too.
SIGNS = set("×÷±−≤≥•™©®°†‡§¶·")
# Letters of European languages beyond ASCII, marks that stand in running text, frequent Russian pairs.
LETTERS = set("äöüßéèêëàâçîïôûùúíóáñãõøåæœðþłőűčžšśćńąęěřůýďťňğşıțșăżźđ" + "ÄÖÜÉÈÊËÀÂÇÎÏÔÛÙÚÍÓÁÑÃÕØÅÆŒÐÞŁŐŰČŽŠŚĆŃĄĘĚŘŮÝĎŤŇĞŞİȚȘĂŻŹĐ")
USUAL = set("äöüßéèêàâçîôûúíóáñãøåæþðłőčžțÎÉÄÖÜÞÐØÂÅŁ")
COMMON = set("äöüßéèêàâçîôûúíóáñãõ")
MARKS = set("‘’“”„«»‹›…–—•°§¶©®™€£¥¼½¾±µ×÷√≈≤≥Ω¬№¿¡ ²³ªº·†‡")
RUSSIAN_PAIRS = set("ст но то на ен ов ни ра во ко ал ер ро по ре пр го ли ос ли не ан та ор ка од ет ел ва ол те ла ти ам ом ом ло ат ле ри де ны ый ой ий до та ру ар ве ес об ак от вы дн ны бо за ог же уст ус ча фе кс".split())

_FREE = re.compile(r"[^\x00-\x7f]")
_DEAD = re.compile("[�\x80-\x84\x86-\x9f]")


def _byte(reader: str, b: int) -> str:
    """What a reader makes of a byte; what its table leaves open is read as a control character."""
    try:
        return bytes([b]).decode(reader)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=None)
def to_bytes(reader: str) -> dict[str, int]:
    table = {_byte(reader, b): b for b in range(128, 256)}
    if reader in ("cp1252", "cp1250", "cp1254"):
        for b in range(128, 160):  # read as ISO 8859-1
            table.setdefault(chr(b), b)
    return table


def _plausible(c: str) -> bool:
    """A character that text is likely to hold: of the scripts in use, or a mark."""
    o = ord(c)
    return (
        c in MARKS
        or c in LETTERS
        or 0xA0 <= o <= 0xFF
        or c in "ƒˆ˜‰Ÿ‚ŠŒŽšœž" or 0x80 <= o < 0xA0  # garbled twice
        or 0x386 <= o <= 0x3CE
        or 0x401 <= o <= 0x45F
        or o in (0x490, 0x491)
        or 0x60C <= o <= 0x652
        or 0x660 <= o <= 0x669
        or 0x5D0 <= o <= 0x5EA
        or 0x900 <= o <= 0x97F
        or 0xE01 <= o <= 0xE5B
        or 0x1E00 <= o <= 0x1FFF
        or 0x2010 <= o <= 0x203A
        or 0x20A0 <= o <= 0x20BF
        or 0x2100 <= o <= 0x2265
        or 0x25A0 <= o <= 0x2612
        or 0x3001 <= o <= 0x30FF
        or 0x4E00 <= o <= 0x9FA5
        or 0xAC00 <= o <= 0xD7A3
        or 0xFF01 <= o <= 0xFF5E
        or 0xFB01 <= o <= 0xFB02
    )


@lru_cache(maxsize=1)
def automaton():
    """Garbled sequences of UTF-8 with the readers that make them; (readers, lower case?) by sequence."""
    import ahocorasick

    found: dict[str, set[tuple[str, bool]]] = {}
    for reader in READERS:
        high = {b: _byte(reader, b) for b in range(128, 256)}
        variants = [high]
        if reader == "cp1252":
            variants.append({b: chr(b) if b < 160 else high[b] for b in high})
        for h in variants:
            for lead in range(0xC2, 0xF0):
                for second in range(0x80, 0xC0):
                    if lead < 0xE0:
                        if not _plausible(bytes([lead, second]).decode()):
                            continue
                    elif not _third(lead, second):
                        continue
                    if reader == "koi8_r" and h[second] in "ёЁ":
                        continue  # letters of the reader's own script
                    g = h[lead] + h[second]
                    found.setdefault(g, set()).add((reader, False))
                    if g.lower() != g and len(g.lower()) == len(g):
                        found.setdefault(g.lower(), set()).add((reader, True))
    a = ahocorasick.Automaton()
    for g, readers in found.items():
        a.add_word(g, (len(g), sorted(readers)))
    a.make_automaton()
    return a


def _third(lead: int, second: int) -> bool:
    for t in (0x80, 0x93, 0xA6, 0xBF):
        try:
            if _plausible(bytes([lead, second, t]).decode()):
                return True
        except UnicodeDecodeError:
            pass
    return False


def _decode_at(text: str, i: int, table: dict[str, int]) -> tuple[str, int] | None:
    """The character that begins at ``i`` in garbled form, and where that form ends."""
    b = table.get(text[i])
    if b is None or not 0xC2 <= b <= 0xF4:
        return None
    n = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
    raw = [b]
    for c in text[i + 1 : i + n]:
        x = table.get(c)
        if x is None:
            x = 0xA0 if c == " " and len(raw) == n - 1 and text[i] in "ÃÂ" and text[i - 1 : i].isalpha() is False else None  # a no-break space that was made a space
        if x is None or not 0x80 <= x < 0xC0:
            return None
        raw.append(x)
    try:
        c = bytes(raw).decode()
    except UnicodeDecodeError:
        return None
    return (c, i + n) if _plausible(c) else None


def _spans(text: str, reader: str, matches: list[int]) -> list[tuple[int, int, str]]:
    """Garbled spans of a reader: (start, end, original), runs of garbled characters as one span."""
    table = to_bytes(reader)
    out: list[tuple[int, int, str]] = []
    end = 0
    for i in matches:
        if i < end:
            continue
        got, j = [], i
        while j < len(text) and (x := _decode_at(text, j, table)):
            got.append(x[0])
            j = x[1]
        if got:
            end = j
            out.append((i, j, "".join(got)))
    return [s for s in out if _sound(text, reader, *s)]


def _sound(text: str, reader: str, i: int, j: int, original: str) -> bool:
    """Is a span garbled, and no chance neighbourhood of characters?"""
    if len(original) >= 2:
        return True
    c = original
    before, after = text[i - 1 : i], text[j : j + 1]
    if reader in ("cp1251", "koi8_r", "cp866", "cp1253"):
        # Letters of the reader's own script stand beside each other by chance.
        return c in LETTERS and (before.isascii() and before.isalpha() or after.isascii() and after.isalpha()) or ord(c) >= 0x2000 and before.isascii() and after.isascii()
    if reader not in ("cp1252", "cp1254") and not ((before.isascii() or not before) and (after.isascii() or not after)):
        return False
    if ord(c) >= 0x3000:
        return not (before.isalpha() and before.isascii()) and not (after.isalpha() and after.isascii())
    if reader == "cp1252" and text[i] in "ÉÈÊÀÔÖÜÄÑÐÓÍÚ" and not (c in LETTERS and (after.isalpha() or before.isalpha() or not before.strip())):
        return False
    return True


_LOWER_FREE = "ãâåäæçéèêëìíîïðñòóôõöøùúûüýþß"


@lru_cache(maxsize=1)
def small_forms() -> tuple[dict[str, str], re.Pattern]:
    """Garbled sequences whose letters were made small, with what they stand for where that is one letter, and a pattern of words that hold one."""
    out: dict[str, set[str]] = {}
    for c in LETTERS | MARKS:
        raw = c.encode()
        for variant in (0, 1):
            g = "".join(chr(b) if variant and b < 160 else _byte("cp1252", b) for b in raw)
            out.setdefault(g.lower(), set()).add(c.lower())
    forms = {g: x.pop() for g, x in out.items() if len(x) == 1 and len(g) > 1}
    return forms, re.compile("|".join(map(re.escape, sorted(forms, key=len, reverse=True))))


def _small(text: str) -> str:
    """Garbled sequences in small letters decoded, in the words that hold one of which the second character is no letter of a word."""
    forms, pattern = small_forms()

    def word(m: re.Match) -> str:
        w = m.group()
        sure = any(not g[1].isalpha() or g[1] in "ªºƒˆ" for g in pattern.findall(w))
        return pattern.sub(lambda g: forms[g.group()], w) if sure else w

    return re.sub(r"\S+", word, text)


def _lowered(text: str, hits: list[tuple[int, int]]) -> int:
    """Garbled sequences in lower case that can't be chance: two or more in one word, or one that no language holds."""
    n = 0
    for i, size in hits:
        g = text[i : i + size]
        if len(g) < 2:
            continue
        second = g[1]
        before, after = text[i - 1 : i], text[i + size : i + size + 1]
        if g[0] in "ãâäåå" and (second in "©¼¤¶±³¡º®´ªŸ¨§¯«²¢£¥¦¬­°µ¸¹½¾¿€‚ƒ†‡ˆ‰Š‹ŒŽ•˜™š›œž\x81\x8d\x8f\x90\x9d\xad" or 0x80 <= ord(second) < 0xA0) and (before.isalpha() or after.isalpha() or not after.isspace() and after):
            n += 2
        elif second in "\x81\x8d\x8f\x90\x9d" or 0x80 <= ord(second) < 0xA0:
            n += 2
        elif not second.isalpha() and second not in "»«…–—’‘“”\xa0 ":
            n += 1
    return n


#: Languages by their letters beyond ASCII.
ALPHABETS = {
    "fr": "éèêëàâçîïôûùœæÉÊÀÂÇÎÔŒ", "de": "äöüßÄÖÜé", "es": "áéíóúñüÁÉÍÓÚÑ", "pt": "ãõçáâàéêíóôúÁÂÉÓÚ", "nordic": "åäöøæéÅÄÖØÆ", "is": "áéíóúýðþæöÁÉÍÓÚÝÞÆÖ",
    "pl": "ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "cs": "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ", "hu": "áéíóöőúüűÁÉÍÓÖŐÚÜŰ", "tr": "çğıöşüâÇĞİÖŞÜ", "ro": "ăâîșțşţĂÂÎȘȚ",
}
#: Characters that may stand between letters, and those that open or close a word.
JOINERS = set("’‘–—…·“«»›‹ºª\xad\xa0")
EDGES = MARKS | {"\xad"}
OPENERS = set("“”„«»‹›¿¡‘’–—…•·°§©®™€£¥†‡\xa0\x85\xad")
_SLAVIC = set("čřěňťďůćđ")
_CLASSES = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" + string.punctuation + "\n\t\r", "a" * 26 + "A" * 26 + "0" * 10 + " " * (len(string.punctuation) + 3))


def _impossible(before: str, g: str, after: str) -> bool:
    """Can no word of right text hold a character between characters of these classes (small, capital, none)?"""
    kind = unicodedata.category(g)
    if kind in ("Ll", "Lu"):
        if g >= "\u0370":
            return before in "aA" and after == "a"  # a letter of another script
        if kind == "Ll":
            return before == after == "A" and g not in "ßı"
        return before == "a"
    inside = before in "aA" and after in "aA"
    return g not in JOINERS and g != "\x85" and not (inside and g in "µ" and after == "A") if inside else g not in EDGES and g != "\x85"


@lru_cache(maxsize=1)
def odd_automaton():
    """Garbled sequences of single-byte encodings, over texts in classes of letters: (length, the pairs that make it) by sequence.

    For every pair a letter is read as another character; with its neighbours this is a sequence that can't be chance
    where no word holds that character there. Two letters in a row make one together.
    """
    import ahocorasick

    found: dict[str, set[tuple[str, str]]] = {}
    small = sorted(c for c in USUAL if c.islower())
    for reader in READERS:
        for source in LATIN:
            if source == reader:
                continue
            seen: dict[str, str] = {}
            for c in sorted(LETTERS):
                try:
                    raw = c.encode(source)
                except UnicodeEncodeError:
                    continue
                g = _byte(reader, raw[0])
                if g == c or g < "\x80" or g in "ﬁﬂ":
                    continue  # ligatures stand in right text
                seen[c] = g
                if g not in OPENERS and (not g.isalpha() or g >= "\u0370" and g != "μ") or g in "ŠŽŸ" and c.islower():
                    found.setdefault(f" {g}aa", set()).add((reader, source))
                for before, after in (("a", "a"), ("A", "a"), ("a", " "), (" ", "a")) if c.islower() else ((" ", "a"), ("A", "A"), ("A", " ")):
                    if _impossible(before, g, after):
                        found.setdefault(before + g + after, set()).add((reader, source))
            for c in small:
                for d in small:
                    if c in seen and d in seen and (_impossible("a", seen[c], "a") or _impossible("a", seen[d], "a")):
                        found.setdefault(f"a{seen[c]}{seen[d]}a", set()).add((reader, source))
    a = ahocorasick.Automaton()
    for g, pairs in found.items():
        a.add_word(g, (len(g), frozenset(pairs)))
    a.make_automaton()
    return a


def odd_words(text: str) -> dict[str, tuple[frozenset, bool]]:
    """Words that hold a garbled sequence: the pairs that make one of them, and whether it stands for more than signs."""
    out: dict[str, tuple[frozenset, bool]] = {}
    slavic = not _SLAVIC.isdisjoint(text)
    # Only what stands around characters beyond ASCII is looked at; a space stands for the ends of the text.
    for run in _AROUND.finditer(text):
        a, z = run.start() - 1, run.end() + 2
        part = " " * (a < 0) + text[max(0, a) : z].translate(_CLASSES) + " " * (z > len(text))
        for e, (n, pairs) in odd_automaton().iter(part):
            i = a + e - n + 2  # past the neighbour
            if slavic and text[i] in "ŠŽ":
                continue  # a capital of the language
            m = _word(text, i, i + n - 2)
            if m:
                w = m.group()
                had = out.get(w, (frozenset(), False))
                out[w] = (had[0] | pairs, had[1] or not set(text[i : i + n - 2]) <= SIGNS)
    return out


_AROUND = re.compile(r"[^\x00-\x7f]+(?:[\x00-\x7f]{1,3}[^\x00-\x7f]+)*")
_RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_ODD_CYRILLIC = re.compile(r"[рсг][°±»µ¶§©®¬¤¦](?=[рсг])|[а-яА-Я][°±µ¶§©®¬¤¦](?=[а-я])|[A-Za-z]г[§©±¤¶ÿ°](?=[a-z])")
_WORD_AT = re.compile(r"[^\s,;:()\[\]/]+")
#: Marks that stand alone, at the head of a word or within one only where another character was.
_SIGN = "¡¿‰¸ˆ˙˚˛˝ˇ¯¨´˜¤¦¬£¥¢§¶†‡•™©®±²³¹¼½¾∂∑∏π∫Ω√∞≈∆≠≤≥◊ƒ„‹‚€"
_AMID = re.compile(f"(?<=[À-ÿŒœ])[{_SIGN}](?=[à-ÿœ])|(?<=[A-Za-zÀ-ÿŒœ])[{_SIGN}Ͱ-ϿЀ-џ]{{2,}}(?=[a-zà-ÿœ])")
#: A word between marks, and letters beside which they hardly stand: the sharp s follows a vowel, others come before one.
_PLAIN_WORD = re.compile(r"[\W_]*[^\W\d_]+(?:['’\-·][^\W\d_]+)*[\W_]*$")
_UNUSUAL = re.compile(r"(?:^|[^aeiouyäöüAEIOUYÄÖÜ])ß|œ(?![uicds])|õ(?!e)|ã(?![oes]|\b)")
#: The sharp s follows a vowel.
_SHARP = re.compile(r"(?:^|[^aeiouyäöüAEIOUYÄÖÜ])ß")
_MISPLACED = re.compile(r"^[†‡¶€™‰ˆ˜¨¸÷×¬±√≈≤≥Ω¼½¾](?:[a-z]|$)|(?<=[^\W\d_])[„”‚“‡†ˆ‰](?=[^\W\d_])")
_HIGH = re.compile(r"[^\x00-\x7fͰ-῿぀-鿿‐-‧가-힯]{3,}")
_CYRILLIC = re.compile(r"[Ѐ-џ]{3,}")


def _as_it_should_be(w: str) -> bool:
    """Is a word one of a Western language as it stands: letters of one alphabet, more than one character, capitals at its head?"""
    letters = [c for c in w if c.isalpha()]
    far = {c for c in w if not c.isascii()} - MARKS
    if not far or len(letters) < 2 or _MISPLACED.search(w) or _UNUSUAL.search(w) or not _PLAIN_WORD.match(w):
        return False
    return any(far <= set(ALPHABETS[k]) for k in ("fr", "de", "es", "pt", "nordic")) and (w.isupper() or not any(c.isupper() for c in letters[1:]))


def _swapped(text: str, odd: dict, reader: str, source: str, first: bool) -> str:
    """A text with the words of a pair decoded: those that hold a garbled sequence and, in the first pass, those that hold letters which the language of the former lacks.

    Words that are right as they stand, in that language or another, are left. Where no such word stands in the text all
    of it was garbled, marks too.
    """
    table = to_bytes(reader)
    fixed = {w: f for w in set(_WORD_AT.findall(text)) if not w.isascii() and (f := _recode(w, table, source))}
    sure = {w: f for w, f in fixed.items() if w in odd and _latin_word(f)}
    if first:
        got = Counter(c for f in sure.values() for c in f if c in LETTERS)
        own = set(max(ALPHABETS.values(), key=lambda letters: sum(n for c, n in got.items() if c in letters)))
        fits = lambda w: all(c.isascii() or c in own or c in MARKS for c in w) and not any(a.islower() and b.isupper() for a, b in zip(w, w[1:]))
        if not any(_as_it_should_be(w) for w in fixed if w not in odd) and (whole := _recode(text, table, source)) and all(c.isascii() or c in LETTERS or c in MARKS for c in whole):
            return whole
        right = lambda w: fits(w) and not _MISPLACED.search(w)
        sure |= {w: f for w, f in fixed.items() if w not in sure and any(c in own or c in "“”‘’„«»" for c in f) and not right(w) and right(f) and not _SHARP.search(f) and (len(w) > 1 or f in "àéóú") and not (w[0] in LETTERS and w[0].islower() and f[0].isupper())}
    return _WORD_AT.sub(lambda m: sure.get(m.group(), m.group()), text)


def _single_byte(text: str, first: bool = True) -> tuple[str, str] | None:
    """(text with what a pair garbled decoded, that pair) of text of a single-byte or East Asian encoding; "" where no pair fits."""
    odd = odd_words(text)
    if odd:
        best = None
        for reader, source in sorted(frozenset().union(*(pairs for pairs, _ in odd.values()))):
            fixed = [_recode(w, to_bytes(reader), source) for w in odd]
            ok = [f for f in fixed if f and _latin_word(f)]
            score = (len(ok), sum(c in COMMON for f in ok for c in f), sum(c in USUAL for f in ok for c in f), -READERS.index(reader), -LATIN.index(source))
            if ok and (best is None or score > best[0]):
                best = (score, reader, source)
        if best and best[0][0] >= max(1, 0.6 * len(odd)):
            return _swapped(text, odd, *best[1:], first), f"{best[2]} as {best[1]}"
    # Signs that may stand between letters, as in 20m×30m, say nothing by themselves.
    dead = any(sure for _, sure in odd.values()) or bool(_AMID.search(text))
    if _ODD_CYRILLIC.search(text):
        return "", "utf-8 as cp1251, letters made small"
    high = [m.group() for m in _HIGH.finditer(text)]
    strange = [w for w in high if _no_word(w)]
    if strange:
        return _other_script(text, strange) or ("", "unknown")
    cyrillic = _CYRILLIC.findall(text)
    if cyrillic:
        now = _russian(cyrillic)
        if now < 0.12 and sum(map(len, cyrillic)) >= 6:
            best = None
            for reader in CYRILLIC:
                table = to_bytes(reader)
                for source in (*CYRILLIC, "iso8859_5"):
                    if source != reader and (score := _russian([_recode(w, table, source) or "" for w in cyrillic])) >= max(0.25, now + 0.15) and (best is None or score > best[0]):
                        best = (score, reader, source)
            if best:
                reader, source = best[1:]
                table = to_bytes(reader)
                return _CYRILLIC.sub(lambda m: _recode(m.group(), table, source) or m.group(), text), f"{source} as {reader}"
    return ("", "unknown") if dead else None


def _word(text: str, i: int, j: int) -> re.Match | None:
    a = i
    while a > 0 and not text[a - 1].isspace() and text[a - 1] not in ",;:()[]/":
        a -= 1
    return _WORD_AT.match(text, a)


def _recode(word: str, table: dict[str, int], source: str) -> str | None:
    raw = bytearray()
    for c in word:
        if c < "\x80":
            raw.append(ord(c))
        elif c in table:
            raw.append(table[c])
        else:
            return None
    try:
        return raw.decode(source)
    except UnicodeDecodeError:
        return None


def _latin_word(w: str) -> bool:
    w = w.strip(".,;:!?“”„\"'()…»«")
    if not w or not all(c.isascii() or c in LETTERS or c in "’‘–" for c in w):
        return False
    inner = [c for c in w if c.isalpha()]
    if not any(not c.isascii() for c in inner):
        return False
    if any(a.islower() and b.isupper() for a, b in zip(w, w[1:])):
        return False
    return not re.search(r"[A-Za-z][^\w’'.\-–][A-Za-z]", w)


def _no_word(w: str) -> bool:
    """A run beyond ASCII and beyond other scripts that no language writes: accented letters only, or symbols amid them."""
    letters = [c for c in w if c.isalpha()]
    symbols = [c for c in w if not c.isalpha() and c in "¸¿¼½¾²³¹©®¤¦¬£¥¢§¶°±µ´¨¯·ª˜ˆ‰‹›™†‡•¡÷×√∂∑∏π∫∞≈∆≠≤≥◊\x81\x8d\x8f\x90\x9d" or "\x80" <= c < "\xa0"]
    if len(w) >= 4 and len(letters) >= 4 and len(letters) == len(w):
        return True
    return len(w) >= 4 and bool(letters) and len(symbols) >= 2


def _other_script(text: str, strange: list[str]) -> tuple[str, str] | None:
    best = None
    for reader in READERS:
        table = to_bytes(reader)
        for source in OTHER:
            got = [_recode(w, table, source) for w in strange]
            if not all(got):
                continue
            letters = [c for w in got for c in w if ord(c) > 0x7F]
            script = Counter(_script(c) for c in letters)
            name, n = script.most_common(1)[0] if script else ("none", 0)
            if name in ("none", "rare") or n < 0.9 * len(letters):
                continue
            cased = sum(any(a.islower() and b.isupper() for a, b in zip(w, w[1:])) for w in got) / len(got)
            score = (n / len(letters) - cased, _russian(got) if name == "cyrillic" else 0.3)
            if best is None or score > best[0]:
                best = (score, dict(zip(strange, got)), f"{source} as {reader}")
    if best is None:
        return None
    fixed = best[1]
    return _HIGH.sub(lambda m: fixed.get(m.group(), m.group()), text), best[2]


def _script(c: str) -> str:
    o = ord(c)
    if 0x400 <= o <= 0x45F:
        return "cyrillic"
    if 0x370 <= o <= 0x3FF:
        return "greek"
    if 0x600 <= o <= 0x6FF:
        return "arabic"
    if 0x3040 <= o <= 0x30FF:
        return "han"
    if 0x4E00 <= o <= 0x9FA5:
        try:
            return "han" if 0xB0 <= c.encode("gb2312")[0] <= 0xD7 else "rare"
        except UnicodeEncodeError:
            try:
                c.encode("big5" if True else "")
                return "han" if c.encode("big5")[0] <= 0xC6 else "rare"
            except UnicodeEncodeError:
                return "han" if _jis(c) else "rare"
    if 0xAC00 <= o <= 0xD7A3:
        return "hangul"
    return "none"


def _jis(c: str) -> bool:
    try:
        return 0x88 <= c.encode("shift_jis")[0] <= 0x98
    except UnicodeEncodeError:
        return False


def _russian(words: list[str]) -> float:
    """Share of the letter pairs that are frequent in Russian."""
    pairs = [w[i : i + 2] for w in (x.lower() for x in words) for i in range(len(w) - 1)]
    return sum(p in RUSSIAN_PAIRS for p in pairs) / len(pairs) if pairs else 0.0


def repair(text: str | None) -> tuple[bool, str | None, str]:
    """(garbled?, original text where it can be had, encodings)."""
    if not text or text.isascii():
        return False, None, ""
    pairs: list[str] = []
    now = text
    lowered = False
    for _ in range(3):
        matches: dict[str, list[int]] = {}
        low: list[tuple[int, int]] = []
        for run in _RUNS.finditer(now):  # sequences are of characters beyond ASCII
            for e, (size, readers) in automaton().iter(now, *run.span()):
                for reader, lower in readers:
                    if not lower:
                        matches.setdefault(reader, []).append(e - size + 1)
                    elif reader == "cp1252":
                        low.append((e - size + 1, size))
        # What was garbled twice was so by one reader.
        spans = {r: s for r, at in matches.items() if (not pairs or pairs[0].endswith(r)) and (s := _spans(now, r, at))}
        if not spans:
            lowered = bool(low) and _lowered(now, low) >= 2
            break
        reader = max(spans, key=lambda r: (sum(len(o) for _, _, o in spans[r]), -READERS.index(r)))
        parts, at = [], 0
        for i, j, o in spans[reader]:
            parts += [now[at:i], o]
            at = j
        now = "".join(parts) + now[at:]
        pairs.append(f"utf-8 as {reader}")
    if lowered:
        now = _small(now)
        left = any(c in "ãâ" and not d.isalpha() and not d.isspace() for c, d in zip(now, now[1:]))
        return True, None if left or _DEAD.search(now) else now, ", ".join([*pairs, "utf-8 as cp1252, letters made small"])
    if not pairs and "�" in text:
        return True, None, "replacement characters"
    # What a single-byte pair garbled, pair by pair: parts of a text may have been read in several ways.
    while (x := _single_byte(now, not any(' as ' in p and not p.startswith('utf-8') for p in pairs))) is not None:
        pairs.append(x[1])
        if not x[0] or x[0] == now:
            return True, None, ", ".join(pairs)
        now = x[0]
    if pairs:
        return True, None if _DEAD.search(now) or "�" in now else now, ", ".join(pairs)
    if _DEAD.search(text):
        return True, None, "control characters"
    return False, None, ""


def garbled(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Garbled rows of ``df``: its keys, ``original`` (null where it can't be had) and ``encodings``.

    Rows in ASCII, which can't be garbled, are dropped before they reach Python.
    """

    def rows(*x):
        bad, original, pair = repair(x[-1])
        return [(*x[:-1], original, pair)] if bad else []

    schema = ", ".join([f"{k} string" for k in keys] + ["original string", "encodings string"])
    some = df.where(F.col(column).rlike(r"[^\x00-\x7f]")).select(*keys, column)
    return map_rows(some, rows, schema, [*keys, "original", "encodings"])

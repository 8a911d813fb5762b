"""Sentence units by a finite transducer (problem 6).

The lexer reduces a text to events: only characters at which a unit could begin or end, each with the class that its
neighbours give it. The boundary rules are a table ``state x event -> state, output``; a run of events is a function
from states to states, so a long document is cut into blocks of events, each block is reduced to its function, the
functions are composed by a prefix scan, and each block is then run from its true state. A short document is one block.

Defined cases: a null or blank text has no unit; text without any end mark is one unit per line; rows that repeat give
the same units, of which the query keeps one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

# Words that end in a full stop inside a sentence, in lower case, by language.
ABBREVIATIONS = set(
    """
    mr mrs ms dr prof rev hon col gen capt lt sgt st jr sr messrs no nos vol vols art arts sec secs fig figs p pp pg ch
    cf cfr approx ca al e.g i.e etc viz vs ltd inc co corp bros dept est univ inst assn assoc soc fdn fed dist off natl
    pub munic reg auth transp jan feb mar apr jun jul aug sep sept oct nov dec a.m p.m u.s u.k
    hr fr frl str nr abs bd bzw usw z.b d.h u.a vgl s z b d h u a evtl ggf inkl jh jhd bspw sog zzt kap anm
    m mme mlle mm me art env p.ex c.-à-d chap av bd éd n.b
    dra dr sra srta ee uu pág págs cap núm ud uds d dª dña aprox ej
    sig dott ing avv ecc
    г гг в вв т е д п гл рис ст табл проф др ул им стр руб т.е т.д т.п т.к см ср акад
    κ κα δρ άρθρ σελ κεφ αρ π.χ κ.λπ κ.ά δηλ βλ μ.μ π.μ τ εικ παρ
    م ص د أ ج ق
    सं डॉ प्रो श्री पृ रु
    """.split()
)
# Those of them that often end a sentence too, before a capital letter.
ENDING = {"etc", "usw", "ecc", "κ.λπ"}
STARTERS = set(
    "the a an what was were nobody between on in at if for after before form according costs over without despite "
    "since who why how il elle le la les selon pourquoi ni depuis après pendant malgré au d’après die der das wer "
    "warum über nach zum für während el los las según desde para ¿por ¡la".split()
)

BEGIN, BODY, LEAD, LEAD_END, INNER, INNER_END = range(6)
N_STATES = 6
# Events: an end mark, quotation marks, a closing mark with a speaker's clause after it, one that perhaps has such a clause
# in a script without case, a hard line end, any other text.
TEXT, STOP, OPEN, CLOSE, LINE, SPEAKER, PERHAPS = range(7)
N_EVENTS = 7


def _compile() -> tuple[np.ndarray, np.ndarray]:
    """The transducer: next state and output (1: the unit ends after this event) by state and event."""
    to = np.zeros((N_STATES, N_EVENTS), dtype=np.int8)
    out = np.zeros((N_STATES, N_EVENTS), dtype=np.int8)
    for s in range(N_STATES):
        to[s, LINE], out[s, LINE] = BEGIN, 1
    for s in (BEGIN, BODY):
        to[s, TEXT], to[s, CLOSE] = BODY, BODY
        to[s, STOP], out[s, STOP] = BEGIN, 1
        to[s, SPEAKER] = BODY
    to[BEGIN, OPEN], to[BODY, OPEN] = LEAD, INNER
    # In a quotation an end mark doesn't end the unit unless the quotation closes with it.
    to[LEAD, TEXT], to[LEAD, OPEN], to[LEAD, STOP], to[LEAD, CLOSE], to[LEAD, SPEAKER] = LEAD, LEAD, LEAD_END, BODY, LEAD
    to[INNER, TEXT], to[INNER, OPEN], to[INNER, STOP], to[INNER, CLOSE], to[INNER, SPEAKER] = INNER, INNER, INNER_END, BODY, INNER
    to[LEAD_END, TEXT], to[LEAD_END, OPEN], to[LEAD_END, STOP] = LEAD, LEAD, LEAD_END
    to[INNER_END, TEXT], to[INNER_END, OPEN], to[INNER_END, STOP] = INNER, INNER, INNER_END
    # The quotation closes after an end mark: led in by its speaker, the unit ends; at the head of the unit it ends
    # unless the speaker follows (event SPEAKER stands for a closing mark with such a follower).
    to[INNER_END, CLOSE], out[INNER_END, CLOSE] = BEGIN, 1
    to[INNER_END, SPEAKER] = BODY
    to[LEAD_END, CLOSE], out[LEAD_END, CLOSE] = BEGIN, 1
    to[LEAD_END, SPEAKER] = BODY
    # Without case a clause after the mark is the speaker's if the quotation stands first in its unit; one that was led in
    # by its speaker ends as others do.
    for s in range(N_STATES):
        as_ = SPEAKER if s in (LEAD, LEAD_END) else CLOSE
        to[s, PERHAPS], out[s, PERHAPS] = to[s, as_], out[s, as_]
    return to, out


TO, OUT = _compile()
BLOCK = 4096

_EVENT = re.compile(r"\n|(?:\.{2,}|[.!?…。！？؟।॥;;·])[.!?…。！？؟।]*[)\]）]*|[“„«「『‹]|[”»」』›]|\"")
_WORD_BEFORE = re.compile(r"[^\s(\[“”„«»「」『』‹›\"¿¡（]*$")
_NEXT = re.compile(r"[\s]*")
_LIST = re.compile(r"(?:\d{1,4}[.)]|[-*•])\s")
_CJK = re.compile(r"[　-〿぀-ヿ㐀-鿿豈-﫿＀-￯]")
_CJK_RUN = re.compile(r".*[　-〿぀-ヿ㐀-鿿豈-﫿＀-￯]")
_GREEK = re.compile(r"[Ͱ-Ͽἀ-῿]")
_OPENERS = "“„«「『‹\"¿¡(["


def _soft_breaks(text: str) -> set[int]:
    """Offsets of the line breaks that wrap a sentence.

    A text is taken as wrapped if its longest line has 30 to 110 characters and a line ends where the next word would no
    longer have fitted; a break is soft where this is so and the line isn't closed by an end mark.
    """
    soft: set[int] = set()
    lines = text.split("\n")
    if len(lines) < 2:
        return soft
    width = max(map(len, lines))
    if width > 110 and len(lines) >= 12:
        width = sorted(map(len, lines))[int(0.96 * (len(lines) - 1))]  # a few long lines may stand among wrapped ones
    if not 30 <= width <= 110:
        return soft
    at = 0
    for i in range(len(lines) - 1):
        a, b = lines[i].rstrip(), lines[i + 1].lstrip()
        at += len(lines[i])
        if a and b:
            word = b.split(None, 1)[0]
            cjk = _CJK.match(word)
            need = 1 if cjk else len(word)
            full = len(a) + (0 if cjk else 1) + need > width
            if full and not _LIST.match(b) and not (a[-1] in ".!?…。！？؟।" and len(a) < width - 14):
                soft.add(at)
            elif a[-1] in ",-–" and b[:1].islower() or (b[0].islower() and len(a) > 0.6 * width and a[-1] not in ".!?…"):
                soft.add(at)
        at += 1
    return soft


def _kind(text: str, m: re.Match, n: int, soft: set[int]) -> int:
    """The event class of a match."""
    g = m.group()
    c = g[0]
    i, j = m.span()
    if c == "\n":
        return LINE
    if c in "“”" and i and text[i - 1] in "€¬ÅÂâ":
        return TEXT  # half of a garbled dash or quotation mark
    if c in "“„«「『‹":
        if c == "“" and i and not text[i - 1].isspace() and "„" in text[max(0, i - 400) : i]:
            return _closing(text, j, n)  # closes a German quotation
        return OPEN
    if c in "”»」』›":
        return _closing(text, j, n)
    if c == '"':
        return OPEN if (i == 0 or text[i - 1].isspace() or text[i - 1] in "(（：:") else _closing(text, j, n)
    if c in ";;·":
        # A question mark only in Greek text.
        if len(g) > 1 or not _GREEK.search(text[max(0, i - 12) : i]) or c == "·":
            return TEXT
    elif c == ".":
        if g.startswith("..") or g.startswith(".…"):
            pass
        else:
            nxt = text[j : j + 1]
            word = _WORD_BEFORE.search(text, max(0, i - 24), i).group().lower()
            if nxt and (nxt.isdigit() or (nxt.isalpha() and (nxt.islower() or not text[i - 1 : i].islower()))):
                # A space is missing after a sentence only if a plain word stands before and a number or a capital after.
                plain = len(word) > 2 and word.isalpha() and word not in ABBREVIATIONS and not _CJK.search(word)
                camel = nxt.islower() and text[j + 1 : j + 2].isupper()
                if not (plain and text[i - 1].islower() and (nxt.isdigit() or camel)) and not (_CJK.match(nxt) and not text[i - 1 : i].isascii()):
                    return TEXT
            if nxt in ("-", ",", ":", "’", "'", "/") and nxt:
                return TEXT
            if word:
                last = _CJK_RUN.sub("", word).rsplit("-", 1)[-1].rsplit("’", 1)[-1].rsplit("'", 1)[-1]
                after = text[_NEXT.match(text, j).end() :][:24] if j < n else ""
                if last == "bd" and not after[:1].isdigit():
                    last = word = "board"
                if len(g) == 1 and (last in ABBREVIATIONS or word in ABBREVIATIONS or (len(last) == 1 and last.isalpha() and not _CJK.match(last)) or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", last)):
                    if word in ENDING and after and after.split(None, 1)[0].lower() in STARTERS and after[0].isupper():
                        return STOP
                    # At the end of the text or of a hard line, or before a blank line, it does end the unit; the line does it.
                    return TEXT
                if re.fullmatch(r"\d{1,4}", word) and (i - len(word) == 0 or text[i - len(word) - 1] == "\n"):
                    return TEXT  # a list number
    elif c in "!?" and text[j : j + 1] in (",", ";", ")"):
        return TEXT
    elif c == "…" and text[j : j + 1] in (",", ";", "]", ")"):
        return TEXT
    k = _NEXT.match(text, j).end()
    if k >= n:
        return STOP
    gap = text[j:k]
    nxt = text[k]
    if "\n" in gap and (text.find("\n", j, k) not in soft or gap.count("\n") > 1):
        return STOP
    if nxt in "”»」』›":
        return STOP
    if nxt == "“" and not gap and c in ".!?…":
        return STOP
    if not gap and c in ".!?…" and not (nxt.isupper() or text[k + 1 : k + 2].isupper() or nxt in _OPENERS or nxt.isdigit() or nxt == "“" or _CJK.match(nxt) or not (nxt.islower() or nxt.isascii())):
        return TEXT
    if nxt.islower() and not text[k + 1 : k + 2].isupper():
        return TEXT
    if nxt in ",;:)–—-" and not (nxt in "–—-" and c in "!?.…" and "\n" in gap):
        return TEXT
    return STOP


def _closing(text: str, j: int, n: int) -> int:
    """A closing quotation mark: SPEAKER if the clause of the speaker follows."""
    k = j
    while k < n and text[k] in "   \t":
        k += 1
    if k >= n:
        return CLOSE
    nxt = text[k]
    if nxt == "\n":
        k2 = _NEXT.match(text, k).end()
        if text.count("\n", k, k2) > 1 or k2 >= n:
            return CLOSE
        nxt = text[k2]
        k = k2
    if nxt in ",—–-":
        return SPEAKER
    if nxt.islower():
        return CLOSE if text[k + 1 : k + 2].isupper() else SPEAKER
    if k == j and nxt.isalnum() and (_CJK.search(text, max(0, j - 12), j + 24)):
        return PERHAPS if nxt != "と" else SPEAKER
    if nxt.isalpha() and not nxt.isupper():
        return PERHAPS if text[j : j + 1] != "と" else SPEAKER
    return CLOSE


def _events(text: str) -> tuple[list[int], list[int]]:
    """Classes and end offsets of the events; what stands between two of them is a TEXT event."""
    soft = _soft_breaks(text)
    kinds: list[int] = []
    ends: list[int] = []
    n, last = len(text), 0
    for m in _EVENT.finditer(text):
        i, j = m.span()
        if i > last and not text[last:i].isspace():
            kinds.append(TEXT)
            ends.append(i)
        if m.group() != "\n" or i not in soft:  # a break within a sentence is white space
            kinds.append(_kind(text, m, n, soft))
            ends.append(j)
        last = j
    return kinds, ends


def _run(kinds: list[int], state: int) -> tuple[list[int], int]:
    """Indexes of the events after which a unit ends."""
    cut: list[int] = []
    to, out = _TO, _OUT
    for i, k in enumerate(kinds):
        if out[state][k]:
            cut.append(i)
        state = to[state][k]
    return cut, state


_TO, _OUT = TO.tolist(), OUT.tolist()


def _function(kinds: np.ndarray) -> np.ndarray:
    """The function from states to states that a block of events is, by pairwise composition."""
    f = TO.T[kinds]  # events x states
    while len(f) > 1:
        if len(f) % 2:
            f = np.concatenate([f, np.arange(N_STATES, dtype=f.dtype)[None]])
        f = np.take_along_axis(f[1::2], f[::2].astype(np.int64), axis=1)
    return f[0] if len(f) else np.arange(N_STATES, dtype=np.int8)


def _scan(functions: list[np.ndarray]) -> list[int]:
    """State before each block: an inclusive prefix scan of the functions by doubling, applied to BEGIN."""
    f = np.stack(functions)
    step = 1
    while step < len(f):
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.int64), axis=1)
        f, step = g, step * 2
    return [BEGIN, *(int(x[BEGIN]) for x in f[:-1])]


def cuts(kinds: list[int], block: int = BLOCK) -> list[int]:
    """Indexes of the events that end a unit."""
    if len(kinds) <= block:
        return _run(kinds, BEGIN)[0]
    parts = [kinds[i : i + block] for i in range(0, len(kinds), block)]
    starts = _scan([_function(np.array(p)) for p in parts])
    return [k * block + i for k, (p, s) in enumerate(zip(parts, starts)) for i in _run(p, s)[0]]


def sentence_spans(text: str | None, block: int = BLOCK) -> list[tuple[int, int]]:
    """Offsets (start, end) of the sentence units of a text, without the white space around them."""
    if not text or text.isspace():
        return []
    kinds, ends = _events(text)
    spans: list[tuple[int, int]] = []
    start = 0
    for i in cuts(kinds, block):
        _push(text, start, ends[i], spans)
        start = ends[i]
    _push(text, start, len(text), spans)
    return spans


def _push(text: str, a: int, b: int, spans: list[tuple[int, int]]) -> None:
    piece = text[a:b]
    left = piece.lstrip()
    if left:
        a = b - len(left)
        spans.append((a, a + len(left.rstrip())))


def sentence_units(df: DataFrame) -> DataFrame:
    """``df(doc_id, text)`` as ``(doc_id, sent_no, sent_start, sent_end)``, one row per unit of every row."""

    def rows(doc_id, text):
        return [(doc_id, i, a, b) for i, (a, b) in enumerate(sentence_spans(text))]

    return map_rows(df.select("doc_id", "text"), rows, "doc_id string, sent_no int, sent_start int, sent_end int", ["doc_id", "sent_no", "sent_start", "sent_end"])

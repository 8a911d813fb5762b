"""Noise in text of scanned pages (problem 5).

Running headers, page numbers, words broken at line ends and misrecognised characters are found line by line in texts
that are wrapped, and the text is put together again as paragraphs.

* Furniture: page numbers by their form and their place beside headers or in a sequence; headers by a boosted
  classifier of a line and its neighbours. Lines that bear a page number beside their text are its positive examples,
  lines of texts that aren't wrapped its negative ones, of both at most ``SAMPLE_LINES``.
* Broken words: a boosted classifier of the two halves at a line end tells a break from a hyphen that stays, by how often
  the corpus has the halves joined, hyphened and by themselves, and by their form. Words of the corpus that are torn at
  random places are its examples of breaks, its hyphened words those of the others; of some the count is hidden, as of
  words that the corpus hasn't seen.
* Misread characters: words that the rest of the corpus doesn't have get candidates through an inverted join of their
  padded trigrams with those of the corpus's words; a boosted ranking chooses the candidate or none. Its positive
  examples are words of the corpus to which confusions of characters were done, its negative ones rare words of texts
  that aren't scans, names and slips of the pen among them; their candidates come from the same join. No candidate is
  ruled out beforehand: that other changes than confusions are hardly misreadings is what the ranking learns from them.

The corpus's words are counted over all texts of other formats, the words of headers over all scans. The bounded samples
(``SAMPLE_TEXTS``, ``SAMPLE_LINES``, ``SAMPLE_WORDS``) go to the driver, and the words of headers, which are a feature of
the classifier.

Defined cases: null and empty texts have no noise; a text that isn't wrapped is no scan, overlong lines of a wrapped
one are neither headers nor page numbers, and their unbroken runs hold no words; a word without a candidate is misread
only if a digit stands between its letters; rows that repeat give one result.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_rows, written
from .gbm import Boosted
from .names import edit_distance
from .sentences import _soft_breaks

SAMPLE_TEXTS, SAMPLE_LINES, SAMPLE_WORDS = 1_500, 4_000, 3_000
FREQUENT = 20_000  # known words that are sent to the tasks so that they needn't be joined
EXAMPLES = 6  # candidates of a word that the ranking is trained with
KNOWN = 3  # occurrences that make a word known
WIDTH = 110  # longer lines aren't lines of a wrapped text
# What scanning makes of characters (right, read).
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("o", "0"), ("i", "l"), ("l", "i"), ("l", "1"), ("i", "1"), ("t", "f"), ("f", "t"), ("u", "ii"), ("s", "5"), ("g", "9"), ("d", "cl"),
    ("h", "b"), ("b", "h"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("é", "6"), ("b", "6"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "l"), ("l", "I"), ("l", "|"),
    ("fi", "ﬁ"), ("fl", "ﬂ"), ("h", "li"), ("n", "ri"), ("cl", "d"), ("ii", "u"), ("n", "u"), ("u", "n"), ("a", "o"), ("y", "v"), ("v", "y"), ("z", "2"), ("q", "g"), ("g", "q"),
    ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ü", "ii"), ("ß", "b"),
]
HYPHENS = "-\xad‐¬"

_PAGE = re.compile(r"^[\[(—–\-\s]*(\d{1,4}|[ivxlc]{1,7})\s*(?:/\s*\d{1,4})?[\])—–\-\s]*$")
_NAMED = re.compile(r"^(?:S|Seite|p|pp|pg|Page|page|Pág|pág|págs|стр|с|С|σελ|Σελ|ص|पृ)\.?\s*\d{1,4}$|^[\[(—–\-]\s*[\dlIOoS]{1,4}\s*[\])—–\-]$|^第\s*\d{1,4}\s*[页頁ページ]+$|^[\dlIOo]{1,4}/[\dlIOo]{1,4}$")
_BARE = re.compile(r"^\d{1,4}$")
_NUMBERED = re.compile(r"^(?:(\d{1,4}|[ivxlc]{1,7})\s{3,}(\S.*)|(\S.*?)\s{3,}(\d{1,4}|[ivxlc]{1,7}))$")
_TABLE = re.compile(r"^[^\d]*:? ?-?\d+(?:[.,]\d+)?$|^\d{1,4}[.)] |^.+ – .+: .+$|^.+: .+\(\d+\)$")
_RUN = re.compile(r"\S{%d,}" % (WIDTH + 1))  # data, no words
_TOKEN = re.compile(r"[^\W_][^\s.,;:!?()\[\]«»“”„…/–—\"·§¶]*")
#: Splits like ``_TOKEN``, for the counts in Spark.
_SPLIT = r"[\s.,;:!?()\[\]«»“”„…/–—\"·§¶]+"


def fold_line(s: str) -> str:
    """A line in the form in which copies of it agree, whatever was misread."""
    s = re.sub(r"\d", "", re.sub(r"(?<=[^\W\d_])[015689](?=[^\W\d_]|\b)", lambda m: {"0": "o", "1": "l", "5": "s", "6": "e", "8": "b", "9": "g"}[m.group()], s.lower()))
    s = s.replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("ii", "u").replace("c", "e").replace("l", "i").replace("f", "t").replace("b", "h")
    return re.sub(r"[\W_]+", " ", s).strip()


def wrapped(text: str) -> bool:
    """Are the lines of a text cut at a width?

    A few overlong ones, as runs of data, table rows or joined lines, may stand among them where the others end as
    wrapping ends them: of scans, all but one in a hundred have 0.46 of such line ends or more.
    """
    lines = text.split("\n")
    some = [s for s in lines if s.strip()]
    fit = [s for s in some if len(s) <= WIDTH]
    over = len(some) - len(fit)
    if len(lines) < 2 or not over:
        return len(lines) > 1
    return 4 * over <= len(fit) and 5 * len(_soft_breaks("\n".join(s for s in lines if len(s) <= WIDTH))) >= 2 * len(fit)


def line_features(lines: list[str], heads: frozenset[str]) -> tuple[dict[int, list[float]], dict[int, str]]:
    """Features of the lines that can be headers, with their neighbours and their page number aside; and these lines folded.

    A header stands at the head of the text, after a blank line or beside a page number.
    """
    stripped = [s.strip() for s in lines]
    page = [bool(s) and len(s) < 16 and bool(_PAGE.match(s)) for s in stripped]
    last = len(lines) - 1
    some = [i for i, s in enumerate(stripped) if s and len(s) <= WIDTH and (i == 0 or not stripped[i - 1] or page[i - 1] or (i < last and page[i + 1]))]
    bare: dict[int, str] = {}
    for i in some:
        m = _NUMBERED.match(stripped[i])
        bare[i] = (m.group(2) or m.group(3)) if m else stripped[i]
    folded = {i: fold_line(s) for i, s in bare.items()}
    count = Counter(f for f in folded.values() if f)
    width = max(1, max((len(s) for s in lines if len(s) <= WIDTH), default=1))
    out: dict[int, list[float]] = {}
    for i, s in bare.items():
        before = stripped[i - 1] if i else ""
        after = stripped[i + 1] if i < last else ""
        words = folded[i].split()
        letters = [c for c in s if c.isalpha()]
        k = i - 1
        while k >= 0 and (not stripped[k] or page[k]):
            k -= 1
        text_before = stripped[k] if k >= 0 else ""
        out[i] = [
            float(not before),
            float(not after),
            min(4, count[folded[i]]) if len(folded[i]) > 5 else 0,
            len(s) / width,
            sum(c.isupper() for c in letters) / max(1, len(letters)),
            sum(w[0].isupper() for w in s.split() if w[0].isalpha()) / max(1, len(s.split())),
            sum(w in heads for w in words) / max(1, len(words)),
            float(s[-1:] in ".!?…»”;:,"),
            float(bool(_TABLE.match(s))),
            float((i < last and page[i + 1]) or (i > 0 and page[i - 1])),
            float(bool(text_before) and text_before[-1] not in ".!?…»”:" and after[:1].islower()),
            float(s[:1].islower()),
            float("·" in s),
            len(words),
        ]
    return out, folded


def furniture(lines: list[str], heads: frozenset[str], model: Boosted | None) -> dict[int, str]:
    """"header" or "pageno" by line number."""
    out: dict[int, str] = {}
    x, folded = line_features(lines, heads)
    p = dict(zip(x, model.probability(np.array(list(x.values()))))) if model and x else {}
    bare: list[tuple[int, int]] = []
    for i, s in enumerate(map(str.strip, lines)):
        if not s:
            continue
        if _NAMED.match(s):
            out[i] = "pageno"
        elif _PAGE.match(s):
            if not _BARE.match(s) and (not s.isalpha() or len(s) > 1 and _roman(s)):
                out[i] = "pageno"
            elif _BARE.match(s):
                bare.append((i, int(s)))
        elif len(s) < 90 and (m := _NUMBERED.match(s)) and not _TABLE.match(m.group(2) or m.group(3)):
            out[i] = "header"
        elif i in p and p[i] > (0.5 if x[i][6] >= 0.4 else 0.8) and not x[i][8] and not x[i][11] and (x[i][6] >= 0.4 or not x[i][7] and s[-1] not in HYPHENS + "–"):  # surer where words of headers are few
            out[i] = "header"
    heads_here = {folded[i] for i, k in out.items() if k == "header" and i in folded}
    for i, f in folded.items():  # copies of a header that were misread otherwise
        if i not in out and f and len(f) > 5 and (i == 0 or not lines[i - 1].strip()) and any(edit_distance(f, h, 3) is not None for h in heads_here):
            out[i] = "header"
    # In a sequence that begins anywhere at an edge of a page, too.
    edge = [(i, n) for i, n in bare if out.get(i - 1) == "header" or out.get(i + 1) == "header" or i == 0 or _alone(lines, i)]
    steps = {i for (i, n), (j, m) in zip(edge, edge[1:]) if 0 < m - n <= 3 and j - i > 8 for i in (i, j)}
    for i, n in edge:
        if out.get(i - 1) == "header" or i in steps or _alone(lines, i):
            out[i] = "pageno"
    return out


def _alone(lines: list[str], i: int) -> bool:
    """Is a number at the head or the foot of a page rather than in a table?"""
    before = lines[i - 1].strip() if i else ""
    after = lines[i + 1].strip() if i + 1 < len(lines) else ""
    near = [s for s in (before, after) if s]
    return (not before or not after) and not any(_TABLE.match(s) or len(s) < 25 and s[-1] not in ".!?" for s in near)


def _roman(s: str) -> bool:
    return bool(re.fullmatch(r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", s)) and bool(s)


def _clean(w: str) -> str:
    w = w.strip("'’‘-‐\xad¬")
    return w[:-2] if w.endswith(("’s", "'s")) else w


def words_of(lines: list[str], skip: dict[int, str]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, str, str]]]:
    """Words as (line, word) and breaks as (line, next line, first half, second half, mark), furniture aside."""
    words: list[tuple[int, str]] = []
    breaks: list[tuple[int, int, str, str, str]] = []
    rest = [i for i, s in enumerate(lines) if s.strip() and i not in skip]
    taken: dict[int, int] = {}
    for a, b in zip(rest, rest[1:]):
        s = lines[a].rstrip()
        if len(s) > 2 and s[-1] in HYPHENS and s[-2].isalpha() and not _RUN.search(s):
            first = re.search(r"[^\s(\[“„«/–—\"]*$", s[:-1]).group()
            second = _TOKEN.match(lines[b].lstrip())
            if first and second and second.group()[0].isalpha():
                breaks.append((a, b, first, second.group(), s[-1]))
                taken[b] = 1
    ends = {a for a, *_ in breaks}
    for i in rest:
        w = _TOKEN.findall(_RUN.sub(" ", lines[i]) if len(lines[i]) > WIDTH else lines[i])
        if i in taken:
            w = w[1:]
        if i in ends:
            w = w[:-1]
        words += [(i, _clean(x)) for x in w]
    return words, breaks


def _asks(text: str, heads: frozenset[str], model: Boosted | None, frequent: frozenset[str] = frozenset()) -> list[tuple[int, str, str, int, int]]:
    """What a text asks of the corpus: (line, kind, word, next line, length of the first half); nothing of words that are ``frequent`` there."""
    if not wrapped(text):
        return []
    lines = text.split("\n")
    skip = furniture(lines, heads, model)
    words, breaks = words_of(lines, skip)
    out = [(i, kind, "", -1, 0) for i, kind in skip.items()]
    out += [(i, "word", w, -1, 0) for i, w in words if len(w) > 1 and w.lower() not in frequent and any(c.isalpha() for c in w) and not re.fullmatch(r"[A-Za-z]{0,2}\d+\w?|\d+\w{0,3}", w)]
    for a, b, first, second, mark in breaks:
        one = _clean(first + second)
        out.append((a, "break" if mark != "-" else "joined" if second[0].islower() or len(first) > 1 and first.isupper() and second.isupper() else "compound", one, b, len(first.lstrip("'’‘"))))
        if mark == "-":
            out += [(a, "hyphened", _clean(first + "-" + second), b, 0), (a, "first", _clean(first), b, 0), (a, "second", _clean(second), b, 0)]
    return out


def corpus_words(texts: list[DataFrame]) -> DataFrame:
    """``(word, n)`` of the words, in lower case, of one-column frames of text, each text counting once."""
    parts = [t.select(F.explode(F.array_distinct(F.split(F.lower(F.col(t.columns[0])), _SPLIT))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")) for t in texts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    strip = F.regexp_replace(F.regexp_replace("word", r"^['’‘\-‐­¬]+|['’‘\-‐­¬]+$", ""), r"['’]s$", "")
    return out.withColumn("word", strip).where(r"word rlike '^[\\p{L}\\p{M}\\p{N}][\\p{L}\\p{M}\\p{N}\'’·-]*$'").groupBy("word").agg(F.sum("n").alias("n"))


def explained(right: str, read: str) -> tuple[int, int]:
    """(confusions, other edits) that turn a word into what was read."""
    conf = other = 0
    table = _CONFUSED
    # What is alike at both ends needs no alignment.
    a, most = 0, min(len(right), len(read))
    while a < most and right[a] == read[a]:
        a += 1
    z = 0
    while z < most - a and right[-1 - z] == read[-1 - z]:
        z += 1
    if (right[a : len(right) - z], read[a : len(read) - z]) in table:
        return 1, 0
    for tag, a, b, c, d in SequenceMatcher(None, right, read, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        x, y = right[a:b], read[c:d]
        if (x, y) in table:
            conf += 1
        elif any((right[a - i : b + j], read[c - i : d + j]) in table for i in (0, 1) for j in (0, 1) if a - i >= 0 and c - i >= 0):
            conf += 1
        elif len(x) == len(y) and all((p, q) in table for p, q in zip(x, y)):
            conf += len(x)
        else:
            other += max(len(x), len(y))
    return conf, other


_CONFUSED = {(a.lower(), b.lower()) for a, b in CONFUSIONS}


def candidate_features(read: str, right: str, n: int, shared: int) -> list[float]:
    conf, other = explained(right, read)
    return [conf, other, shared / (max(len(read), len(right)) + 2), math.log1p(n), float(any(c.isdigit() for c in read)), len(read), abs(len(read) - len(right)), float(read[:1] == right[:1])]


def misreadings(known: list[str], seed: int = 7) -> list[tuple[str, str]]:
    """(read, right): words to which one or two confusions were done."""
    rng = random.Random(seed)
    out = []
    for w in known:
        read = w
        for _ in range(1 + (rng.random() < 0.15)):
            fits = [(a, b) for a, b in CONFUSIONS if a in read and a.islower()]
            if not fits:
                break
            a, b = rng.choice(fits)
            at = rng.choice([m.start() for m in re.finditer(re.escape(a), read)])
            read = read[:at] + b.lower() + read[at + len(a) :]
        if read != w:
            out.append((read, w))
    return out


def ranking_examples(known: list[str], rare: list[str]) -> dict[str, str]:
    """What was read, with the right word, or "" where it is right itself: misreadings of known words, and rare words."""
    pairs = misreadings([w for w in known if len(w) > 3 and w.isalpha()])
    return {w: "" for w in rare if len(w) > 3} | dict(pairs) if len(pairs) >= 20 else {}


def train_ranking(found: DataFrame, truth: dict[str, str]) -> Boosted | None:
    """The ranking of candidates, from the ``EXAMPLES`` likest candidates in ``found`` of each of the examples."""
    if not truth:
        return None
    own = found.join(F.broadcast(found.sparkSession.createDataFrame([(w,) for w in truth], "word string")), "word", "left_semi")
    w = Window.partitionBy("word").orderBy(F.desc("shared"), F.desc("n"), "right")
    best = own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= EXAMPLES).orderBy("word", "right").collect()
    y = [float(truth[r["word"]] == r["right"]) for r in best]
    if sum(y) < 10:
        return None
    return Boosted(rounds=40).fit(np.array([candidate_features(r["word"], r["right"], r["n"], r["shared"]) for r in best]), np.array(y))


def join_features(joined: int, hyphened: int, first: int, second: int, lower: bool, size: int) -> list[float]:
    """Of two halves with a hyphen between them: counts in the corpus, and whether the second one begins small."""
    return [math.log1p(joined), math.log1p(hyphened), math.log1p(first), math.log1p(second), float(lower), float(joined > 0), float(hyphened > 0), min(size, 20)]


def train_joins(known: list[tuple[str, int]], hyphened: list[tuple[str, int]], counts: dict[str, int], seed: int = 11) -> Boosted | None:
    """The classifier of breaks, from known words torn at random and hyphened words; ``counts`` are of the halves."""
    rng = random.Random(seed)
    x, y = [], []
    for w, n, label in [(w, n, 1.0) for w, n in known if len(w) > 5 and w.isalpha()] + [(w, n, 0.0) for w, n in hyphened]:
        at = rng.randrange(2, len(w) - 1) if label else w.index("-")
        first, second = w[:at], w[at + (not label) :]
        seen = n if rng.random() < 0.7 else 0
        small = True if label else rng.random() < 0.5
        x.append(join_features(seen if label else counts.get(first + second, 0), 0 if label else seen, counts.get(first, 0), counts.get(second, 0), small, len(w)))
        y.append(label)
    return Boosted(rounds=30).fit(np.array(x), np.array(y)) if min(sum(y), len(y) - sum(y)) >= 20 else None


def trigrams(w: str) -> list[str]:
    s = f"##{w}##"
    return sorted({s[i : i + 3] for i in range(len(s) - 2)})


def candidates(odd: DataFrame, words: DataFrame) -> DataFrame:
    """``odd(word)`` with words of the corpus that may have been misread as it: (word, right, n, shared).

    A candidate shares all but six of a word's trigrams, two at least: one confusion changes up to four of them and
    two are allowed where they meet. So it shares one of the word's rarest trigrams, the number of which is the total
    less what must be shared, plus one; only those are looked up, and the rest are counted within the joined row.
    """
    gram = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c) + 2), lambda i: F.substring(F.concat(F.lit("##"), c, F.lit("##")), i, 3))
    right = words.where(F.char_length("word") >= 2).select(F.col("word").alias("right"), "n", F.array_distinct(gram(F.col("word"))).alias("rt"))
    index = right.select("right", "n", "rt", F.explode("rt").alias("gram"))
    use = index.groupBy("gram").agg(F.count(F.lit(1)).alias("use"))
    left = odd.where(F.char_length("word") >= 2).select("word", F.array_distinct(gram(F.col("word"))).alias("lt"))
    each = left.select("word", F.explode("lt").alias("gram")).join(use, "gram")
    ranked = each.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("use", "gram"))).alias("g"))
    need = F.greatest(F.lit(2), F.size("lt") - 6)
    # Trigrams that no word has are left out of the list but count as not shared.
    left = left.join(ranked, "word").withColumn("need", need)
    left = left.withColumn("gram", F.explode(F.slice(F.transform("g", lambda x: x["gram"]), F.lit(1), F.greatest(F.lit(1), F.size("g") - F.col("need") + 1))))
    # The cheaper conditions first; two confusions are four edits at most, and a short word holds but one.
    near = F.expr("abs(length(word) - length(right)) <= 2 and levenshtein(word, right, 4) between 0 and least(4, greatest(2, floor(length(word) / 3)))")
    shared = F.when(near, F.size(F.array_intersect("lt", "rt"))).otherwise(-1)
    both = left.hint("merge").join(index, "gram").withColumn("shared", shared).where("shared >= need")
    return both.select("word", "right", "n", "shared").distinct()


def corrections(found: DataFrame, model: Boosted | None) -> DataFrame:
    """Words with ``right``, the word that was misread, where the ranking chooses one of the candidates in ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("word", "right", "n", "shared"))))
            if not rows:
                continue
            x = np.array([candidate_features(*r) for r in rows])
            p = model.probability(x) if model else (x[:, 0] > 0) & (x[:, 1] == 0)
            keep = [(w, right, float(q)) for (w, right, _, _), q in zip(rows, p) if q > 0.5]
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*keep), (pa.string(), pa.string(), pa.float64()))], ["word", "right", "p"])

    ranked = found.mapInArrow(run, "word string, right string, p double")
    return ranked.groupBy("word").agg(F.max(F.struct("p", "right")).alias("x")).select("word", "x.right")


def header_words(texts: DataFrame) -> frozenset[str]:
    """Words of the numbered header lines of all scans of ``texts(text, format)``, three times as frequent there as in other lines.

    Lines at the head of a text or after a blank line are counted, each word once a line.
    """

    def lines(text, kind):
        all_lines = text.split("\n")
        is_scan = kind == "pdf" and wrapped(text)
        out: Counter[tuple[int, str]] = Counter()
        for i, s in enumerate(map(str.strip, all_lines)):
            if not 2 < len(s) < 90:
                continue
            if is_scan:
                m = _NUMBERED.match(s)
                f = fold_line(m.group(2) or m.group(3)) if m else ""
            else:
                f = fold_line(s) if i == 0 or not all_lines[i - 1].strip() else ""
            if f:
                out[int(is_scan), ""] += 1
                out.update((int(is_scan), w) for w in set(f.split()) if len(w) > 2)
        return [(k, w, n) for (k, w), n in out.items()]

    each = map_rows(texts, lines, "label int, word string, n int", ["label", "word", "n"])
    count = checkpointed(each.groupBy("word").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg")))
    total = count.where("word = ''").first()
    if total is None:
        return frozenset()
    least = F.greatest(F.lit(3.0), 3.0 * F.col("neg") * total["pos"] / max(1, total["neg"]))
    return frozenset(r["word"] for r in count.where("word <> ''").where(F.col("pos") >= least).select("word").toLocalIterator())


def scan_noise(parsed: DataFrame, other_texts: list[DataFrame]) -> DataFrame:
    """Noise lines of ``parsed(doc_id, text, format)``: (doc_id, line_no, noise, word, right).

    ``other_texts`` are one-column frames whose words count as known, beside those of parsed texts of other formats.
    ``word`` and ``right`` are what was read and what it should be, for broken and misread words.
    """
    pdf = parsed.where("format = 'pdf' and text is not null")
    scans = pdf.where(F.col("text").contains("\n")).select("doc_id", "text")
    counted = written(corpus_words([parsed.where("format <> 'pdf'").select("text"), *other_texts]))
    words = counted.where(F.col("n") >= KNOWN)
    # Examples of headers, from lines with a page number beside them, and of others, out of SAMPLE_TEXTS of each format.

    def lines(text, kind):
        all_lines = text.split("\n")
        is_scan = wrapped(text) and kind == "pdf"
        x, folded = line_features(all_lines, frozenset())
        out = []
        for i, v in x.items():
            s, f = all_lines[i], folded[i]
            if is_scan and _NUMBERED.match(s.strip()) and len(s) < 90:
                out.append((1, f, v))
            elif not is_scan and 2 < len(s.strip()) < 90 and f:
                out.append((0, f, v))
        return out

    plain = parsed.where("format in ('pdf', 'txt') and text is not null").select("doc_id", "format")
    h = F.xxhash64("doc_id", "format")
    some = plain.where("format = 'pdf'").orderBy(h).limit(SAMPLE_TEXTS).unionByName(plain.where("format = 'txt'").orderBy(h).limit(SAMPLE_TEXTS)).select("doc_id").distinct()
    texts = parsed.where("format in ('pdf', 'txt') and text is not null").join(F.broadcast(some), "doc_id", "left_semi").select("text", "format")
    pick = checkpointed(map_rows(texts, lines, "label int, folded string, x array<double>", ["label", "folded", "x"])).withColumn("h", F.xxhash64("folded", F.col("x").cast("string"))).orderBy("h")
    pos = pick.where("label = 1").limit(SAMPLE_LINES // 4).collect()
    neg = pick.where("label = 0").limit(SAMPLE_LINES).collect()
    heads = header_words(parsed.where("format in ('pdf', 'txt') and text is not null").select("text", "format"))
    model = None
    if len(pos) >= 10 and len(neg) >= 10:
        share = lambda f: sum(w in heads for w in f.split()) / max(1, len(f.split()))
        rows = [[*r["x"][:6], share(r["folded"]), *r["x"][7:]] for r in [*pos, *neg]]
        model = Boosted(rounds=30).fit(np.array(rows), np.array([1.0] * len(pos) + [0.0] * len(neg)))

    # The most frequent words are known; no text need ask for them.
    frequent = frozenset(r["word"] for r in words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect())
    names = ["doc_id", "line_no", "kind", "word", "next_line", "first"]
    asked = map_rows(scans, lambda d, t: [(d, *a) for a in _asks(t, heads, model, frequent)], "doc_id string, line_no int, kind string, word string, next_line int, first int", names)
    asked = written(asked.withColumn("low", F.lower("word")))
    low = asked.where("word <> ''").select(F.col("low").alias("word")).distinct()
    unknown = checkpointed(low.join(words, "word", "left_anti"))
    drawn = lambda df, k=SAMPLE_WORDS: [(r["word"], r["n"]) for r in df.withColumn("h", F.xxhash64("word")).orderBy("h").limit(k).collect()]
    known = drawn(words)
    # Examples and words that are asked for get their candidates in one join.
    truth = ranking_examples([w for w, _ in known], [w for w, _ in drawn(counted.where(F.col("n") < KNOWN))])
    examples = unknown.sparkSession.createDataFrame([(w,) for w in truth] or [("",)], "word string")
    found = written(candidates(unknown.unionByName(examples), words))
    fixed = corrections(found, train_ranking(found, truth))
    state = checkpointed(unknown.join(fixed, "word", "left").select(F.col("word").alias("low"), F.lit(1).alias("odd"), "right"))
    furn = asked.where("kind in ('header', 'pageno')").select("doc_id", "line_no", F.col("kind").alias("noise"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("string").alias("right"))
    # Words that are known need nothing more; breaks do, known or not.
    a = asked.where("kind in ('break', 'joined', 'compound', 'hyphened', 'first', 'second')").join(state, "low", "left").join(words.select(F.col("word").alias("low"), "n"), "low", "left")
    whole = F.col("kind").isin("break", "joined", "compound")
    of = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    br = a.groupBy("doc_id", "line_no").agg(
        F.max(F.when(whole, F.struct("kind", "word", "next_line", "first", "odd", "right", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"), of("hyphened").alias("hyphened"), of("first").alias("n_first"), of("second").alias("n_second")
    ).select("doc_id", "line_no", "x.*", "hyphened", "n_first", "n_second")
    # A joined word that was misread counts as often as the right one, which the corpus has.
    br = br.withColumn("n", F.when(F.col("right").isNotNull(), F.greatest(F.lit(KNOWN), F.col("n"))).otherwise(F.col("n"))).where("kind is not null")
    torn = drawn(words.where("word rlike '^[^-]{2,}-[^-]{2,}$'"))
    parts = {q for w, _ in torn for q in (w.split("-")[0], w.split("-")[1], w.replace("-", ""))}
    halves = words.join(F.broadcast(words.sparkSession.createDataFrame([(q,) for q in parts] or [("",)], "word string")), "word", "left_semi")
    joins = train_joins(known, torn, {r["word"]: r["n"] for r in halves.collect()})

    def is_break(doc_id, line_no, kind, word, next_line, first, odd, right, n, hyphened, n_first, n_second):
        if kind == "break":
            return [(doc_id, line_no, word, next_line, first, odd, right)]
        x = join_features(n, hyphened, n_first, n_second, kind == "joined", len(word))
        ok = float(joins.probability(np.array([x]))[0]) > 0.5 if joins else n > 0 or kind == "joined" and not hyphened
        return [(doc_id, line_no, word, next_line, first, odd, right)] if ok else []

    columns = ["doc_id", "line_no", "kind", "word", "next_line", "first", "odd", "right", "n", "hyphened", "n_first", "n_second"]
    broken = written(map_rows(br.select(*columns), is_break, "doc_id string, line_no int, word string, next_line int, first int, odd int, right string"))
    hyphen = broken.select("doc_id", "line_no", F.lit("hyphen").alias("noise"), "word", F.coalesce("right", F.lower("word")).alias("right"))
    digit = F.col("word").rlike(r"\p{L}[0-9|]\p{L}|\p{Ll}[0-9|]+$|^[0-9|]\p{Ll}{2}|[ﬁﬂ]")
    mis = asked.where("kind = 'word'").join(state, "low").where(F.col("right").isNotNull() | digit)
    mis = mis.select("doc_id", "line_no", F.lit("misread").alias("noise"), "word", "right")
    # In a broken word the half that differs from the right word was misread.
    half = broken.where("odd is not null and right is not null")
    first = F.expr("lower(substring(word, 1, first)) <> substring(right, 1, first)")
    half = half.select("doc_id", F.when(first, F.col("line_no")).otherwise(F.col("next_line")).alias("line_no"), F.lit("misread").alias("noise"), "word", "right")
    return furn.unionByName(hyphen).unionByName(mis).unionByName(half)


def repaired(parsed: DataFrame, noise: DataFrame) -> DataFrame:
    """Scanned texts of ``parsed`` put together again: (doc_id, text), paragraphs separated by blank lines.

    Furniture is left out, broken words are joined, misread words replaced in the case they stand in.
    """
    per = noise.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "noise", "word", "right")).alias("items"))
    docs = parsed.where("format = 'pdf' and text is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).join(per, "doc_id")

    def rows(doc_id, text, items):
        return [(doc_id, rebuild(text, [(x["line_no"], x["noise"], x["word"], x["right"]) for x in items]))]

    return map_rows(docs.select("doc_id", "text", "items"), rows, "doc_id string, text string", ["doc_id", "text"])


def _like(read: str, right: str) -> str:
    letters = [c for c in read if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if read[:1].isupper() else right


def rebuild(text: str, items: list[tuple[int, str, str | None, str | None]]) -> str:
    lines = text.split("\n")
    drop = {i for i, k, _, _ in items if k in ("header", "pageno")}
    hyphen = {i for i, k, _, _ in items if k == "hyphen"}
    for i, k, word, right in items:
        if k == "misread" and word and right and i < len(lines):
            lines[i] = re.sub(rf"(?<!\w){re.escape(word)}(?!\w)", lambda m: _like(m.group(), right), lines[i])
    rest = [i for i in range(len(lines)) if i not in drop]
    out: list[str] = []
    buffer = ""
    torn = False
    for n, i in enumerate(rest):
        s = lines[i].strip()
        if not s:
            # A blank line that a page end put into a sentence ends no paragraph.
            nxt = next((lines[j].strip() for j in rest[n + 1 :] if lines[j].strip()), "")
            if buffer and (torn or (buffer[-1] not in ".!?…»”。！？।؟:" and nxt[:1].islower())):
                continue
            if buffer:
                out.append(buffer)
            buffer = ""
            continue
        buffer = buffer + s if torn else f"{buffer} {s}" if buffer else s
        torn = i in hyphen
        if torn:
            buffer = buffer[:-1]
    if buffer:
        out.append(buffer)
    return "\n\n".join(out)

"""Keywords ranked by the statistics of a document's own terms (Campos et al. 2020).

All that the ranking needs stands in the document itself, which is one row; so a document is ranked in one pass over its
text in an Arrow batch; only its candidates, some tens, are shuffled to be filtered and numbered.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from statistics import fmean, median, pstdev

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X

from .units import occurrences

NGRAM = 3
SIMILAR = 0.9
#: Languages with a list of stop words in Spark.
LANGUAGES = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian", "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian",
    "sv": "swedish", "tr": "turkish",
}

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W_][^\W_'’\-]*(?:['’\-]+[^\W_]*)*")
#: Punctuation around keywords, as in their normal form.
_OUTER = ".,;:!?()[]{}'\"“”‘’"
_NO_TERM = re.compile(r"[\d\W]+")


def stop_words(language: str = "en") -> frozenset[str]:
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords(LANGUAGES.get(language, "english")))


@dataclass
class Term:
    """What is counted of a word of a document."""

    tf: int = 0
    capitals: int = 0
    proper: int = 0
    sentences: list[int] = field(default_factory=list)
    left: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    right: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    stop: bool = False


def tokenized(text: str) -> list[list[str]]:
    """Words by sentence; sentences without a word keep their place."""
    return [_WORD.findall(s) for s in _SENTENCE.split(text)]


def term_scores(sentences: list[list[str]], stops: frozenset[str]) -> tuple[dict[str, Term], dict[str, float]]:
    """The terms and the score of those that are no stop words, low for the telling ones: casing, place, frequency, company, spread."""
    terms: dict[str, Term] = defaultdict(Term)
    for i, words in enumerate(sentences):
        low = [w.lower() for w in words]
        for j, (w, k) in enumerate(zip(words, low)):
            t = terms[k]
            t.tf += 1
            t.capitals += len(w) > 1 and w.isupper()
            t.proper += j > 0 and w[0].isupper()
            t.sentences.append(i)
            if j:
                t.left[low[j - 1]] += 1
            if j + 1 < len(low):
                t.right[low[j + 1]] += 1
    for k, t in terms.items():
        t.stop = k in stops or len(k) < 3 or bool(_NO_TERM.fullmatch(k))
    valid = {k: t for k, t in terms.items() if not t.stop}
    if not valid:
        return terms, {}
    tfs = [t.tf for t in valid.values()]
    usual, top = fmean(tfs) + pstdev(tfs), max(tfs)
    last = max(t.sentences[-1] for t in terms.values()) + 1
    scores = {}
    for k, t in valid.items():
        case = max(t.capitals, t.proper) / (1 + math.log(t.tf))
        place = math.log(math.log(3 + median(t.sentences)))
        sides = sum(len(s) / sum(s.values()) for s in (t.left, t.right) if s)
        rel = 1 + sides * t.tf / top
        spread = len(set(t.sentences)) / last
        scores[k] = max(1e-9, rel * place / (case + (t.tf / usual + spread) / rel))
    return terms, scores


def ranked_phrases(sentences: list[list[str]], terms: dict[str, Term], scores: dict[str, float], n: int = NGRAM) -> list[tuple[float, str]]:
    """Phrases up to ``n`` words that neither begin nor end with a stop word, the lowest score first, then the earliest.

    A stop word inside counts as a term of score one.
    """
    found: dict[str, list] = {}
    for words in sentences:
        low = [w.lower() for w in words]
        for j, k in enumerate(low):
            if terms[k].stop:
                continue
            product, total = 1.0, 0.0
            for e in range(j, min(j + n, len(low))):
                s = scores.get(low[e], 1.0)
                product, total = product * s, total + s
                if not terms[low[e]].stop:
                    x = found.setdefault(" ".join(low[j : e + 1]), [0, product, total, len(found)])
                    x[0] += 1
    return [(s, p) for s, _, p in sorted((prod / (tf * (1 + total)), first, p) for p, (tf, prod, total, first) in found.items())]


def language_of(sentences: list[list[str]], stops: dict[str, frozenset[str]]) -> str:
    """The language with most stop words in a text; English where none has any."""
    words = [w.lower() for s in sentences for w in s]
    n = {k: sum(w in v for w in words) for k, v in stops.items()}
    return max(n, key=lambda k: (n[k], k == "en"))


def distinct_phrases(ranked: list[tuple[float, str]], most: int) -> list[tuple[float, str]]:
    """The best ``most`` phrases, of those that are nearly alike the better one."""
    kept: list[tuple[float, str]] = []
    masks: list[tuple[int, int]] = []
    for s, p in ranked:
        if len(kept) >= most:
            break
        n, mask = len(p), 0
        for c in p:
            mask |= 1 << (ord(c) & 63)
        # Of both a share of 1 - SIMILAR at most is unmatched, so no more kinds of characters differ.
        if not any((mask ^ m).bit_count() <= (1 - SIMILAR) * (n + k) and _alike(p, kept[i][1]) for i, (k, m) in enumerate(masks)):
            kept.append((s, p))
            masks.append((n, mask))
    return kept


def keywords(docs: DataFrame, max_keywords: int = 40, language: str | None = "en") -> DataFrame:
    """``docs(doc_id, text)`` as ``(doc_id, rank, name, score, count, source)``, the lowest score first.

    Of phrases that are nearly alike the better one is kept, until there are twice as many as are asked for; then form
    words and fragments are left out. Documents without a term have no keyword. ``language`` names the stop words; with
    None each document is taken in the language whose stop words it has most of.
    """
    stops = {k: stop_words(k) for k in ([language] if language else LANGUAGES)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int64())
        for b in batches:
            rows = []
            for doc, text, low in zip(*(c.to_pylist() for c in b.columns)):
                s = tokenized(text)
                terms, scores = term_scores(s, stops[language or language_of(s, stops)])
                seen = set()
                for i, (x, p) in enumerate(distinct_phrases(ranked_phrases(s, terms, scores), 2 * max_keywords)):
                    name = p.replace("�", "-").strip(_OUTER)
                    if name and name not in seen:
                        seen.add(name)
                        rows.append((doc, i, p, name, round(x, 9), occurrences(name, low)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "place", "phrase", "name", "score", "count"])

    some = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text").distinct()
    best = some.select("doc_id", "text", F.lower("text").alias("low")).mapInArrow(run, "doc_id string, place int, phrase string, name string, score double, count bigint")
    kept = best.where(X.keyword_accepted(F.col("phrase"))).withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    return kept.where(F.col("rank") <= max_keywords).select("doc_id", "rank", "name", "score", "count", F.lit("yake").alias("source"))


def _alike(a: str, b: str) -> bool:
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < longer * 0.8:
        return False
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() > SIMILAR and m.quick_ratio() > SIMILAR and m.ratio() > SIMILAR

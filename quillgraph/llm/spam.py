"""Keyword-stuffed pages, link lists and product tags (problem 9).

Every document gets one row of shares: the top word and top word pair among content words, repeated lines, words inside
link markup, tags, separators, function words and letters in sentences. A line-wise score tells how much of the text
is running prose, so a page that opens with a borrowed sentence still counts by what most of it is. Limits are quantiles
of these shares over all documents of a language that are running prose, drawn to prior values with the weight of
``PRIOR`` documents, so they change smoothly with the size of the corpus and a new language begins with the priors. The
language of a text is taken from its function words where ``lang`` is null or doubtful; a text in sentences that holds
few function words of any listed language is in another one, and its function words count for nothing.

Defined cases: a null text has no row and a blank one is no spam; of texts with fewer than ``MIN_WORDS`` words (an
address being one), in which shares of words say nothing, only links and tags count; a copy of a page has the result of
the page.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, written

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": set("the a an of to and in is was were be been by for that it its on at as with from this these those which who whom what why how we i you he she they our your their not no nor or but if unless until while where when so since although because despite before after between over under will would can could has have had do did does only than then there more my me us him her them any all about against without within".split()),
    "de": set("der die das den dem des ein eine einen einem einer eines und oder aber in im ist war wird wurde werden wurden sind von vom zu zum zur mit auf für an am als aus bei nach vor seit bis nicht kein keine wer was warum wie wir ich sie er es unser ihr ihre dass daß weil da damit während über unter zwischen durch ohne um haben hat hatte wollen brauchen sich auch nur noch".split()),
    "fr": set("le la les un une des de du d l et ou mais en dans est sont fut a ont été être par pour que qui quoi pourquoi comment nous je vous il elle ils elles notre nos votre leur ne ni pas plus sur sous avec sans au aux ce cette ces se son sa ses y où dès depuis pendant après avant selon malgré jadis désormais afin alors".split()),
    "es": set("el la los las un una unos unas de del al y o u pero en es son fue fueron ha han sido ser será por para que quien quién qué cómo nosotros yo nuestro nuestra su sus no ni más sobre bajo con sin se lo le les este esta estos estas ese esa entre desde hasta durante después antes según aunque porque mientras donde hoy muy ya contra".split()),
}
MIN_WORDS = 12
PRIOR = 200  # documents that the prior values of limits weigh as much as
PROSE_WORDS = 30  # words of a text that says what is usual in its language
#: Limits: the share, its quantile among prose, a factor, and the prior value.
LIMITS = {
    "function_words": (0.001, 0.85, 0.2), "top_word": (0.985, 1.0, 0.16), "distinct_words": (0.04, 1.0, 0.35), "link_text": (0.999, 3.0, 0.4), "separators": (0.999, 2.5, 0.3),
}

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LINK = re.compile(r"\[[^\]\n]*\]\([^)\s]*\)|<a\s[^>]*>.*?</a>|https?://\S+|www\.\S+", re.S)
_URL = re.compile(r"https?://\S+|www\.\S+")
_TAG = re.compile(r"#\w+")
_SEPARATOR = re.compile(r"[|·•»>;,/+*#]| - | – ")
_NUMBERED = re.compile(r"\d+(?:/\d+|[.)])\s")
#: A paper laid: its number of two parts, its title, perhaps its address.
_PAPER = re.compile(r"\d+/\d+ [^\W\d_][^\[\]<>#]*?(?:: (?:https?://|www\.)\S+)?")
_END = re.compile(r"[.!?…][\"”»“)]*(?:\s|$)")


FIELDS = (
    "doc_id bigint, lang string, words int, top_word double, top_pair double, function_words double, duplicate_lines double, link_text double, tags double, separators double, prose double, distinct_words double, "
    "numbered_lines double, menu_lines double, paper_lines double, links int"
)
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_LANGUAGES = sorted(FUNCTION_WORDS)
#: The languages that a function word belongs to, by their numbers.
_OF = {w: tuple(i for i, k in enumerate(_LANGUAGES) if w in FUNCTION_WORDS[k]) for v in FUNCTION_WORDS.values() for w in v}


def shares(text: str, lang: str | None) -> tuple:
    """The features of a text, after its language and word count."""
    low = text.lower()
    bare = _URL.sub(" ", low)
    words = _WORD.findall(bare)
    n = len(words)
    tokens = n + len(_URL.findall(low))
    if not tokens:
        return (lang, 0, *[0.0] * 12, 0)
    m_words = max(1, n)
    count = Counter(words)
    by = [0] * len(_LANGUAGES)
    for w in _OF.keys() & count.keys():
        for i in _OF[w]:
            by[i] += count[w]
    best = by.index(max(by))
    if lang in FUNCTION_WORDS and by[_LANGUAGES.index(lang)] * 1.5 >= by[best]:
        best = _LANGUAGES.index(lang)
    lang, fun = _LANGUAGES[best], by[best] / m_words
    common = FUNCTION_WORDS[lang]
    content = [w for w in words if w not in common and not w.isdigit()]
    m = max(1, len(content))
    top = max(Counter(content).values(), default=0) / m
    pair = max(Counter(zip(content, content[1:])).values(), default=0) / max(1, m - 1)
    lines = [x.strip() for x in low.split("\n") if x.strip()]
    duplicates = 1 - len(set(lines)) / len(lines)
    found = _LINK.findall(low)
    links = sum(map(len, found)) / len(text)
    tags = len(_TAG.findall(low)) / m_words
    separators = len(_SEPARATOR.findall(bare)) / m_words
    # Prose: words of sentences that end in an end mark, repeat no content word much and hold their share of function words.
    prose = form = 0
    for line in lines:
        at = 0
        for e in _END.finditer(line):
            sentence = _WORD.findall(line[at : e.end()])
            at = e.end()
            if len(sentence) >= 2:
                rest = [w for w in sentence if w not in common]
                if len(set(rest)) == len(rest) or max(Counter(rest).values()) <= max(1, len(sentence) // 8):
                    form += len(sentence) if len(sentence) >= 4 else 0
                    if len(sentence) - len(rest) >= 0.15 * len(sentence):
                        prose += len(sentence)
    if fun < 0.1 and form > 0.8 * m_words:
        lang, prose = "other", form
    return (
        lang, tokens, top, pair, fun, duplicates, links, tags, separators, prose / m_words, len(count) / m_words, sum(bool(_NUMBERED.match(x)) for x in lines) / len(lines),
        sum(len(x.split()) <= 4 and x[-1] not in ".!?" for x in lines) / max(len(lines), 8), paper_lines(text), len(found),
    )


def limits(scores: DataFrame) -> DataFrame:
    """Limits by language: quantiles over the texts in running prose, drawn to the priors; a row per language."""
    some = scores.where((F.col("prose") > 0.5) & (F.col("words") >= PROSE_WORDS))
    n = F.count(F.lit(1))
    each = [((n * factor * F.percentile_approx(c, F.lit(q), F.lit(10_000)) + PRIOR * prior) / (n + PRIOR)).alias(f"at_{c}") for c, (q, factor, prior) in LIMITS.items()]
    return some.groupBy("lang").agg(*each)


def is_spam() -> Column:
    """The verdict on a row of shares beside the limits of its language."""
    c = F.col
    at = {k: F.coalesce(c(f"at_{k}"), F.lit(prior)) for k, (_, _, prior) in LIMITS.items()}
    one = lambda cond, w=1.0: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    fun, top, pair, links, tags = c("function_words"), c("top_word"), c("top_pair"), c("link_text"), c("tags")
    listed = c("lang") != "other"
    score = (
        one(listed & (fun < 0.5 * at["function_words"]))
        + one(listed & (fun < at["function_words"]), 0.5)
        + one((top > at["top_word"]) | ((top > 0.6 * at["top_word"]) & (pair > 0.5 * top)))
        + one(top > 0.45 * at["top_word"], 0.5)
        + one(c("distinct_words") < at["distinct_words"])
        + one(c("duplicate_lines") > 0.2)
        + one(links > at["link_text"])
        + one(tags > 0.3)
        + one(c("separators") > at["separators"])
        + one(c("menu_lines") > 0.6, 0.5)
        - one(c("prose") > 0.5, 2.0)
        # Papers and agenda items bear numbers; where links or tags outweigh them, only the form of papers tells them.
        - one((c("numbered_lines") > 0.5) & (top < 0.25) & (((links <= at["link_text"]) & (tags <= 0.3)) | (c("paper_lines") > 0.5)), 8.0)
        - one((c("distinct_words") > 0.45) & (top <= 0.5 * at["top_word"]) & (pair <= 0.03) & (links < 0.1) & (tags < 0.05), 2.0)  # lists of names
    )
    few = (((links > at["link_text"]) & (c("links") >= 3)) | (tags > 0.5) & (tags * c("words") >= 3)) & (c("prose") <= 0.5) & (c("paper_lines") <= 0.5)
    return F.when(c("words") < MIN_WORDS, few).otherwise(score >= 2)


def paper_lines(text: str) -> float:
    """Share of the lines that list a paper."""
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    return sum(bool(_PAPER.fullmatch(x)) for x in lines) / max(1, len(lines))


def spam_scores(df: DataFrame) -> DataFrame:
    """``df(doc_id, text, lang)`` with the shares and ``spam`` of every row.

    The shares are written once; the limits are a row per language, of the four listed ones and "other".
    """
    rows = lambda doc_id, text, lang: [] if text is None else [(doc_id, *shares(text, lang))]
    scores = written(map_rows(df.select("doc_id", "text", "lang"), rows, FIELDS, NAMES))
    judged = scores.join(F.broadcast(limits(scores)), "lang", "left").withColumn("spam", F.coalesce(is_spam(), F.lit(False)))
    return judged.select(*NAMES, "spam")

"""Values cut off by field limits or in transfer (problem 4).

Lengths of every value are recomputed in characters, UTF-8 bytes, UTF-16 units, with entities escaped, with JSON
escapes and with line ends of two characters. Grouped by source and by each of these, a length at which far more values
end openly than at those beside it is a hidden storage limit. Then endings are inspected: a value that ends in an end
mark is complete unless the mark belongs to an abbreviation, a number or a quotation still open; what is left, some
tenth of the rows, is looked up in the text that it quotes, white space aside, where the next characters decide: the end
of a line or of the unit, or the same omission mark, is complete. Values that can't be found there, because the text is
damaged, are decided by their form and by whether they are at a limit of their source, by any of the measures.

A document's values come to its text in groups of at most some hundreds, however many it has.

Defined cases: null, empty and blank values are no cases; values whose document is missing are decided by their form;
rows that repeat give one result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_rows
from .sentences import ABBREVIATIONS, _soft_breaks

# Abbreviations that often end a name, and so a sentence, before a capital letter.
CLOSING = set("ltd inc co corp bros dept assn assoc soc fdn fed univ inst bd auth off natl est jr etc usw ecc a.m p.m u.s u.k".split())
MEASURES = ["chars", "utf8_bytes", "utf16_units", "entity_chars", "json_chars", "crlf_chars"]
GROUP = 400

_MARK = re.compile(r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…+)\s*$")
_CLOSED = re.compile(r"(?:[.!?。！？।؟॥…]|(?<=[\u0370-\u03ff]);)[\"”’)\]]*(?:\s?[»“”」』])*$")
# The lines that documents are listed with: numbered items, dashes and colons, table rows.
_LINE = re.compile(r"^\d{1,4}[.)] .+[,/] .+\S$|^.+ – [^.!?–]+: \S.*$|^.+: [^.!?]+\(\d+\)$|^[^.!?]+:? -?\d+(?:[.,]\d+)?$|^\d+(?:[.,]\d+)?$")
_PAIRS = [("“", "”"), ("«", "»"), ("„", "“"), ("「", "」"), ("『", "』"), ("(", ")"), ("（", "）")]
#: The same as a Spark pattern, to settle most rows before Python: an end mark after a word of three letters or more in
#: lower case or in a script without case, and no quotation or bracket in the value.
_PLAIN_END = r"^[^“”«»„「」『』()（）\"…]*(?:[a-zß-öø-ÿа-яё]{4,}|[α-ωά-ώ]{4,}|[ء-ي]{3,}|[ऀ-ॿ]{2,}|[぀-ヿ一-鿿]{2,})[.!?。！？।؟]\s*$"

#: Longer abbreviations would pass as such words.
_LONG_ABBREVIATION = r"(?i)(?:^|[^\p{L}])(?:" + "|".join(sorted(re.escape(a) for a in ABBREVIATIONS if len(a) >= 4)) + r")\.\s*$"


def lengths(text) -> list:
    """Expressions of the lengths in ``MEASURES``, in their order."""
    n = F.char_length(text)
    count = lambda p: F.char_length(F.regexp_replace(text, p, ""))
    amp, angle, quote = n - count("&"), n - count("[<>]"), n - count("[\"']")
    astral = n - count(r"[\x{10000}-\x{10FFFF}]")
    free = n - count(r"[^\x00-\x7f]")
    slash = n - count(r'["\\\n\r\t]')
    return [n, F.octet_length(text), n + astral, n + 4 * amp + 3 * angle + 5 * quote, n + 5 * free + 6 * astral + slash, n + (n - count("\n"))]


def storage_limits(values: DataFrame, least: int = 8) -> DataFrame:
    """``values(source, text)`` as hidden limits: (source, measure, length, values, open_values, beside).

    A limit is a length at which ``least`` values or more end openly, at least half of those of that length, and four
    times as many as at the mean of the six lengths beside it.
    """
    v = values.where("text is not null and trim(text) <> ''").select("source", "text", F.expr(r"rtrim(text) not rlike '[.!?。！？।؟;][\"”’)\\]]*([\\s\u00a0]?[»“”」』])*$'").cast("int").alias("open"))
    at = v.select("source", "open", F.explode(F.arrays_zip(F.array(*map(F.lit, MEASURES)).alias("measure"), F.array(*(x.cast("int") for x in lengths(F.col("text")))).alias("length"))).alias("x"))
    h = at.groupBy("source", F.col("x.measure").alias("measure"), F.col("x.length").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.sum("open").alias("open_values"))
    w = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-3, 3)
    h = h.withColumn("beside", (F.sum("open_values").over(w) - F.col("open_values")) / 6.0)
    return h.where((F.col("open_values") >= least) & (2 * F.col("open_values") >= F.col("n")) & (F.col("open_values") >= 4 * F.col("beside"))).select("source", "measure", "length", F.col("n").alias("values"), "open_values", "beside")


def ending(text: str) -> str:
    """"complete", or what makes the end doubtful: "mark", "open", "abbreviation", "quotation", "led"."""
    t = text.rstrip()
    m = _MARK.search(t)
    if m:
        return "mark"
    for a, b in _PAIRS:
        if t.count(a) > t.count(b) and not (a == "“" and "„" in t) and not (a == "“" and "€" in t):
            return "quotation"
    if not _CLOSED.search(t):
        return "open"
    if t[-1] in "”»“」』":
        last = t[-1]
        opener = {"”": "“", "»": "«", "“": "„", "」": "「", "』": "『"}[last]
        k = t.rfind(opener)
        before = t[:k].rstrip()
        # A quotation that nothing leads in: its speaker may be missing.
        return "led" if k >= 0 and (not before or before[-1] in ".!?。！？।؟…”»」;") else "complete"
    if t[-1] == ".":
        w = re.search(r"[^\s(\[“„«「,、。]*$", t[:-1]).group().lower()
        if not w or w in ABBREVIATIONS or w.rsplit(".", 1)[-1] in ABBREVIATIONS and "." in w or len(w) == 1 or w[-1].isdigit() or re.fullmatch(r"(?:\w\.)+\w?", w) or w.endswith("."):
            return "abbreviation"
    return "complete"


def _flat(s: str) -> str:
    return "".join(s.split())


class Quoted:
    """A document's text without white space, with the offsets at which lines end."""

    def __init__(self, text: str) -> None:
        self.text = text
        parts, self.breaks, at = [], {}, 0
        position = 0
        for line in text.split("\n"):
            f = _flat(line)
            parts.append(f)
            at += len(f)
            position += len(line)
            self.breaks.setdefault(at, position)
            position += 1
        self.flat = "".join(parts)
        self._soft: set[int] | None = None

    def line_ends(self, at: int) -> bool:
        """Does a line that isn't wrapped end here?"""
        if at not in self.breaks:
            return False
        if self._soft is None:
            self._soft = _soft_breaks(self.text)
        return self.breaks[at] not in self._soft

    def find(self, core: str) -> int:
        """Where a value ends in the text, by all of it or, where it is damaged, by its last characters; -1."""
        for n in (len(core), 40, 20):
            tail = core[-n:]
            if len(tail) < min(8, len(core)):
                break
            k = self.flat.find(tail)
            if k >= 0:
                return k + len(tail)
        return -1


def cut_off(text: str, doubt: str, doc: Quoted | None, at_limit: bool) -> bool:
    """Is a value of doubtful ending cut off?"""
    t = text.strip()
    m = _MARK.search(t)
    core = _flat(t[: m.start()] if m else t)
    if m and (m.group()[0].isspace() or m.group()[0] in "[("):
        # Set off by a space or in brackets: put there afterwards, unless the document has it.
        return not (doc and _flat(t) in doc.flat)
    end = doc.find(core) if doc and core else -1
    if end < 0:
        if doubt == "open":
            return at_limit or not _LINE.match(t)
        if doubt == "mark":
            return at_limit or not re.search(r"[^\W\d_]{2,}\W*$", t[: m.start()])
        if doubt == "quotation":
            return True
        if doubt == "abbreviation":
            return not re.search(r"(?:etc|Ltd|al|\.)\.$", t)
        return False
    nxt = doc.flat[end : end + 1]
    if doubt == "mark":
        tail = core[-20:]
        if tail + "…" in doc.flat or tail + "..." in doc.flat:
            return False
        return core in doc.flat or at_limit or not re.search(r"[^\W\d_]{2,}\W*$", t[: m.start()])
    if doubt == "open":
        # A list line ends at any line end, though the lines of the text are wrapped, unless it goes on in small letters.
        return not (end >= len(doc.flat) or doc.line_ends(end) or end in doc.breaks and not nxt.islower() and _LINE.match(t))
    if doubt == "abbreviation":
        if end >= len(doc.flat) or doc.line_ends(end):
            return False
        if core.endswith(".."):
            return False
        word = re.search(r"[^\s(\[“„«「,、。]*$", t[:-1]).group()
        if nxt.islower() or nxt.isdigit() or nxt in ",;:.)’'–-":
            return True
        if word.isdigit() or word.lower() in CLOSING or re.search(r", \w\.$", t):
            return False
        return word.lower() in ABBREVIATIONS or len(word) == 1 or "." in word
    if doubt == "quotation":
        return True
    return nxt.islower() or nxt in "—–,と" or (nxt.isalpha() and not nxt.isupper())


def truncated(values: DataFrame, parsed: DataFrame, use_limits: bool = True) -> DataFrame:
    """``values(record_table, doc_id, record_id, source, text)`` that are cut off, as ``(record_table, doc_id, record_id)``.

    ``parsed(doc_id, text)`` has the documents that they quote.
    """
    v = values.where("text is not null and trim(text) <> ''").distinct()
    some = v.where(~F.col("text").rlike(_PLAIN_END) | F.col("text").rlike(_LONG_ABBREVIATION))

    doubtful = map_rows(
        some.select("record_table", "doc_id", "record_id", "source", "text"),
        lambda a, b, c, d, t: [(a, b, c, d, t, k)] if (k := ending(t)) != "complete" else [],
        "record_table string, doc_id string, record_id string, source string, text string, doubt string",
        ["record_table", "doc_id", "record_id", "source", "text", "doubt"],
    )
    if use_limits:
        # A value is at a limit if its length by any measure is one of its source's; sources have few limits each.
        mark = lambda m, n: F.concat(F.lit(m + " "), n.cast("string"))
        limits = storage_limits(v.select("source", "text")).groupBy("source").agg(F.collect_set(F.concat_ws(" ", "measure", F.col("length").cast("string"))).alias("limits"))
        doubtful = doubtful.join(limits, doubtful.source.eqNullSafe(limits.source), "left").drop(limits.source)
        own = F.array(*(mark(m, n.cast("int")) for m, n in zip(MEASURES, lengths(F.col("text")))))
        doubtful = doubtful.withColumn("at_limit", F.coalesce(F.arrays_overlap("limits", own), F.lit(False)))
    else:
        doubtful = doubtful.withColumn("at_limit", F.lit(False))
    item = F.struct("record_table", "record_id", "text", "doubt", "at_limit")
    # Split a document's values into groups by their number, counted beforehand.
    salted = doubtful.withColumn("salt", F.pmod(F.xxhash64("record_table", "record_id"), F.lit(1 << 20)))
    per = salted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    big = per.where(F.col("n") > GROUP)
    salted = salted.join(big, "doc_id", "left").withColumn("salt", F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.col("salt"), F.ceil(F.col("n") / GROUP))))
    grouped = salted.groupBy("doc_id", "salt").agg(F.collect_list(item).alias("items"))
    docs = parsed.where("doc_id is not null").select("doc_id", F.col("text").alias("doc_text"))
    joined = grouped.join(docs, "doc_id", "left").select("doc_id", "doc_text", "items")

    def rows(doc_id, doc_text, items):
        doc = Quoted(doc_text) if doc_text else None
        return [(x["record_table"], doc_id, x["record_id"]) for x in items if cut_off(x["text"], x["doubt"], doc, x["at_limit"])]

    return map_rows(joined, rows, "record_table string, doc_id string, record_id string", ["record_table", "doc_id", "record_id"]).distinct()


def quoted_values(evidence: DataFrame, nodes: DataFrame) -> DataFrame:
    """Evidence texts and node snippets as ``(record_table, doc_id, record_id, source, text)``."""
    e = evidence.select(F.lit("graph_evidence").alias("record_table"), "doc_id", F.col("evidence_id").cast("string").alias("record_id"), F.concat(F.lit("evidence:"), F.coalesce("source", F.lit(""))).alias("source"), "text")
    n = nodes.select(F.lit("graph_nodes").alias("record_table"), "doc_id", F.col("id").alias("record_id"), F.concat(F.lit("nodes:"), F.coalesce(F.array_join("sources", "+"), F.lit(""))).alias("source"), F.col("snippet").alias("text"))
    return e.unionByName(n)


def truncation_rates(values: DataFrame, cut: DataFrame) -> DataFrame:
    """Share of cut values by table and source: (record_table, source, values, truncated, share)."""
    v = values.where("text is not null and trim(text) <> ''").select("record_table", "doc_id", "record_id", "source").distinct()
    flagged = v.join(cut.withColumn("hit", F.lit(1)), ["record_table", "doc_id", "record_id"], "left")
    out = flagged.groupBy("record_table", "source").agg(F.count(F.lit(1)).alias("values"), F.sum(F.coalesce("hit", F.lit(0))).alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.col("values"))

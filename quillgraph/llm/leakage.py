"""Evaluation items that leak into documents (problem 8).

The words of the items, lower-cased and without punctuation, are cut into grams of ``GRAM`` words; one Aho-Corasick
automaton holds those of a block of items and scans every document once. Items of the same words are one text, and near
copies count as one where the texts that hold a gram are counted. Runs of ``FORMULA_WORDS`` words that ``SHARED`` texts or
more hold, and that stand in documents mostly without their items, are procedural formulas; grams inside them stand in no
automaton. The hits of a document and an item are chained in order; the gaps of a chain may hold replaced words, or an
interruption on the document's side, and chains on both sides of a longer one add up. The ends of a passage are carried
on word by word past one replaced word, beyond which no gram may fit. A document leaks an item if the passage spans at least a
third of the item's words other than formulas. An item with fewer words than a gram is matched as a whole. Offsets are
mapped back to the text.

The items are the stated query set: they are read in blocks of ``BLOCK_ITEMS``, each block one automaton of bounded
size, so nothing that grows with the corpus goes to the driver or to the executors.

Defined cases: null texts and texts without words leak nothing; an item with fewer than ``GRAM`` words that stands in
``SHARED`` item texts or more is a formula and leaks nothing; an item that is listed twice counts once; copies of a
document leak what the document does.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows
from .names import components

GRAM = 4
FORMULA_WORDS, SHARED = 8, 3
NEAR = 0.75  # share of their grams that near copies have in common
SHARE = 1 / 3
#: Most words that a replaced passage may hold between two hits of a chain, on either side, and what an interruption may
#: add on the document's side.
GAP, INTERRUPTION = 8, 60
BLOCK_ITEMS = 5_000

_NOT_WORD = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normal_words(text: str) -> list[str]:
    return [w for w in _NOT_WORD.sub(" ", text.lower()).split(" ") if w]


def grams(w: list[str], n: int) -> list[str]:
    return [" ".join(w[q : q + n]) for q in range(len(w) - n + 1)]


class Items:
    """Item texts ready to be matched: grams by their text, words and formula words by item.

    ``common`` are the grams that more than two texts hold, ``formulas`` the runs of ``FORMULA_WORDS`` words to be left out.
    """

    def __init__(self, items: list[tuple[int, str]], common: set[str] = frozenset(), formulas: set[str] = frozenset()) -> None:
        self.words = {i: normal_words(t) for i, t in items if t}
        self.plain: dict[int, list[int]] = {}  # number of words other than formulas before each word
        self.own: dict[int, list[int]] = {}  # number of plain words in own grams before each word
        self.grams: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.common = common
        for i, w in self.words.items():
            formula, own = bytearray(len(w)), bytearray(len(w))
            for q, g in enumerate(grams(w, FORMULA_WORDS)):
                if g in formulas:
                    formula[q : q + FORMULA_WORDS] = b"\1" * FORMULA_WORDS
            if len(w) < GRAM:
                self.grams[" ".join(w)].append((i, 0))
            for q, g in enumerate(grams(w, GRAM)):
                if not all(formula[q : q + GRAM]):
                    self.grams[g].append((i, q))
                    if g not in common:
                        own[q : q + GRAM] = b"\1" * GRAM
            n, m, before, mine = 0, 0, [0], [0]
            for x, y in zip(formula, own):
                n += not x
                m += y and not x
                before.append(n)
                mine.append(m)
            self.plain[i], self.own[i] = before, mine

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for g, where in self.grams.items():
            rare = g not in self.common
            a.add_word(f" {g} ", (g.count(" ") + 1, [(rare, i, q) for i, q in where]))
        if self.grams:
            a.make_automaton()
        return a


def chains(hits: list[tuple[int, int]], before: list[int]) -> list[list[tuple[int, int]]]:
    """Chains of hits (word of the document, word of the item), in order on both sides and with bounded gaps.

    ``before`` counts the item's words other than formulas; only they widen a gap on its side. Both sides advance alike,
    but where the item goes straight on the document may hold an interruption. A hit extends the open chain whose end
    it follows most closely on the item's side.
    """
    out: list[list[tuple[int, int]]] = []
    open_: list[list[tuple[int, int]]] = []
    for p, q in sorted(hits):
        open_ = [c for c in open_ if p - c[-1][0] <= GAP + GRAM + INTERRUPTION]
        best, gap = None, 0
        for c in open_:
            lp, lq = c[-1]
            if lp < p and lq < q:
                step = before[q] - before[lq]
                shift = (p - lp) - step
                if step <= GAP + GRAM and (-3 <= shift <= 3 or step <= GRAM + 2 and -3 <= shift <= INTERRUPTION) and (best is None or step < gap):
                    best, gap = c, step
        if best is None:
            best = []
            out.append(best)
            open_.append(best)
        best.append((p, q))
    return out


def _carry_on(words: list[str], item: list[str], found: bytearray, p: int, q: int, step: int) -> int:
    """Mark the item's words that follow a passage's end in a document, past one replaced word; the last place in the document.

    ``p`` and ``q`` are the first places beyond the end, ``step`` is 1 or -1. Sentences of one form agree in every other
    word or so, which is no passage; so no second word is passed.
    """
    last, passed = p - step, False
    while 0 <= q < len(item) and 0 <= p < len(words):
        if words[p] == item[q]:
            found[q] = 1
        elif not passed and 0 <= q + step < len(item) and 0 <= p + step < len(words) and words[p + step] == item[q + step]:
            found[q] = found[q + step] = 1
            p, q, passed = p + step, q + step, True
        else:
            break
        last = p
        p, q = p + step, q + step
    return last


def passages(items: Items, hits: list[tuple[int, int, int, bool]], flat: str) -> list[tuple[int, float, int, int]]:
    """(item, share of its words, first and last word in the document) of the best passage of each item.

    A passage is a chain, or chains that follow each other on the item's side whatever interrupts them in the document.
    Half of its words or more must stand in grams that two texts at most share, or ``SHARE`` of the item's words in such
    grams be among them: items are alike in phrases. Of an item that has no such grams, half must be found.
    """
    words: list[str] = []
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    own: dict[int, set[int]] = defaultdict(set)
    for p, item, q, rare in hits:
        by[item].append((p, q))
        if rare:
            own[item].add(q)
    out = []
    for item, pq in by.items():
        before, mine = items.plain[item], items.own[item]
        total, total_own = before[-1], mine[-1]
        if total_own and not own[item]:
            continue
        best = (0.0, 0, 0)
        for c in _sequences([c for c in chains(pq, before) if len(c) * 4 >= 0.1 * total], before):
            found, found_own = bytearray(len(before) - 1), bytearray(len(before) - 1)
            for p, q in c:
                found[q : q + GRAM] = b"\1" * GRAM
                if q in own[item]:
                    found_own[q : q + GRAM] = b"\1" * GRAM
            n_own = sum(found_own)
            if total_own and 2 * n_own < sum(found) and n_own < SHARE * total_own:
                continue
            words = words or flat.split()
            first = _carry_on(words, items.words[item], found, c[0][0] - 1, c[0][1] - 1, -1)
            end = _carry_on(words, items.words[item], found, c[-1][0] + GRAM, c[-1][1] + GRAM, 1)
            # Replaced words within the passage belong to it; a longer gap on the item's side does not.
            got, last = 0, None
            for q in range(len(found)):
                if found[q]:
                    if last is not None and 0 < before[q] - before[last + 1] <= GAP:
                        got += before[q] - before[last + 1]
                    got += before[q + 1] - before[q]
                    last = q
            share = got / max(1, total)
            if share > best[0] and (total_own or share >= 0.5):
                best = (share, first, end)
        if best[0]:
            out.append((item, *best))
    return out


def _sequences(parts: list[list[tuple[int, int]]], before: list[int]) -> list[list[tuple[int, int]]]:
    """The chains, each with the longest sequence of chains before it that it carries on on the item's side."""
    parts = sorted(parts)
    best: list[tuple[int, list[tuple[int, int]]]] = []
    out = []
    for c in parts:
        p, q = c[0]
        lead = max((b for b in best if b[1][-1][0] < p and b[1][-1][1] < q and before[q] - before[b[1][-1][1]] <= GAP + GRAM), key=lambda b: b[0], default=(0, []))
        whole = lead[1] + c
        best.append((lead[0] + len(c), whole))
        out.append(whole)
    return out


def leaks(documents: DataFrame, eval_items: DataFrame, share: float = SHARE) -> DataFrame:
    """``documents(doc_id, text)`` and ``eval_items(item_id, text)`` as ``(doc_id, item_id, share, start, end)``; offsets into the text."""
    texts = item_texts(eval_items)
    shared = shared_grams(texts)
    formulas = _formulas(documents, texts, shared)
    out = None
    for block, common, runs in _blocks(texts, shared.where(F.col("words") == GRAM), formulas):
        found = _scan(documents, Items(block, common, runs), share)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, share double, start int, end int")
    out = out.join(F.broadcast(texts.select("key", F.explode("ids").alias("item_id"))), "key")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("share", "start", "end")).alias("x")).select("doc_id", "item_id", "x.*")


def item_texts(eval_items: DataFrame) -> DataFrame:
    """Different texts of the items, as their words, with the items that have them: ``(key, text, ids)``."""
    some = eval_items.where("item_id is not null and text is not null").select("item_id", "text")
    words = map_rows(some, lambda i, t: [(i, " ".join(w))] if (w := normal_words(t)) else [], "item_id bigint, text string", ["item_id", "text"])
    texts = checkpointed(words.groupBy("text").agg(F.array_sort(F.collect_set("item_id")).alias("ids")).select(F.xxhash64("text").alias("key"), "text", "ids"))
    # Short texts that others hold as well are formulas.
    short = texts.where(F.size(F.split("text", " ")) < GRAM).select(F.col("text").alias("gram"), F.col("key").alias("short"))
    runs = map_rows(texts.select("key", "text"), lambda k, t: [(k, g) for n in range(1, GRAM) for g in sorted(set(grams(t.split(" "), n)))], "key bigint, gram string")
    shared = runs.join(short, "gram").groupBy("short").agg(F.count_distinct("key").alias("n")).where(F.col("n") >= SHARED).select(F.col("short").alias("key"))
    return texts.join(shared, "key", "left_anti")


def shared_grams(texts: DataFrame) -> DataFrame:
    """``(key, words, gram)``: the grams, of ``GRAM`` and of ``FORMULA_WORDS`` words, that three texts or more hold, near copies counting as one."""
    rows = lambda k, t: [(k, n, g) for n in (GRAM, FORMULA_WORDS) for g in sorted(set(grams(t.split(" "), n)))]
    each = checkpointed(map_rows(texts.select("key", "text"), rows, "key bigint, words int, gram string", ["key", "words", "gram"]))
    # Near copies share ``NEAR`` of the grams of either; so they share one of the rarest, those beyond that share plus one.
    small = each.where(F.col("words") == GRAM)
    use = small.groupBy("gram").agg(F.count(F.lit(1)).alias("use"))
    per = small.join(use, "gram").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("use", "gram"))).alias("g")).select("key", F.transform("g", lambda x: x["gram"]).alias("g"))
    per = checkpointed(per)
    first = per.select("key", "g", F.explode(F.slice("g", F.lit(1), (F.size("g") - F.ceil(F.size("g") * NEAR) + 1).cast("int"))).alias("gram"))
    other = first.select(F.col("key").alias("other"), F.col("g").alias("h"), "gram")
    near = first.join(other, "gram").where("key < other").where(F.size(F.array_intersect("g", "h")) >= NEAR * F.greatest(F.size("g"), F.size("h")))
    edges = near.select(F.col("key").cast("string").alias("a"), F.col("other").cast("string").alias("b")).distinct()
    group = components(edges, texts.select(F.col("key").cast("string").alias("node"))).select(F.col("node").cast("bigint").alias("key"), "label")
    many = each.join(group, "key").groupBy("words", "gram").agg(F.countDistinct("label").alias("n")).where(F.col("n") >= SHARED).select("words", "gram")
    return checkpointed(each.join(many, ["words", "gram"]).select("key", "words", "gram"))


def _formulas(documents: DataFrame, texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Shared runs that are formulas, ``(key, gram)``: half or more of the documents that hold one hold no own gram of its items."""
    runs = shared.where(F.col("words") == FORMULA_WORDS).select("key", "gram")
    seen = None
    for block, common, held in _blocks(texts.join(runs.select("key").distinct(), "key", "left_semi"), shared.where(F.col("words") == GRAM), runs):
        found = _runs_in(documents, Items(block, common), held)
        seen = found if seen is None else seen.unionByName(found)
    if seen is None:
        return runs
    free = seen.groupBy("gram", "doc_id").agg(F.max("own").alias("own")).groupBy("gram").agg(F.avg(F.col("own").cast("int")).alias("own")).where("own <= 0.5")
    return checkpointed(runs.join(free.select("gram"), "gram", "left_semi"))


def _runs_in(documents: DataFrame, items: Items, held: set[str]) -> DataFrame:
    """``(doc_id, gram, own)``: runs that a document holds, and whether it holds an own gram of one of their items as well."""
    holders: dict[str, set[int]] = defaultdict(set)
    for i, w in items.words.items():
        for g in grams(w, FORMULA_WORDS):
            if g in held:
                holders[g].add(i)
    sent = documents.sparkSession.sparkContext.broadcast((dict(holders), {g: {i for i, _ in where} for g, where in items.grams.items() if g not in items.common}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        import pyarrow as pa

        holders, own = sent.value
        a = ahocorasick.Automaton()
        for k, part in ((False, holders), (True, own)):
            for g, ids in part.items():
                a.add_word(f" {g} ", (k, g, ids))
        a.make_automaton()
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                here, mine = set(), set()
                for _, (k, g, ids) in a.iter(_flat(text)):
                    if k:
                        mine |= ids
                    else:
                        here.add(g)
                out += [(doc_id, g, not holders[g].isdisjoint(mine)) for g in here]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.bool_()))], ["doc_id", "gram", "own"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, gram string, own boolean")


def _blocks(texts: DataFrame, common: DataFrame, runs: DataFrame) -> Iterator[tuple[list[tuple[int, str]], set[str], set[str]]]:
    """Texts by ``BLOCK_ITEMS`` with the grams that are common and the runs among theirs."""
    gathered = lambda df, name: df.groupBy("key").agg(F.collect_set("gram").alias(name))
    rows = texts.join(gathered(common, "common"), "key", "left").join(gathered(runs, "runs"), "key", "left").orderBy("key")
    block, common_here, runs_here = [], set(), set()
    for r in rows.select("key", "text", "common", "runs").toLocalIterator():
        block.append((r["key"], r["text"]))
        common_here.update(r["common"] or ())
        runs_here.update(r["runs"] or ())
        if len(block) == BLOCK_ITEMS:
            yield block, common_here, runs_here
            block, common_here, runs_here = [], set(), set()
    if block:
        yield block, common_here, runs_here


def _flat(text: str) -> str:
    """The normal words of a text, one space around each."""
    flat = f" {_NOT_WORD.sub(' ', text.lower())} "
    return flat[1:] if flat.startswith("  ") else flat


def _scan(documents: DataFrame, items: Items, share: float) -> DataFrame:
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        items = sent.value
        automaton = items.automaton()
        names = ["doc_id", "key", "share", "start", "end"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
        for b in batches:
            out: list[tuple] = []
            if items.grams:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if text:
                        out.extend(_document(items, automaton, doc_id, text, share))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, key bigint, share double, start int, end int")


def _document(items: Items, automaton, doc_id: int, text: str, share: float) -> list[tuple]:
    flat = _flat(text)
    ends = [(e, where) for e, where in automaton.iter(flat)]
    if not ends:
        return []
    # Words before an offset, counted on from the hit before.
    hits, at, n = [], 0, 0
    whole: dict[int, tuple[int, float, int, int]] = {}
    for e, (size, where) in ends:
        n += flat.count(" ", at, e)
        at = e
        if size < GRAM:
            whole |= {item: (item, 1.0, n - size, n - 1) for _, item, _ in where if item not in whole}
        else:
            hits.extend((n - GRAM, item, q, rare) for rare, item, q in where)
    found = [*whole.values(), *(x for x in passages(items, hits, flat) if x[1] >= share - 1e-9)]
    if not found:
        return []
    spans = [m.span() for m in _WORD.finditer(text)]
    last = len(spans) - 1
    return [(doc_id, item, float(s), spans[min(a, last)][0], spans[min(z, last)][1]) for item, s, a, z in found]

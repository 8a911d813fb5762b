"""Text functions on columns: names, relations, units, tokens, ids and formats.

All are built-in expressions, evaluated in the JVM. White space is Unicode's wherever a text is stripped or
collapsed; ``WS`` is spelt out so that other engines can use the same class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Punctuation that is trimmed from names and relations; of keywords all but the last three.
TRIM = r".,;:!?()\[\]{}'\"“”‘’*•\-"
TRIM_KEYWORD = r".,;:!?()\[\]{}'\"“”‘’"
# Phrases and words of table fragments that are no entity.
NOISE_PHRASES = ["accessed by ", "document currency", "standards australia www", "records result", "item action", "requirement records", "service records records"]
NOISE_WORDS = ["accessed", "currency", "printed", "comments", "pass/fail"]
DESCRIPTOR_WORDS = ["correct", "satisfactory", "fitted", "competent", "fully", "latch"]
BAD_FIRST_WORDS = ["item", "records", "requirement", "accessed", "this"]
# Form words of keywords.
KEYWORD_NOISE = [
    "action", "appendix", "australia", "check", "comments", "complete", "fail", "item", "pass", "records", "required", "result", "schedule", "section", "service", "standards", "system",
]
KEYWORD_FORM = ["action", "check", "comments", "complete", "fail", "pass", "required", "result"]
NOISE_LINE = r"(?i)^(?:item|no\.?|records?|result|pass/fail|comments?|accessed by|document currency)"
# Relation labels with their keys, and those that swap their ends.
RELATION_KEYS = {
    "is_a": ["is a", "is an", "is a type of", "is type of", "is-a-type-of", "type of", "kind of"],
    "part_of": ["part of", "is part of", "belongs to", "contained in"],
    "contains": ["contains", "includes", "has"],
    "depends_on": ["depends on", "dependent on", "relies on", "requires"],
    "uses": ["is used by", "used by", "uses", "utilizes", "employs"],
    "causes": ["causes", "leads to", "results in"],
    "mentions": ["mentions", "refers to", "discusses"],
    "associated_with": ["co-occurs with", "cooccurs with", "co occurs with", "associated with", "related to"],
}
SWAPPED = ["is used by", "used by"]
RELATION_LABELS = {
    "is_a": "is a", "part_of": "part of", "contains": "contains", "depends_on": "depends on", "uses": "uses", "causes": "causes", "mentions": "mentions", "associated_with": "co-occurs with",
}
HEADING = r"^(?:#{1,6}\s+|\d+(?:\.\d+)*[.)]?\s+|[A-Z][A-Z0-9][A-Z0-9 \-:]{4,})"
PALETTE_SIZE = 12


def _rx(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def ustrip(c: Column) -> Column:
    return _rx(c, f"^[{WS}]+|[{WS}]+$")


def collapse(c: Column) -> Column:
    return _rx(c, f"[{WS}]+", " ")


def cleanup(text: Column) -> Column:
    """A parsed text without spaces before line ends, without runs of blank lines, and stripped."""
    return ustrip(_rx(_rx(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def words(text: Column) -> Column:
    """The words of a text, split at white space."""
    return F.filter(F.split(text, f"[{WS}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def _trimmed(c: Column, chars: str) -> Column:
    return _rx(c, f"^[{chars}]+|[{chars}]+$")


def normalize_name(name: Column) -> Column:
    """Key of an entity: lower case, single spaces, no outer punctuation, no leading article."""
    c = _rx(F.coalesce(name, F.lit("")), "�", "-")
    c = _trimmed(collapse(F.lower(ustrip(c))), TRIM)
    return ustrip(_rx(c, f"^(the|a|an)[{WS}]+"))


def normalize_keyword(name: Column) -> Column:
    """Key of a keyword: as of a name, but articles and some marks stay."""
    return _trimmed(_rx(F.lower(ustrip(collapse(F.coalesce(name, F.lit(""))))), "�", "-"), TRIM_KEYWORD)


def normalize_relation(relation: Column) -> Column:
    return _trimmed(collapse(F.lower(ustrip(F.coalesce(relation, F.lit(""))))), TRIM)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with the value computed once, however often the function uses it, also where a filter is pushed down."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def usable_name(name: Column) -> Column:
    """Can a name teach a concept? False for fragments of tables and for names without a Latin letter."""
    return let(normalize_name(name), lambda n: let(words(n), lambda w: _usable(n, w)))


def _usable(n: Column, w: Column) -> Column:
    noisy = F.size(F.filter(w, lambda x: x.isin(NOISE_WORDS)))
    phrase = F.lit(False)
    for p in NOISE_PHRASES:
        phrase = phrase | F.contains(n, F.lit(p))
    bad = (
        (F.char_length(n) < 2)
        | phrase
        | (F.size(w) > 6)
        | ((F.size(w) >= 5) & F.arrays_overlap(w, F.array(*map(F.lit, DESCRIPTOR_WORDS))))
        | ((F.size(w) > 1) & F.get(w, F.lit(0)).isin(BAD_FIRST_WORDS))
        | ((F.size(w) >= 3) & (noisy >= 2))
    )
    return ~bad & n.rlike("[a-z]")


def keyword_accepted(phrase: Column) -> Column:
    """Is a phrase kept as a keyword? The form words count once however often they stand in it."""
    return let(normalize_keyword(phrase), lambda n: let(words(n), lambda w: _accepted(n, w) & usable_name(n)))


def _accepted(n: Column, w: Column) -> Column:
    listed = lambda values: F.size(F.array_intersect(w, F.array(*map(F.lit, values))))
    bad = (
        (F.char_length(n) < 3)
        | (F.size(w) > 6)
        | ((F.size(F.array_distinct(w)) == 1) & (listed(KEYWORD_NOISE) == 1))
        | (listed(KEYWORD_FORM) > 0)
        | ((listed(["schedule"]) > 0) & (listed(["service", "routine"]) == 0))
        | ((F.size(F.array_distinct(w)) >= 2) & (listed(KEYWORD_NOISE) >= 2))
        | n.rlike(r"(?U)^[0-9\W]+$")
    )
    return ~bad


def noise_line(fragment: Column) -> Column:
    return fragment.rlike(NOISE_LINE) & (word_count(fragment) <= 6)


def quoted(c: Column) -> Column:
    """A column's value as a literal within a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def in_text(name: Column, lower_text: Column) -> Column:
    """Does a lower-case text hold a name: a word between boundaries, a phrase anywhere?

    The substring test comes first; it is cheap and settles most pairs.
    """
    word = F.rlike(lower_text, F.concat(F.lit("(?<![a-z0-9])"), quoted(name), F.lit("(?![a-z0-9])")))
    return F.contains(lower_text, name) & (F.contains(name, F.lit(" ")) | word)


def count_in_text(name: Column, lower_text: Column) -> Column:
    """Occurrences of a name that don't overlap."""
    word = F.regexp_count(lower_text, F.concat(F.lit("(?<![a-z0-9])"), quoted(name), F.lit("(?![a-z0-9])")))
    phrase = ((F.char_length(lower_text) - F.char_length(F.replace(lower_text, name, F.lit("")))) / F.char_length(name)).cast("int")
    return F.when(F.contains(name, F.lit(" ")), phrase).otherwise(word)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, rf"\n[{WS}]*\n"), ustrip), lambda p: p != "")


def fragments(paragraph: Column) -> Column:
    """Link units of a paragraph: cut after end marks and at line ends."""
    return F.filter(F.transform(F.split(paragraph, rf"(?<=[.!?])[{WS}]+|\n+"), ustrip), lambda x: x != "")


def strict_sentences(text: Column) -> Column:
    """Sentences for chunks: cut after end marks where a capital, a digit or an opening mark follows."""
    return F.split(text, rf"(?<=[.!?])[{WS}]+(?=[A-Z0-9\"'(])")


def tail(text: Column, n: int) -> Column:
    """About the last ``n`` characters, from the next space on if it is near; empty for ``n`` = 0."""
    if n <= 0:
        return F.lit("")
    cut = F.right(text, F.lit(n))
    at = F.instr(cut, " ")
    return F.when(F.char_length(text) <= n, text).otherwise(ustrip(F.when((at > 1) & (at <= 20), cut.substr(at, F.char_length(cut))).otherwise(cut)))


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), F.lower)


def has_heading(text: Column) -> Column:
    """Does one of the first five lines look like a heading?"""
    return F.exists(F.slice(F.split(text, "\n"), 1, 5), lambda line: ustrip(line).rlike(HEADING))


def target_count(total: Column, mode: Column | str, fraction: float = 0.35, minimum: int = 12, maximum: int = 250) -> Column:
    """Chunks to select of ``total`` in a mode: all of a short document, else a bounded share."""
    mode = F.lit(mode) if isinstance(mode, str) else mode
    share = F.when(mode == "fast", F.lit(max(0.05, min(fraction, 0.2)))).otherwise(F.lit(max(0.05, fraction)))
    part = F.least(total, F.greatest(F.lit(1), F.least(F.lit(maximum), F.greatest(F.lit(minimum), F.ceil(total * share)))))
    return F.when(total == 0, F.lit(0)).when((mode == "full") | (total <= minimum), total).otherwise(part).cast("int")


def node_id(key: Column) -> Column:
    return F.concat(F.lit("n_"), F.substring(F.sha1(key), 1, 10))


def edge_id(source: Column, target: Column, relation: Column) -> Column:
    return F.concat(F.lit("e_"), F.substring(F.sha1(F.concat_ws("|", source, target, relation)), 1, 10))


def cache_key(model: Column, prompt: Column, chunk: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("v2"), model, F.substring(F.sha2(prompt, 256), 1, 16), chunk), 256)


def relation_key_map() -> Column:
    pairs = [x for key, labels in RELATION_KEYS.items() for label in labels for x in (F.lit(label), F.lit(key))]
    return F.create_map(*pairs)


def canonical_relation(relation: Column) -> Column:
    """Struct of relation, relation_key, original_relation, swap; null where the label has no letter or digit."""
    n = normalize_relation(relation)
    token = ustrip(collapse(F.translate(n, "_/", "  ")))
    key = relation_key_map()[token]
    labels = F.create_map(*[F.lit(x) for kv in RELATION_LABELS.items() for x in kv])
    own = _rx(_rx(token, "[^a-z0-9]+", "_"), "^_+|_+$")
    original = F.substring(ustrip(F.coalesce(relation, F.lit(""))), 1, 120)
    display = F.coalesce(labels[key], n)
    s = F.struct(
        display.alias("relation"), F.coalesce(key, own).alias("relation_key"), F.when(original == "", display).otherwise(original).alias("original_relation"), token.isin(SWAPPED).alias("swap")
    )
    return F.when(n.rlike("[a-z0-9]") & (F.coalesce(key, own) != ""), s)


def link_tag(tags: Column) -> Column:
    return F.when(F.size(tags) == 1, F.get(tags, F.lit(0))).otherwise(F.lit("both"))


def tag_list(tags: Column, tag: Column) -> Column:
    """Tags in the order first seen, ``both`` as its two parts, ``llm`` if there are none."""
    given = F.concat(F.coalesce(tags, F.array().cast("array<string>")), F.when(tag.isNotNull(), F.array(tag)).otherwise(F.array().cast("array<string>")))
    both = F.flatten(F.transform(given, lambda t: F.when(t == "both", F.array(F.lit("llm"), F.lit("cooccurrence"))).otherwise(F.array(t))))
    clean = F.array_distinct(F.filter(both, lambda t: t.isNotNull() & (t != "")))
    return F.when(F.size(clean) == 0, F.array(F.lit("llm"))).otherwise(clean)


def js_round(c: Column) -> Column:
    """Rounds a half up, as scripts in browsers do."""
    return F.floor(c + 0.5)


def format_duration(seconds: Column) -> Column:
    m, h = F.floor(seconds / 60), F.floor(seconds / 3600)
    rest = seconds - m * 60
    return (
        F.when(seconds.isNull() | F.isnan(seconds), F.lit("—"))
        .when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s")))
        .when(seconds < 3600, F.concat(m.cast("string"), F.lit("m "), js_round(rest).cast("string"), F.lit("s")))
        .otherwise(F.concat(h.cast("string"), F.lit("h "), F.lpad(js_round((seconds - h * 3600) / 60).cast("string"), 2, "0"), F.lit("m")))
    )


def format_size(size: Column) -> Column:
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / 1024.0), F.lit(" KB")))
        .otherwise(F.concat(F.format_string("%.1f", size / (1024.0 * 1024.0)), F.lit(" MB")))
    )


def node_radius(degree: Column, count: Column) -> Column:
    d, n = F.greatest(F.lit(0), F.coalesce(degree, F.lit(0))), F.greatest(F.lit(0), F.coalesce(count, F.lit(0)))
    return F.greatest(F.lit(4.0), F.least(F.lit(16.0), F.sqrt(d * 1.4 + F.log2(n + F.lit(1)) * 2 + 1) * 2.1))


def edge_signal(kind: Column, confidence: Column, weight: Column) -> Column:
    boost = F.when(kind == "assertion", 2.0).otherwise(1.0)
    return boost * (0.5 + F.coalesce(confidence, F.lit(0.0))) * F.log2(F.greatest(F.lit(1), F.coalesce(weight, F.lit(1))) + F.lit(1))


def community_color(community: Column, palette: int = PALETTE_SIZE) -> Column:
    """Place in a palette, for negative numbers too."""
    return F.pmod(community, F.lit(palette))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def safe_filename(name: Column) -> Column:
    """The stem of a file name in plain characters, ``document`` if none is left."""
    stem = _rx(_rx(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")
    clean = ustrip(_rx(stem, r"[^A-Za-z0-9._ -]+", "_"))
    return F.when(clean == "", F.lit("document")).otherwise(clean)

"""Spellings of one person or organisation (problem 2).

A form is parsed into a rare part, which is a surname or a place, and what qualifies it: the given name in its full
form or an initial; or the initials of the organisation's other words with its number, which are the same for the words
written out, shortened, misspelt or put as an acronym. Forms with equal parts are one entity. The rare parts and the
given names are then joined among themselves by segments: each is cut into ``k + 2``, of which ``k`` edits leave two
whole, shifted by ``k`` places at most; an inverted index of pairs of segments by length gives the candidates, with
transpositions across two segments undone by the probe, and a banded edit distance, which counts a transposition as
one, decides. Two entities are linked if their parts are equal or so near, unless both given names are listed ones; an
entity with an initial only is linked to the one full name of its surname that it can stand for. Groups are the
connected components of the links.

Defined cases: null and blank names are no forms; a form is of the kind that most of its typed rows have, and forms of
other kinds are left out; untyped forms count only where a group holds a typed one; numbers of bodies must be equal; an
initial that fits several full names is linked to none.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, form_key, map_rows

# Given names with the short forms in use, from common usage in several languages. Names without one are
# listed so that they are known as given names where the surname comes first.
NICKNAMES = """
alexander: alex sasha sandy xander alec aleks sascha; alexandra: sandra lexi; andré: andy; andrew: andy drew;
anthony: tony; antonio: toni; barbara: barb babs; béatrice: bea trixie; benjamin: ben benny; björn: ; camille: cami;
catherine: cathy cate; charles: charlie chuck; charlotte: lottie charlie lotte; christopher: chris kit;
daniel: dan danny; david: dave davy; deborah: deb debbie; dorothea: dora thea dorothy dot; edmund: ned ed eddie;
edward: ned ted ed eddie; eleanor: nell ellie nora; elizabeth: betty liz lizzie beth eliza betsy bess lisa;
émile: ; eugene: gene; florence: flo florrie; francisco: paco pancho curro kiko; frederick: fred freddy; friedrich: fritz;
françois: ; gerald: gerry; geoffrey: geoff; giuseppe: beppe peppe pino; gregory: greg; gudrun: ; helen: nell ; hélène: ;
henrietta: hattie etta hetty; henry: harry hal hank; ignacio: nacho; ingrid: inga; irene: ; isabella: bella izzy;
ivan: vanya; jacob: jake; james: jim jimmy; jennifer: jenny jen; johannes: hannes jan hans; john: jack johnny;
josé: pepe; joseph: joe; josephine: josie jo; joshua: josh; judith: judy; jürgen: ; katherine: kate kathy katie kat kitty;
kenneth: ken; lawrence: larry; leonard: len lenny; ludmila: luda mila; łucja: ; lucy: lu; margaret: peggy maggie meg greta madge daisy;
martin: marty; mary: molly polly mamie; matthew: matt; michael: mike mick; mikhail: misha; nathaniel: nat nate;
natalia: natasha nata; nicholas: nick nico klaus; noémie: ; oliver: ollie noll; ottilie: tilly otti; patricia: pat patty tricia;
patrick: paddy; paul: ; penelope: penny nell; peter: pete; philip: phil; quentin: ; rebecca: becky; richard: rick dick rich ricky;
robert: bob rob bobby bert; ronald: ron; rosalind: roz rosie; samuel: sam sammy; sarah: sally; sören: ; stephen: steve;
susanna: sue susie suzy; theodore: ted theo teddy; theresa: terry tess; thomas: tom tommy; timothy: tim; tobias: toby;
ursula: ulla uschi; valentín: ; victoria: vicky vic tori; vincent: vince vinnie; walter: walt wally; wilhelmina: mina minnie willa;
william: will bill billy willy liam; xaver: ; yvonne: ; zachary: zack zac; zoë:
"""
TITLES = set("mr mrs ms miss dr prof professor hon rev sir dame lord lady cllr col capt gen sen rep hr fr frau herr m mme mlle me sr sra don doña ing".split())
# Words of organisations' names with their short forms, and words that an acronym leaves out.
BODY_WORDS = set(
    """
    academy agency alliance assembly association assn authority auth bank board bd bureau centre center chamber charity club college
    commission committee company co co-op co-ops cooperative cooperatives corporation corp council department dept district dist
    division energy engineering federation fed firm fishing foundation fdn fund grain group guild harbour docks hospital inc
    incorporated institute inst land league library limited ltd merchants ministry munic municipal museum national natl office off
    party pub public reg regional river school society soc studies supply survey transport trust union univ university
    water works council archive plc gmbh ag llc
    """.split()
)
SKIPPED = set("of for the and & de la du des der die und del y et no".split())
EDITS = 2


def fold(s: str) -> str:
    s = s.replace("ł", "l").replace("ø", "o").replace("đ", "d").replace("ß", "ss").replace("æ", "ae").replace("œ", "oe").replace("ð", "d").replace("þ", "th")
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


class GivenNames:
    """Given names with their short forms; a short form may be one of several names."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        """``pairs`` of a name and a short form of it, which is "" for a name without one."""
        self.full = {fold(g) for g, _ in pairs}
        self.of: dict[str, set[str]] = {g: {g} for g in self.full}
        for g, s in pairs:
            if s and fold(s) not in self.full:
                self.of.setdefault(fold(s), set()).add(fold(g))

    def __contains__(self, token: str) -> bool:
        return token in self.of

    def names(self, token: str) -> list[str]:
        """Full given names that a folded token can stand for."""
        return sorted(self.of.get(token, {token}))


def _listed() -> list[tuple[str, str]]:
    parts = [p.partition(":") for p in NICKNAMES.replace("\n", " ").split(";")]
    return [(g.strip(), s) for g, _, short in parts for s in short.split() or [""] if g.strip()]


GIVEN = GivenNames(_listed())
#: Most rows of a table of given names, which goes to every task.
MOST_GIVEN = 100_000


def given_names(table: DataFrame | None) -> GivenNames:
    """The names of a table ``(given, short)``, the short form null or empty where there is none; the own list without one."""
    if table is None:
        return GIVEN
    rows = table.where("given is not null").select(F.lower("given"), F.lower(F.coalesce("short", F.lit("")))).distinct().limit(MOST_GIVEN + 1).collect()
    if len(rows) > MOST_GIVEN:
        raise ValueError(f"more than {MOST_GIVEN} given names")
    return GivenNames([(r[0], r[1]) for r in rows])


_INITIAL = re.compile(r"^[^\W\d_]\.?$")
_SPLIT = re.compile(r"[\s]+")


def parse_person(form: str, known: GivenNames = GIVEN) -> list[tuple[str, str, str]]:
    """(surname, given name, initial) readings of a form; the given name is "" where only an initial is known."""
    s = fold(form)
    comma = None
    if "," in s:
        left, _, right = s.partition(",")
        comma = (left.strip(), right.strip())
    words = [w for w in _SPLIT.split(s.replace(",", " ")) if w]
    while words and words[0].rstrip(".") in TITLES and len(words) > 1 and len(words[0].rstrip(".")) > 1:
        words.pop(0)
    words = [w for w in words if w.rstrip(".") not in ("jr", "sr")]
    if not words:
        return []
    if comma and comma[0] and comma[1]:
        surname = comma[0].replace(" ", "")
        rest = [w for w in _SPLIT.split(comma[1]) if w]
        return _with_given(surname, rest, known)
    names = [w for w in words if not _INITIAL.match(w)]
    if len(words) < 2 or not names:
        return []
    if _INITIAL.match(words[0]):
        return _with_given("".join(names), [words[0]], known)
    if len(words) == 2 and len(words[0]) == 2 and "." not in words[0] and words[0] not in known:
        return [(words[1], "", words[0][0])]  # both initials in one
    if _INITIAL.match(words[-1]) and len(names) == 1:
        return _with_given(names[0], [words[-1]], known)
    if len(names) == 1:
        return []
    if names[-1] in known and names[0] not in known:
        return _with_given("".join(names[:-1]), [names[-1]], known)
    return _with_given("".join(names[1:]), [names[0]], known)


def _with_given(surname: str, rest: list[str], known: GivenNames) -> list[tuple[str, str, str]]:
    if not rest or len(surname) < 2:
        return []
    if _INITIAL.match(rest[0]) or (len(rest[0]) == 2 and rest[0].endswith(".")):
        return [(surname, "", rest[0][0])]
    return [(surname, g, g[0]) for g in known.names(rest[0].strip("."))]


def _near_body(w: str) -> bool:
    w = w.strip(".,()")
    return w in BODY_WORDS or (len(w) >= 4 and any(abs(len(w) - len(b)) <= 2 and len(b) >= 4 and edit_distance(w, b, 2 if len(w) > 6 else 1) is not None for b in BODY_WORDS))


def parse_body(form: str, known: GivenNames = GIVEN) -> list[tuple[str, str]]:
    """(place, initials of the other words with the number) readings of an organisation's form."""
    s = re.sub(r"\([^)]*\)", " ", fold(form))
    number = re.findall(r"\d+", s)
    s = re.sub(r"\bno\.?\s*(?=\d)", " ", s)
    m = re.match(r"^((?:[a-z]\.){2,}|[a-z]{2,5}?)\s*(\d*)[\s-]+([^\s,.]{4,})$", s.strip())
    if m and not _near_body(m.group(1).rstrip(".")) and m.group(1) not in known and (m.group(2) or not re.search(r"[aeiou].*[aeiou]", m.group(1)) or "." in m.group(1)):
        head = m.group(1).replace(".", "")
        return [(m.group(3), f"{head}|{m.group(2)}")]
    comma = [p.strip() for p in s.split(",") if p.strip()]
    words = [w for w in re.split(r"[\s,]+", s) if w and not w.isdigit()]
    if len(words) < 2:
        return []
    place = None
    if len(comma) == 2:
        one = [p for p in comma if len([w for w in p.split() if not w.isdigit()]) == 1]
        if one:
            place = one[0].split()[0] if len(one) == 1 else comma[1]
    if place is None and " of " in s:
        tail = s.rsplit(" of ", 1)[1].strip()
        if len(tail.split()) == 1 and not _near_body(tail):
            place = tail
    if place is None:
        first, last = words[0], words[-1]
        place = first if _near_body(last) and not _near_body(first) else last
    rest = list(words)
    if place in rest:
        (rest.remove(place) if rest[0] == place else rest.pop(len(rest) - 1 - rest[::-1].index(place)))
    head = "".join(w[0] for w in rest if w not in SKIPPED and w.strip(".") and w[0].isalnum())
    if len(head) < 2:
        return []
    return [(place.strip(".,"), f"{head}|{''.join(number[:1])}")]


def edit_distance(a: str, b: str, k: int) -> int | None:
    """Edits from a to b with a transposition as one, within a band of ``k`` about the diagonal; None beyond ``k``."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return None
    if a == b:
        return 0
    far = k + 1
    before2: list[int] = []
    before = [j if j <= k else far for j in range(m + 1)]
    for i in range(1, n + 1):
        now = [far] * (m + 1)
        if i <= k:
            now[0] = i
        lo, hi = max(1, i - k), min(m, i + k)
        least = now[0] if lo == 1 else far
        for j in range(lo, hi + 1):
            x = before[j - 1] + (a[i - 1] != b[j - 1])
            if before[j] + 1 < x:
                x = before[j] + 1
            if now[j - 1] + 1 < x:
                x = now[j - 1] + 1
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1] and before2[j - 2] + 1 < x:
                x = before2[j - 2] + 1
            now[j] = x if x <= k else far
            if now[j] < least:
                least = now[j]
        if least > k:
            return None
        before2, before = before, now
    return before[m] if before[m] <= k else None


def allowed(n: int, k: int = EDITS) -> int:
    """Edits allowed for a string of a length: none up to 2 characters, one up to 6."""
    return 0 if n <= 2 else min(1, k) if n <= 6 else k


WHOLE = 2  # segments of a key; with 3 a string has eight times as many probes for two thirds of the candidates


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the ``k + WHOLE`` segments of a string, of lengths that differ by one at most."""
    parts = k + WHOLE
    size, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - more)
        out.append((at, n))
        at += n
    return out


@lru_cache(maxsize=None)
def _shifts(k: int, more: int) -> list[tuple[int, ...]]:
    """Shifts of ``WHOLE`` segments, in order, in a string longer by ``more`` that ``k`` edits at most make."""
    every = product(range(-k, k + 1), repeat=WHOLE)
    return [x for x in every if sum(abs(q - p) for p, q in zip((0, *x), (*x, more))) <= k]


@lru_cache(maxsize=None)
def _index_plan(length: int, k: int) -> tuple:
    """What the keys of an indexed string of a length are made of: (key prefix, slices)."""
    seg = segments(length, k)
    chosen = combinations(range(len(seg)), WHOLE)
    return tuple((f"{length}|{''.join(map(str, c))}", tuple(slice(seg[i][0], sum(seg[i])) for i in c)) for c in chosen)


@lru_cache(maxsize=None)
def _probe_plan(n: int, most: int) -> tuple:
    """Where a string of ``n`` characters looks for shorter or equal ones: (place of an exchange or -1, key prefix, slices)."""
    out = []
    for length in range(max(3, n - most), n + 1):
        k, more = allowed(length, most), n - length
        if not k or more > k:
            continue
        seg = segments(length, k)
        every = list(combinations(range(len(seg)), WHOLE))

        def look(swap, chosen, edits):
            for c, x in product(chosen, _shifts(edits, more)):
                places = [(seg[i][0] + y, seg[i][0] + y + seg[i][1]) for i, y in zip(c, x)]
                if places[0][0] >= 0 and places[-1][1] <= n and all(p[1] <= q[0] for p, q in zip(places, places[1:])):
                    out.append((swap, f"{length}|{''.join(map(str, c))}", tuple(slice(*p) for p in places)))

        look(-1, every, k)
        # A transposition where two segments meet breaks both: it is undone, which leaves k - 1 edits.
        for b in {start for start, _ in seg[1:]}:
            for at in range(b - 1 - (k - 1), b + k - 1):
                if 0 <= at < n - 1:
                    look(at, every if k > 1 else every[:1], k - 1)
    return tuple(out)


def segment_keys(s: str, k: int = EDITS) -> list[str]:
    """Keys under which the index holds a string."""
    return [p + "".join(f"|{s[x]}" for x in places) for p, places in _index_plan(len(s), allowed(len(s), k))]


def probe_keys(s: str, k: int = EDITS) -> set[str]:
    """Keys under which the strings that are as long or shorter and within the allowed edits are looked up."""
    out, t, at = set(), s, -1
    for swap, p, places in _probe_plan(len(s), k):
        if swap != at:
            at, t = swap, s if swap < 0 else s[:swap] + s[swap + 1] + s[swap] + s[swap + 2 :]
        if swap < 0 or t != s:
            out.add(p + "".join(f"|{t[x]}" for x in places))
    return out


def segment_join(strings: DataFrame, column: str = "s", k: int = EDITS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct strings of a column within ``allowed`` edits of the shorter one.

    Of ``k + WHOLE`` segments ``k`` edits leave ``WHOLE`` as they are, so an inverted index of sets of so many segments
    holds every partner; together they are rarely shared by chance, which one of two or three characters often is. The
    longer string looks up its substrings at all places to which edits can have shifted them. Keys are of distinct
    strings, so a name that many rows bear is no hot key; keys that many strings share are split by the engine's skew join.
    """
    base = strings.select(F.col(column).alias("s")).where(F.char_length("s") > 2).distinct()
    index = lambda s: [(x, s) for x in segment_keys(s, k)]
    probe = lambda s: [(x, s) for x in probe_keys(s, k)]
    left = map_rows(base, index, "key string, a string", ["key", "a"])
    right = map_rows(base, probe, "key string, b string", ["key", "b"])
    pairs = left.hint("merge").join(right, "key").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(a, b):
        return [(a, b)] if edit_distance(a, b, allowed(min(len(a), len(b)), k)) is not None else []

    return map_rows(pairs, verify, "a string, b string", ["a", "b"])


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges(a, b)`` and ``nodes(node)`` as ``(node, label)``, the label the least node that is connected.

    Labels fall to the least of the neighbours' and then to the label of the label, until none changes; each round is
    written to the checkpoint folder.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = nodes.select("node", F.col("node").alias("label")).distinct()
    while True:
        least = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(least, labels.node == least.a, "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        up = step.select(F.col("node").alias("n2"), F.col("new").alias("jump"))
        step = step.join(up, step.new == up.n2, "left").select("node", "label", F.least("new", F.coalesce("jump", "new")).alias("new"))
        step = checkpointed(step)
        labels = step.select("node", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return labels


def spark_list(df: DataFrame, names: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(n,) for n in names], "name string")


def name_forms(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """Distinct forms of ``nodes(name, type)`` and ``keywords(name)`` as ``(form, kind)``: person, organization, other or null."""
    n = nodes.select(form_key(F.col("name")).alias("form"), "type")
    k = keywords.select(form_key(F.col("name")).alias("form"), F.lit(None).cast("string").alias("type"))
    per = n.unionByName(k).where("form <> ''").groupBy("form", "type").agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("type").isin("person", "organization"), F.col("type")).when(F.col("type").isNotNull(), "other")
    best = per.withColumn("kind", kind).groupBy("form").agg(F.max(F.when(F.col("kind").isNotNull(), F.struct("n", "kind"))).alias("x"))
    return best.select("form", F.col("x.kind").alias("kind"))


def name_groups(nodes: DataFrame, keywords: DataFrame, k: int = EDITS, nicknames: DataFrame | None = None) -> DataFrame:
    """Forms with the group that they belong to: (form, kind, group_id); forms that stand alone are groups of one.

    ``nicknames(given, short)`` replaces the own list of given names.
    """
    known = given_names(nicknames)
    forms = name_forms(nodes, keywords).where("kind is null or kind <> 'other'")

    def parts(form, kind):
        out = []
        if kind != "organization":
            out += [(form, kind, "p", r, g, i) for r, g, i in parse_person(form, known)]
        if kind == "organization" or (kind is None and any(_near_body(w) for w in re.split(r"[\s,]+", form))):
            out += [(form, kind, "o", r, g, "") for r, g in parse_body(form, known)]
        return out

    names = ["form", "kind", "sort", "rare", "given", "initial"]
    parsed = checkpointed(map_rows(forms, parts, ", ".join(f"{n} string" for n in names), names))
    key = lambda c: F.concat_ws("\x1f", *(F.col(x) for x in c))
    parsed = parsed.withColumn("entity", key(["sort", "rare", "given", "initial"]))
    full = parsed.where("given <> ''").select("entity", "sort", "rare", "given").distinct()
    same = lambda df, c: df.select(F.col(c).alias("a"), F.col(c).alias("b")).distinct()
    near = segment_join(parsed, "rare", k)
    rare = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same(parsed, "rare"))
    rare = checkpointed(rare)
    # Two listed given names are names of their own, however near; any other spelling is one of what it is near to.
    listed = spark_list(parsed, sorted(known.full))
    g = segment_join(full.where("sort = 'p'"), "given", k)
    g = g.join(listed.withColumnRenamed("name", "a").withColumn("la", F.lit(1)), "a", "left").join(listed.withColumnRenamed("name", "b").withColumn("lb", F.lit(1)), "b", "left").where("la is null or lb is null").select("a", "b")
    given = g.unionByName(g.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(same(full, "given"))
    x = full.join(rare.withColumnRenamed("a", "rare").withColumnRenamed("b", "rare2"), "rare").join(given.withColumnRenamed("a", "given").withColumnRenamed("b", "given2"), "given")
    y = full.select(F.col("sort"), F.col("rare").alias("rare2"), F.col("given").alias("given2"), F.col("entity").alias("entity2"))
    links = x.join(y, ["sort", "rare2", "given2"]).where("entity < entity2").select(F.col("entity").alias("a"), F.col("entity2").alias("b"))
    # Readings of one form (a short name of two given names) link nothing by themselves: the ones that stand alone fall out below.
    full_groups = components(links, full.select(F.col("entity").alias("node")))
    # Initials: the one group of full names, over the surname and its near spellings, that begins with the letter.
    short = parsed.where("sort = 'p' and given = ''").select("entity", "rare", "initial").distinct()
    heads = full.where("sort = 'p'").join(full_groups, full.entity == full_groups.node).select(F.col("rare").alias("rare2"), F.substring("given", 1, 1).alias("initial"), "label").distinct()
    fits = short.join(rare.withColumnRenamed("a", "rare").withColumnRenamed("b", "rare2"), "rare").join(heads, ["rare2", "initial"])
    exact = fits.where("rare = rare2").groupBy("entity").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label"))
    loose = fits.groupBy("entity").agg(F.count_distinct("label").alias("n2"), F.min("label").alias("label2"))
    one = loose.join(exact, "entity", "left").select("entity", F.when(F.col("n") == 1, F.col("label")).when(F.col("n").isNull() & (F.col("n2") == 1), F.col("label2")).alias("label")).where("label is not null")
    # Initials that fit no full name are linked among themselves, by equal surname and letter.
    groups = full_groups.unionByName(one.select(F.col("entity").alias("node"), "label")).unionByName(short.join(one, "entity", "left_anti").select(F.col("entity").alias("node"), F.col("entity").alias("label")))
    member = parsed.join(groups, parsed.entity == groups.node).select("form", "kind", F.col("label").alias("group_id"))
    # Of several readings of a form, the one with the largest group holds.
    size = member.groupBy("group_id").agg(F.count_distinct("form").alias("n"))
    best = member.join(size, "group_id").groupBy("form").agg(F.max("kind").alias("kind"), F.max(F.struct("n", "group_id")).alias("x"))
    out = best.select("form", "kind", F.col("x.group_id").alias("group_id"))
    typed = out.where("kind is not null").select("group_id").distinct()
    return out.join(typed, "group_id", "left_semi").select("form", "kind", "group_id")


def variant_pairs(nodes: DataFrame, keywords: DataFrame, k: int = EDITS, nicknames: DataFrame | None = None) -> DataFrame:
    """Pairs of forms of one group, (name_a, name_b) with name_a < name_b."""
    g = checkpointed(name_groups(nodes, keywords, k, nicknames))
    a = g.select("group_id", F.col("form").alias("name_a"))
    b = g.select("group_id", F.col("form").alias("name_b"))
    return a.join(b, "group_id").where("name_a < name_b").select("name_a", "name_b").distinct()



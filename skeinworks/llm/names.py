"""Variant spellings of names typed by people, linked by a pigeonhole segment join.

A name is read into a key: its rare words (the head), its common words (kind of
organisation, place or event, given name), a year and a generational suffix. Common
words are found by counting, and abbreviations, nicknames, titles, order, spacing,
accents, damaged characters and misspelt common words are undone on the way. Keys
whose heads differ by one edit are found by cutting each head into three segments, of
which one is intact and at most one place off; an inverted index on the segments
gives candidates and a banded edit distance verifies them. Shorter forms (initials,
acronyms, heads alone, blends, cut-off names) are then joined to the one entity whose
own key yields the same form. Links are closed into groups by the component operator.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Stage, pick
from . import components
from .survivors import STAND_INS

# Words that carry no identity.
TITLES = frozenset("dr prof professor sen senator coach dame sir mr mrs ms miss lord lady rep gov governor capt captain judge hon rev president minister justice gen col sgt".split())
LEGAL = frozenset("incorporated inc corporation corp company co limited ltd llc plc gmbh ag sa".split())
FILLERS = frozenset("the of and a an for".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv", "2nd": "ii", "3rd": "iii"}

# Abbreviations of common words.
ABBREVIATIONS = {
    "svcs": "services", "svc": "services", "sys": "systems", "labs": "laboratories", "lab": "laboratories", "grp": "group", "dept": "department", "mfg": "manufacturing",
    "smt": "summit", "cncl": "council", "isl": "island", "is": "island", "cnty": "county", "cnsl": "console", "ctr": "center", "mt": "mount", "mtn": "mount", "mountain": "mount", "st": "saint", "pt": "port", "univ": "university", "assoc": "association",
    "assn": "association", "hldgs": "holdings", "hldg": "holdings", "intl": "international", "int": "international", "tech": "technologies", "pharma": "pharmaceuticals",
    "fin": "financial", "elec": "electric", "mar": "maritime", "ath": "athletic", "log": "logistics", "ptnrs": "partners", "ptrs": "partners", "cty": "county", "co": "company",
    "bcast": "broadcasting", "brdcst": "broadcasting", "brd": "broadcasting", "fds": "foods", "nrg": "energy", "enrg": "energy", "enrgy": "energy", "tourn": "tournament", "champ": "championship",
}
# Generic words, common in any corpus of names.
GENERIC = frozenset(ABBREVIATIONS.values()) | frozenset("port mount saint north south east west bay island county city lake river cup summit console council university association".split())

# Nicknames.
NICKNAMES = {
    "abby": "abigail", "gail": "abigail", "alex": "alexander", "sasha": "alexander", "xander": "alexander", "al": "alexander", "ben": "benjamin", "benny": "benjamin", "benji": "benjamin",
    "lottie": "charlotte", "charlie": "charlotte", "charley": "charlotte", "dom": "dominic", "nick": "nicholas", "nico": "nicholas", "nicky": "nicholas", "nell": "eleanor", "ellie": "eleanor",
    "nora": "eleanor", "liz": "elizabeth", "beth": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "betsy": "elizabeth", "fred": "frederick", "fritz": "frederick", "rick": "frederick", "freddie": "frederick",
    "freddy": "frederick", "georgie": "georgina", "gina": "georgina", "greg": "gregory", "hattie": "harriet", "harry": "harriet", "bella": "isabella", "izzy": "isabella", "belle": "isabella",
    "jon": "jonathan", "jonny": "jonathan", "nathan": "jonathan", "josie": "josephine", "jo": "josephine", "kate": "katherine", "katie": "katherine", "kathy": "katherine", "kitty": "katherine",
    "kat": "katherine", "larry": "lawrence", "laurie": "lawrence", "len": "leonard", "lenny": "leonard", "leo": "leonard", "maggie": "margaret", "meg": "margaret", "peggy": "margaret",
    "peg": "margaret", "marge": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael", "mikey": "michael", "lina": "ottoline", "otti": "ottoline", "ottie": "ottoline",
    "pat": "patricia", "trish": "patricia", "patty": "patricia", "tricia": "patricia", "becky": "rebecca", "becca": "rebecca", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert",
    "robbie": "robert", "sue": "susannah", "susie": "susannah", "sukie": "susannah", "suzie": "susannah", "ted": "theodore", "theo": "theodore", "teddy": "theodore", "vicky": "victoria",
    "tori": "victoria", "vic": "victoria", "vin": "vincent", "vince": "vincent", "vinny": "vincent", "will": "william", "bill": "william", "billy": "william", "liam": "william", "zach": "zachary",
    "zack": "zachary", "zac": "zachary", "tony": "anthony", "andy": "andrew", "dan": "daniel", "danny": "daniel", "dave": "david", "ed": "edward", "jim": "james", "jimmy": "james", "joe": "joseph",
    "ken": "kenneth", "matt": "matthew", "steve": "stephen", "tom": "thomas", "tim": "timothy", "sam": "samuel", "chris": "christopher", "dick": "richard", "jen": "jennifer",
    "jenny": "jennifer", "sandy": "sandra", "cathy": "catherine", "debbie": "deborah", "barb": "barbara",
}

# Type labels by family.
FAMILIES = {
    "person": "person people human individual per", "org": "organization organisation org company corporation institution agency business",
    "place": "location geo gpe place loc city country region", "event": "event competition occasion tournament", "product": "product artifact device software",
}
_FAMILY = {w: k for k, v in FAMILIES.items() for w in v.split()}

DAMAGE = re.compile("(?:�)+|\\?\\?+|\\\\u00|&#\\d+;?|Ã¢â‚¬|â‚¬|Ã.|[\x00-\x08\x0e-\x1f]")
_CUT = re.compile(r"\s*(?:…|\.\.\.|-)$")
_PAREN = re.compile(r"\s*\(([^()]*)\)\s*")
_CAMEL = re.compile(r"(?<=\p{Ll}\p{Ll})(?=\p{Lu}\p{Ll})")
_TOKEN = re.compile("[^\\W_\x01]*(?:\x01[^\\W_\x01]*)*\\.?")
_YEAR = re.compile("(?=.*[0-9].*[0-9])[12\x01][0-9\x01]{3}")
_SHORT_YEAR = re.compile(r"\s['’](\d\d)\b")
_STAND_IN = frozenset(STAND_INS["original_name"].split("|"))
HOLE = "\x01"


def fold(name: str) -> str:
    """Lower case without accents, damage as one hole, single spaces; for words and for prefixes."""
    name = DAMAGE.sub(HOLE, name)
    name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return name


def is_stand_in(name: str) -> bool:
    core = re.sub(r"^[\W_]+|[\W_]+$", "", name).lower()
    return not core or core in _STAND_IN or bool(re.fullmatch(r"(?:entity|person|organi[sz]ation|location|event|product|name) ?\d+", core))


def words(name: str) -> list[str]:
    """Words of a name in order, lower-cased; a full stop that ends a word is kept."""
    name = _PAREN.sub(" ", name) if not _PAREN.fullmatch(name) else name
    name = _CAMEL.sub(" ", _SHORT_YEAR.sub(r" 20\1", fold(name))).replace("'", "").replace("’", "")
    return [t.lower() for t in _TOKEN.findall(name) if t.strip(".")]


def osa1(a: str, b: str) -> bool:
    """Whether two strings are equal up to one insertion, deletion, substitution or swap of neighbours."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (i + 1 < len(a) and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])


class Reader:
    """Reads names into keys, given the common words of the corpus."""

    def __init__(self, common: Iterable[str]):
        self.common = frozenset(w for w in common if len(w) >= 3) | GENERIC | frozenset(NICKNAMES.values())
        self.seen = frozenset(common)
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(self.common):
            self.by_length.setdefault(len(w), []).append(w)
        self.memo: dict[str, str] = {}

    def word(self, t: str) -> str:
        """Common word meant by a word, or the word itself."""
        if t in self.memo:
            return self.memo[t]
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[t] = out = self._word(t)
        return out

    def _word(self, t: str) -> str:
        dotted, t = t.endswith("."), t.rstrip(".")
        # a short form means its word however often it occurs itself
        if t in NICKNAMES and NICKNAMES[t] in self.common:
            return NICKNAMES[t]
        if t in self.common or t in LEGAL or t in FILLERS or t in TITLES or t in GENERATIONS:
            return ABBREVIATIONS.get(t, t) if t not in LEGAL else t
        if t in ABBREVIATIONS:
            return ABBREVIATIONS[t]
        if dotted and len(t) >= 2:
            full = [w for w in self.seen if w.startswith(t)] or [w for w in self.common if w.startswith(t)]
            if len(full) == 1:
                return full[0]
        if len(t) >= 4 or HOLE in t and len(t) == 3:
            near = {ABBREVIATIONS.get(w, w) for n in (len(t) - 1, len(t), len(t) + 1) if n >= min(4, len(t)) for w in self.by_length.get(n, ()) if osa1(t, w)}
            if len(near) == 1:
                return near.pop()
        return t

    def read(self, name: str) -> dict | None:
        """Key and forms of a name; None for stand-ins."""
        if is_stand_in(DAMAGE.sub("x", name)):
            return None
        stripped = name.strip()
        cut = _CUT.search(stripped)
        body = stripped[: cut.start()] if cut else stripped
        raw = words(body)
        if len(raw) == 1 and re.fullmatch(r"[A-Z]{2,6}", body):
            return {k: "" for k in ("year", "gen", "initial", "first", "legal", "prefix", "initials")} | {"kind": "acronym", "head": raw[0], "mods": [], "order": []}
        split = []
        for t in raw:
            # a hole may stand for the space between two words
            if HOLE in t.strip(HOLE) and self.word(t) not in self.common:
                parts = [p for p in t.split(HOLE) if p]
                if len(parts) == 2 and min(map(len, parts)) >= 3 and any(p in self.common and p not in FILLERS for p in parts):
                    split += parts
                    continue
            split.append(t)
        if len(split) == 1 and not split[0].endswith("."):
            t = split[0]
            for w in ("bay", "island", "county", "cup", "summit", "console"):
                if t.endswith(w) and len(t) - len(w) >= 6 and t not in self.common:
                    split = [t[: -len(w)], w]
            for w in ("port", "mount", "north", "saint"):
                if t.startswith(w) and len(t) - len(w) >= 6 and t not in self.common:
                    split = [w, t[len(w) :]]
        head, mods, year, gen, initials, legal = [], [], "", "", [], ""
        for i, t in enumerate(split):
            bare = t.rstrip(".")
            if _YEAR.fullmatch(bare):
                year = bare
            elif bare in GENERATIONS and i > 0:
                gen = GENERATIONS[bare]
            elif bare in FILLERS or (bare in TITLES and len(split) > 1):
                continue
            elif bare in LEGAL and i > 0:
                legal = bare[0]
            elif len(bare) == 1 and bare != HOLE:
                initials.append(bare)
            elif len(bare) == 2 and i == 0 and len(split) > 1 and re.match(r"\p{Lu}\p{Lu} \p{Lu}\p{Ll}", name.strip()):
                initials.append(bare[0])
            else:
                w = self.word(t)
                if w in LEGAL and i > 0:
                    legal = w[0]
                elif w in self.common:
                    mods.append(w)
                elif bare.strip(HOLE):
                    head.append(bare)
        if not head:
            # a name of common words only is its own head
            head, mods = mods, []
        if not head:
            return None
        initial = initials[0] if initials and not mods else ""
        if initials and mods and mods[0] in ("county",) and initials[0] in "nsew":
            mods = [{"n": "north", "s": "south", "e": "east", "w": "west"}[initials[0]], *mods]
        prefix = " ".join(re.sub(r"[\s-]+", " ", fold(body)).lower().split())
        return {
            "kind": "cut" if cut else "initial" if initial else "full",
            "head": "".join(sorted(head)), "mods": sorted(set(mods)), "order": mods, "year": year, "gen": gen, "initial": initial,
            "first": sorted(head)[0] if len(head) > 1 else "", "legal": legal, "prefix": prefix,
            "initials": "".join(t[0] for t in split if t.rstrip(".") not in FILLERS and not (t.rstrip(".") in LEGAL)) if len(split) > 1 else "",
        }


READ = "name string, kind string, head string, sig string, prefix string, forms array<struct<sig:string,head:string>>, shorts array<struct<sig:string,head:string>>"

# Segments of a head of n characters start at 0, n div 3 and halfway through the rest. A probe finds every head of its own
# length, or one shorter, within one edit: one edit leaves a segment intact and moves it by no more than one place.
_SPLIT = "named_struct('m', {m}, 'a', {m} div 3, 'b', {m} div 3 + ({m} - {m} div 3) div 2)"
SEGMENTS = "array(named_struct('l', x.m, 'i', 0, 's', substring(head, 1, x.a)), named_struct('l', x.m, 'i', 1, 's', substring(head, x.a + 1, x.b - x.a)), named_struct('l', x.m, 'i', 2, 's', substring(head, x.b + 1)))"
SHORTER = (
    "array(named_struct('l', y.m, 'i', 0, 's', substring(head, 1, y.a)), named_struct('l', y.m, 'i', 1, 's', substring(head, y.a + 1, y.b - y.a)), "
    "named_struct('l', y.m, 'i', 1, 's', substring(head, y.a + 2, y.b - y.a)), named_struct('l', y.m, 'i', 2, 's', substring(head, y.b + 2)))"
)


def forms_of(r: dict) -> list[tuple[str, str]]:
    """Shorter forms under which an entity with this key may also appear, as (signature, head)."""
    head, mods, order, gen = r["head"], r["mods"], r["order"], r["gen"]
    if r["kind"] != "full" or not order or HOLE in r["year"]:
        return []
    out = [(f"head|{gen}", head)]
    if r["year"]:
        # a year with one damaged digit means this edition, one with more damage any edition
        out.append((f"edition|{' '.join(mods)}|", head))
        out += [(f"edition|{' '.join(mods)}|{r['year'][:i]}{HOLE}{r['year'][i + 1:]}", head) for i in range(4)]
    if len(order) == 1 and not r["year"]:
        out.append((f"initial|{order[0][0]}|{gen}", head))
    if len(r["initials"]) >= 2:
        out.append(("acronym", r["initials"]))
        if r["legal"]:
            out.append(("acronym", r["initials"] + r["legal"]))
    if len(order) >= 2:
        out += [(f"part|{m}|{r['year']}|{gen}", head) for m in mods]
        for c in (2, 3):
            if len(head) - c >= 4:
                rest = " ".join(sorted(set(order[1:])))
                out += [(f"blend|{rest}", head[:-c] + order[0][:3]), ("blend|", head[:-c] + order[0][:3])]
    if r["first"]:
        out.append((f"part|{' '.join(mods)}|{r['year']}|{gen}", r["first"]))
    return list(dict.fromkeys(out))


def short_forms(r: dict) -> list[tuple[str, str]]:
    """What a name must be found under if it is itself a shorter form."""
    mods, head = " ".join(r["mods"]), r["head"]
    if r["kind"] == "acronym":
        return [("acronym", head)]
    if r["kind"] == "initial":
        return [(f"initial|{r['initial']}|{r['gen']}", head)]
    if r["kind"] == "cut":
        return []
    if HOLE in r["year"]:
        return [(f"edition|{mods}|{r['year'] if r['year'].count(HOLE) == 1 else ''}", head)]
    return [(f"blend|{mods}", head), (f"part|{mods}|{r['year']}|{r['gen']}", head) if mods else (f"head|{r['gen']}", head)]


def distinct_names(mentions: DataFrame) -> DataFrame:
    """``(name, family)``: every original name and the family most of its type labels are of, or null."""
    m = pick(mentions, name="original_name", label="entity_type").where("name is not null")
    family = F.create_map(*[F.lit(x) for kv in sorted(_FAMILY.items()) for x in kv])[F.lower(F.trim("label"))]
    per = m.groupBy("name", family.alias("family")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max(F.when(F.col("family").isNotNull(), F.struct("n", "family")))
    return per.groupBy("name").agg(best.alias("b")).select("name", F.col("b.family").alias("family"))


def name_words(names: DataFrame) -> DataFrame:
    """``(t)``: the distinct whole words of each name as the reader sees them; damaged, abbreviated and marked cut words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                t = words(name)
                t = t[:-1] if _CUT.search(name.strip()) else t
                rows.append(list(dict.fromkeys(w for w in t if len(w) >= 3 and w.isalpha())))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.string()))], names=["t"])

    return names.select("name").where("name is not null").mapInArrow(run, "t array<string>")


def common_words(names: DataFrame, partners: int = 12, share: int = 2_000, ratio: int = 8) -> list[str]:
    """Words that stand beside many different words, unlike the rare word of one entity.

    The partner of a word is the longest other word of the name, told apart by three
    letters; a word counts as common with ``partners`` of them and in one of ``share``
    names, so that the vocabulary stays as large as a name is long times ``share`` and
    what is common does not depend on the size of the input. Nicknames, and words that
    begin, end or misspell by one edit a word of ``ratio`` times as many names, are forms
    of that word.
    """
    t = name_words(names)
    total = t.count()
    each = t.where("size(t) > 1").selectExpr("explode(transform(t, w -> struct(w as w, array_max(transform(filter(t, x -> x <> w), x -> struct(length(x) as n, x as x))).x as p))) as e")
    counts = each.selectExpr("e.w as w", "substring(e.p, 1, 3) as p").groupBy("w").agg(F.countDistinct("p").alias("k"), F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counts.where((F.col("k") >= partners) & (F.col("n") * share >= total)).collect()}
    return sorted(w for w in found if w not in NICKNAMES and not _is_form(w, found, ratio))


def _is_form(w: str, found: dict[str, int], ratio: int) -> bool:
    return any(n >= ratio * found[w] and (x.startswith(w) or x.endswith(w) or osa1(w, x)) for x, n in found.items())


def read_names(names: DataFrame, common: list[str]) -> DataFrame:
    words_ = names.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(words_.value)
        form = pa.list_(pa.struct([("sig", pa.string()), ("head", pa.string())]))
        for b in batches:
            rows = []
            for name in b.column(0).to_pylist():
                r = reader.read(name)
                if r is not None:
                    sig = f"{' '.join(r['mods'])}|{r['year']}|{r['gen']}" if r["kind"] == "full" else None
                    forms, shorts = ([{"sig": x, "head": h} for x, h in f(r)] for f in (forms_of, short_forms))
                    rows.append((name, r["kind"], r["head"], sig, r["prefix"], forms, shorts))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string()] * 5 + [form, form])], names=["name", "kind", "head", "sig", "prefix", "forms", "shorts"])

    return names.select("name").mapInArrow(run, READ)


def segment_join(keys: DataFrame) -> DataFrame:
    """Pairs of heads of one signature within one edit, ``(sig, a, b)``, from distinct ``(sig, head)``."""
    n = "length(head)"
    k = keys.where("head is not null").select("sig", "head", F.expr(_SPLIT.format(m=n)).alias("x"), F.expr(_SPLIT.format(m=f"({n} - 1)")).alias("y"))
    index = k.select("sig", F.col("head").alias("a"), F.explode(F.expr(SEGMENTS)).alias("z")).select("sig", "a", "z.*")
    probe = k.select("sig", F.col("head").alias("b"), F.explode(F.expr(f"array_distinct(concat({SEGMENTS}, {SHORTER}))")).alias("z")).select("sig", "b", "z.*")
    pairs = index.join(probe, ["sig", "l", "i", "s"]).where("a <> b").select("sig", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = F.levenshtein("a", "b", 2)
    swap = (near == 2) & (F.length("a") == F.length("b")) & (F.array_sort(F.split("a", "")) == F.array_sort(F.split("b", "")))
    return pairs.where((near == 1) | swap)


def _unique(targets: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    return targets.groupBy(*by).agg(F.min(label).alias("target"), F.max(label).alias("_m")).where("target = _m").drop("_m")


def entity_names(mentions: DataFrame, stage: Stage | None = None) -> DataFrame:
    """``(name, label)``: names that were read and the entity each belongs to.

    Null, blank and stand-in names have no row. Forms that more than one entity yields
    are left on their own, as are names cut off where several entities still fit.
    """
    spark = mentions.sparkSession
    stage = stage or Stage(spark, "names")
    names = stage.write(distinct_names(mentions), "names")
    read = stage.write(read_names(names, common_words(names)).join(names, "name"), "read")
    full = read.where("sig is not null").withColumn("key", F.concat_ws("|", "sig", "head"))
    keys = stage.write(full.select("key", "sig", "head").distinct(), "keys")
    ids = stage.write(components.dense_ids(keys.select("key")), "ids")
    links = segment_join(keys).select(F.concat_ws("|", "sig", "a").alias("ka"), F.concat_ws("|", "sig", "b").alias("kb"))
    edges = links.join(ids.selectExpr("key as ka", "vid as u"), "ka").join(ids.selectExpr("key as kb", "vid as v"), "kb").select("u", "v")
    groups = components.components(edges, rounds=3, stage=stage)  # variants lie within a hop or two
    labelled = ids.join(groups, "vid", "left").select("key", F.coalesce("label", "vid").alias("label"))
    own = stage.write(read.withColumn("key", F.concat_ws("|", "sig", "head")).join(labelled, "key", "left").drop("key", "sig", "head"), "own")

    def attach(named: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
        """Moves entities whose names are shorter forms to the one entity that yields the form."""
        wanted = F.substring_index("sig", "|", 1).isin(*kinds)
        targets = stage.write(named.where("label is not null").select("label", "family", F.explode("forms").alias("f")).select("label", "family", "f.*").where(wanted).distinct(), "targets")
        shorts = stage.write(named.select("name", "label", "family", F.explode("shorts").alias("f")).select("name", "label", "family", "f.*").where(wanted), "shorts")
        # an exact form counts first, a misspelt one where there is none
        known = targets.select("sig", "head").distinct()
        exact = shorts.join(known, ["sig", "head"], "left_semi").withColumn("as", F.col("head"))
        others = shorts.join(known, ["sig", "head"], "left_anti").where("sig <> 'acronym'")
        near = segment_join(stage.write(known.unionByName(others.select("sig", "head")).distinct(), "heads"))
        near = near.selectExpr("sig", "inline(array(struct(a as head, b as `as`), struct(b as head, a as `as`)))")
        asked = stage.write(exact.unionByName(others.join(near, ["sig", "head"])), "asked")
        t = targets.withColumnRenamed("head", "as")
        found = asked.join(t.select("sig", "as", F.col("label").alias("target"), F.col("family").alias("tf")), ["sig", "as"])
        of = lambda same, what: F.expr(f"{what}(case when {same} then target end)")
        per = found.groupBy("name", "label", "family").agg(
            F.min("target").alias("lo"), F.max("target").alias("hi"), of("tf = family", "min").alias("flo"), of("tf = family", "max").alias("fhi")
        )
        hit = per.selectExpr("name", "label", "case when flo = fhi then flo when flo is null and lo = hi then lo when lo = hi then lo end as target")
        hit = stage.write(hit.where("target is not null and (label is null or target <> label)"), "hit")
        # a whole group moves, so that misspelt shorter forms come along; names without a group move alone
        moved = _unique(hit.where("label is not null").select("label", F.col("target").alias("t")), ["label"], "t").withColumnRenamed("target", "to")
        alone = _unique(hit.where("label is null").select("name", F.col("target").alias("t")), ["name"], "t").withColumnRenamed("target", "alone")
        out = named.join(moved, "label", "left").join(alone, "name", "left")
        return stage.write(out.withColumn("label", F.coalesce("to", "label", "alone")).drop("to", "alone"), "attached")

    named = attach(own, ("blend", "part"))
    named = attach(named, ("head", "initial", "acronym", "edition"))

    # cut-off names: the one entity whose names go on where the cut is, first of those of the name's family; of a
    # name and the same name with more after it (a son's, say) the shorter
    long = stage.write(named.where("label is not null and length(prefix) > 5").selectExpr("name", "kind", "label", "family", "prefix"), "long")
    marked = named.where("kind = 'cut' and length(prefix) >= 5").selectExpr("name", "family", "prefix", "false as unmarked")
    asked = long.where("kind = 'full'").select("prefix").unionByName(marked.select("prefix")).distinct()
    starts = long.selectExpr("name", "label", "family", "prefix as whole", "explode(sequence(5, length(prefix) - 1)) as l").selectExpr(
        "name as of", "label as target", "family as tf", "whole", "substring(whole, 1, l) as prefix", "substring(whole, l, 2) rlike '^[^ ]{2}$' as inside"
    )
    starts = stage.write(starts.join(asked, "prefix", "left_semi"), "starts")
    inside = starts.where("inside").select("prefix", "target").distinct()
    broken = stage.write(long.where("kind = 'full'").join(inside, "prefix").where("target <> label").select("name").distinct(), "broken")
    sound = starts.join(broken.withColumnRenamed("name", "of"), "of", "left_anti").drop("of")
    ended = long.join(broken, "name", "left_anti").selectExpr("label as target", "family as tf", "prefix as whole", "prefix", "false as inside")
    cuts = marked.unionByName(long.join(broken, "name").selectExpr("name", "family", "prefix", "true as unmarked"))
    ends = sound.unionByName(ended).groupBy("prefix", "inside", "target", "tf").agg(F.min("whole").alias("first"), F.max("whole").alias("last"))
    fits = cuts.join(ends, "prefix").where("inside or not unmarked")
    per = fits.groupBy("name").agg(
        F.expr("min(target) lo"), F.expr("max(target) hi"), F.expr("min(case when tf = family then target end) flo"), F.expr("max(case when tf = family then target end) fhi"),
        F.expr("min(struct(first, target)) as least"), F.expr("max(last) as last"),
    )
    to = per.selectExpr("name", "case when lo = hi then lo when flo = fhi then flo when startswith(last, least.first) then least.target end as target")
    out = named.join(to, "name", "left")
    return out.select("name", F.coalesce("target", "label").alias("label")).where("label is not null")


def variant_pairs(mentions: DataFrame) -> DataFrame:
    """``(name_a, name_b)``, a < b: different original names used for the same entity."""
    stage = Stage(mentions.sparkSession, "names")
    e = stage.write(entity_names(mentions, stage), "entities")
    a, b = e.select("label", F.col("name").alias("name_a")), e.select("label", F.col("name").alias("name_b"))
    return a.join(b, "label").where("name_a < name_b").select("name_a", "name_b").distinct()

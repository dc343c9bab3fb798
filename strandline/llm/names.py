"""Names as people typed them, linked to the nodes they denote.

A name is read into a frame (words that many registered names share: kind of body, field of work,
direction; for people the given name) and a core (the place or family name). Frames must agree
exactly once abbreviations, nicknames and slips in them are undone, so another field or kind of body
is another entity. Cores are joined by pigeonhole segments: k edits, each of which harms one segment or,
as a transposition, two, leave one of 2 k + 1 segments unharmed, at a place shifted by at most k;
segments of registered cores are an inverted index, substrings of typed cores look them up, and a
banded edit distance verifies.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.snapshots import BLANKS
from strandline.session import new_folder, written

# Titles, articles and suffixes that are no part of a name.
NO_PART = frozenset("the of and for mr mrs ms miss dr prof eng ing hon sir rev mme hq headquarters head office formerly".split())
# Usual abbreviations of words in the names of bodies.
ABBREVIATIONS = dict(
    x.split("=")
    for x in """
natl=national intl=international int=international inter=international nthn=northern nth=northern sthn=southern utd=united cent=central ctrl=central
co=company coy=company ltd=limited corp=corporation corpn=corporation dept=department dpt=department auth=authority authy=authority
assn=association assoc=association comm=commission commn=commission cmsn=commission cncl=council ccl=council bd=board brd=board bk=bank bnk=bank
ctr=centre center=centre cntr=centre inst=institute instit=institute res=research reg=regulatory regul=regulatory dev=development devt=development
devpt=development coord=coordination adv=advisory advis=advisory fd=fund tr=trust supp=supply
tel=telecom telecoms=telecom telco=telecom transm=transmission trans=transmission fish=fisheries for=forestry irrig=irrigation sanit=sanitation avn=aviation av=aviation
min=minerals pwr=power wtr=water hsg=housing rds=roads rlwy=rail railway=rail
""".split()
)
# Nicknames and the given names they stand for.
NICKNAMES = dict(
    x.split("=")
    for x in """
liz=elizabeth lizzie=elizabeth beth=elizabeth betty=elizabeth eliza=elizabeth fred=frederick freddie=frederick freddy=frederick mike=michael mick=michael mickey=michael josie=josephine jo=josephine
nat=nathaniel nate=nathaniel thea=theodora dora=theodora theo=theodora kathy=katherine kate=katherine katie=katherine kitty=katherine bob=robert rob=robert bobby=robert robbie=robert bert=robert
bill=william will=william billy=william willy=william liam=william gabby=gabriela gabi=gabriela gaby=gabriela bella=isabella izzy=isabella isa=isabella al=alexander alex=alexander sandy=alexander
vince=vincent vinny=vincent sam=samantha sammy=samantha ed=edward eddie=edward ted=edward ned=edward charlie=charles chuck=charles chas=charles zach=zachary zack=zachary zac=zachary
tom=thomas tommy=thomas dick=richard rick=richard rich=richard richie=richard pat=patricia patty=patricia trish=patricia tricia=patricia maggie=margaret meg=margaret peggy=margaret marge=margaret
len=leonard lenny=leonard leo=leonard ossie=oscar oz=oscar ozzie=oscar ursie=ursula hanna=hannah annie=hannah yoli=yolanda
jim=james jimmy=james joe=joseph tony=anthony dan=daniel danny=daniel dave=david steve=steven sue=susan vicky=victoria
""".split()
)
#: Words of at least so many registered names, and of this share of them, may belong to frames; so may given names.
FRAME_LEAST, FRAME_SHARE = 3, 0.0002
_LEET = str.maketrans("013457", "oleast")
_CAMEL = re.compile(r"(?<=[a-z]{3})(?=[A-Z][a-z])")
_PAREN = re.compile(r"\s*[(\[][^)\]]*[)\]]?\s*")


def plain(text: str) -> str:
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.replace("’", "'")


def words_of(text: str) -> list[tuple[str, bool]]:
    """Lower-case words without accents, and whether an abbreviation mark follows."""
    text = _CAMEL.sub(" ", plain(text))
    bare = _PAREN.sub(" ", text)
    text = (bare if bare.strip() else text).lower()
    text = re.sub(r"'s\b", "", text)
    marked = bool
    out = []
    for m in re.finditer(r"([^\W_]+(?:'[^\W_]+)*)(\.)?", text):
        word = m[1].replace("'", "")
        if any(c.isalpha() for c in word):
            word = word.translate(_LEET)
        out.append((word, marked(m[2]) or "'" in m[1]))
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, in a band of width ``most``; more than ``most`` gives most + 1."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    big = most + 1
    two, one = None, [j if j <= most else big for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        row = [big] * (m + 1)
        if i <= most:
            row[0] = i
        ca, best = a[i - 1], row[0]
        for j in range(lo, hi + 1):
            v = one[j - 1] + (ca != b[j - 1])
            if one[j] + 1 < v:
                v = one[j] + 1
            if row[j - 1] + 1 < v:
                v = row[j - 1] + 1
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == b[j - 1] and two[j - 2] + 1 < v:
                v = two[j - 2] + 1
            row[j] = v
            best = v if v < best else best
        if best > most:
            return big
        two, one = one, row
    return min(one[m], big)


def allowed(length: int) -> int:
    """Edits that a core of this many letters may have: none below four letters, three from fourteen on,
    where more would join names of different places. It defines which slips are links; nothing else is cut."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 14 else 3


class Near:
    """Words of a lexicon by their segments: those within k edits of a word, nearest first, without a scan."""

    def __init__(self, words: frozenset[str], most):
        self.most, self.sizes, self.index = most, sorted({len(w) for w in words}), {}
        for w in words:
            for i, _, text in segments(w, most(w)):
                self.index.setdefault((len(w), i, text), []).append(w)
        self.layout = {n: (most("x" * n), segments("x" * n, most("x" * n))) for n in self.sizes}

    def __call__(self, word: str) -> list[tuple[int, str]]:
        n, found = len(word), set()
        for size in self.sizes:
            k, parts = self.layout[size]
            if abs(size - n) > k:
                continue
            for i, at, text in parts:
                for start in range(max(0, at - k), min(n - len(text), at + k) + 1):
                    found.update(self.index.get((size, i, word[start : start + len(text)]), ()))
        return sorted((d, w) for w in found if (d := edits(word, w, self.most(w))) <= self.most(w))


@dataclass(frozen=True)
class Lexicon:
    """Words of frames: those of bodies, and given names. Both are bounded: see ``lexicon_of``."""

    body: frozenset[str]
    given: frozenset[str]

    def __hash__(self) -> int:
        return hash((len(self.body), len(self.given)))

    def __reduce__(self):
        return Lexicon, (self.body, self.given)

    @cached_property
    def near_body(self) -> Near:
        return Near(self.body, lambda w: 1 if len(w) < 7 else 2)

    @cached_property
    def near_given(self) -> Near:
        return Near(self.given, lambda w: 1 if len(w) < 6 else 2)

    @cached_property
    def near_short(self) -> Near:
        """Long abbreviations whose full words are of bodies."""
        return Near(frozenset(a for a in ABBREVIATIONS if len(a) >= 5 and ABBREVIATIONS[a] in self.body), lambda w: 1)

    @cached_property
    def near_nick(self) -> Near:
        return Near(frozenset(n for n, w in NICKNAMES.items() if len(n) > 2 and w in self.given), lambda w: 1)

    @cached_property
    def by_start(self) -> dict[str, list[str]]:
        """Body words by each of their beginnings."""
        out: dict[str, list[str]] = {}
        for w in sorted(self.body):
            for n in range(1, len(w) + 1):
                out.setdefault(w[:n], []).append(w)
        return out


def _abbreviates(short: str, word: str) -> bool:
    if len(short) >= len(word) or short[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in short)


@lru_cache(maxsize=200_000)
def _as_body(word: str, marked: bool, lexicon: Lexicon) -> str | None:
    """The body word that a typed word stands for."""
    if word in lexicon.body:
        return word
    full = ABBREVIATIONS.get(word)
    if full in lexicon.body:
        return full
    if len(word) > 1 and (marked or len(word) <= 5):
        fits = lexicon.by_start.get(word, []) or ([w for w in lexicon.by_start.get(word[:2], []) if _abbreviates(word, w)] if marked else [])
        if len(fits) == 1 and (marked or len(word) >= 4):
            return fits[0]
    if len(word) >= 3:
        near = lexicon.near_body(word)
        if near and (len(near) == 1 or near[0][0] < near[1][0]) and (len(word) > 3 or near[0][0] <= 1 and near[0][1][0] == word[0]):
            return near[0][1]
        if len(word) >= 5:
            near = {ABBREVIATIONS[a] for _, a in lexicon.near_short(word)}
            if len(near) == 1:
                return near.pop()
    return None


@lru_cache(maxsize=200_000)
def _as_given(word: str, lexicon: Lexicon) -> str | None:
    if word in lexicon.given:
        return word
    if NICKNAMES.get(word) in lexicon.given:
        return NICKNAMES[word]
    if len(word) >= 4:
        near = lexicon.near_given(word)
        if near and (len(near) == 1 or near[0][0] < near[1][0]):
            return near[0][1]
    if len(word) >= 2:
        # a slip in a nickname, if one given name alone can be meant
        near = {NICKNAMES[n] for _, n in lexicon.near_nick(word)}
        if len(near) == 1:
            return near.pop()
    return None


def _unglued(word: str, marked: bool, lexicon: Lexicon) -> list[tuple[str, bool]]:
    """A body word that lost the blank to its neighbour, apart again."""
    if len(word) >= 10 and word not in lexicon.body:
        for n in range(len(word) - 4, 4, -1):
            if word[:n] in lexicon.body:
                return [(word[:n], False), (word[n:], marked)]
            if word[-n:] in lexicon.body:
                return [(word[:-n], False), (word[-n:], marked)]
    return [(word, marked)]


def read(name: str, lexicon: Lexicon) -> list[tuple[str, str]]:
    """The (frame, core) pairs that a typed name may stand for; usually one, none for an empty name.

    A single word is an acronym if it has three to seven letters, as names of three to seven words give it.
    """
    words = [(w, m) for w, m in words_of(name) if w not in NO_PART or w == "for" and m]
    if not words:
        return []
    if len(words) == 1 or all(len(w) == 1 for w, _ in words):
        w = "".join(w for w, _ in words)
        return [("acronym", w)] if 3 <= len(w) <= 7 and lexicon.body else []
    words = [part for word in words for part in _unglued(*word, lexicon)]
    body = [_as_body(w, m, lexicon) for w, m in words]
    single = [i for i, (w, _) in enumerate(words) if len(w) == 1]
    if any(body):
        if single and all(len(w) == 1 for w, _ in words[: len(single)]) and len(words) - len(single) < 2:
            return []
        frame = [b for b in body if b]
        core = [w for (w, _), b in zip(words, body) if not b and len(w) > 1]
        core = list(dict.fromkeys(core))
        if len(core) == 2 and core[0] != core[1] and edits(core[0], core[1], 2) <= 2 and len(core[0]) > 4:
            core = core[:1]  # the place given twice
        frames = [sorted(frame)]
        if single:
            frames = [sorted([*frame, w]) for w in sorted(lexicon.body) if w[0] == words[single[0]][0]] + frames
        return [(" ".join(f), "".join(core)) for f in frames if core]
    given = [_as_given(w, lexicon) for w, _ in words]
    at = [i for i, g in enumerate(given) if g]
    if at:
        # the given name is the word that is one as written, else the first
        exact = [i for i in at if words[i][0] in lexicon.given or words[i][0] in NICKNAMES]
        k = (exact or at)[0]
        core = [w for i, (w, _) in enumerate(words) if i != k and len(w) > 1]
        return [(given[k], "".join(core))] if core else []
    if single:
        core = [w for w, _ in words if len(w) > 1]
        return [(f"initial {words[single[0]][0]}", "".join(core))] if core else []
    return [("other", "".join(w for w, _ in words))]


def segments(core: str, k: int) -> list[tuple[int, int, str]]:
    """(number, place, text) of the even segments of a core, of which k edits leave one unharmed.

    A transposition counts as one edit but can harm two segments, so there are 2 k + 1 of them.
    """
    n = len(core)
    parts = max(1, min(n, 2 * k + 1))
    short, longer = divmod(n, parts)
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((i, at, core[at : at + size]))
        at += size
    return out


def _key(frame: str, length: int, number: int, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{frame}\0{length}\0{number}\0{text}") - (1 << 63)


def index_keys(frame: str, core: str) -> set[int]:
    if frame == "acronym":
        return {_key(frame, 0, 0, core)}
    return {_key(frame, len(core), i, text) for i, _, text in segments(core, allowed(len(core)))}


def probe_keys(frame: str, core: str) -> set[int]:
    """Keys of every substring that could be a segment of a registered core within its edits."""
    if frame == "acronym":
        return {_key(frame, 0, 0, core)}
    n, out = len(core), set()
    for length in range(max(1, n - 3), n + 4):
        k = allowed(length)
        if abs(length - n) > k:
            continue
        for i, at, text in segments("x" * length, k):
            for start in range(max(0, at - k), min(n - len(text), at + k) + 1):
                out.add(_key(frame, length, i, core[start : start + len(text)]))
    return out


def _reader(lexicon: Lexicon, probing: bool):
    def read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, frames, cores, keys, sure = [], [], [], [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                readings = read(name, lexicon)
                for frame, core in readings:
                    rows.append(i)
                    sure.append(len(readings) == 1)
                    frames.append(frame)
                    cores.append(core)
                    keys.append(sorted(probe_keys(frame, core) if probing else index_keys(frame, core)))
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(frames, pa.string()), pa.array(cores, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(sure, pa.bool_())], names=[*batch.schema.names, "frame", "core", "keys", "sure"])

    return read_all


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(batch.schema.get_field_index("core")).to_pylist(), batch.column(batch.schema.get_field_index("node_core")).to_pylist()
        d = [0 if x == y else edits(x, y, allowed(len(y))) for x, y in zip(a, b)]
        keep = pa.array([v <= allowed(len(y)) for v, y in zip(d, b)])
        yield pa.RecordBatch.from_arrays([*[c.filter(keep) for c in batch.columns], pa.array(d, pa.int32()).filter(keep)], names=[*batch.schema.names, "d"])


def lexicon_of(entities: DataFrame) -> Lexicon:
    """Frame words of the registry's names. A name's words divided by FRAME_SHARE is the most that there can
    be of body words, 1 / FRAME_SHARE that of given names, so what is collected is bounded."""
    named = entities.where("entity is not null").select(F.filter(F.split(F.lower(F.regexp_replace("entity", r"[^\p{L}\p{M}\p{N}]+", " ")), " "), lambda w: w != "").alias("p"))
    longer = named.where("size(p) > 2")
    total = max(1, longer.count())
    # the rarest word of a name tells it from others of its kind: it is seldom a frame's
    each = longer.withColumn("n", F.monotonically_increasing_id()).select("n", F.explode(F.array_distinct("p")).alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rarest = each.join(counts, "word").withColumn("least", F.min("df").over(Window.partitionBy("n")))
    words = rarest.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.count(F.when(F.col("df") == F.col("least"), 1)).alias("alone")).where((F.col("df") >= max(FRAME_LEAST, FRAME_SHARE * total)) & (F.col("alone") < 0.5 * F.col("df")))
    body = {r["word"] for r in words.select("word").collect()}
    # a frequent given name stands first of two words that are no words of bodies
    outside = lambda c: ~c.isin(*sorted(body)) if body else F.lit(True)
    pairs = named.where("size(p) = 2").select(F.col("p")[0].alias("first"), F.col("p")[1].alias("last")).where(outside(F.col("first")) & outside(F.col("last")))
    least = max(FRAME_LEAST, FRAME_SHARE * pairs.count())
    given = {plain(r["first"]) for r in pairs.groupBy("first").count().where(F.col("count") >= least).select("first").collect()}
    return Lexicon(frozenset(plain(w) for w in body), frozenset(given))


def link_names(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, uid, is_node) for typed names (one string column ``name``) and the registry (uid, entity, aliases).

    Each name gets at most one uid: the nearest node whose frame agrees, the smallest uid among nodes
    that are the same entity; names equally near to different entities get none. Null and blank names
    get none. Any number of rows per name may be given; each name is read once.
    """
    spark = names.sparkSession
    nodes = nodes.where("uid is not null")
    lexicon = lexicon_of(nodes)
    typed = names.where(F.col("name").isNotNull()).select(F.col("name").cast("string").alias("name")).distinct()
    parsed = "name string, frame string, core string, keys array<bigint>, sure boolean"
    entity_names = nodes.select(F.col("entity").alias("name"), "uid").unionByName(nodes.select(F.explode("aliases").alias("name"), "uid")).where("name is not null").distinct()
    known = entity_names.mapInArrow(_reader(lexicon, False), "name string, uid string, frame string, core string, keys array<bigint>, sure boolean").where("core <> ''").drop("sure")
    known = known.unionByName(_acronyms(known, lexicon)).unionByName(_initials(known))
    index = known.select("uid", "frame", F.col("core").alias("node_core"), F.explode("keys").alias("key"))
    read_names = typed.mapInArrow(_reader(lexicon, True), parsed).where("core <> ''")
    found = (
        read_names.select("name", "frame", "core", F.explode("keys").alias("key")).join(index, ["key", "frame"])
        .select("name", "frame", "core", "uid", "node_core").distinct()
        .mapInArrow(_distance, "name string, frame string, core string, uid string, node_core string, d int")
    )
    # most names with a slip have frames of the core that it comes from; those of a name of its own have others
    frames = read_names.where(F.col("sure") & ~F.col("frame").startswith("initial ")).select("core", "frame").groupBy("core", "frame").agg(F.count(F.lit(1)).alias("names"))
    registered = known.select(F.col("core").alias("node_core"), "frame").distinct().withColumn("shared", F.lit(1))
    judged = (
        found.where("d > 0").select("core", "node_core").distinct().join(frames, "core").join(registered, ["node_core", "frame"], "left")
        .groupBy("core", "node_core").agg(F.sum(F.when(F.col("shared").isNotNull(), F.col("names"))).alias("n_shared"), F.sum("names").alias("n_all"))
    )
    found = found.join(judged, ["core", "node_core"], "left")
    return found.where((F.col("d") == 0) | F.col("n_all").isNull() | (2 * F.coalesce("n_shared", F.lit(0)) >= F.col("n_all"))).select("name", "uid", "frame", "d")


def _initials(known: DataFrame) -> DataFrame:
    """People under the initial of their given name."""
    person = known.where(~F.col("frame").contains(" ") & ~F.col("frame").isin("acronym", "other"))
    return _keyed(person.select("name", "uid", F.concat(F.lit("initial "), F.substring("frame", 1, 1)).alias("frame"), "core"))


def _acronyms(known: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Bodies under the initials of their words."""
    initials = F.lower(F.array_join(F.transform(F.filter(F.split(F.regexp_replace("name", r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: ~F.lower(w).isin(*sorted(NO_PART)) & (w != "")), lambda w: F.substring(w, 1, 1)), ""))
    return _keyed(known.where(F.col("frame").contains(" ")).select("name", "uid", F.lit("acronym").alias("frame"), initials.alias("core")).distinct())


def _keyed(rows: DataFrame) -> DataFrame:
    def keys(batches):
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(index_keys(f, c)) for f, c in pairs], pa.list_(pa.int64()))], names=[*batch.schema.names, "keys"])

    return rows.mapInArrow(keys, "name string, uid string, frame string, core string, keys array<bigint>")


def node_twins(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key_a, key_b): uids that are the same entity, key_a < key_b.

    Nodes are twins if the name of one is read as the other's. A node's aliases make it a twin of the
    one entity that they are read as instead; one entered under an acronym or initial is also the twin
    of the one entity that has this as an alias, else of the only one that it fits. ``links`` must
    hold the aliases for that.
    """
    nodes = nodes.where("uid is not null")
    names = nodes.where("entity is not null").select(F.col("uid").alias("u"), F.col("entity").alias("name"), F.lit(False).alias("alias"))
    names = names.unionByName(nodes.select(F.col("uid").alias("u"), F.explode("aliases").alias("name"), F.lit(True).alias("alias")).where("name is not null")).distinct()
    each = written(names.join(links, "name"), new_folder(nodes.sparkSession, "names"), "each")
    full, loose = ~F.col("frame").rlike("^(acronym|initial|other)"), F.col("frame").rlike("^(acronym$|initial )")
    sure = each.where(~F.col("alias") & full & (F.col("u") != F.col("uid"))).select(F.least("u", "uid").alias("key_a"), F.greatest("u", "uid").alias("key_b")).distinct()
    whole = each.where(~F.col("alias") & full & (F.col("u") == F.col("uid"))).select("u").distinct()
    by_alias = each.where(F.col("alias") & full).withColumn("own", F.max(F.col("u") == F.col("uid")).over(Window.partitionBy("u", "name"))).where("not own").select(F.col("u").alias("v"), F.col("uid").alias("fit"), F.lit(1).alias("tier"), "d")
    apart = each.where(loose & (F.col("u") != F.col("uid")))
    as_alias = apart.where(F.col("alias") & (F.col("d") == 0)).select(F.col("uid").alias("v"), F.col("u").alias("fit"), F.lit(2).alias("tier"), "d")
    by_name = apart.where(~F.col("alias")).select(F.col("u").alias("v"), F.col("uid").alias("fit"), F.lit(3).alias("tier"), "d")
    short = as_alias.unionByName(by_name).join(whole.withColumnRenamed("u", "v"), "v", "left_anti").join(whole.withColumnRenamed("u", "fit"), "fit", "left_semi")
    nearest = by_alias.unionByName(short).withColumn("r", F.rank().over(Window.partitionBy("v").orderBy("tier", "d"))).where("r = 1")
    one = nearest.join(_smallest(sure).withColumnRenamed("uid", "fit"), "fit", "left").groupBy("v").agg(F.min(F.coalesce("smaller", "fit")).alias("fit"), F.countDistinct(F.coalesce("smaller", "fit")).alias("n")).where("n = 1 and fit <> v")
    return _closed(written(sure.unionByName(one.select(F.least("v", "fit").alias("key_a"), F.greatest("v", "fit").alias("key_b"))), new_folder(nodes.sparkSession, "names"), "twins"))


def _smallest(twins: DataFrame) -> DataFrame:
    """(uid, smaller): the smallest twin of each uid that has a smaller one."""
    return twins.groupBy(F.col("key_b").alias("uid")).agg(F.min("key_a").alias("smaller"))


def _closed(twins: DataFrame) -> DataFrame:
    """Twins, and pairs of those with a twin in common."""
    both = twins.select(F.col("key_a").alias("x"), F.col("key_b").alias("y")).unionByName(twins.select(F.col("key_b").alias("x"), F.col("key_a").alias("y"))).distinct()
    shared = both.join(both.withColumnRenamed("y", "z"), "x").where("y < z").select(F.col("y").alias("key_a"), F.col("z").alias("key_b"))
    return twins.unionByName(shared).distinct()


def best_links(links: DataFrame, twins: DataFrame) -> DataFrame:
    """(name, uid): the nearest node of each name, twins counted as their smaller uid."""
    w = Window.partitionBy("name").orderBy("d")
    near = links.withColumn("r", F.rank().over(w)).where("r = 1").join(_smallest(twins), "uid", "left").select("name", F.coalesce("smaller", "uid").alias("uid")).distinct()
    return near.groupBy("name").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "uid")


def linked_records(entities: DataFrame, claims: DataFrame, nodes: DataFrame) -> DataFrame:
    """(record_table, key_a, key_b) over the intake's last names, the claims' subjects and the registry itself.

    Names that the registry has as written are left out, as are null names. Keys are unique per table.
    """
    trimmed = F.regexp_replace(F.coalesce(F.col("entity_id"), F.lit("")), BLANKS, "")
    last = entities.groupBy(trimmed.alias("key_a")).agg(F.max_by("name", F.struct("snapshot_no", F.col("delivered_at").isNotNull(), "delivered_at", "name")).alias("name"))
    subjects = claims.where("seq is not null").select(F.col("seq").cast("string").alias("key_a"), F.col("subject").alias("name"))
    registered = nodes.select(F.col("entity").alias("name")).unionByName(nodes.select(F.explode("aliases").alias("name"))).where("name is not null").distinct()
    typed = last.select(F.lit("rita_entities").alias("record_table"), "key_a", "name").unionByName(subjects.select(F.lit("atomic_claims").alias("record_table"), "key_a", "name"))
    typed = typed.where("name is not null").join(registered, "name", "left_anti")
    links = written(link_names(typed.select("name").unionByName(registered), nodes), new_folder(nodes.sparkSession, "names"), "links")
    twins = node_twins(links, nodes)
    found = typed.join(best_links(links, twins), "name").select("record_table", "key_a", F.col("uid").alias("key_b"))
    return found.unionByName(twins.select(F.lit("canonical_nodes").alias("record_table"), "key_a", "key_b"))

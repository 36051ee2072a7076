"""Linking variant spellings of the names of persons and organisations.

1. Names are read into folded tokens (no titles, legal forms or order); tokens get the spelling that the whole table has most
   often for them. Distinct token sets go on. How many names have a token is its weight's inverse: a given name, or what
   organisations do, tells less than a surname or an organisation's own word. No list of such words is needed.
2. MinHash banding over the padded q-grams of whole names, weighted by their tokens. Bands are tuned from the collision curve.
   Names whose weightiest token is short are also met by that token with a letter left out, beside an initial.
3. In a bucket a name is compared with the bucket's leaders only, and verified by Monge-Elkan similarity over its tokens.
4. Star clustering over the verified links: a name that links to no centre ranking before it is a centre (fuller and more
   frequent names rank first), every other name joins the one centre that it is most like.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knowloom.session import cores, materialize

#: Labels of kinds, words without identity, large regions, short forms of given names.
PERSON_TYPES = {"person", "people", "per", "人物", "人"}
ORG_TYPES = {"organization", "organisation", "org", "company", "公司", "组织", "机构", "firm"}
OTHER_TYPES = {"product", "产品", "location", "event"}
TITLES = {"dr", "prof", "ing", "mr", "mrs", "ms", "herr", "frau", "dipl", "sir", "phd", "jr", "sr"}
NOISE = {"the", "and", "of", "und", "et", "y"}
LEGAL = {"ltd", "limited", "llc", "inc", "incorporated", "corp", "corporation", "co", "company", "gmbh", "ag", "aktiengesellschaft", "bv", "sa", "plc", "gesellschaft", "mbh", "kg", "se", "nv", "spa", "srl", "oy", "ab", "sarl", "lp", "llp"}
REGIONS = {
    "north", "south", "east", "west", "northern", "southern", "eastern", "western", "central", "northeast", "northwest", "southeast", "southwest", "midwest",
    "africa", "america", "americas", "antarctica", "arctic", "asia", "australia", "europe", "oceania", "eurasia", "apac", "emea", "latam",
    "adriatic", "alpine", "andean", "arabia", "atlantic", "balkan", "balkans", "baltic", "benelux", "british", "caribbean", "caucasus", "dach", "gulf", "iberia", "iberica", "levant", "maghreb",
    "mediterranean", "nordic", "nordics", "pacific", "polynesia", "sahel", "scandinavia", "siberia",
}
SHORT_FORMS = {
    "alexander": "alex al sasha", "andrew": "andy drew", "anthony": "tony", "abigail": "abby gail", "benjamin": "ben benny", "charles": "charlie chuck", "christopher": "chris kit",
    "daniel": "dan danny", "david": "dave davy", "deborah": "debbie deb", "dimitri": "dima mitya", "edward": "ed ted ned eddie", "eleanor": "ellie nell nora", "elizabeth": "liz beth betty lizzie eliza",
    "francisco": "paco pancho", "frederick": "fred freddie", "gabriele": "gabi", "giovanni": "gianni", "gregory": "greg", "heinrich": "heinz", "henry": "harry hank", "ignacio": "nacho", "isabella": "bella isa",
    "james": "jim jimmy jamie", "jennifer": "jen jenny", "johannes": "hans", "john": "jack johnny", "jose": "pepe", "joseph": "joe joey", "katherine": "kate kathy katie", "lawrence": "larry", "leonard": "len lenny leo",
    "margaret": "peggy maggie meg", "matthew": "matt", "michael": "mike mick mickey", "nicholas": "nick nicky", "patricia": "pat trish patty", "penelope": "penny", "philip": "phil", "rebecca": "becky", "richard": "dick rick rich",
    "robert": "bob rob bobby", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli", "victoria": "vicky tori vic", "vladimir": "vova volodya", "walter": "walt wally",
    "wilhelm": "willi willy", "william": "bill will billy",
}
#: Length of q-grams; similarity that must be met, and with which chance; least rows of a band, and the names that may share a
#: band with one by accident, if two unlike names have a similarity of UNLIKE: rows of a band follow from the number of names.
Q, AT_SIMILARITY, RECALL, ROWS, BY_ACCIDENT, UNLIKE = 3, 0.45, 0.97, 3, 500, 0.05
#: Letters of the weightiest token up to which names are also met by that token's one-edit keys.
EDIT_LETTERS = 7
#: Letters of tokens that may be misspellings of tokens one edit away, if those are in so many times as many names.
NEAR_LETTERS, USUAL = (4, 24), 3
#: The weightiest token is clear if another one of the name is in so many times as many names (and FEW more).
CLEAR = 4
#: So few names with a token tell nothing about how common it is.
FEW = 8
#: Least Monge-Elkan similarity of two names of one star, and of the weightiest token of each to some token of the other.
ALIKE, MATCHED = 0.85, 0.8
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})


def osa(a: str, b: str, most: int) -> int:
    """Edits (neighbours swapped count one) between two words, or most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            c = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                c = min(c, older[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return most + 1
    return row[-1]


def edits_allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 8 else 2


@functools.lru_cache(maxsize=200_000)
def letters(w: str) -> int:
    """A bit for each letter of a word, by its code modulo 64."""
    x = 0
    for c in w:
        x |= 1 << (ord(c) & 63)
    return x


@functools.lru_cache(maxsize=300_000)
def close(a: str, b: str) -> bool:
    """Few edits apart. An edit changes two of the letters at most, which tells most pairs apart at once."""
    m = edits_allowed(min(len(a), len(b)))
    return abs(len(a) - len(b)) <= m and (letters(a) ^ letters(b)).bit_count() <= 2 * m and osa(a, b, m) <= m


def grams(token: str, q: int = Q) -> list[str]:
    """Distinct q-grams of a token padded at both ends; a single letter has only that of a word's beginning, so it is like any word with it."""
    t = "\x02" * (q - 1) + token + "\x03" * (q - 1)
    return list(dict.fromkeys(t[i : i + q] for i in range(len(t) - q + 1))) if len(token) > 1 else [t[:q]]


def bands_for(similarity: float = AT_SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands needed, by the collision curve 1 - (1 - s^rows)^bands, to meet a pair of this similarity with this chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def rows_for(names: int) -> int:
    """Rows of a band so that a name shares a band with at most BY_ACCIDENT of so many unlike ones; the bands for RECALL go with it."""
    r = ROWS
    while names * UNLIKE**r * bands_for(rows=r) > BY_ACCIDENT:
        r += 1
    return r


@dataclass(frozen=True)
class Name:
    kind: str  # person, org, or nothing if the type doesn't tell
    tokens: tuple[str, ...]
    region: str
    heavy: str = ""  # the weightiest token
    clear: bool = False  # it is much rarer than another token of the name


def tokens(name: str) -> list[str]:
    """Folded words of a name, without titles."""
    t = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name).translate(LETTERS))
    t = "".join(c for c in t if not unicodedata.combining(c)).casefold()
    t = re.sub(r"['’`´]", "", t)
    t = re.sub(r"\b(?:[^\W\d_]\.){2,}", lambda m: m.group().replace(".", "") + " ", t)
    return [w for w in re.split(r"[\W_]+", t) if w and w not in TITLES and w not in NOISE]


def _near(w: str, words: set[str]) -> str | None:
    if w in words:
        return w
    return next((x for x in sorted(words) if len(x) >= 5 and len(w) >= 5 and osa(w, x, 1) <= 1), None)


_near_legal = functools.lru_cache(maxsize=50_000)(lambda w: _near(w, LEGAL))
_near_region = functools.lru_cache(maxsize=50_000)(lambda w: _near(w, REGIONS))


def parse(name: str | None, type_: str | None) -> Name | None:
    """The parts of a person's or organisation's name; None for blank names and other things."""
    if not name or not name.strip():
        return None
    label = (type_ or "").strip().casefold()
    if label in OTHER_TYPES:
        return None
    words = tokens(name)
    if not words:
        return None
    kind = "person" if label in PERSON_TYPES else "org" if label in ORG_TYPES else ""
    if not kind and any(c.isdigit() for c in "".join(words)):
        return None
    region = ""
    if kind != "person":
        legal = {w for w in words if _near_legal(w)}
        regions = [r for w in words if (r := _near_region(w))]
        if not kind and len(words) > 1 and (legal or regions):
            kind = "org"
        if kind == "org":
            region = regions[0] if regions else ""
            words = [w for w in words if w not in legal and not _near_region(w)] or words
    if kind != "org" and sum(len(w) > 1 for w in words) > 1:
        words = [w for w in words if len(w) > 1]  # a name in full says more than initials beside it
    return Name(kind, tuple(sorted(set(words))), region)


def left_out(w: str) -> set[str]:
    """The word, and it with any one letter left out: two words of one edit have one of these in common."""
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


@functools.cache
def _formal() -> dict[str, set[str]]:
    """Given name or short form of one, to the full forms."""
    out: dict[str, set[str]] = {}
    for full, forms in SHORT_FORMS.items():
        for w in (full, *forms.split()):
            out.setdefault(w, set()).add(full)
    return out


@functools.cache
def _misspelt() -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for w in _formal():
        if len(w) > 3:
            for v in left_out(w):
                out.setdefault(v, set()).add(w)
    return out


@functools.lru_cache(maxsize=100_000)
def formal(w: str) -> frozenset[str]:
    """The full forms of a given name that has short ones, perhaps misspelt; nothing for other words."""
    if w in _formal() or not 4 <= len(w) <= 16:
        return frozenset(_formal().get(w, ()))
    near = {x for v in left_out(w) for x in _misspelt().get(v, ()) if osa(w, x, 1) <= 1}
    return frozenset(f for x in near for f in _formal()[x])


def shortens(w: str, full: str) -> bool:
    """w has letters of `full` in their order, beginning with the first; in words of four letters and more one may be wrong."""
    if len(w) < 2 or w[0] != full[0] or len(w) >= len(full):
        return False
    missed, k = 0, 0
    for c in w:
        at = full.find(c, k)
        if at < 0:
            missed += 1
        else:
            k = at + 1
    return missed <= (len(w) >= 4)


def _person_token(a: str, b: str) -> float:
    x, y = formal(a), formal(b)
    if x & y:
        return 1.0 if a in _formal() and b in _formal() else 0.9
    if min(len(a), len(b)) == 1:
        return 0.9 if {a[0], *(f[0] for f in x)} & {b[0], *(f[0] for f in y)} else 0.0
    if close(a, b) and (min(len(a), len(b)) > 3 or a[0] == b[0]):
        return 0.9
    return 0.4 if a[0] == b[0] else 0.2


def _org_token(a: str, b: str) -> float:
    short, long = sorted((a, b), key=len)
    if long.startswith(short) or shortens(short, long):
        return 0.9
    return 0.9 if len(short) > 3 and close(a, b) else 0.2


@functools.lru_cache(maxsize=200_000)
def alike(a: str, b: str, kind: str) -> float:
    """Similarity of two tokens of names of a kind: equal, short or misspelt forms, initials, abbreviations."""
    if a == b:
        return 1.0
    if kind == "person":
        return _person_token(a, b)
    return _org_token(a, b) if kind == "org" else max(_person_token(a, b), _org_token(a, b))


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...], kind: str) -> float:
    """Mean, over the tokens of the shorter name, of the best similarity to a token of the longer; 0 if either has none."""
    short, long = sorted((a, b), key=len)
    there = set(long)
    return sum(1.0 if x in there else max(alike(x, y, kind) for y in long) for x in short) / len(short) if short else 0.0


def _met(w: str, others: tuple[str, ...], kind: str) -> bool:
    """A name's weightiest token is, perhaps misspelt, shortened by itself or (of persons) as an initial, among the other's."""
    if w in others or any(len(y) > 1 and (y[0] == w[0] or len(w) > 3) and (letters(w) ^ letters(y)).bit_count() < 5 and close(w, y) for y in others):
        return True
    if kind != "person" and any(len(w) < len(y) and alike(w, y, "org") >= MATCHED for y in others):
        return True
    return kind != "org" and (bool((f := formal(w)) and any(f & formal(y) for y in others)) or any(min(len(w), len(y)) == 1 and alike(w, y, "person") > 0 for y in others))


def glued(word: str, other: str) -> bool:
    """A one-word name that is a letter before another word, as in user names."""
    return len(word) > 4 and len(other) > 2 and -3 < len(word) - 1 - len(other) < 3 and osa(word[1:], other, 2) < osa(word, other, 2)


def similarity(a: Name, b: Name) -> float:
    """0 if two names can't be of one entity, else the Monge-Elkan similarity of their tokens."""
    if a.region != b.region or (a.kind and b.kind and a.kind != b.kind):
        return 0.0
    kind = a.kind or b.kind
    if a.tokens == b.tokens:
        return 1.0
    if kind != "org":
        for x, y in ((a, b), (b, a)):
            if len(x.tokens) == 1 < len(y.tokens):
                for w in y.tokens:
                    if glued(x.tokens[0], w):
                        return 0.9 if any(alike(x.tokens[0][0], v, "person") > 0 for v in y.tokens if v != w) else 0.0
    if not ((not a.clear or _met(a.heavy, b.tokens, kind)) and (not b.clear or _met(b.heavy, a.tokens, kind))):
        return 0.0
    s = monge_elkan(a.tokens, b.tokens, kind)
    # Initials alone tell nothing: some word is the same.
    return round(s, 6) if s >= ALIKE and any(alike(x, y, kind) >= MATCHED for x in a.tokens for y in b.tokens if min(len(x), len(y)) > 1) else 0.0


def read_names(df: DataFrame, name: str, type_: str) -> DataFrame:
    """(name, type, rows, kind, tokens, region), one row for each distinct name and type that is a person's or organisation's."""
    d = df.select(F.col(name).alias("name"), F.col(type_).alias("type")).where("name is not null").groupBy("name", "type").agg(F.count("*").alias("rows"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(n, t, r, p.kind, list(p.tokens), p.region) for n, t, r in b.itertuples(index=False) if (p := parse(n, t if isinstance(t, str) else None))]
            yield pd.DataFrame(got, columns=["name", "type", "rows", "kind", "tokens", "region"])

    # Reading names is work for the processor: as many tasks as there are cores, however small the table.
    return d.repartition(tasks(df), "name").mapInPandas(work, "name string, type string, rows bigint, kind string, tokens array<string>, region string")


def tasks(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * cores(df.sparkSession))


def spellings(names: DataFrame) -> DataFrame:
    """(token, usual, n): the usual spelling of each token, and in how many names that is.

    A token is taken for a misspelling of the commonest token one edit away if that is in USUAL times as many names, so that given
    names and what organisations do needn't be listed. Tokens meet by what is left of them without one letter. A letter before the
    commoner token isn't a misspelling, as it may be an initial, as in user names.
    """
    n = names.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    size = F.length("token")
    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(F.col("token"), F.lit(1), i - 1), F.substring(F.col("token"), i + 1, size)))
    near = n.where(size.between(*NEAR_LETTERS)).select("token", "n", F.explode(F.array_distinct(F.concat(F.array("token"), less))).alias("v")).select("token", "n", F.xxhash64("v").alias("v"))
    # Each token sends its frequency to what it has left, and takes the highest there.
    best = near.groupBy("v").agg(F.max("n").alias("m"), F.max_by("token", F.struct("n", "token")).alias("other"), F.count("*").alias("c")).where("c > 1").drop("c")
    got = near.select("token", "v").join(best, "v").groupBy("token").agg(F.max("m").alias("m"), F.max_by("other", F.struct("m", "other")).alias("other"))
    wrong = F.coalesce((F.col("m") >= USUAL * F.col("n")) & (F.col("other") != F.substring("token", 2, 1_000)), F.lit(False))
    return n.join(got, "token", "left").select("token", F.when(wrong, F.col("other")).otherwise(F.col("token")).alias("usual"), F.when(wrong, F.col("m")).otherwise(F.col("n")).alias("n"))


def weighed(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, ids) of names as read_names has them, with `nid`: the distinct names in usual spelling, and (nid, name_id) for what was read.

    names: name_id, kind, tokens, region, common (in how many names each token is), heavy, clear, rank. A name whose type doesn't tell
    is of the kind that the same name mostly has elsewhere. heavy: the rarest token of two letters or more, the longest under
    ties. rank: fuller, typed, more frequent, longer first.
    """
    one = read.groupBy("nid").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.first("region").alias("region"), F.sum("rows").alias("rows"))
    usual = one.select("nid", F.explode("tokens").alias("token")).join(spellings(one), "token").groupBy("nid").agg(F.collect_set(F.struct("usual", "n")).alias("u"))
    x = one.drop("tokens").join(usual, "nid")
    x = x.withColumn("tokens", F.array_sort(F.array_distinct(F.transform("u", lambda t: t["usual"]))))
    x = x.withColumn("common", F.transform("tokens", lambda t: F.array_max(F.transform(F.filter("u", lambda y: y["usual"] == t), lambda y: y["n"]))))
    same = Window.partitionBy("tokens")  # a name's kinds and regions
    known = F.max(F.when(F.col("kind") != "", F.struct("rows", "kind", "region"))).over(same)
    x = x.withColumn("k_", known).withColumns({"kind": F.when(F.col("kind") == "", F.coalesce("k_.kind", F.lit(""))).otherwise(F.col("kind")), "region": F.when(F.col("kind") == "", F.coalesce("k_.region", F.lit(""))).otherwise(F.col("region"))})
    x = materialize(x.select("nid", F.xxhash64("kind", "region", F.array_join("tokens", " ")).alias("name_id"), "kind", "tokens", "region", "common", "rows"), "usual")
    names = x.groupBy("name_id").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.first("region").alias("region"), F.max("common").alias("common"), F.sum("rows").alias("rows"))
    each = F.zip_with("tokens", "common", lambda t, n: F.struct(n.alias("n"), (-F.length(t)).alias("l"), t.alias("t")))
    words = F.filter(each, lambda w: w["l"] < -1)
    full = F.least(F.size(words), F.lit(255)).cast("bigint")
    heavy = F.array_min(F.when(F.size(words) > 0, words).otherwise(each))
    clear = (heavy["n"] + FEW) * CLEAR <= F.array_max("common") + FEW
    letters = F.least(F.length(F.array_join("tokens", "")), F.lit(1023)).cast("bigint")
    rank = ((full * 2 + F.when(F.col("kind") == "", 0).otherwise(1)) * (1 << 34)) + F.least("rows", F.lit((1 << 24) - 1)) * 1024 + letters
    return names.select(F.col("name_id").alias("nid"), "kind", "tokens", "region", "common", heavy["t"].alias("heavy"), clear.alias("clear"), rank.alias("rank")), x.select("nid", "name_id")


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(names: list[tuple[str, list[str], list[int]]], bands: int, rows: int) -> np.ndarray:
    """Band keys (names x bands) of names (kind, tokens, how common): MinHash over padded q-grams, each weighted 1 / sqrt(how common + FEW).

    For every hash function each gram draws an exponential time with its weight as rate, the first one counts: two names have
    the same first gram with the probability of their weighted similarity. Short given names count as their full forms.
    """
    with np.errstate(over="ignore"):
        seen: dict[str, int] = {}
        at, weight, start = [], [], []
        for kind, words, common in names:
            start.append(len(at))
            for w, n in zip(words, common):
                f = sorted(formal(w)) if kind != "org" else ()
                for g in grams(f[0] if f else w):
                    at.append(seen.setdefault(g, len(seen)))
                    weight.append((n + FEW) ** -0.5)
        codes = np.array([int.from_bytes(g.encode("utf-8", "surrogatepass")[:8].ljust(8, b"\0"), "little") ^ (len(g.encode("utf-8", "surrogatepass")) << 56) for g in seen], dtype=np.uint64)
        at, weight = np.array(at), np.array(weight)[:, None]
        key = np.zeros((len(names), bands), np.uint64)
        low = np.uint64((1 << 20) - 1)
        for r in range(rows):
            h = _mix64(codes[:, None] + np.uint64(0x9E3779B97F4A7C15) * (np.arange(bands, dtype=np.uint64) * np.uint64(64) + np.uint64(r + 1))[None, :])
            time = -np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 1e-300)
            # The gram goes into the low bits of its time, so that one minimum gives both.
            t = ((time[at] / weight).view(np.uint64) & ~low) | (_mix64(codes) & low)[at][:, None]
            key = _mix64(key ^ (np.minimum.reduceat(t, start, axis=0) & low) + np.uint64(r + 1))
        return _mix64(key + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64)


def edit_keys(n: Name) -> set[str]:
    """Keys of a name whose weightiest token is short: that token with a letter left out, beside an initial of another token.

    Any two names with such tokens one edit apart, and a token of one initial, have one in common.
    """
    w = n.heavy
    starts = {x[0] for t in n.tokens if t != w for x in (t, *formal(t))}
    return {f"{s} {v}" for v in left_out(w) for s in starts} if 2 < len(w) <= EDIT_LETTERS else set()


def initial_keys(n: Name) -> tuple[set[str], bool]:
    """(keys, full) of a person's name: each word beside each initial of the others; full: the name has no initial itself.

    So a name with an initial meets all names that it may stand for, and is linked to none if these are several. A one-word name
    is read as an initial and a word, as in user names.
    """
    if n.kind == "org":
        return set(), False
    words = [t for t in n.tokens if len(t) > 1]
    if len(words) == 1 and len(n.tokens) > 1:
        return {f"{t}. {words[0]}" for t in n.tokens if len(t) == 1}, False
    if len(n.tokens) == 1:
        return ({f"{words[0][0]}. {words[0][1:]}"} if words and len(words[0]) > 4 else set()), False
    starts = {t: {x[0] for x in (t, *formal(t))} for t in words}
    return {f"{s}. {t}" for t in words for u in words if u != t for s in starts[u]}, True


def key_rows(names: DataFrame, rows: int) -> DataFrame:
    """(key, nid, rank, full, body): every band of each name's signature, its edit keys and its initial keys; full: a full name by an initial key. body: the name."""
    bands = bands_for(rows=rows)
    kind = "key bigint, nid bigint, rank bigint, full boolean, body string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):
                x = b.iloc[s : s + 500]
                todo = list(zip(range(len(x)), x["kind"], x["tokens"], x["common"]))
                # A one-word name may be a user name: it is also read as an initial and a word.
                todo += [(i, k, [t[0][0], t[0][1:]], [n[0], n[0]]) for i, k, t, n in todo if len(t) == 1 and len(t[0]) > 4 and k != "org"]
                key = [signatures([t[1:] for t in todo], bands, rows).ravel()]
                at, full = [np.repeat(np.array([t[0] for t in todo]), bands)], [np.zeros(len(key[0]), bool)]
                for i, (k, t, r, h) in enumerate(zip(x["kind"], x["tokens"], x["region"], x["heavy"])):
                    n = Name(k, tuple(t), r, h)
                    initials, whole = initial_keys(n)
                    for more, flag in ((sorted(edit_keys(n)), False), (sorted(initials), whole)):
                        key.append(np.array([_text_key(m) for m in more], np.int64))
                        at.append(np.full(len(more), i))
                        full.append(np.full(len(more), flag))
                at = np.concatenate(at)
                yield pd.DataFrame({"key": np.concatenate(key), "nid": x["nid"].to_numpy()[at], "rank": x["rank"].to_numpy()[at], "full": np.concatenate(full), "body": x["body"].to_numpy()[at]})

    body = F.concat_ws("\t", "kind", "region", "heavy", F.col("clear").cast("int").cast("string"), F.array_join("tokens", " "))
    return names.select("nid", "rank", "kind", "tokens", "common", "region", "heavy", body.alias("body")).repartition(tasks(names), "nid").mapInPandas(work, kind)


def _text_key(k: str) -> int:
    h = 0xCBF29CE484222325
    for c in k.encode("utf-8", "surrogatepass"):
        h = ((h ^ c) * 0x100000001B3) & (2**64 - 1)
    return h - (1 << 64) if h >> 63 else h


def name_links(names: DataFrame, rows: int) -> DataFrame:
    """(member, leader, s): verified links of names to leaders that rank before them, leaders being those of a bucket without such a link.

    A bucket is taken in order of rank, as a stream: only its leaders stay in memory. Full names by their initials lead and aren't
    compared among themselves. Keys that one name has alone are left out before that.
    """
    keys = key_rows(names, rows).repartition(tasks(names), "key")
    w = Window.partitionBy("key").orderBy(F.desc("rank"), "nid")
    shared = keys.withColumns({"p_": F.lag("nid").over(w), "n_": F.lead("nid").over(w)}).where("p_ is not null or n_ is not null").select("key", "nid", "full", "body")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, leaders, known, read = None, [], {}, {}
        for b in batches:
            out = []
            for k, i, full, text in zip(*(b[c].tolist() for c in ("key", "nid", "full", "body"))):
                if k != key:
                    key, leaders = k, []
                if (n := read.get(text)) is None:
                    kind, region, heavy, clear, words = text.split("\t")
                    n = read[text] = Name(kind, tuple(words.split(" ")), region, heavy, clear == "1")
                hit = False
                for j, m in () if full else leaders:
                    if j == i:
                        hit = True
                        continue
                    if (s := known.get((i, j))) is None:
                        s = known[i, j] = similarity(n, m)
                        if s:
                            out.append((i, j, s))
                    hit = hit or s > 0
                if not hit:
                    leaders.append((i, n))
            if len(known) > 1_000_000 or len(read) > 200_000:
                known.clear()
                read.clear()
            yield pd.DataFrame(out, columns=["member", "leader", "s"])

    return shared.mapInPandas(work, "member bigint, leader bigint, s double").distinct()


def stars(links: DataFrame) -> DataFrame:
    """(member, centre) of all names that aren't centres: star clustering over links to names of higher rank.

    Names without a link to a centre are centres. Each round settles all names whose links are settled, until none is left, so
    the highest ranking ones always are. A name that is equally like several centres, as with an initial that two persons share,
    joins none of them: its centre is itself.
    """
    open_ = links
    joined = None
    while not open_.isEmpty():
        hits = open_.join(open_.select(F.col("member").alias("leader")).distinct(), "leader", "left_anti").select("member").distinct()
        new = materialize(hits, "satellites")
        joined = new if joined is None else joined.unionByName(new)
        open_ = materialize(open_.join(new, "member", "left_anti").join(new.withColumnRenamed("member", "leader"), "leader", "left_anti").select(*links.columns), "openlinks")
    if joined is None:
        return links.select("member", F.col("leader").alias("centre"))
    to = links.join(joined.withColumnRenamed("member", "leader"), "leader", "left_anti")
    best = to.groupBy("member", "s").agg(F.count("*").alias("c"), F.min("leader").alias("leader")).groupBy("member").agg(F.max(F.struct("s", "c", "leader")).alias("b"))
    return best.select("member", F.when(F.col("b.c") == 1, F.col("b.leader")).otherwise(F.col("member")).alias("centre"))


def link_names(df: DataFrame, id_col: str = "entity_id", name: str = "entity_name", type_: str = "entity_type") -> DataFrame:
    """(<id>, cluster): the star of every row that names a person or organisation, one row per input row.

    - Null and blank names and other things (by type, or names with digits and no type that tells) aren't linked and don't
      come out. Names of equal tokens, kind and region are always in one star; a name whose type doesn't tell may join both kinds.
    - Repeated rows are kept; ids aren't needed to be unique. An empty table gives no rows.
    """
    nid = F.xxhash64("kind", "region", F.array_join("tokens", " "))
    read = materialize(read_names(df, name, type_).withColumn("nid", nid), "names")
    names, ids = weighed(read)
    names = materialize(names, "weighed")
    links = materialize(name_links(names, rows_for(names.count())), "links")
    x = read.select("name", "type", "nid").join(ids, "nid").join(stars(links).withColumnRenamed("member", "name_id"), "name_id", "left").select("name", "type", F.coalesce("centre", "name_id").alias("cluster"))
    rows = df.select(F.col(id_col).alias("id"), F.col(name).alias("n"), F.col(type_).alias("t"))
    return rows.join(x, (F.col("n") == F.col("name")) & F.col("t").eqNullSafe(F.col("type"))).select(F.col("id").alias(id_col), "cluster")


def entity_sizes(links: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(<id>, cluster, members): each row with its star and the star's size."""
    return links.withColumn("members", F.count("*").over(Window.partitionBy("cluster")))


def linked_pairs(links: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """(<id>_a, <id>_b): all pairs within stars, the smaller id first. This is the asked-for form, as many rows as it has."""
    a, b = links.select("cluster", F.col(id_col).alias(f"{id_col}_a")), links.select("cluster", F.col(id_col).alias(f"{id_col}_b"))
    return a.join(b, "cluster").where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b")).select(f"{id_col}_a", f"{id_col}_b").distinct()

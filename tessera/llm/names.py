"""Variant spellings of institution names, linked by blocking, comparison and components.

Each distinct name is read once: kind of institution, place, patron.  The spellings of
places and patrons are blocked by phonetic codes of their sorted sounds, compared by
Jaro-Winkler and edits, and clustered by connected components; a nickname table and
initials settle given names.  Only distinct names and spellings are compared, never rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, functions as F, types as T

from tessera.session import cut, stored

PLACEHOLDERS = re.compile(
    r"(?:|[\W_]+|n\.?\s*/?\s*a\.?|n\.?\s*n\.?|none|null|nil|nan|unknown|unbekannt|unknow|inconnu\w*|desconocid\w*|not (?:known|given|stated|available|specified|provided|applicable|found|set)|no (?:value|data|information|info|entry)(?: given| available)?|missing|"
    r"keine angabe\w*|k\.?\s*a\.?|nicht (?:angegeben|bekannt|verfügbar)|ohne angabe|fehlt|t\.?\s*b\.?\s*[acd]\.?|to be (?:announced|confirmed|determined|defined)|tba|tbd|tbc|see (?:notes?|above|below|page|website|web ?page|e-?mail|description)|siehe .{1,20}|"
    r"todo|xxx+|pending|undefined|blank|empty|leer|leave blank|value missing|no value given|à préciser|non (?:communiqué|renseigné|précisé)e?|sin (?:datos|información|especificar)|no disponible)",
    re.I,
)
# Short forms in common use that begin otherwise than their name, or need not.
NICKNAMES = {"bill": "william", "bob": "robert", "dick": "richard", "jack": "john", "peggy": "margaret", "liz": "elizabeth", "beth": "elizabeth", "tony": "anthony", "ted": "edward", "fritz": "friedrich", "hans": "johannes", "sepp": "josef", "paco": "francisco", "pepe": "jose", "peg": "margaret", "ned": "edward", "nell": "helen", "polly": "mary", "sally": "sarah", "hank": "henry", "harry": "henry", "chuck": "charles", "lena": "magdalena", "toni": "anton"}

WORDS = {
    "univ": ["university", "universitaet", "universitat", "universite", "universidad", "universita", "univ", "uni", "universities"],
    "tech": ["technical", "technische", "technology", "technological", "tech", "technisch", "techn", "technique", "tecnica", "polytechnic"],
    "techuni": ["techuni", "tu"],
    "applied": ["hochschule", "hochsch", "fachhochschule", "applied", "appl", "sciences", "sci", "science", "angewandte", "wissenschaften", "fh", "hs", "uas"],
    "arts": ["academy", "acad", "akademie", "kunstakademie", "kunstakad", "kunsthochschule", "fine", "arts", "kuenste", "kunste", "kunst"],
    "link": ["of", "de", "der", "die", "das", "the", "for", "fuer", "fur", "and", "und", "des", "du", "la", "le", "institute", "zu", "in", "at"],
}
LOOKUP = {w: k for k, ws in WORDS.items() for w in ws}
COUNTRIES = frozenset("germany deutschland austria osterreich oesterreich switzerland schweiz france spain italy netherlands allemagne de at ch fr es it nl".split())


def fold(text: str) -> str:
    """Lower case without accents; ae, oe and ue as the plain vowel; doubled letters once."""
    t = unicodedata.normalize("NFKC", text).casefold()
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).replace("ø", "o").replace("æ", "ae")
    t = re.sub(r"([aou])e", r"\1", t)
    return re.sub(r"([a-z])\1+", r"\1", t)


FOLDED = {fold(w): k for w, k in LOOKUP.items()} | LOOKUP


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    last2, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last2[j - 2] + 1)
            row.append(d)
        last2, last = last, row
    return last[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    second = [y for y, u in zip(b, used) if u]
    m = len(first)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


SOUNDS = str.maketrans({"p": "b", "f": "v", "w": "v", "t": "d", "k": "g", "c": "g", "q": "g", "z": "s", "x": "s", "y": "i", "j": "i"})


def sounds(token: str) -> str:
    """Consonant sounds in order, voiced and unvoiced alike, repeats once."""
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[aeiouh]", "", token.translate(SOUNDS)))


def block_codes(token: str, cut_off: bool) -> list[str]:
    """Codes of which two spellings of one token share at least one.

    Phonetic: the sounds of the token, and its first and last four, each sorted, so that swapped
    letters do not matter; and its head and tail with one letter left out, for a lost or wrong one.
    """
    s = sounds(token)
    head, tail = token[:5], token[-5:]
    out = {"b" + "".join(sorted(s[:4])), "d" + head, *("d" + head[:i] + head[i + 1 :] for i in range(len(head)))}
    if not cut_off:
        out |= {"e" + "".join(sorted(s[-4:])), "s" + "".join(sorted(set(s))), "t" + tail, *("t" + tail[:i] + tail[i + 1 :] for i in range(len(tail)))}
    return sorted(out)


@lru_cache(maxsize=200_000)
def word_kind(token: str) -> str | None:
    """Which of the fixed words a folded token is, allowing for a typing error in longer ones."""
    if token in FOLDED:
        return FOLDED[token]
    if len(token) >= 4:
        for w, k in FOLDED.items():
            if len(w) >= 6 and abs(len(w) - len(token)) <= 2 and edits(token, w) <= (1 if len(w) < 7 else 2) and len(token) >= len(w) - 2:
                return k
            if len(w) in (4, 5) and abs(len(w) - len(token)) <= 1 and edits(token, w) == 1 and sorted(w)[:3] == sorted(token)[:3]:
                return k
    return None


#: Short words that a typing error leaves hard to tell.
SHORT = {"univ": "univ", "uni": "univ", "tech": "tech", "uas": "applied", "apl": "applied"}


@lru_cache(maxsize=100_000)
def short_kind(token: str) -> str | None:
    """The short word that a token of up to four letters is an edit away from; initials of a patron end in u."""
    if token == "ut":
        return "techuni"
    if token in ("sh", "hf"):
        return "applied"
    if len(token) < 2 or len(token) > 5 or token.endswith("u"):
        return None
    return next((k for w, k in SHORT.items() if edits(token, w) == 1 and (len(token) <= len(w) or token[0] == w[0] or w == "apl")), None)

PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "place", "patron", "given", "initials")] + [T.StructField("place_cut", T.BooleanType()), T.StructField("patron_cut", T.BooleanType())])


def parse(name: str | None) -> dict | None:
    """kind (tech, applied, arts, univ, named, lone), place, patron, given name and initials; None for a placeholder.

    ``named`` has a patron; ``lone`` is one proper word before the word for university: a place or a patron.
    A proper word that ends in a dot is cut off.
    """
    if name is None:
        return None
    text = unicodedata.normalize("NFKC", name)
    text = re.sub(r"\s+", " ", text).strip()
    if PLACEHOLDERS.fullmatch(text):
        return None
    text = re.sub(r"\s+-\s+[a-z ]*official[a-z ]*$", "", text, flags=re.I)
    text = re.sub(r"(?i)\bT\.\s?U\.|\bT\. U\.", "TU", text)
    text = re.sub(r"(?i)\bU\.\s?A\.\s?S\.", "UAS", text)
    text = re.sub(r"(?i)\bF\.\s?H\.", "FH", text)
    text = re.sub(r"(?i)\bU\.?(?=\s+[a-z]{1,3}\s)", "Uni", text)
    raw = re.findall(r"\(|\)|,|/|[^\s(),/\-–]+|[\-–]", text)
    items: list[tuple[str, str, bool]] = []  # folded token, its kind, cut off
    depth = 0
    for i, tok in enumerate(raw):
        if tok in "(),/-–":
            items.append((tok, "mark", False))
            continue
        cut_off = tok.endswith(".")
        letters = re.sub(r"[^\w]", "", tok)
        bare = fold(letters)
        if not bare:
            continue
        kind = word_kind(bare) or word_kind(letters.casefold()) or short_kind(bare)
        if cut_off and kind is None and any(len(w) >= 4 and w.startswith(bare) and len(bare) >= 3 for w in FOLDED):
            kind = next(FOLDED[w] for w in FOLDED if len(w) >= 4 and w.startswith(bare))
        if kind is None and bare in COUNTRIES and items:
            continue
        if bare == "u" and not cut_off:
            kind = "techuni" if raw[i - 1 : i] == ["("] else "univ"
        if kind is None and len(bare) <= 2 and not cut_off and not bare.endswith("u"):
            kind = "link"
        items.append((bare, kind or "proper", cut_off))
    kinds = [k for _, k, _ in items]
    proper = [(i, t, c) for i, (t, k, c) in enumerate(items) if k == "proper"]
    # a place said twice: "Tech. Univ. X / X"
    seen: list[tuple[int, str, bool]] = []
    for i, t, c in proper:
        same = next((k for k, (_, s, sc) in enumerate(seen) if t == s or (len(t) > 4 and edits(t, s) <= 1) or (sc and len(s) >= 3 and edits(s, t[: len(s)]) <= 1)), None)
        if same is None:
            seen.append((i, t, c))
        elif seen[same][2]:  # the whole word instead of the cut-off one
            seen[same] = (seen[same][0], t, c)
    proper = seen
    out = {"kind": None, "place": None, "patron": None, "given": None, "initials": None, "place_cut": False, "patron_cut": False}
    if "arts" in kinds:
        out["kind"] = "arts"
    elif "tech" in kinds or "techuni" in kinds:
        out["kind"] = "tech"
    elif "applied" in kinds:
        out["kind"] = "applied"
    elif "univ" in kinds:
        out["kind"] = "univ"
    if out["kind"] in ("arts", "tech", "applied"):
        if not proper:
            return None
        long = [p for p in proper if len(p[1]) > 4] or proper
        out["place"] = "".join(t for _, t, _ in long)
        out["place_cut"] = long[-1][2]
        return out
    acronym = [p for p in proper if len(p[1]) <= 4 and (p[1].endswith("u") or len(p[1]) == 3) and not p[2]]
    if out["kind"] is None:
        rest = [p for p in proper if p not in acronym]
        if acronym and rest:
            out |= {"kind": "named", "initials": acronym[0][1], "place": rest[-1][1], "place_cut": rest[-1][2]}
            return out
        if not proper:
            return None
        return out | {"kind": "other", "place": "".join(t for _, t, _ in proper)}
    if not proper:
        return None
    at = kinds.index("univ")
    before = [p for p in proper if p[0] < at]
    after = [p for p in proper if p[0] > at]
    opened = next((i for i, (t, k, _) in enumerate(items) if k == "mark" and t == "("), None)
    inside = [p for p in after if opened is not None and p[0] > opened]
    after = [p for p in after if p not in inside]
    between = [t for t, k, _ in items[before[0][0] : before[-1][0]] if k == "mark"] if len(before) > 1 else []
    if inside and len(before) >= 1 and not after:  # P, G University (Z)
        people, place = (before[::-1] if "," in between else before), inside
    elif inside and after:  # University Z (G P)
        people, place = inside, after
    elif len(before) >= 1 and after:  # G P University of Z
        people, place = before, after
    elif len(after) >= 2:  # Univ. P, Z
        people, place = after[:-1], after[-1:]
    elif len(before) >= 2:  # G P Univ.
        comma = next((i for i, (t, k, _) in enumerate(items) if k == "mark" and t == ","), None)
        people, place = before, []
        if comma is not None and comma < at:
            people, place = [], before
    elif before:
        comma = any(t == "," and k == "mark" for t, k, _ in items) or any(t == "of" for t, _, _ in items[at:])
        return out | {"kind": "univ" if comma else "lone", "place": before[0][1], "place_cut": before[0][2]}
    else:
        return out | {"kind": "univ", "place": after[0][1], "place_cut": after[0][2]}
    if not people:
        return out | {"kind": "univ", "place": "".join(t for _, t, _ in place), "place_cut": place[-1][2]}
    out["kind"] = "named"
    out["patron"], out["patron_cut"] = people[-1][1], people[-1][2]
    if len(people) > 1:
        out["given"] = people[0][1]
    if place:
        out["place"], out["place_cut"] = place[-1][1], place[-1][2]
    return out


def given_initial(given: str | None) -> str | None:
    """First letter of a given name; a nickname counts as the name it stands for."""
    return NICKNAMES.get(given, given)[0] if given else None


#: Of two accepted spellings the rarer is a variant if the other is this many times as frequent.
CLEAR = 4
#: Share of the level of its field (the uses of the word a name has, on average) below which a spelling is rare.
RARE = 0.5


def alike(a: str, b: str, cut_a: bool, cut_b: bool, uses_a: float, uses_b: float) -> float:
    """How sure spelling ``a`` is meant for ``b``, 0 for not: Jaro-Winkler with a bound on the edits.

    ``uses``: how often a spelling stands in names as a share of the level of its field, so that nothing
    here changes when all counts grow alike.  Two spellings that are both in common use are two words,
    unless one is far more frequent; a spelling more than an edit away must be far rarer.
    """
    if a == b:
        return 1.0
    if cut_a or cut_b:
        short, long = (a, b) if (cut_a and len(a) <= len(b)) or not cut_b else (b, a)
        if len(short) < 4 or len(long) < len(short) - 1:
            return 0.0
        if long.startswith(short):
            return 0.99
        d = min(edits(short, long[:k]) for k in range(len(short) - 1, min(len(long), len(short) + 1) + 1))
        return 0.95 - 0.05 * d if d <= 1 or (d == 2 and len(short) >= 7 and short[0] == long[0]) else 0.0
    if uses_a >= RARE and uses_b < CLEAR * uses_a:
        return 0.0
    d, n = edits(a, b), min(len(a), len(b))
    if n < 5:  # function words of titles: "fro" for "for"
        return 0.85 if d == 1 and uses_b >= 20 * uses_a and n >= 2 else 0.0
    score = jaro_winkler(a, b)
    # swapped first letters cost Jaro-Winkler its prefix
    if d == 1:
        return max(score, 0.9)
    if uses_a >= RARE / 2 and uses_b < (CLEAR + 1) * uses_a:
        return 0.0
    if d == 2 and n >= 7 and score >= 0.82:
        return score - 0.05
    if d == 3 and n >= 8 and score >= 0.92:
        return score - 0.12
    return 0.0


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the graph of ``edges`` (a, b strings), both ways.

    Alternating large-star and small-star steps keep the edges linear in number and end, after
    a logarithmic number of rounds, when a round changes nothing; each is cut to the shared folder.
    """
    both = edges.filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    current = cut(both)
    before = None
    while True:
        # large star: larger neighbours go to the smallest neighbour
        around = current.select(F.col("low").alias("n"), F.col("high").alias("m")).unionByName(current.select(F.col("high").alias("n"), F.col("low").alias("m")))
        least = around.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
        large = around.join(least, "n").filter("m > n").select(F.col("least").alias("low"), F.col("m").alias("high")).filter("low <> high").distinct()
        # small star: smaller neighbours and the node itself go to the smallest one
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = large.join(least, "high")
        small = small.select(F.col("least").alias("x"), F.col("low").alias("y")).unionByName(small.select(F.col("least").alias("x"), F.col("high").alias("y")))
        current = cut(small.filter("x <> y").select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct())
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).collect()[0])
        if now == before:
            break
        before = now
    return current.select(F.col("high").alias("node"), F.col("low").alias("component"))


def tasks_of(df: DataFrame) -> int:
    """Tasks for Python work on few bytes, which would otherwise be laid together into one.

    Never the number of shuffle partitions: a repartition equal to the shuffle before it is dropped.
    """
    spark = df.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    return tasks + (tasks == int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_names(names: DataFrame) -> DataFrame:
    """name and its parts for every distinct name that is no placeholder."""
    schema = T.StructType([T.StructField("name", T.StringType()), *PARSED.fields, T.StructField("initial", T.StringType())])

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for name in batch["name"]:
                got = parse(name)
                if got:
                    rows.append({"name": name} | got | {"initial": given_initial(got["given"])})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return names.filter("name is not null").select("name").distinct().repartition(tasks_of(names), "name").mapInPandas(read, schema)


def name_spellings(read: DataFrame) -> DataFrame:
    """Distinct (field, token, is_cut) of places by kind, and of patrons, with the number of names that have it."""
    uncut = read.filter("place is not null and not place_cut").groupBy(F.col("place").alias("token")).agg(F.count(F.lit(1)).alias("uses"))
    kind = F.when(F.col("kind") == "lone", "univ").otherwise(F.col("kind"))
    places = read.filter("place is not null").select(F.concat(F.lit("place|"), kind).alias("field"), F.col("place").alias("token"), F.col("place_cut").alias("is_cut")).distinct()
    places = places.join(uncut, "token", "left")
    patrons = read.filter("patron is not null").groupBy(F.lit("patron").alias("field"), F.col("patron").alias("token"), F.col("patron_cut").alias("is_cut")).agg(F.count(F.lit(1)).alias("uses"))
    lone = read.filter("kind = 'lone'").groupBy(F.lit("patron").alias("field"), F.col("place").alias("token"), F.col("place_cut").alias("is_cut")).agg(F.count(F.lit(1)).alias("uses"))
    return (
        places.select("field", "token", "is_cut", "uses")
        .unionByName(patrons)
        .unionByName(lone)
        .groupBy("field", "token")
        .agg(F.bool_and("is_cut").alias("is_cut"), F.sum(F.coalesce("uses", F.lit(0))).alias("uses"))
    )


#: What the level of a field counts for: titles share few words, so a word's level is far above that of most words in use.
LEVELS = {"word": 0.125}
#: Spellings of a block beyond which it is split by finer codes.
BLOCK = 2000


def finer_codes(token: str, cut_off: bool) -> list[str]:
    """Codes within a large block: the token, and its beginnings where words are cut off, with up to two letters left out.

    Spellings two edits apart share one, so a block split by them loses no pair at that distance; of pairs
    three edits apart (long words) those with the same first or last half stay together.
    """
    out = {token}
    for base in {token, *(token[:k] for k in range(4, len(token)))} if cut_off else {token}:
        one = {base[:i] + base[i + 1 :] for i in range(len(base))}
        out |= {base} | one
        if len(base) >= 7:
            out |= {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}
    half = len(token) // 2
    if len(token) >= 8:
        out |= {"^" + token[:half], "$" + token[-half:]}
    return sorted(out)


def spelling_clusters(spellings: DataFrame) -> DataFrame:
    """field, token, cluster: connected components of all accepted pairs of spellings (``spellings``: field, token, is_cut, uses).

    An accepted pair is left out only where it would join two words: a spelling close to several
    words that are no variants of each other goes with the best of them.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def codes(tokens, cuts):
        import pandas as pd

        return pd.Series([block_codes(t, bool(c)) for t, c in zip(tokens, cuts)])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def finer(tokens, cuts):
        import pandas as pd

        return pd.Series([finer_codes(t, bool(c)) for t, c in zip(tokens, cuts)])

    @F.pandas_udf(T.DoubleType())
    def score(a, b, ca, cb, ua, ub):
        import pandas as pd

        return pd.Series([alike(*x) for x in zip(a, b, ca, cb, ua, ub)], dtype="float64")

    tasks = tasks_of(spellings)
    # the level of a field: how many names have the spelling that a name has, on average
    level = spellings.groupBy("field").agg((F.sum(F.col("uses") * F.col("uses")) / F.greatest(F.sum("uses"), F.lit(1))).alias("level"))
    for field, factor in LEVELS.items():
        level = level.withColumn("level", F.when(F.col("field") == field, F.col("level") * factor).otherwise(F.col("level")))
    rated = spellings.join(F.broadcast(level), "field").withColumn("uses", F.col("uses") / F.greatest("level", F.lit(1.0))).drop("level")  # one row a field
    coded = stored(rated.repartition(tasks, "field", "token").select("*", F.explode(codes("token", "is_cut")).alias("code")))
    large = coded.groupBy("field", "code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("field", "code")
    if not large.isEmpty():
        parted = coded.join(large, ["field", "code"], "left_semi").repartition(tasks, "field", "token").withColumn("fine", F.explode(finer("token", F.lit(True))))
        fine = parted.withColumn("code", F.concat_ws("|", "code", "fine")).drop("fine")
        coded = coded.join(large, ["field", "code"], "left_anti").unionByName(fine)
    columns = ("token", "is_cut", "uses")
    weak = coded.select("field", "code", *[F.col(c).alias(c + "_a") for c in columns])
    other = coded.select("field", "code", *[F.col(c).alias(c + "_b") for c in columns])
    # a rarer spelling looks for the word it is meant for; what lengths rule out is not asked in Python
    far = F.abs(F.length("token_a") - F.length("token_b")) > 3
    pairs = weak.join(other, ["field", "code"]).filter(~far | F.col("is_cut_a") | F.col("is_cut_b")).filter("token_a <> token_b").filter(F.col("is_cut_a") | (F.col("uses_a") < RARE) | (F.col("uses_b") >= CLEAR * F.col("uses_a"))).drop("code").distinct()
    scored = pairs.repartition(tasks, "field", "token_a").withColumn("score", score("token_a", "token_b", "is_cut_a", "is_cut_b", "uses_a", "uses_b")).filter("score > 0")
    # words in use first; cut-off spellings link only to whole ones
    accepted = stored(scored.filter("not (is_cut_b and not is_cut_a)"))
    rank = F.struct((F.col("uses_b") >= F.col("uses_a")) & (F.col("uses_b") >= RARE / 2), F.col("score"), F.col("uses_b"), F.col("token_b"))
    best = accepted.groupBy("field", "token_a").agg(F.max(F.struct(rank, F.col("token_b").alias("of"), F.col("uses_b").alias("best_uses"))).alias("m")).select("field", "token_a", "m.of", "m.best_uses")
    # beside the best: a partner that is itself no rival of it, being no word of its own
    tied = accepted.join(best, ["field", "token_a"]).filter((F.col("token_b") == F.col("of")) | ((F.col("uses_b") < RARE) & ~F.col("is_cut_a") & (F.col("score") >= 0.9) & (F.col("best_uses") < RARE)))
    key = lambda c: F.concat_ws("|", "field", c)
    grouped = components(tied.select(key("token_a").alias("a"), key("token_b").alias("b")))
    return (
        spellings.withColumn("node", key("token"))
        .join(grouped, "node", "left")
        .select("field", "token", F.coalesce("component", "node").alias("cluster"))
    )


def link_names(names: DataFrame) -> DataFrame:
    """name, entity for every distinct name that is no placeholder (``names``: name string).

    Null names and placeholders have no entity; names that differ only in case or blanks are
    different strings of one entity; an empty table gives an empty one.
    """
    read = cut(read_names(names))
    return entities(read, cut(spelling_clusters(name_spellings(read))))


def entities(read: DataFrame, clusters: DataFrame) -> DataFrame:
    """name, entity of the names of ``read_names`` with their spellings clustered."""
    place = clusters.filter("field like 'place|%'").select(F.col("field").alias("pf"), F.col("token").alias("place"), F.col("cluster").alias("place_id"))
    patron = clusters.filter("field = 'patron'").select(F.col("token").alias("patron"), F.col("cluster").alias("patron_id"))
    kind = F.when(F.col("kind") == "lone", "univ").otherwise(F.col("kind"))
    got = (
        read.withColumn("patron", F.when(F.col("kind") == "lone", F.col("place")).otherwise(F.col("patron")))
        .withColumn("pf", F.concat(F.lit("place|"), kind))
        .join(place, ["pf", "place"], "left")
        .join(patron, "patron", "left")
    )
    got = cut(got.select("name", "kind", "place_id", "patron_id", "initials", "initial", F.substring("patron", 1, 1).alias("patron_initial")))
    # what stands under a patron in full
    named = got.filter("kind = 'named' and patron_id is not null").select("patron_id").distinct().withColumn("has_patron", F.lit(True))
    plain = got.filter("kind = 'univ'").select("place_id").distinct().withColumn("has_place", F.lit(True))
    # the place of a patron, for names without one: of the same given name or initial first
    seats = got.filter("kind = 'named' and patron_id is not null and place_id is not null").groupBy("patron_id", "place_id").agg(F.count(F.lit(1)).alias("n"))
    seat = seats.groupBy("patron_id").agg(F.max(F.struct("n", "place_id")).alias("s")).select("patron_id", F.col("s.place_id").alias("seat"))
    placed = got.filter("kind = 'named' and patron_id is not null and place_id is not null")
    own = placed.filter("initial is not null").groupBy("patron_id", "initial", "place_id").agg(F.count(F.lit(1)).alias("n"))
    seat_by_given = own.groupBy("patron_id", "initial").agg(F.max(F.struct("n", "place_id")).alias("s")).select("patron_id", "initial", F.col("s.place_id").alias("seat_by_given"))
    # the patron of a place, for initials: one whose name begins with the letter before the u first
    holders = seats.groupBy("place_id").agg(F.max(F.struct("n", "patron_id")).alias("h")).select("place_id", F.col("h.patron_id").alias("holder"))
    by_letter = placed.groupBy("place_id", "patron_initial", "patron_id").agg(F.count(F.lit(1)).alias("n"))
    by_letter = by_letter.groupBy("place_id", "patron_initial").agg(F.max(F.struct("n", "patron_id")).alias("h")).select("place_id", F.col("patron_initial").alias("letter"), F.col("h.patron_id").alias("holder_by_letter"))
    full = (
        got.join(named, "patron_id", "left")
        .join(plain, "place_id", "left")
        .join(seat, "patron_id", "left")
        .join(holders, "place_id", "left")
        .join(seat_by_given, ["patron_id", "initial"], "left")
        .withColumn("letter", F.substring("initials", -2, 1))
        .join(by_letter, ["place_id", "letter"], "left")
    )
    by_patron = F.col("patron_id").isNotNull() & ((F.col("kind") == "named") | ((F.col("kind") == "lone") & F.col("has_patron") & F.col("has_place").isNull()))
    own_seat = F.when(F.col("kind") == "named", F.col("place_id"))
    entity = (
        F.when(F.col("initials").isNotNull(), F.concat_ws("|", F.lit("named"), F.coalesce("holder_by_letter", "holder", F.concat(F.lit("?"), "initials")), "place_id"))
        .when(by_patron, F.concat_ws("|", F.lit("named"), "patron_id", F.coalesce(own_seat, "seat_by_given", "seat", F.lit("?"))))
        .otherwise(F.col("place_id"))
    )
    return full.select("name", entity.alias("entity"))


def institution_names(candidates: DataFrame, batch: DataFrame, seeds: DataFrame) -> DataFrame:
    """The distinct names of the three fields, exactly as stored."""
    ok = F.expr("try_parse_json(normalized_data) is not null")
    return (
        candidates.filter(ok).select(F.get_json_object("normalized_data", "$.university_name").alias("name"))
        .unionByName(batch.select(F.col("expected_university_name").alias("name")))
        .unionByName(seeds.select(F.col("institution_name").alias("name")))
        .filter("name is not null")
        .distinct()
    )


#: Names that one task pairs with all names of their entity.
PAIRED_AT_ONCE = 256


def name_pairs(linked: DataFrame) -> DataFrame:
    """name_a, name_b (a before b by code points) of every two names of one entity.

    The names of an entity are dealt to parts of ``PAIRED_AT_ONCE``; each part meets all names of
    the entity, so a large entity is paired by many tasks.
    """
    sizes = linked.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("entity", F.ceil(F.col("n") / PAIRED_AT_ONCE).cast("int").alias("parts"))
    both = linked.join(sizes, "entity")
    a = both.select("entity", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("part"), F.col("name").alias("name_a"))
    b = both.select("entity", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("name_b"))
    return a.join(b, ["entity", "part"]).filter("name_a < name_b").select("name_a", "name_b").distinct()

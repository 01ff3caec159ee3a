"""Problem 7: variant spellings of names typed by people, by metric-space partitioning."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinscope.llm.common import one
from kinscope.llm.components import connected_components
from kinscope.runtime import materialise, spread

RADIUS = 2
# One pivot for so many stems of an anchor, rounded up; at most PIVOTS of them. The stems a task holds come in chunks of CHUNK_ROWS.
CELL_ROWS, PIVOTS, CHUNK_ROWS = 1_024, 256, 65_536
# An anchor has so many different companions; the ANCHORS with the most serve as pivots of the first level.
COMPANIONS, ANCHORS = 5, 4_096
# A short form is learnt from so many stems, and that share of the stems it stands beside.
SEEN_WITH, SEEN_SHARE = 3, 0.02

# Words that decorate a name and do not tell whose it is.
DECORATION = "the a an group team crew gang cluster alias aka op operation mr mrs ms miss dr prof actor unknown unattributed unnamed none".split()
# Letters that a decomposition to base letters leaves as they are.
LETTERS = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th"}
# Digits that stand for letters inside a word.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
# Usual short forms of the commonest first names of the United States census of 1990. Others are learnt from the table.
SHORT_FORMS = {
    "albert": "al bert",
    "alexander": "alex",
    "amanda": "mandy",
    "andrew": "andy drew",
    "angela": "angie",
    "anthony": "tony",
    "arthur": "art",
    "barbara": "barb",
    "benjamin": "ben benny",
    "carolyn": "carol",
    "catherine": "cathy",
    "charles": "charlie chuck",
    "christine": "chrissy tina",
    "christopher": "chris",
    "cynthia": "cindy",
    "daniel": "dan danny",
    "david": "dave davy",
    "deborah": "deb debbie",
    "donald": "don donnie",
    "dorothy": "dot dottie",
    "douglas": "doug",
    "edward": "ed eddie ted",
    "elizabeth": "beth betty liz",
    "frances": "fran",
    "frederick": "fred freddie",
    "gerald": "gerry jerry",
    "gregory": "greg",
    "henry": "hank",
    "jacqueline": "jackie",
    "james": "jamie jim jimmy",
    "jeffrey": "jeff",
    "jennifer": "jen jenny",
    "jessica": "jess",
    "john": "jack johnny",
    "jonathan": "jon",
    "joseph": "joe joey",
    "joshua": "josh",
    "judith": "judy",
    "katherine": "kate katie kathy",
    "kenneth": "ken kenny",
    "kimberly": "kim",
    "lawrence": "larry",
    "margaret": "maggie meg peggy",
    "mary": "molly",
    "matthew": "matt",
    "michael": "mick mike mikey",
    "nicholas": "nick",
    "pamela": "pam",
    "patricia": "pat patty trish",
    "peter": "pete",
    "raymond": "ray",
    "rebecca": "becky",
    "richard": "dick rich rick",
    "robert": "bob bobby rob",
    "ronald": "ron",
    "samuel": "sam sammy",
    "sandra": "sandy",
    "stephanie": "steph",
    "steven": "steve",
    "susan": "sue susie",
    "theresa": "terry",
    "thomas": "tom tommy",
    "timothy": "tim",
    "victoria": "vicky",
    "virginia": "ginny",
    "walter": "walt",
    "william": "bill billy will",
}

_CODE = re.compile(r"([a-z]{2,5})[\s_/\-.]?(\d{4,})")
_WORD = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])")


def words_of(name: str) -> tuple[str | None, list[str]]:
    """(code, words) of a typed name: a code such as abc1234 in any notation, or its words in base letters.

    Case, accents, separators, digits for letters inside words, a capital in mid-word and decorating words do not count.
    """
    text = _HUMP.sub(" ", unicodedata.normalize("NFKC", name).strip())
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    text = "".join(LETTERS.get(c, c) for c in text)
    if m := _CODE.fullmatch(text.strip()):
        return m[1] + m[2], []
    out = []
    for w in _WORD.findall(text):
        if any(c.isalpha() for c in w):
            w = "".join(DIGITS.get(c, c) for c in w) if len(w) > 2 else w
        elif w.isdigit():
            continue
        if w not in DECORATION:
            out.append(w)
    return None, out


def distances(texts: list[str], pivot: str) -> np.ndarray:
    """Levenshtein distance of each text to the pivot: one row of the table for all texts at a time."""
    n = max((len(t) for t in texts), default=0)
    chars = np.zeros((len(texts), n), np.uint32)
    for i, t in enumerate(texts):
        chars[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    row = np.tile(np.arange(n + 1, dtype=np.int32), (len(texts), 1))
    step = np.arange(n + 1, dtype=np.int32)
    for i, c in enumerate(pivot, 1):
        new = np.empty_like(row)
        new[:, 0] = i
        new[:, 1:] = np.minimum(row[:, :-1] + (chars != ord(c)), row[:, 1:] + 1)
        # Insertions run along the row: a running minimum of value minus place.
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row[np.arange(len(texts)), [len(t) for t in texts]]


def _grams(texts: list[str]) -> np.ndarray:
    """64 bits of each text's neighbouring letter pairs; an edit changes at most four of them."""
    out = np.zeros(len(texts), np.uint64)
    for i, t in enumerate(texts):
        bits = 0
        for a, b in zip("^" + t, t + "$"):
            bits |= 1 << (ord(a) * 31 + ord(b) * 17) % 61
        out[i] = bits
    return out


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, one row a text, and lengths)."""
    size = np.array([len(t) for t in texts], np.int64)
    chars = np.zeros((len(texts), int(size.max()) if len(texts) else 0), np.uint32)
    for i, t in enumerate(texts):
        chars[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    return chars, size


def pair_distances(chars: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the pairs (a, b) of rows of `letters`: one row of every pair's table at a time."""
    out = np.empty(len(a), np.int32)
    for lo in range(0, len(a), 1 << 16):
        own = slice(lo, lo + (1 << 16))
        x, n, y, m = chars[a[own]], size[a[own]], chars[b[own]], size[b[own]]
        y = y[:, : int(m.max())]
        step = np.arange(y.shape[1] + 1, dtype=np.int32)
        row = np.tile(step, (len(x), 1))
        for i in range(int(n.max())):
            new = np.empty_like(row)
            new[:, 0] = i + 1
            new[:, 1:] = np.minimum(row[:, :-1] + (y != x[:, i, None]), row[:, 1:] + 1)
            # Insertions run along the row: a running minimum of value minus place.
            new = np.minimum.accumulate(new - step, axis=1) + step
            row = np.where((i < n)[:, None], new, row)
        out[own] = row[np.arange(len(x)), m]
    return out


def _near(texts: list[str], first: np.ndarray, second: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a text of `first` and one of `second` within the distance `radius` (1 for texts below 7 letters).

    Lengths and pair sketches bound the distance from below, so they come first; survivors are decided by the distance.
    """
    chars, size = letters(texts)
    grams = _grams(texts)
    first, second = first[np.argsort(size[first], kind="stable")], second[np.argsort(size[second], kind="stable")]
    found = []
    for lo in range(0, len(first), 256):
        own = first[lo : lo + 256]
        low, high = np.searchsorted(size[second], [size[own[0]] - radius, size[own[-1]] + radius + 1])
        i, j = np.nonzero(np.bitwise_count(grams[own, None] ^ grams[None, second[low:high]]) <= 4 * radius)
        a, b = own[i], second[low + j]
        near = np.abs(size[a] - size[b]) <= radius
        a, b = a[near], b[near]
        # Short stems bear fewer slips.
        near = pair_distances(chars, size, a, b) <= np.where(np.minimum(size[a], size[b]) >= 7, radius, 1)
        found.append((a[near], b[near]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def radius_join(df: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(anchor, x, y, guest): pairs of different stems of one anchor within the edit distance `radius` (1 for stems below 7 letters).

    df: distinct (anchor, stem, guest). The names of an anchor lie within the edit distance of their stems, which is a
    metric. An anchor of n stems gets n / cell_rows pivots, rounded up: stems of the table with the lowest hashes, the
    same for all anchors. A stem is at home with its nearest pivot and visits every pivot at most 2 * radius farther: by
    the triangle inequality each pair within the radius then meets in the home of either, and it counts in the home of
    the lower stem. The visitors of a cell come in chunks of bounded size, each to a task of its own with those at home.
    Every pair is decided by the true distance. Two guests make no pair; `guest` tells that one of the two is one (x).
    """
    sizes = df.groupBy("anchor").count()
    cells = F.least(F.ceil(F.col("count") / cell_rows), F.lit(PIVOTS)).cast("int")
    sized = df.join(sizes, "anchor").select("anchor", "stem", "guest", cells.alias("cells"), F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks"))
    # At most PIVOTS texts.
    pivots = [r["stem"] for r in df.select("stem").distinct().orderBy(F.xxhash64("stem"), "stem").limit(PIVOTS).collect()]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            stem, cells, chunks = b.column("stem").to_pylist(), np.minimum(np.asarray(b.column("cells")), len(pivots)), np.asarray(b.column("chunks"), np.int64)
            own = np.flatnonzero(cells == 1)
            parts = [(own, np.zeros(len(own), np.int64), np.ones(len(own), bool))]
            many = np.flatnonzero(cells > 1)
            if len(many):
                d = np.stack([distances([stem[i] for i in many], p) for p in pivots[: cells.max()]], axis=1)
                d[np.arange(d.shape[1])[None] >= cells[many, None]] = 1 << 20
                i, c = np.nonzero(d <= d.min(axis=1, keepdims=True) + 2 * radius)
                parts.append((many[i], c, d.argmin(axis=1)[i] == c))
            row, cell, home = (np.concatenate(p) for p in zip(*parts))
            mark = np.array([xxhash.xxh32_intdigest(s) for s in stem], np.int64) % chunks
            # Those at home meet all chunks of visitors; a visitor is in one chunk, those at home included.
            times = np.where(home, chunks[row], 1)
            again = np.repeat(np.arange(len(row)), times)
            chunk = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times)
            row, cell, home = row[again], cell[again], home[again]
            chunk = np.where(home, chunk, mark[row])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("anchor").take(at), b.column("stem").take(at), b.column("guest").take(at), pa.array(cell.astype(np.int32)), pa.array(chunk.astype(np.int32)), pa.array(home), pa.array(chunk == mark[row])], names=["anchor", "stem", "guest", "cell", "chunk", "home", "visits"])

    def join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = one(it)
        if t is None:
            return
        t = t.sort_by([("anchor", "ascending"), ("cell", "ascending"), ("chunk", "ascending"), ("stem", "ascending")]).combine_chunks()
        code = np.asarray(t.column("anchor").chunk(0).dictionary_encode().indices)
        cell, chunk, home, visits, guest = (np.asarray(t.column(c)) for c in ("cell", "chunk", "home", "visits", "guest"))
        cut = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1]), True])
        for lo, hi in zip(cut[:-1], cut[1:]):
            if hi - lo < 2:
                continue
            a, b = _near(t.column("stem").slice(lo, hi - lo).to_pylist(), np.flatnonzero(home[lo:hi]), np.flatnonzero(visits[lo:hi]), radius)
            a, b = a + lo, b + lo
            # Rows ascend by stem: a pair counts at the home of its lower one.
            ok = (a < b) & ~(guest[a] & guest[b])
            a, b = a[ok], b[ok]
            if len(a):
                x, y = np.where(guest[b], b, a), np.where(guest[b], a, b)
                yield pa.RecordBatch.from_arrays([t.column("anchor").take(pa.array(x)).combine_chunks(), t.column("stem").take(pa.array(x)).combine_chunks(), t.column("stem").take(pa.array(y)).combine_chunks(), pa.array(guest[x])], names=["anchor", "x", "y", "guest"])

    placed = sized.mapInArrow(place, "anchor string, stem string, guest boolean, cell int, chunk int, home boolean, visits boolean")
    return spread(placed, "anchor", "cell", "chunk").mapInArrow(join, "anchor string, x string, y string, guest boolean")


def spellings(df: DataFrame, key: str, name: str, aliases: str) -> DataFrame:
    """(key, form, code, words): each distinct way a record is named, its code or its words."""

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            done = [words_of(f) for f in b.column("form").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("form"), pa.array([c for c, _ in done], pa.string()), pa.array([w for _, w in done], pa.list_(pa.string()))], names=["key", "form", "code", "words"])

    names = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    rows = df.select(F.col(key).cast("string").alias("key"), F.explode(names).alias("form")).where("key is not null and trim(form) <> ''").distinct()
    return rows.mapInArrow(clean, "key string, form string, code string, words array<string>")


class _Anchors:
    """Which anchors each word is, or is a slip of. All words of a batch are held against all anchors at once."""

    def __init__(self, partners: dict[str, int], parent: dict[str, str]) -> None:
        self.partners, self.parent = partners, parent
        self.names = sorted(partners)
        self.grams = _grams(self.names)
        self.known: dict[str, list[str]] = {}

    def root(self, a: str) -> str:
        """The full name of a short form."""
        while a in self.parent:
            a = self.parent[a]
        return a

    def learn(self, words: set[str]) -> None:
        if len(self.known) > 500_000:
            self.known.clear()
        new = sorted(w for w in words if w not in self.known)
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            self.known.update((w, [self.root(w)] if w in self.partners else []) for w in part)
            open_ = [w for w in part if w not in self.partners and len(w) >= 4]
            if open_ and self.names:
                for w, hits in self.slips(open_).items():
                    self.known[w] = list(dict.fromkeys(self.root(a) for _, a in sorted(hits)))

    def slips(self, words: list[str]) -> dict[str, list[tuple[int, str]]]:
        """The anchors within a slip or two of each word, with their distances."""
        grams = _grams(words)
        hits = [np.nonzero(np.bitwise_count(grams[lo : lo + 256, None] ^ self.grams[None]) <= 8) for lo in range(0, len(words), 256)]
        i = np.concatenate([256 * k + h[0] for k, h in enumerate(hits)]) if hits else np.empty(0, np.int64)
        j = np.concatenate([h[1] for h in hits]) + len(words) if hits else i
        chars, size = letters(words + self.names)
        near = np.abs(size[i] - size[j]) <= 2
        i, j = i[near], j[near]
        out: dict[str, list[tuple[int, str]]] = {}
        for w, a, d in zip(i, j, pair_distances(chars, size, i, j)):
            w, a = words[w], self.names[a - len(words)]
            # A long word may bear two slips; in a short one two count only as letters changing places.
            if d <= (2 if len(w) >= 8 and len(a) >= 7 else 1) or (d == 2 and len(w) > 4 and sorted(w) == sorted(a)):
                out.setdefault(w, []).append((int(d), a))
        return out

    def __contains__(self, word: str) -> bool:
        return word in self.partners

    def of(self, word: str) -> str | None:
        """The anchor a word is, or is nearest to."""
        return next(iter(self.known.get(word, [])), None)


def family(partners: dict[str, int], short: dict[str, str]) -> tuple[dict[str, int], dict[str, str]]:
    """(anchors without the common slips and plurals of others, full form of each short form)."""
    own = _Anchors(partners, {})
    # Of a word and its slips the right spelling is far the commonest; a slip is no pivot, it visits all that it may mean.
    slips = {w for w, hits in own.slips([w for w in own.names if len(w) >= 4 and w not in short]).items() if any(5 * partners[w] <= partners[a] for _, a in hits)}
    kept = {w: n for w, n in partners.items() if w not in slips}
    parent = {s: f for s, f in short.items() if s != f and s in kept and f in kept}
    for w in list(parent):
        seen = {w}
        while (up := parent.get(w)) is not None:
            if up in seen:
                del parent[w]
                break
            seen.add(up)
            w = up
    return kept, parent


def _split(words: list[str], anchors: _Anchors) -> tuple[str, str, str, list[str]]:
    """(kind, anchor, stem, further anchors) of a name's words; further ones are those its anchor may be a slip of as well.

    kind 'full': an anchor and a stem. 'initial': a stem with only the anchor's first letter. 'short': the first letters
    of both. Else '': it could be anybody's.
    """
    long = [w for w in words if len(w) > 1]
    if len(long) == len(words) == 1 and len(long[0]) > 9 and anchors.of(long[0]) is None:
        # Two words typed without a space.
        w = long[0]
        for cut in range(len(w) - 3, 2, -1):
            for a, s in ((w[cut:], w[:cut]), (w[:cut], w[cut:])):
                if len(a) >= 4 and len(s) >= 5 and (hit := next((x for x in (a, a.rstrip("s")) if x in anchors), None)):
                    return "full", anchors.root(hit), s, []
    if len(long) >= 2:
        known = [(anchors.partners[a], a, i) for i, w in enumerate(long) if (a := anchors.of(w))]
        if known:
            _, a, i = max(known)
            stem = "".join(sorted(w for j, w in enumerate(long) if j != i))
            if len(stem) >= 5:
                return "full", a, stem, anchors.known[long[i]][1:]
            if len(stem) >= 3 and len(long[i]) >= 3:
                return "short", a[:4], stem[:4], []
            return "", "", "", []
        if all(len(w) <= 4 for w in long) and len(long) == 2:
            return "short", *sorted(long), []
        stem = "".join(sorted(long))
        return ("full", "", stem, []) if len(stem) >= 8 else ("", "", "", [])
    if len(long) == 1 and len(words) == 2 and len(long[0]) >= 5 and long[0] not in anchors:
        return "initial", next(w for w in words if len(w) == 1), long[0], []
    return "", "", "", []


def _companions(raw: DataFrame) -> DataFrame:
    """(word, n): the words that are the commoner one in most of the names of two words they are in, n different companions each.

    Of a first name and a surname, or a noun and the word before it, the one that many different names share is the
    commoner one nearly always; a slip of it, however often typed beside one other word, is not.
    """
    long = F.filter("words", lambda w: F.length(w) > 2)
    two = raw.select(F.array_sort(F.array_distinct(long)).alias("w")).where("size(w) = 2").groupBy(F.col("w")[0].alias("a"), F.col("w")[1].alias("b")).agg(F.count(F.lit(1)).alias("c"))
    two = materialise(two, "name-pairs")
    both = two.select(F.col("a").alias("word"), "c").unionByName(two.select(F.col("b").alias("word"), "c"))
    many = both.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("names")).where(F.col("n") >= COMPANIONS)
    ends = two.join(many.select(F.col("word").alias("a"), F.col("n").alias("na")), "a", "left").join(many.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b", "left")
    up = F.coalesce("na", F.lit(0)) > F.coalesce("nb", F.lit(0))
    won = ends.where("na is not null or nb is not null").groupBy(F.when(up, F.col("a")).otherwise(F.col("b")).alias("word")).agg(F.sum("c").alias("won"))
    return many.join(won, "word").where("2 * won >= names").select("word", "n")


def _learnt(raw: DataFrame, anchors: DataFrame) -> dict[str, str]:
    """Short forms that the table itself shows: two anchors beside the same stem, in one record or under one code.

    A pair counts once a stem. Each anchor gets at most one commoner anchor as its full form: the one it comes with most
    often, beside at least SEEN_WITH stems and SEEN_SHARE of its companions.
    """
    two = raw.withColumn("w", F.array_distinct(F.filter("words", lambda w: F.length(w) > 2))).where("size(w) = 2").select("key", F.explode(F.array(F.struct(F.col("w")[0].alias("a"), F.col("w")[1].alias("s")), F.struct(F.col("w")[1].alias("a"), F.col("w")[0].alias("s")))).alias("x")).select("key", "x.a", "x.s").where("length(s) >= 5")
    # The anchors are at most ANCHORS rows.
    two = two.join(F.broadcast(anchors.toDF("a", "n")), "a").distinct()
    codes = raw.where("code is not null").select("key", "code").distinct()
    same = two.select(F.concat(F.lit("k"), "key").alias("g"), "s", "a", "n").unionByName(two.join(codes, "key").select(F.concat(F.lit("c"), "code").alias("g"), "s", "a", "n"))
    groups = same.groupBy("g", "s").agg(F.max(F.struct("n", "a")).alias("top"), F.collect_set(F.struct("n", "a")).alias("all")).where("size(all) > 1")
    pairs = groups.select("s", "top", F.explode("all").alias("x")).where("x < top").select(F.col("x.a").alias("short"), F.col("x.n").alias("n"), F.col("top.a").alias("full"), "s")
    seen = pairs.groupBy("short", "full").agg(F.countDistinct("s").alias("seen"), F.max("n").alias("n")).where((F.col("seen") >= SEEN_WITH) & (F.col("seen") >= SEEN_SHARE * F.col("n")))
    best = seen.groupBy("short").agg(F.max(F.struct("seen", "full")).alias("b"))
    return {r["short"]: r["b"]["full"] for r in best.collect()}


def same_names(df: DataFrame, key: str, name: str, aliases: str, *, radius: int = RADIUS, cell_rows: int = CELL_ROWS, short_forms: dict[str, str] = SHORT_FORMS) -> tuple[DataFrame, DataFrame]:
    """Which records mean the same person or group: (members, forms).

    members = (key, group): every key that has a telling name or code, with the lowest key of all records joined to it.
    forms = (key, form, node): the telling spellings of each key.

    A name is an anchor, a word that many different names share (a first name, a common noun), and a stem. Anchors are
    the pivots of the first level: words with at least COMPANIONS different companions that are the commoner word in most
    of their names, whatever the table's size; the ANCHORS commonest are used, and names without one are compared whole.
    A name belongs to the anchor its word is, or is nearest to as a slip, and visits all other anchors its word may be a
    slip of. Short forms of first names count as the full ones: those of `short_forms`, and those the table shows
    (`_learnt`). Names of one anchor join where their stems lie within `radius` (`radius_join`, pivots of the second
    level); a visitor joins where nothing is near it at home and it fits one group. Records join through equal or joined
    names and through equal codes. A name with an initial, or with both parts cut short, joins the one full name it
    fits, and nothing if it fits several. A spelling or code that stands beside many unlike names is anybody's and joins
    nothing.
    Null, blank and decorating names link nothing; repeated rows and revisions change nothing; an empty table gives none.
    """
    raw = materialise(spellings(df, key, name, aliases), "spellings")
    spark = raw.sparkSession
    common = _companions(raw).orderBy(F.desc("n"), "word").limit(ANCHORS).collect()
    anchors = {r["word"]: r["n"] for r in common}
    short = {s: full for full, forms in short_forms.items() for s in forms.split()}
    if anchors:
        short |= _learnt(raw, spark.createDataFrame(list(anchors.items()), "word string, n bigint"))
    anchors |= {a: COMPANIONS for a in [*short, *short.values()] if a not in anchors}
    anchors, parent = family(anchors, short)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Anchors(anchors, parent)
        for b in it:
            kinds = []
            own.learn({w for words in b.column("words").to_pylist() for w in words})
            for c, w in zip(b.column("code").to_pylist(), b.column("words").to_pylist()):
                if c is not None:
                    kinds.append(("code", "", c, []))
                else:
                    kinds.append(_split(w, own))
            kind, anchor, stem, more = zip(*kinds) if kinds else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("form"), *[pa.array(c, pa.string()) for c in (kind, anchor, stem)], pa.array(more, pa.list_(pa.string()))], names=["key", "form", "kind", "anchor", "stem", "more"])

    forms = raw.mapInArrow(split, "key string, form string, kind string, anchor string, stem string, more array<string>").where("kind <> ''")
    forms = materialise(forms.withColumn("node", F.concat_ws("|", F.lit("~"), "kind", "anchor", "stem")), "name-forms")
    # Anybody's names: one far-off companion a record is enough to tell, so a record's least and greatest full name stand for all.
    full = forms.where("kind = 'full'")
    ends = full.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min("stem").alias("s1"), F.max("stem").alias("s2"))
    beside = forms.where("kind in ('full', 'code')").select("key", "node", "kind", "stem").distinct().join(ends, "key")
    far = beside.withColumn("other", F.when(F.col("node") == F.col("low"), F.col("high")).otherwise(F.col("low"))).where("node <> other")
    far = far.withColumn("o", F.when(F.col("other") == F.col("low"), F.col("s1")).otherwise(F.col("s2")))
    unlike = F.when(F.col("kind") == "full", F.levenshtein(F.substring_index("other", "|", -1), F.col("stem")) > 4).otherwise(True)
    # Slips seldom touch a stem's first letters, so companions that differ in anchor or there are other names. A group
    # that very many records are about meets a few such by accident; hence the share.
    parts = F.split("other", r"\|")
    companion = F.concat_ws("|", F.get(parts, F.lit(2)), F.substring(F.get(parts, F.lit(3)), 1, 3))
    beside = far.where(unlike).groupBy("node").agg(F.countDistinct(companion).alias("n"), F.count(F.lit(1)).alias("seen"))
    anybody = materialise(beside.where("n >= 8 and n >= 0.1 * seen").select("node"), "anybody")
    telling = materialise(forms.join(anybody, "node", "left_anti"), "telling-names")
    node = lambda s: F.concat_ws("|", F.lit("~"), F.lit("full"), "anchor", s)
    full = telling.where("kind = 'full'").select("anchor", "stem").distinct()
    visits = materialise(telling.where("kind = 'full' and size(more) > 0").select("node", "stem", F.explode("more").alias("anchor")).distinct(), "name-visits")
    placed = full.withColumn("guest", F.lit(False)).unionByName(visits.select("anchor", "stem", F.lit(True).alias("guest"))).groupBy("anchor", "stem").agg(F.bool_and("guest").alias("guest"))
    near = materialise(radius_join(placed, radius, cell_rows), "near-names")
    home = near.where("not guest").select(node("x").alias("u"), node("y").alias("v"))
    edges = telling.where("kind in ('full', 'code')").select(F.col("node").alias("u"), F.concat(F.lit("."), "key").alias("v")).unionByName(home)
    strong = materialise(connected_components(edges), "name-groups")
    # Visitors: those with nothing near them at home, as the stem itself under the other anchor or near one there.
    alone = visits.join(home.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_anti")
    hits = alone.select("node", "anchor", "stem", F.col("stem").alias("to")).unionByName(alone.join(near.where("guest").select("anchor", F.col("x").alias("stem"), F.col("y").alias("to")), ["anchor", "stem"]))
    adopted = hits.select(F.col("node").alias("v"), node("to").alias("node")).join(strong, "node").groupBy("v").agg(F.min("root").alias("u"), F.max("root").alias("last")).where("u = last").select("u", "v")
    # Cut-down forms: of all full names only the groups they fit matter; one group or none.
    groups = full.withColumn("node", node("stem")).join(strong, "node").select("anchor", "stem", "root")
    first = groups.select(F.concat_ws("|", F.lit("~"), F.lit("initial"), F.substring("anchor", 1, 1), "stem").alias("weak"), "root")
    a4, s4 = F.substring("anchor", 1, 4), F.substring("stem", 1, 4)
    cut = groups.select(F.explode(F.array(F.concat_ws("|", F.lit("~"), F.lit("short"), a4, s4), F.concat_ws("|", F.lit("~"), F.lit("short"), F.least(a4, s4), F.greatest(a4, s4)))).alias("weak"), "root")
    fits = first.unionByName(cut).groupBy("weak").agg(F.min("root").alias("root"), F.max("root").alias("last")).where("root = last").select("weak", "root")
    weak = telling.where("kind in ('initial', 'short')").select("key", F.col("node").alias("weak")).distinct().join(fits, "weak").select(F.col("root").alias("u"), F.concat(F.lit("."), "key").alias("v"))
    joined = connected_components(strong.select(F.col("root").alias("u"), F.col("node").alias("v")).unionByName(weak).unionByName(adopted))
    own = joined.where("node like '.%'").select(F.substring("node", 2, 1 << 30).alias("key"), "root")
    lead = own.groupBy("root").agg(F.min("key").alias("group"))
    return own.join(lead, "root").select("key", "group"), telling.select("key", "form", "node")

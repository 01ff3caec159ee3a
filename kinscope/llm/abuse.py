"""Problem 10: abusive, hateful or sexual content, by a counterfactually regularised classifier of sentences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMS = 1 << 18
LABELLED_DOCUMENTS = 4_000
COUNTERFACTUAL = 4.0
ROUNDS, STEPS, HOLD = 4, 40, 0.2
# The weight that strong words start with.
STRONG_START = 15.0
# A sentence without any known feature is clean: the bias is not learned.
BIAS = -2.5

# Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("авекмнорстухіјѕԁһɡοαερυνικτ", "abekmhopctyxijsdhgoaepuvikt"))
# Signs that stand for letters inside a word.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "€": "e", "!": "i"}
# Words for groups of people. A neutral mention of one must score as a mention of any other.
GROUPS = {
    "en": "women men girls boys muslims jews christians hindus believers atheists gays lesbians immigrants migrants refugees foreigners strangers disabled blacks whites asians arabs gypsies poor old".split(),
    "de": "frauen männer mädchen muslime juden christen gläubige schwule lesben ausländer migranten flüchtlinge fremde behinderte schwarze weiße alte arme".split(),
    "fr": "femmes hommes filles musulmans juifs chrétiens croyants gays lesbiennes étrangers migrants réfugiés immigrés handicapés noirs blancs vieux pauvres".split(),
    "es": "mujeres hombres chicas musulmanes judíos cristianos creyentes gays lesbianas extranjeros migrantes refugiados inmigrantes discapacitados negros blancos viejos pobres".split(),
}
# Words that insult, threaten or are explicit in most uses; the model may overrule them.
STRONG = {
    "en": "asshole bastard bitch braindead bullshitter cock cocksucker cunt dick dickhead dimwit dipshit dumbass fag faggot fuckface fucker halfwit horny idiot imbecile jackass moron motherfucker naked nigger nude parasite prick pussy retard retarded scum scumbag shithead slut spineless subhuman turd twat vermin wanker whore".split(),
    "de": "abschaum arsch arschloch bastard dreck dreckskerl fick ficken fotze hurensohn hure idiot missgeburt nackt nutte schlampe schwachkopf spast trottel ungeziefer untermensch versager vollidiot wichser".split(),
    "fr": "abruti batard bite chienne connard connasse couille crétin débile encule enculé merdeux nique nue ordure parasite pute putain raclure racaille salaud salope vermine".split(),
    "es": "basura bastardo cabron cabrón coño desnuda desnudo escoria follar follo gilipollas hijoputa idiota imbécil maricón mierda parásito pendejo perra polla puta puto zorra".split(),
}

# A unit of more words than LONG is read in windows of SPAN words, each half over the next.
LONG, SPAN = 30, 24
# Texts are taken together up to so many characters.
CHARS = 1 << 22
_TEXT = "\x01"
# Sentence ends; then line ends, also escaped ones, and the quotes that end a field of a dump.
_END = re.compile(r"([.!?…])[\"'”»)\]]*\s+")
_FIELD = re.compile(r"\r+|(?:\\[rn])+|\\?[\"”»][^\S\n]*[,:}\]]+[^\S\n]*(?:(?:\\?[\"“«{\[])+|$)")
_STAMP = re.compile(r"^[^\w\n\x01]{0,3}\d{1,2}:\d{2}\]?[^\S\n]*(?:<[^>\n]*>)?", re.M)
_FIELD_SIGNS, _ALIKE = frozenset("\r\\\"”»"), frozenset(ALIKE)
# Kinds of characters.
_OTHER, _LETTER, _DIGIT, _BANG, _LINE, _NEXT = range(6)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _string(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def _table(points: np.ndarray, of, kind: type) -> np.ndarray:
    """What `of` says of each character; asked once for each distinct one."""
    seen = np.flatnonzero(np.bincount(points)) if len(points) else np.empty(0, np.int64)
    out = np.zeros(int(seen[-1]) + 1 if len(seen) else 1, kind)
    out[seen] = [of(chr(c)) for c in seen]
    return out[points]


def _kind(c: str) -> int:
    if c.isalnum():
        return _DIGIT if c.isdecimal() else _LETTER
    return {"!": _BANG, "?": _BANG, "\n": _LINE, _TEXT: _NEXT}.get(c, _OTHER)


def _beside(mask: np.ndarray, by: int) -> np.ndarray:
    """The mask of the neighbours `by` places on."""
    out = np.zeros_like(mask)
    if by > 0:
        out[:-by] = mask[by:]
    else:
        out[-by:] = mask[:by]
    return out


def _undone(x: np.ndarray) -> np.ndarray:
    """Characters with letters set apart put together, signs inside words as letters, stars inside words and long runs dropped."""
    if len(x) < 3:
        return x
    letter = _table(x, _kind, np.int8) == _LETTER
    # Three letters or more, each alone, with one sign between.
    alone = letter & ~_beside(letter, 1) & ~_beside(letter, -1)
    link = alone & _beside(np.isin(x, _points(" .-_*·")), 1) & _beside(alone, 2)
    link &= _beside(link, 2) | _beside(link, -2)
    x = x[~_beside(link, -1)]
    letter = _table(x, _kind, np.int8) == _LETTER
    sign = np.isin(x, _points("0123456789@$€"))
    inside = (sign & _beside(letter, 1)) | ((sign | (x == ord("!"))) & _beside(letter, -1))
    at = np.flatnonzero(inside)
    x = x.copy()
    x[at] = [ord(SIGNS.get(chr(c), chr(c))) for c in x[at]]
    star, word = np.isin(x, _points("*#_")), np.isin(_table(x, _kind, np.int8), (_LETTER, _DIGIT))
    edge = np.flatnonzero(np.diff(np.r_[False, star, False].astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    drop = (lo > 0) & (hi < len(x)) & word[np.maximum(lo - 1, 0)] & word[np.minimum(hi, len(x) - 1)]
    gone = np.zeros(len(x) + 1, np.int64)
    gone[lo[drop]] += 1
    gone[hi[drop]] -= 1
    x = x[np.cumsum(gone)[:-1] == 0]
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    size = np.diff(np.r_[start, len(x)])
    return np.repeat(x[start], np.where((size > 2) & (x[start] != 10), 1, size))


def _plain(text: str) -> np.ndarray:
    lines = text.split("\n")
    other = [i for i, line in enumerate(lines) if not line.isascii()]
    if other:
        x = _points(unicodedata.normalize("NFKC", "\n".join(lines[i] for i in other)))
        wide = _string(x[~_table(x, lambda c: unicodedata.category(c) == "Cf", bool)]).casefold().split("\n")
        for k, line in enumerate(wide):
            if not line.isascii() and not _ALIKE.isdisjoint(line) and re.search(r"[a-z]", line):
                wide[k] = re.sub(r"[^\W\d_]+", lambda m: "".join(ALIKE.get(c, c) for c in m[0]) if re.search("[a-z]", m[0]) or all(c in ALIKE for c in m[0]) else m[0], line)
        x = _points(unicodedata.normalize("NFKD", "\n".join(wide)))
        for i, line in zip(other, _string(x[~_table(x, lambda c: unicodedata.combining(c) > 0, bool)]).split("\n")):
            lines[i] = line
    return _undone(_points("\n".join(lines).lower()))


def plain(text: str) -> str:
    """Lower-case base letters, with disguises undone: invisible signs, look-alike letters, digits for letters, letters set apart, stars, long runs.

    Line by line, and lines stay: a text may hold many units.
    """
    return _string(_plain(text))


def _tokens(x: np.ndarray) -> pa.DictionaryArray:
    """Runs of letters, of digits, of marks, and single line ends, in order."""
    kind = _table(x, _kind, np.int8)
    kept = kind != _OTHER
    cut = kept & ((kind != np.r_[0, kind[:-1]]) | (kind >= _LINE)) if len(x) else kept
    x = x[kept]
    wide = 1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000)
    ends = np.r_[0, np.cumsum(wide)].astype(np.int64)
    first = np.flatnonzero(cut[kept])
    offsets = np.r_[ends[first], ends[-1]].astype(np.int32) if len(first) else np.zeros(1, np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_string(x).encode())).dictionary_encode()


@dataclass
class Units:
    """Many texts as one row of tokens, and the stretches of it that are scored.

    Stretches are the sentences, lines and fields of each text, those of more than LONG words in overlapping windows that
    cover all of it; and each unit together with the next where both are no longer than a window.
    """

    words: list[str]
    token: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    single: np.ndarray

    @staticmethod
    def read(texts: list[str | None]) -> Units:
        whole = f"\n{_TEXT}\n".join((t or "").replace(_TEXT, " ") for t in texts)
        lines = [_FIELD.sub("\n", line) if not _FIELD_SIGNS.isdisjoint(line) else line for line in _END.sub(r"\1\n", whole).split("\n")]
        found = _tokens(_plain(_STAMP.sub("", "\n".join(lines))))
        words = ["0" if w[0].isdigit() else w for w in found.dictionary.to_pylist()]
        code = np.asarray(found.indices, np.int64)
        kind = np.array([1 if w == "\n" else 2 if w == _TEXT else 3 if w[0] in "!?" else 0 for w in words], np.int8)[code] if words else np.empty(0, np.int8)
        own = np.flatnonzero((kind == 0) | (kind == 3))
        unit, text = np.cumsum((kind == 1) | (kind == 2))[own], np.cumsum(kind == 2)[own]
        token = code[own]
        # Units that hold a token, and the words among their tokens.
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(own) else np.empty(0, np.int64)
        last = np.r_[first[1:], len(own)] if len(own) else first
        place = np.flatnonzero(kind[own] == 0)
        low, high = np.searchsorted(place, first), np.searchsorted(place, last)
        many = high - low
        short = np.flatnonzero(many <= LONG)
        long = np.flatnonzero(many > LONG)
        times = -(-(many[long] - SPAN // 2) // (SPAN // 2))
        which = np.repeat(long, times)
        step = (np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)) * (SPAN // 2)
        start = np.where(step == 0, first[which], place[np.minimum(low[which] + step, high[which] - 1)]) if len(which) else which
        after = low[which] + step + SPAN
        stop = np.where(after < high[which], place[np.minimum(after, len(place) - 1)], last[which]) if len(which) else which
        pair = np.flatnonzero((text[first[:-1]] == text[first[1:]]) & (many[:-1] > 0) & (many[1:] > 0) & (many[:-1] + many[1:] <= SPAN)) if len(first) > 1 else np.empty(0, np.int64)
        begin = np.concatenate([first[short], start, first[pair]])
        end = np.concatenate([last[short], stop, last[pair + 1] if len(pair) else pair])
        single = np.arange(len(begin)) < len(short) + len(which)
        return Units(words, token, begin, end, text[begin] if len(begin) else begin, single)


_BASE = {lang: [plain(w) for w in words] for lang, words in GROUPS.items()}
_GROUP_OF = {w: lang for lang, words in _BASE.items() for w in words}
_STRONG = {plain(w) for words in STRONG.values() for w in words}
_STRONG_WORD = xxhash.xxh32_intdigest("s") % DIMS


def _word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of all words, how many each has): the word, its pieces of four letters, and whether it is a strong one."""
    out, count = [], np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        padded = f"<{w}>"
        own = {xxhash.xxh32_intdigest(f) % DIMS for f in ["w" + w, *("c" + padded[j : j + 4] for j in range(len(padded) - 3))]}
        if w in _STRONG:
            own.add(_STRONG_WORD)
        out += sorted(own)
        count[i] = len(own)
    return np.array(out, np.int64), count


def _marks(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint64)


def _pair_features(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashed features of neighbouring words, out of the marks of both."""
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % DIMS


def features(words: list[str]) -> np.ndarray:
    """All features of a row of words, as often as they come: those of the words, and of pairs of neighbours."""
    own, _ = _word_features(words)
    mark = _marks(words)
    return np.concatenate([own, _pair_features(mark[:-1], mark[1:])])


@dataclass
class Classifier:
    """A linear model of the features; `weight` is None where there was nothing to learn from, and then nothing is scored."""

    weight: np.ndarray | None
    bias: float
    threshold: float = 0.5

    def documents(self, texts: list[str | None]) -> np.ndarray:
        """The highest score of each text's stretches (`Units`), the whole text read; 0 for no text.

        A stretch has the sum of its features' weights over the root of their number; running sums give it for all
        stretches at once.
        """
        best = np.zeros(len(texts))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < CHARS):
                size += len(texts[hi] or "")
                hi += 1
            u = Units.read(texts[lo:hi])
            if len(u.begin):
                feature, count = _word_features(u.words)
                own = np.bincount(np.repeat(np.arange(len(count)), count), weights=self.weight[feature], minlength=len(count))
                mark = _marks(u.words)[u.token]
                pairs = self.weight[_pair_features(mark[:-1], mark[1:])].astype(np.float64)
                total, number = np.r_[0, np.cumsum(own[u.token])], np.r_[0, np.cumsum(count[u.token])]
                beside = np.r_[0, np.cumsum(pairs)]
                z = total[u.end] - total[u.begin] + beside[u.end - 1] - beside[u.begin]
                n = number[u.end] - number[u.begin] + u.end - u.begin - 1
                np.maximum.at(best, lo + u.text, 1 / (1 + np.exp(-np.clip(z / np.sqrt(n) + self.bias, -30, 30))))
            lo = hi
        return best

    def document(self, text: str | None) -> float:
        return float(self.documents([text])[0])


class _Rows:
    """Sparse rows, normalised by the root of their length."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.n = len(rows)
        self.count = np.array([len(r) for r in rows], np.int64)
        self.index = np.concatenate(rows) if rows else np.empty(0, np.int64)
        self.row = np.repeat(np.arange(self.n), self.count)
        self.value = np.repeat(1 / np.sqrt(np.maximum(self.count, 1)), self.count)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index] * self.value, minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=g[self.row] * self.value, minlength=DIMS)


def _swap(words: tuple[str, ...]) -> list[str] | None:
    """The words with those for groups exchanged for others of the same language, chosen by a hash; None if they name no group."""
    if not any(w in _GROUP_OF for w in words):
        return None
    turn = xxhash.xxh32_intdigest(" ".join(words))
    out = list(words)
    for i, w in enumerate(words):
        if lang := _GROUP_OF.get(w):
            own = _BASE[lang]
            out[i] = own[(own.index(w) + 1 + turn % (len(own) - 1)) % len(own)]
    return out


def _fit(rows: _Rows, y: np.ndarray, weight: np.ndarray, twin: _Rows, twin_of: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Adam, with the counterfactual penalty. Strong words start with a weight."""
    w, bias = np.zeros(DIMS), BIAS
    w[_STRONG_WORD] = STRONG_START
    m, v = np.zeros(DIMS), np.zeros(DIMS)
    for k in range(1, STEPS + 1):
        z = rows.dot(w)
        g = weight * (1 / (1 + np.exp(-np.clip(z + bias, -30, 30))) - y)
        if twin.n:
            change = (z[twin_of] - twin.dot(w)) * penalty / (50 * twin.n)
            g = g + np.bincount(twin_of, weights=change, minlength=rows.n)
        grad = rows.back(g) + 2e-5 * w
        if twin.n:
            grad -= twin.back(change)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
    return w, bias


def train(texts: list[str | None], labels: list[float], penalty: float = COUNTERFACTUAL) -> Classifier:
    """Learns to score sentences from labels of whole texts.

    A text labelled abusive has some abusive sentence, not only such; one labelled clean has none, unless the label is
    wrong. So rounds alternate: fit a logistic model on the sentences held to be abusive and the clean ones; then hold
    those sentences of abusive texts to be abusive that score high. Scores come from models fitted on the other half of
    the texts, so a wrong label cannot confirm itself: a text labelled abusive without any suspicious sentence, and a
    clean one with a plainly abusive sentence, drop out. The loss also has `penalty` times the squared change of a
    sentence's score when the groups it names are exchanged for others.
    Without texts of both labels nothing can be learnt, and the model scores nothing.
    """
    label = np.array(labels, np.float64)
    u = Units.read(texts)
    kept = np.flatnonzero(u.single)
    if not len(kept) or not (label > 0.5).any() or not (label < 0.5).any():
        return Classifier(None, BIAS)
    begin, end, own = u.begin[kept], u.end[kept], u.text[kept]
    listed = u.token.tolist()
    spelled = [tuple(u.words[t] for t in listed[i:j]) for i, j in zip(begin.tolist(), end.tolist())]
    distinct = {s: k for k, s in enumerate(dict.fromkeys(spelled))}
    at = np.array([distinct[s] for s in spelled])
    sparse = [features(list(s)) for s in distinct]
    swapped = {k: features(x) for s, k in distinct.items() if (x := _swap(s)) is not None}
    positive = label[own] > 0.5
    half = np.array([xxhash.xxh32_intdigest(t or "") & 1 for t in texts], np.int64)[own]

    def fitted(use: np.ndarray, hold: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, float]:
        """Fits on the sentences of `use`: those of `hold` abusive, those of `clean` not; the rest of abusive texts most likely not."""
        times = lambda mask: np.bincount(at[use & mask], minlength=len(distinct))
        # What clean texts say as often is not abusive.
        y = times(hold) > times(clean)
        # A sentence said often in clean texts weighs more than one said once, but not in proportion.
        no = np.sqrt(times(clean)) * ~y
        maybe = np.where(no > 0, 0, np.sqrt(times(positive & ~hold))) * ~y
        weight = y / max(y.sum(), 1) + (no + 0.3 * maybe) * 4 / max(no.sum() + 0.3 * maybe.sum(), 1)
        kept = np.flatnonzero(weight > 0)
        new = np.full(len(distinct), -1)
        new[kept] = np.arange(len(kept))
        twins = [k for k in swapped if weight[k] > 0]
        return _fit(_Rows([sparse[k] for k in kept]), y[kept].astype(float), weight[kept], _Rows([swapped[k] for k in twins]), new[twins], penalty)

    everything = _Rows(sparse)
    # First guess: features that abusive texts have more often than clean ones.
    seen = lambda mask: np.bincount(everything.index, weights=(np.bincount(at[mask], minlength=len(distinct)) > 0)[everything.row].astype(float), minlength=DIMS)
    pos, neg = seen(positive), seen(~positive)
    score = everything.dot(np.log((pos + 0.5) / (neg + 0.5)))
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, own, score[at])
    hold, clean = positive & (score[at] == top[own]) & (score[at] > 0), ~positive
    for r in range(ROUNDS):
        p = np.zeros(len(at))
        for h in (0, 1):
            w, bias = fitted(half != h, hold, clean)
            z = everything.dot(w) + bias
            p[half == h] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[at[half == h]]
        top = np.zeros(len(texts))
        np.maximum.at(top, own, p)
        hold = positive & ((p >= 0.5) | ((p == top[own]) & (p >= HOLD)))
        if not hold.any():
            hold = positive & (p == top[own])
        clean = ~positive & (p < 0.8)
    w, bias = fitted(np.ones(len(at), bool), hold, clean)
    # The threshold that agrees best with the labels on texts the scoring model has not seen; the lowest of equals.
    truth = label > 0.5
    best = max((round(2 * (truth & (top >= t)).sum() / max(truth.sum() + (top >= t).sum(), 1), 3), -t) for t in np.arange(0.3, 0.65, 0.05))
    return Classifier(w.astype(np.float32), float(bias), float(-best[1]))


def fit(docs: DataFrame, labels: DataFrame, *, at_most: int = LABELLED_DOCUMENTS) -> Classifier:
    """Trains on the labelled documents, at most `at_most` of them: those with the lowest hashed ids.

    A document's label is the mean of its judgements; null judgements, ties, and judgements of unknown or textless
    documents are left out.
    """
    label = labels.where("abusive is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("abusive").alias("label")).where("label <> 0.5")
    some = label.join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    # At most `at_most` rows of two numbers, so a broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "label").toArrow()
    order = np.argsort([xxhash.xxh64_intdigest(t) for t in rows.column("text").to_pylist()], kind="stable")
    texts, marks = rows.column("text").to_pylist(), rows.column("label").to_pylist()
    return train([texts[i] for i in order], [marks[i] for i in order])


def score(docs: DataFrame, model: Classifier, keep: list[str], text: str) -> DataFrame:
    """(keep..., score, abusive) of every row: the highest score of its sentences, the whole text read; 0 for null and empty texts.

    A model that had nothing to learn from gives null for both.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    if model.weight is None:
        return docs.select(*keep, F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("abusive"))
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.threshold))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*shared.value)
        for b in it:
            p = own.documents(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p), pa.array(p >= own.threshold)], names=[*keep, "score", "abusive"])

    return docs.select(*keep, F.col(text).cast("string").alias("__text")).mapInArrow(run, f"{fields}, score double, abusive boolean")

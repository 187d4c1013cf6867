"""Toxicity by a counterfactual-regularised classifier.

Logistic regression over a text's distinct words, and over how many of them share a beginning or an end (of 4 to
8 bytes; so inflected and compound forms of a word count together). Every sampled text has SWAPS counterfactuals: its
identity terms are swapped for those of other groups, or, where it has none, one neutral mention of a group is put into
it (the kind of term by the text's hash, so all languages and kinds come up). Beside the labels' loss, training penalises
how far a counterfactual moves the text's score (the label stays out of this term), so that neither a group's name
nor what it shares with other words makes a text toxic.

Scoring shuffles nothing; the model (words that go with the labels by MIN_ROWS and MIN_G2) is sent
with the function. Each of its words is in MIN_ROWS sampled texts at least, so the sample bounds it.

Defined cases: null and empty texts have the score of a text without known words; with nothing to learn
from every score is 0; rows that repeat are scored each; bytes that are not UTF-8 are words like others.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHE_WORDS, filtered, per_text
from .labelled import EDGES, copy_heads, gathered, sample, sigmoid, words_of

THRESHOLD = 0.3
#: Labelled rows that the classifier is fitted on at most.
SAMPLE_ROWS = 4096
#: Bytes of a beginning or end, and the numbers of words with it that are features.
AFFIXES = (4, 5, 6, 7, 8)
COUNTS = (1, 2, 3, 5)
#: Different sampled texts that must have a word for it to count, and how surely it must go with the labels
#: (likelihood-ratio statistic of the word's 2 x 2 table), so that rare words don't learn a text's label by heart.
MIN_ROWS = 3
MIN_G2 = 20.0
PENALTY = 1.0
L2 = 0.5
SWAPS = 4
STEPS = 400


def _endings(stems: str, endings: str) -> tuple[tuple[str, ...], ...]:
    """A kind of terms for each ending ("-": none)."""
    return tuple(tuple(s + e.strip("-") for s in stems.split()) for e in endings.split())


#: Terms of the same kind (and language, number, gender and case) stand in for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
    ("immigrants", "refugees", "natives", "foreigners"),
    # German
    ("frauen", "männer", "mütter", "väter", "jungs"),
    ("frau", "mann", "mutter", "vater", "mädchen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("muslimin", "christin", "jüdin", "buddhistin", "atheistin", "katholikin"),
    ("muslim", "christ", "jude", "hindu", "buddhist", "atheist", "katholik"),
    *_endings("muslimisch christlich jüdisch hinduistisch buddhistisch atheistisch katholisch", "- e er en es em"),
    *_endings("schwarz weiß asiatisch arabisch afrikanisch europäisch", "- e er en es em"),
    *_endings("schwul lesbisch bisexuell heterosexuell", "- e er en es em"),
    ("alt", "jung"),
    *_endings("alt jung", "e er en es em"),
    *_endings("behindert blind taub autistisch", "e er en es em"),
    ("einwanderer", "flüchtlinge", "einheimische", "ausländer"),
    # French
    ("femmes", "hommes", "filles", "garçons", "mères", "pères"),
    ("femme", "homme", "fille", "garçon", "mère", "père"),
    *_endings("musulman chrétien juif hindou bouddhiste athée catholique", "- s"),
    *_endings("musulmane chrétienne juive hindoue", "- s"),
    *_endings("noir blanc asiatique arabe africain européen", "- s"),
    *_endings("noire blanche africaine européenne", "- s"),
    *_endings("homosexuel hétérosexuel bisexuel", "- s"),
    *_endings("lesbienne homosexuelle hétérosexuelle bisexuelle", "- s"),
    ("vieux", "jeune", "âgé"),
    ("vieille", "âgée"),
    ("vieilles", "âgées"),
    ("jeunes", "âgés"),
    *_endings("handicapé aveugle sourd autiste", "- s"),
    *_endings("handicapée sourde", "- s"),
    ("immigrés", "réfugiés", "indigènes", "étrangers"),
    # Spanish
    ("mujeres", "hombres", "niñas", "niños", "madres", "padres"),
    ("mujer", "hombre", "niña", "niño", "madre", "padre"),
    *_endings("musulmán cristiano judío budista ateo católico", "-"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos", "católicos"),
    *_endings("musulmana cristiana judía atea católica", "- s"),
    *_endings("negro blanco asiático árabe africano europeo", "- s"),
    *_endings("negra blanca asiática africana europea", "- s"),
    ("homosexuales", "heterosexuales", "bisexuales", "lesbianas"),
    *_endings("viejo anciano joven", "-"),
    ("viejos", "ancianos", "jóvenes"),
    *_endings("vieja anciana", "- s"),
    *_endings("discapacitado ciego sordo autista", "- s"),
    *_endings("discapacitada ciega sorda", "- s"),
    ("inmigrantes", "refugiados", "indígenas", "extranjeros"),
)


def word_id(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def _spellings(term: str) -> set[str]:
    """The term as words are read: only A-Z are lower-cased, so other letters may be capitals."""
    return {term, term[0].upper() + term[1:] if not term[0].isascii() else term, "".join(c if c.isascii() or c == "ß" else c.upper() for c in term)}


#: word -> terms that stand in for it. A word of two languages stands for the others of both.
_SWAP: dict[bytes, list[bytes]] = {}
for _kind in IDENTITY_TERMS:
    for _t in _kind:
        for _s in _spellings(_t):
            _known = _SWAP.setdefault(_s.encode(), [])
            _known += [o.encode() for o in _kind if o != _t and o.encode() not in _known]


def bases(word: bytes) -> list[bytes]:
    """The word, and its beginnings and ends."""
    return [word, *(b"^" + word[:k] for k in AFFIXES if k < len(word)), *(word[-k:] + b"$" for k in AFFIXES if k < len(word))]


def counted_id(base: int, count: int) -> int:
    """The feature "at least ``count`` words" of a base's id."""
    return (base + (1 << 63) + (count - 1) * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63)


def _features(seen: Counter) -> np.ndarray:
    return np.unique(np.fromiter((counted_id(word_id(b), c) for b, n in seen.items() for c in COUNTS if n >= c), np.int64))


def extract(text: bytes) -> np.ndarray:
    """A text's features, sorted."""
    return _features(Counter(b for w in words_of(text) for b in bases(w)))


def counterfactual_words(text: bytes, swaps: int = SWAPS) -> list[set[bytes]]:
    """The text's distinct words with every identity term replaced by the k-th other of its kind, for each k; without
    an identity term, with the k-th of a kind as well."""
    words = words_of(text)
    if any(w in _SWAP for w in words):
        return [{_SWAP[w][k % len(_SWAP[w])] if w in _SWAP else w for w in words} for k in range(swaps)]
    kind = IDENTITY_TERMS[xxhash.xxh64_intdigest(text) % len(IDENTITY_TERMS)]
    return [words | {kind[k % len(kind)].encode()} for k in range(swaps)]


def counterfactuals(text: bytes, swaps: int = SWAPS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features that it gains, features that it loses) for each counterfactual of a text."""
    words = words_of(text)
    seen = Counter(b for w in words for b in bases(w))
    out = []
    for other in counterfactual_words(text, swaps):
        change = Counter(b for w in other - words for b in bases(w))
        change.subtract(Counter(b for w in words - other for b in bases(w)))
        gained, lost = [], []
        for b, d in change.items():
            for c in COUNTS:
                if (seen[b] >= c) != (seen[b] + d >= c):
                    (gained if d > 0 else lost).append(counted_id(word_id(b), c))
        out.append((np.array(sorted(gained), np.int64), np.array(sorted(lost), np.int64)))
    return out


def sampled(text: bytes) -> np.ndarray:
    """A row to learn from: the number of features and the features, then the same of what each counterfactual gains and loses."""
    parts = [extract(text), *(x for pair in counterfactuals(text) for x in pair)]
    return np.concatenate([y for x in parts for y in ([len(x)], x)]).astype(np.int64)


def unpacked(row: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(features, counterfactuals) of a sampled row."""
    parts, at = [], 0
    while at < len(row):
        parts.append(row[at + 1 : at + 1 + row[at]])
        at += 1 + int(row[at])
    return parts[0], list(zip(parts[1::2], parts[2::2], strict=True))


class _Rows:
    """Sparse rows of 1, and of -1 for ``minus``, over columns 0 .. n - 1."""

    def __init__(self, rows: list[np.ndarray], vocabulary: np.ndarray, minus: list[np.ndarray] | None = None):
        plus = [self._places(r, vocabulary) for r in rows]
        less = [self._places(r, vocabulary) for r in minus or []]
        ends = np.concatenate([np.arange(len(rows)), np.arange(len(less))])
        self.row = np.repeat(ends, [len(f) for f in plus + less])
        self.col = np.concatenate([*plus, *less, np.empty(0, np.int64)]).astype(np.int64)
        self.sign = np.repeat([1.0, -1.0], [sum(map(len, plus)), sum(map(len, less))])
        self.n, self.m = len(rows), len(vocabulary)

    @staticmethod
    def _places(r: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
        if not len(vocabulary):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(vocabulary, r), len(vocabulary) - 1)
        return at[vocabulary[at] == r]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.sign * w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.sign * g[self.row], self.m)


def telling(rows: list[np.ndarray], y: np.ndarray, min_rows: int = MIN_ROWS, min_g2: float = MIN_G2) -> np.ndarray:
    """Sorted ids of the features that go with the labels."""
    total, ones = len(rows), float(y.sum())
    # rows of each bucket of ids: no fewer than those of any id in it, so ids of rare buckets can go at once
    buckets = np.zeros(1 << 22, np.int32)
    for r in rows:
        buckets[r & (1 << 22) - 1] += 1
    kept = [r[buckets[r & (1 << 22) - 1] >= min_rows] for r in rows]
    ids, at = np.unique(np.concatenate(kept), return_inverse=True)
    n = np.bincount(at, minlength=len(ids)).astype(float)
    with_one = np.bincount(at, np.repeat(y, [len(r) for r in kept]), len(ids))

    def term(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    share = ones / max(total, 1)
    g2 = 2 * (term(with_one, n * share) + term(n - with_one, n * (1 - share)) + term(ones - with_one, (total - n) * share) + term(total - n - ones + with_one, (total - n) * (1 - share)))
    return ids[(n >= min_rows) & (g2 >= min_g2)]


def fit(rows: list[np.ndarray], y: np.ndarray, penalty: float = PENALTY, l2: float = L2, min_rows: int = MIN_ROWS, min_g2: float = MIN_G2, steps: int = STEPS) -> dict:
    """{"ids": sorted features, "weights", "bias", "pairs": counterfactuals that the penalty was taken over, "moving": those of
    them that change a feature of the model} from rows as ``sampled`` makes them."""
    if not len(rows):
        return {"ids": np.empty(0, np.int64), "weights": np.empty(0), "bias": -40.0, "pairs": 0, "moving": 0}
    made = [unpacked(r) for r in rows]
    heads, y = copy_heads([r for r, _ in made], y)
    rows = [made[i][0] for i in heads]
    vocabulary = telling(rows, y, min_rows, min_g2)
    others = [(k, gained, lost) for k, i in enumerate(heads.tolist()) for gained, lost in made[i][1]]
    x, change = _Rows(rows, vocabulary), _Rows([g for _, g, _ in others], vocabulary, [r for _, _, r in others])
    base = np.array([k for k, _, _ in others], np.int64)
    w, b = np.zeros(len(vocabulary)), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    # Adam on the whole sample
    m1, m2, mb1, mb2 = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = x.times(w) + b
        p, q = sigmoid(z), sigmoid(z[base] + change.times(w))
        move = 2 * penalty * (q - p[base])
        dq = move * q * (1 - q)
        g = p - y + np.bincount(base, dq - move * p[base] * (1 - p[base]), len(rows))
        gw, gb = x.back(g) + change.back(dq) + l2 * w, g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.999 * mb2 + 0.001 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= rate * m1 / (np.sqrt(m2) + 1e-8)
        b -= rate * mb1 / (np.sqrt(mb2) + 1e-8)
    return {"ids": vocabulary, "weights": w, "bias": float(b), "pairs": len(others), "moving": len(np.unique(change.row))}


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS, **options) -> dict:
    """Fitted on at most ``rows`` of ``labels`` (doc_id, label), each with its counterfactuals."""
    found, y = gathered(docs, sample(labels, label, id_col, rows), sampled, id_col, text_col)
    model = fit(found, y, **options)
    if len(found) and not model["pairs"]:
        raise RuntimeError("no counterfactual was made of the sampled texts")
    return model


def scorer(model: dict):
    def make():
        weights = dict(zip(model["ids"].tolist(), model["weights"].tolist(), strict=True))
        # what the model knows of a word as it stands: (the word without its edges, its known bases); None: nothing
        known: dict[bytes, tuple[bytes, list[int]] | None] = {}
        # base -> weight of each of COUNTS; every base that has a learned feature is counted_id backwards from it
        steps_of = {}
        for i in weights:
            for c in COUNTS:
                base = (i + (1 << 63) - (c - 1) * 0x9E3779B97F4A7C15) % (1 << 64) - (1 << 63)
                steps_of[base] = [weights.get(counted_id(base, k), 0.0) for k in COUNTS]

        def look(word: bytes) -> tuple[bytes, list[int]] | None:
            if len(known) >= CACHE_WORDS:
                known.clear()
            bare = word.strip(EDGES)
            mine = [i for i in map(word_id, bases(bare)) if i in steps_of] if bare else []
            known[word] = out = (bare, mine) if mine else None
            return out

        bias = model["bias"]

        def work(texts: list[bytes]) -> np.ndarray:
            z = np.empty(len(texts))
            for i, t in enumerate(texts):
                found = {}
                for w in set(t.lower().split()):
                    try:
                        k = known[w]
                    except KeyError:
                        k = look(w)
                    if k:
                        found[k[0]] = k[1]
                seen = Counter(b for mine in found.values() for b in mine)
                z[i] = bias + sum(w for b in sorted(seen) for c, w in zip(COUNTS, steps_of[b], strict=True) if seen[b] >= c)
            return np.where(z > -40, sigmoid(z), 0.0)

        return work

    return make


def score(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep``, score and predicted."""
    make = scorer(model)

    def one():
        work = make()
        return lambda texts: [work(texts)]

    return per_text(docs, keep, text_col, [("score", T.DoubleType(), pa.float64())], one).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    make = scorer(model)

    def one():
        work = make()
        return lambda texts: work(texts) < threshold

    return filtered(docs, text_col, one)

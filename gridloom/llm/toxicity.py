"""Toxicity: a learned weighted lexicon matched by Aho-Corasick over folded text.

Folding lowers case, drops zero-width marks, maps look-alike letters and digits
that stand for letters to plain letters, strips accents and turns everything
else into single blanks. Lexicon terms are whole words or word beginnings; a
match inside an exception phrase doesn't count. A document's weight is divided by
a power of its length, the one that fits the labels best, and mapped to 0..1 by
a fitted logistic curve.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables
from .textbuf import mix

#: At most about so many labelled rows a class are learned from.
TRAIN_ROWS = 6000
THRESHOLD = 0.7
#: Least log-odds of a term; letters of the word beginnings that may be terms (whole words may be of any length); length added before the power.
LEAST_ODDS, SHORTEST, LONGEST, OFFSET = 2.0, 4, 12, 20.0
#: Labelled texts whose sets of SHINGLE words in a row are at least so alike speak for a term once.
SHINGLE, ALIKE = 5, 0.25

# Letters of other scripts that look like Latin ones, and marks used for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d",
}
LETTERS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
NOTHING = "­​‌‍⁠﻿"


class _Folding(dict):
    """Code point to folded text, found out once for each code point met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in NOTHING or unicodedata.combining(c):
            out = ""
        else:
            out = "".join(LOOK_ALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c.lower()) if not unicodedata.combining(x))
            out = "".join(LOOK_ALIKES.get(x, x) for x in out.lower())
            out = "".join(x if x.isalnum() or x in LETTERS_FOR else " " for x in out)
        self[code] = out
        return out


_FOLDING = _Folding()
_STANDS = re.compile(r"\S*[0-9@$!]\S*")
_INSIDE = str.maketrans(LETTERS_FOR)
_BLANK = str.maketrans({"@": " ", "$": " ", "!": " "})


def _letters(m: re.Match) -> str:
    """Marks and digits become letters only in a word that has letters, and a mark at its end is none."""
    w = m[0].rstrip("!$@")
    return w.translate(_INSIDE) if any(c.isalpha() for c in w) else w.translate(_BLANK)


def fold(text: str | None) -> str:
    """Folded words between single blanks, with a blank at either end; null reads as empty."""
    return f" {' '.join(_STANDS.sub(_letters, (text or '').translate(_FOLDING)).split())} "


@dataclass
class Lexicon:
    """Folded patterns (a leading blank, for whole words a trailing one) with weights, exception phrases, and the curve."""

    terms: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    slope: float = 1.0
    base: float = -4.0
    power: float = 0.5

    def automaton(self) -> ahocorasick.Automaton | None:
        """Each pattern's length, and its weight or, for an exception, None."""
        if not self.terms:
            return None
        a = ahocorasick.Automaton()
        for p, w in self.terms.items():
            a.add_word(p, (len(p), w))
        for p in self.exceptions:
            a.add_word(p, (len(p), None))
        a.make_automaton()
        return a


def counted(found: list[tuple[int, tuple[int, float | None]]]) -> list[float]:
    """The weights of the matches (last place, (length, weight)) that lie within no exception's match."""
    free = sorted((end + 1 - n, end) for end, (n, w) in found if w is None)
    if not free:
        return [w for _, (_, w) in found]
    starts = [a for a, _ in free]
    reach = list(accumulate((b for _, b in free), max))  # the farthest end of the exceptions that begin so early
    out = []
    for end, (n, w) in found:
        if w is not None:
            k = bisect_right(starts, end + 1 - n)
            if k == 0 or reach[k - 1] < end:
                out.append(w)
    return out


def weigh(automaton: ahocorasick.Automaton | None, folded: str) -> tuple[float, int, int]:
    """Of a folded text: the summed weight, the number of matches, and the length in words."""
    found = counted(list(automaton.iter(folded))) if automaton is not None else []
    return sum(found), len(found), folded.count(" ") - 1


def level(weight: float, words: int, power: float) -> float:
    """The weight normalised by length; logarithmic, so that few matches count and many don't drown them."""
    return math.log1p(weight / (words + OFFSET) ** power)


def _candidates(t: str) -> set[str]:
    words = set(t.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(SHORTEST, min(len(w), LONGEST + 1))}


def _kin(texts: Iterable[str]) -> list[list[str]]:
    """All texts, in groups: each joins the first text before it whose shingles are ALIKE; shared least hashes bring pairs together."""
    near: dict[tuple[int, int], list[int]] = defaultdict(list)
    sets: list[set[int]] = []
    group: list[int] = []
    out: list[list[str]] = []
    for t in sorted(set(texts)):
        words = t.split()
        own = {zlib.crc32(" ".join(words[i : i + SHINGLE]).encode()) for i in range(max(1, len(words) - SHINGLE + 1))}
        h = np.fromiter(own, np.uint64, len(own))
        least = list(enumerate(int(mix(h ^ np.uint64(k << 32)).min()) for k in range(16)))
        met = sorted({i for key in least for i in near[key]})
        first = next((i for i in met if (both := len(own & sets[i])) >= ALIKE * (len(own) + len(sets[i]) - both)), None)
        for key in least:
            near[key].append(len(sets))
        sets.append(own)
        group.append(len(out) if first is None else group[first])
        if first is None:
            out.append([])
        out[group[-1]].append(t)
    return out


def _held(group: list[str]) -> set[str]:
    return {c for t in group for c in _candidates(t)}


def fit(toxic: list[str], clean: list[str]) -> Lexicon:
    """Learn terms, exceptions and curve from folded texts; a term is counted by groups of texts that are much alike, so copies speak once.

    Terms are chosen one after another, each the one that explains most toxic
    groups, where a group that earlier terms explain counts half as much for each,
    so words that merely stand beside them are not taken. A term needs two groups, and one in 250.
    """
    toxic, clean = sorted(set(toxic)), sorted(set(clean) - set(toxic))
    if not toxic:
        return Lexicon({})
    bad, good = _kin(toxic), _kin(clean)
    least = max(2, len(bad) // 250)
    df: Counter[str] = Counter()
    for g in bad:
        df.update(_held(g))
    df = Counter({c: n for c, n in df.items() if n >= least})
    other: Counter[str] = Counter()
    for g in good:
        other.update(c for c in _held(g) if c in df)
    odds = {c: math.log((n + 0.5) / (len(bad) + 1)) - math.log((other[c] + 0.5) / (len(good) + 1)) for c, n in df.items()}
    odds = {c: o for c, o in odds.items() if o >= LEAST_ODDS}
    holds = [[c for c in _held(g) if c in odds] for g in bad]
    posting: dict[str, list[int]] = defaultdict(list)
    for i, held in enumerate(holds):
        for c in held:
            posting[c].append(i)
    terms: dict[str, float] = {}
    gain = {c: float(len(p)) for c, p in posting.items()}
    left = [1.0] * len(bad)
    queue = [(-gain[c] * odds[c], -len(c), c) for c in gain]  # a gain only falls, so what is up to date at the top is the best
    heapify(queue)
    while queue:
        worth, _, best = heappop(queue)
        if -gain[best] * odds[best] != worth:
            heappush(queue, (-gain[best] * odds[best], -len(best), best))
            continue
        if gain[best] < least:
            break
        n = len(posting[best])
        kin = [p for p in terms if p.startswith(best.rstrip()) or best.startswith(p.rstrip())]
        if any(len(best) > len(p) or n <= 1.2 * len(posting[p]) for p in kin):
            continue  # a beginning of, or a word begun by, a term that says as much
        for p in kin:
            del terms[p]
        terms[best] = odds[best]
        for i in posting[best]:
            left[i] /= 2
            for c in holds[i]:
                gain[c] -= left[i]
    lexicon = Lexicon(terms)
    lexicon.exceptions = _exceptions(lexicon, toxic, clean)
    lexicon.slope, lexicon.base, lexicon.power = _curve(lexicon, bad, good)
    return lexicon


def _exceptions(lexicon: Lexicon, toxic: list[str], clean: list[str]) -> set[str]:
    """Pairs of a matched word and a neighbour that clean texts hold more often than toxic ones."""
    seen = Counter(), Counter()
    heads = {p.strip() for p in lexicon.terms}
    whole = {p.strip() for p in lexicon.terms if p.endswith(" ")}

    def term(w: str) -> bool:
        return w in whole or any(w[:k] in heads and w[:k] not in whole for k in range(SHORTEST, min(len(w), LONGEST) + 1))

    for kind, texts in ((1, toxic), (0, clean)):
        for t in texts:
            words = t.split()
            at = [i for i, w in enumerate(words) if term(w)]
            seen[kind].update({f" {words[j]} {words[j + 1]} " for i in at for j in (i - 1, i) if 0 <= j < len(words) - 1})
    return {phrase for phrase, n in seen[0].items() if n >= 3 and (n + 0.5) / (len(clean) + 1) > 3 * (seen[1][phrase] + 0.5) / (len(toxic) + 1)}


def _curve(lexicon: Lexicon, toxic: list[list[str]], clean: list[list[str]]) -> tuple[float, float, float]:
    """Slope, base and power of the curve with the least loss; both classes, and the groups of a class, weigh the same."""
    a = lexicon.automaton()
    seen = [(*weigh(a, t), y, 1 / len(groups) / len(g)) for groups, y in ((toxic, 1.0), (clean, 0.0)) for g in groups for t in g]
    best = (math.inf, 1.0, -4.0, 0.5)
    for power in (0.1, 0.25, 0.5, 1.0):
        rows = [(level(w, n, power), y, k) for w, _, n, y, k in seen]
        best = min(best, (*_logistic(rows), power))
    return best[1:]


def _logistic(rows: list[tuple[float, float, float]]) -> tuple[float, float, float]:
    """Loss, slope and base of a logistic curve through (x, y, importance), by Newton's method."""
    scale = max([1e-9, *(x for x, _, _ in rows)]) / 10
    slope, base, loss = 0.0, 0.0, math.inf
    for _ in range(100):
        g0 = g1 = h00 = h01 = h11 = loss = 0.0
        for x, y, k in rows:
            x /= scale
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, slope * x + base))))
            loss -= k * math.log(max(1e-15, p if y else 1 - p))
            d, v = k * (p - y), k * p * (1 - p)
            g0, g1 = g0 + d, g1 + d * x
            h00, h01, h11 = h00 + v, h01 + v * x, h11 + v * x * x
        ridge = 1e-3
        g0, g1, h00, h11 = g0 + ridge * base / 10, g1 + ridge * slope, h00 + ridge / 10, h11 + ridge
        det = h00 * h11 - h01 * h01
        db, ds = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        step = min(1.0, 2.0 / max(abs(db), abs(ds), 1e-12))
        base, slope = base - step * db, slope - step * ds
        if abs(db) + abs(ds) < 1e-8:
            break
    return loss, max(slope, 0.0) / scale, base


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: dict[int, list[str]] = {0: [], 1: []}
    share = tables.Share(tables.TRAIN_BYTES)
    for b in batches:
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
            if share.fits(y, t):
                texts[y].append(fold(t))
    model = pickle.dumps(fit(texts.pop(1), texts.pop(0)))
    tables.release()
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, most: int = TRAIN_ROWS) -> Lexicon:
    """A lexicon learned in one task from about `most` labelled documents and TRAIN_BYTES of text a class outside fold `held`.

    Without any it is empty. What tables.labelled() says of nulls and repeats holds here.
    """
    sample = tables.labelled(docs, labels, label, tables.fold("doc_id", folds) != held, most)
    got = sample.mapInArrow(_train, "model binary").collect()
    return pickle.loads(bytes(got[0][0])) if got else Lexicon({})


def score(spark: SparkSession, docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """`docs` with toxicity (0 to 1) and toxic_matches; earlier columns of these names are replaced.

    A text without a match, null or empty included, has the curve's base score.
    """
    shared = spark.sparkContext.broadcast(lexicon)
    made: list = []

    def run(b: pa.RecordBatch) -> list[pa.Array]:
        if not made:
            made.append(shared.value.automaton())
        lex = shared.value
        got = [weigh(made[0], fold(t.as_py())) for t in b.column("text")]
        p = [1 / (1 + math.exp(-max(-35.0, min(35.0, lex.slope * level(w, n, lex.power) + lex.base)))) for w, _, n in got]
        return [pa.array(p, pa.float64()), pa.array([k for _, k, _ in got], pa.int64())]

    return tables.append(docs, "toxicity double, toxic_matches long", run)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, repeated ones too: doc_id, held_out (null for a null id), score, predicted (1 from 0.7), matches that count."""
    docs = tables.read(spark, sf_dir, "documents")
    out = score(spark, docs.select("doc_id", "text"), train(docs, tables.read(spark, sf_dir, "labels")))
    s = F.col("toxicity")
    return out.select("doc_id", (tables.fold("doc_id", 3) == 1).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"), F.col("toxic_matches").alias("matches"))

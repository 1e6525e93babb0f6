"""Language ID by hierarchical discrimination: the language family first, then one-versus-one linear support vector
machines between the languages of that family. Features are hashed runs of one to three letters."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, fold, map_slices, table

#: Documents of each language that machines are trained on: a parameter that bounds what the driver gathers.
SAMPLE = 500
#: And of all languages together.
SAMPLE_ALL = 3000
BUCKETS = 4096
#: Vectors of half floats that a machine widens at a time, and those that it keeps wide: bounds what the fit holds besides the sample.
BLOCK, WIDE = 256, 1024
UNKNOWN = "und"

# Families of common language codes. A code not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "indic": "hi bn ur mr ne pa gu",
    "semitic": "ar he mt am",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def family(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def codes(text: str | None) -> np.ndarray:
    """Bucket of every run of one to three letters (word ends are blanks); empty if there is no letter."""
    # cased and uncased letters and marks that \w holds; other characters are blanks
    plain = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, plain)):
        return np.zeros(0, np.int64)
    c = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] * np.uint64(31) ^ one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] * np.uint64(31) ^ one[2:] * np.uint64(0x165667B19E3779F9)
    return np.concatenate([(x >> np.uint64(41)) % np.uint64(BUCKETS) for x in (one[1:-1], two, three)]).astype(np.int64)


def vector(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of all buckets: a unit vector; None if there is no letter."""
    at = codes(text)
    return np.sqrt(np.bincount(at, minlength=BUCKETS) / len(at), dtype=np.float32) if len(at) else None


def machine(X: np.ndarray, rows: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 120) -> tuple[np.ndarray, float]:
    """A linear support vector machine (squared hinge, classes weighed alike) of some rows of X by accelerated descent; y is -1 or 1."""
    n, d = len(rows), X.shape[1]
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    wide = lambda at: X[rows[at : at + BLOCK]].astype(np.float32)
    held = [wide(at) for at in range(0, min(n, WIDE), BLOCK)]
    w, v, b, vb = np.zeros(d, np.float32), np.zeros(d, np.float32), 0.0, 0.0
    rate = 1.0 / (4 + l2)  # rows are unit vectors, and the bias adds one
    for t in range(1, steps + 1):
        pulled, bias = np.zeros(d, np.float32), 0.0
        for k, x in enumerate(itertools.chain(held, map(wide, range(len(held) * BLOCK, n, BLOCK)))):
            own = slice(k * BLOCK, (k + 1) * BLOCK)
            slack = np.maximum(0, 1 - y[own] * (x @ v + vb)) * weight[own] * y[own]
            pulled += slack @ x
            bias += float(slack.sum())
        nw, nb = v + rate * (2 * pulled - l2 * v), vb + rate * 2 * bias
        pull = (t - 1) / (t + 2)
        v, vb, w, b = nw + pull * (nw - w), nb + pull * (nb - b), nw, nb
    return w, float(b)


class Ladder:
    """Votes between every two of some classes, each pair by its own machine. Learns from some rows of X, which are not copied whole; names: the class of each."""

    def __init__(self, X: np.ndarray, rows: np.ndarray, names: np.ndarray) -> None:
        self.names = sorted(set(names.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.names)), 2))
        fits = []
        for a, b in self.pairs:
            of = np.flatnonzero((names == self.names[a]) | (names == self.names[b]))
            fits.append(machine(X, rows[of], np.where(names[of] == self.names[a], 1, -1).astype(np.float32)))
        self.W = np.array([w for w, _ in fits], np.float32).reshape(len(fits), X.shape[1])
        self.b = np.array([b for _, b in fits], np.float32)

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """The class with most votes, ties by summed margins, and a confidence from 0.5 to 1 by its least margin."""
        if not self.pairs:
            return self.names[0], 1.0
        m = self.W @ x + self.b
        votes, sums, least = np.zeros(len(self.names)), np.zeros(len(self.names)), np.full(len(self.names), np.inf)
        for (a, b), v in zip(self.pairs, m.tolist(), strict=True):
            votes[a if v >= 0 else b] += 1
            sums[a] += v
            sums[b] -= v
            least[a], least[b] = min(least[a], v), min(least[b], -v)
        k = max(range(len(votes)), key=lambda i: (votes[i], sums[i]))
        return self.names[k], float(1 / (1 + np.exp(-4 * max(0.0, least[k]))))


class Model:
    """The family machine and one ladder for each family."""

    def __init__(self, X: np.ndarray, langs: np.ndarray) -> None:
        families = np.array([family(x) for x in langs.tolist()], object)
        self.top = Ladder(X, np.arange(len(langs)), families) if len(langs) else None
        self.within = {f: Ladder(X, np.flatnonzero(families == f), langs[families == f]) for f in set(families.tolist())}

    def predict(self, text: str | None) -> tuple[str, float]:
        x = vector(text)
        if x is None or self.top is None:
            return UNKNOWN, 0.0
        f, p = self.top.decide(x)
        lang, q = self.within[f].decide(x)
        return lang, p * q


def fit(docs: DataFrame, per_lang: int = SAMPLE) -> Model:
    """Machines from at most about per_lang documents of each non-null lang, and SAMPLE_ALL in all. Each gives its whole text and, as short texts
    are harder, one of its lines by itself. Of more than common.MOST_CLASSES languages the most frequent are learned. Rows that repeat id, lang
    and text count once. Vectors are mostly noughts, so they come to the driver deflated and are held there as half floats. Without such
    documents every prediction is `und`."""

    def work(rows: dict) -> dict:
        out: dict[str, list] = {"doc_id": [], "lang": [], "x": []}
        for i, lang, text in zip(rows["doc_id"], rows["lang"], rows["text"], strict=True):
            lines = text.split("\n")
            for t in {text, lines[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(lines)]}:
                if (x := vector(t)) is not None:
                    out["doc_id"].append(i)
                    out["lang"].append(lang)
                    out["x"].append(zlib.compress(x.astype(np.float16).tobytes(), 1))
        return out

    chosen = bounded_sample(docs.where("text is not null").select("doc_id", "lang", "text"), "lang", ["doc_id", "text"], per_lang, SAMPLE_ALL)
    got = sorted(map(tuple, map_slices(chosen, work, "doc_id long, lang string, x binary").collect()), key=lambda r: (r[0] if r[0] is not None else -1, r[1], bytes(r[2])))
    X = np.empty((len(got), BUCKETS), np.float16)
    for i, (_, _, x) in enumerate(got):
        X[i] = np.frombuffer(zlib.decompress(x), np.float16)
    return Model(X, np.array([x for _, x, _ in got], object))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred and score (0 to 1) of every whole text; a null text or one without a letter is `und` at 0."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("lang_pred", "score"))

    def work(rows: dict) -> dict:
        got = [model.predict(t) for t in rows["text"]]
        return rows | {"lang_pred": [x for x, _ in got], "score": [s for _, s in got]}

    return map_slices(docs.drop("lang_pred", "score"), work, schema + ", lang_pred string, score double")


def op6_language_id(spark, sf_dir):
    """Predict the language of every row of documents from machines that learn outside the held-out third. A null id is never held out; odd texts as in identify."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")

"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

A word's features are its subsequences of three characters within five places,
the mark of its start being one, weighted ``DECAY`` per place skipped, so
``i.d.i-o-t`` and ``idiiot`` still share most of theirs with the plain word.
Characters that are neither letters nor digits may be skipped but never chosen,
accents are folded, single letters set apart by spaces are read as one word too,
and long words are read in overlapping pieces.  A text is judged by its worst
word and by the mean of its worst words, one for every ``SHARE`` of its words.

Learning: labelled texts are bags of words of which at least one is toxic in a
toxic text.  Words are mapped by the kernel with landmark words through the
inverse root of the landmarks' kernel matrix (Nyström), and a linear machine with
squared hinge loss is trained on them, in rounds that choose each text's worst
words anew; words that many toxic texts have and hardly any clean one are always
among the toxic.  As kernel and map are linear in the subsequences, the whole
machine is one weight for each of them, a vector of fixed size.  A logistic
calibration on labelled texts of which the machine has seen nothing turns the
margins of the worst words into a probability.

Cases: a null or empty text has the least margins; a text of any length is read
whole; a null doc_id is scored, ``held_out`` false, and never learnt from; rows
that repeat are each scored, and equal texts score alike; extra columns are
ignored, whatever their names; with one class or none in the labels every score
is that class's share, or 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import crc_mod, fit_logistic, labelled_sample, sigmoid

PER_CLASS = 1200      # labelled texts of each class that the model is fitted on, at most
TRAIN_CHARS = 20000   # longer labelled texts are not in the sample (all texts are scored whole)
LANDMARKS = 256
ROUNDS = 5
DECAY = 0.6
CLEAN_MASS = 10000     # weight of all clean examples together; that of the toxic ones is 1000
RADIX = 64            # symbols: 0 none, a-z, 0-9, 26 shared by all other letters, and the start of a word
START = 63
SHARE = 100           # the words that a text is judged by are its worst one and the worst of its every ``SHARE``-th
PIECE, STRIDE = 24, 12
PATTERNS = [(a, b) for b in range(2, 5) for a in range(1, b)]  # places of the second and third character after the first
ROWS = 2000           # texts whose words are scored at once


def _symbols() -> np.ndarray:
    table = np.zeros(0x250, np.uint8)
    for c in range(len(table)):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if "a" <= base <= "z":
            table[c] = ord(base) - 96
        elif base.isdigit() and base.isascii():
            table[c] = 27 + ord(base) - 48
        elif base.isalpha():
            table[c] = 37 + c % 26
    return table


_TABLE = _symbols()


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words, with the mark of a start before and four zeros after each, and where each word starts."""
    codes = np.frombuffer(("\0\0\0\0\0".join(["", *words, ""])[4:]).encode("utf-32-le", "surrogatepass"), np.uint32)[:-1]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 5
    sym = np.where(codes < len(_TABLE), _TABLE[np.minimum(codes, len(_TABLE) - 1)], 37 + codes % 26).astype(np.int32)
    start = np.cumsum(lengths) - lengths
    sym[start] = START
    return sym, start


def subsequences(sym: np.ndarray):
    """(code, weight) for every pattern: the code at each place, and where it is one."""
    n = len(sym) - 4
    for a, b in PATTERNS:
        x, y, z = sym[:n], sym[a:a + n], sym[b:b + n]
        yield (x * RADIX + y) * RADIX + z, ((x > 0) & (y > 0) & (z > 0)) * np.float32(DECAY ** (b - 2))


def margins(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Product of ``weights`` with each word's features, over the root of the sum of their squared weights."""
    if not words:
        return np.zeros(0)
    sym, start = symbols(words)
    total, norm = np.zeros(len(sym) - 4, np.float32), np.zeros(len(sym) - 4, np.float32)
    for code, w in subsequences(sym):
        total += weights[code] * w
        norm += w * w
    return np.add.reduceat(total, start) / np.sqrt(np.maximum(np.add.reduceat(norm, start), 1e-9))


def feature_rows(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, values) of each word, scaled as in margins()."""
    sym, start = symbols(words)
    found = list(subsequences(sym))
    out = []
    for i, a in enumerate(start.tolist()):
        z = a + len(words[i]) + 1
        codes = np.concatenate([c[a:z] for c, _ in found])
        w = np.concatenate([v[a:z] for _, v in found])
        codes, w = codes[w > 0], w[w > 0]
        u, at = np.unique(codes, return_inverse=True)
        out.append((u, np.bincount(at, w, len(u)) / np.sqrt(max((w * w).sum(), 1e-9))))
    return out


def _dense(features, used: np.ndarray) -> np.ndarray:
    """The columns ``used`` of some feature rows."""
    out = np.zeros((len(features), len(used)), np.float32)
    for i, (codes, values) in enumerate(features):
        at = np.minimum(np.searchsorted(used, codes), len(used) - 1)
        known = used[at] == codes
        out[i, at[known]] = values[known]
    return out


def pieces(word: str) -> list[str]:
    if len(word) <= PIECE:
        return [word]
    return [word[a:a + PIECE] for a in range(0, len(word) - PIECE + STRIDE, STRIDE)]


def bags(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of some texts, and (text, word) of all their occurrences."""
    words = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    counts = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), counts)
    distinct = coded.dictionary.to_pylist()
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    some = (length > 0)[code] if len(code) else np.zeros(0, bool)
    code, text = code[some], text[some]
    vocabulary, extra_text, extra_word = list(distinct), [], []
    # Single letters in a row are a word as well.
    one = (length == 1)[code] if len(code) else np.zeros(0, bool)
    edge = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (text[1:] != text[:-1])]) if len(code) else np.zeros(0, int)
    for a, z in zip(edge.tolist(), np.r_[edge[1:], len(code)].tolist(), strict=True):
        if z - a >= 3 and one[a]:
            for p in pieces("".join(distinct[c] for c in code[a:z])):
                extra_text.append(text[a])
                extra_word.append(len(vocabulary))
                vocabulary.append(p)
    long = np.flatnonzero(length > PIECE)
    if len(long):
        parts = {}
        for c in long.tolist():
            parts[c] = []
            for p in pieces(distinct[c])[1:]:
                parts[c].append(len(vocabulary))
                vocabulary.append(p)
            vocabulary[c] = distinct[c][:PIECE]
        for i in np.flatnonzero((length > PIECE)[code]).tolist():
            for w in parts[code[i]]:
                extra_text.append(text[i])
                extra_word.append(w)
    return vocabulary, np.r_[text, np.array(extra_text, np.int64)], np.r_[code, np.array(extra_word, np.int64)]


def _worst_words(text: np.ndarray, margin: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts the largest margin of its words, and the mean of the largest of every SHARE-th word, of three at least."""
    out = np.full((n, 2), -1.0)
    order = np.lexsort((-margin, text))
    text, margin = text[order], margin[order]
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(text)])
    taken = np.maximum(-(-count // SHARE), 3)
    rank = np.arange(len(text)) - np.repeat(first, count)
    use = rank < np.repeat(taken, count)
    sums = np.bincount(text[use], margin[use], n)[text[first]]
    out[text[first], 0] = margin[first]
    out[text[first], 1] = (sums - np.maximum(taken - count, 0)) / taken  # a word that is missing counts -1
    return out


class ToxicityModel:
    def __init__(self, weights=None, calibration: np.ndarray | None = None, constant: float = 0.5):
        self.weights, self.calibration, self.constant = weights, calibration, constant

    def worst(self, texts: pa.Array) -> np.ndarray:
        """What the margins of each text's worst words are, as of :func:`_worst_words`."""
        out = np.full((len(texts), 2), -1.0)
        for a in range(0, len(texts), ROWS):
            part = texts.slice(a, ROWS)
            words, text, word = bags(part)
            if len(text):
                out[a:a + len(part)] = _worst_words(text, margins(words, self.weights)[word], len(part))
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        return sigmoid(np.c_[self.worst(texts), np.ones(len(texts))] @ self.calibration)


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights (the bias last) of a linear machine with squared hinge loss, by Newton's method on its support vectors."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        active = y * (x @ w) < 1
        xa, ca = x[active], weight[active]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + ridge * np.eye(len(w)), xa.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-6:
            return new
        w = new
    return w


def fit_weights(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Weights of all subsequences, from texts labelled 1 (toxic) and 0."""
    words, text, word = bags(pa.array(texts, pa.string()))
    pairs = np.unique(text * len(words) + word)
    text, word = pairs // len(words), pairs % len(words)
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)

    # A first guess: the subsequences that more toxic texts have than clean ones.
    holders = np.zeros((2, RADIX**3))
    sym, start = symbols(words)
    for code, w in subsequences(sym):
        at = np.flatnonzero(w)
        of = np.searchsorted(start, at, side="right") - 1
        seen = np.unique(of * RADIX**3 + code[at])
        of, code = seen // RADIX**3, seen % RADIX**3
        for label in (0, 1):
            holders[label] += np.bincount(code, np.bincount(word[y[text] == label], minlength=len(words))[of], RADIX**3)
    weights = (np.log((holders[1] + 0.5) / n1) - np.log((holders[0] + 0.5) / n0)).astype(np.float32)
    weights[holders.sum(0) == 0] = 0

    rows = np.bincount(word, y[text], len(words)), np.bincount(word, 1 - y[text], len(words))
    evidence = (np.log((rows[0] + 0.1) / n1) - np.log((rows[1] + 0.1) / n0)) * np.sqrt(rows[0])
    # So often among the toxic, and so seldom elsewhere, that hardly one word of this vocabulary would be so by chance.
    chance = np.log(8 * max((rows[0] + rows[1] >= 8).sum(), 1)) / np.log((n0 + n1) / n1)
    telling = (rows[0] >= max(chance, n1 / 100)) & (rows[0] / n1 >= 20 * (rows[1] + 0.1) / n0)
    mined = np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        margin = margins(words, weights)
        order = np.lexsort((-margin[word], text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        t, w = text[order], word[order]
        count = np.bincount(t, minlength=len(y))[t]
        chosen = np.where(y[t] == 1, (rank < np.maximum(1, count // SHARE)) | telling[w], (rank < 4) | (rank % 97 == 50))
        positive, negative = w[chosen & (y[t] == 1)], w[chosen & (y[t] == 0)]
        mined = negative = np.r_[mined, negative]  # a clean word that once looked toxic stays an example
        wanted = [np.argsort(-evidence, kind="stable")[:LANDMARKS // 2], np.unique(positive, return_counts=True), np.unique(negative, return_counts=True)]
        marks = list(dict.fromkeys([*wanted[0].tolist(), *(c.tolist()[i] for c, n in wanted[1:] for i in np.argsort(-n, kind="stable")[:LANDMARKS // 4].tolist())]))
        features = feature_rows([words[i] for i in marks])
        used = np.unique(np.concatenate([c for c, _ in features]))
        landmarks = _dense(features, used)
        value, vector = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
        root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T

        instances = np.r_[np.unique(positive), np.unique(negative)]
        counts = np.r_[np.unique(positive, return_counts=True)[1], np.unique(negative, return_counts=True)[1]].astype(float)
        sign = np.r_[np.ones(len(np.unique(positive))), -np.ones(len(np.unique(negative)))]
        for label, mass in ((1, 1000), (-1, CLEAN_MASS)):
            counts[sign == label] /= max(counts[sign == label].sum(), 1) / mass
        kernel = np.concatenate([_dense(feature_rows([words[i] for i in instances[a:a + 512]]), used) @ landmarks.T for a in range(0, len(instances), 512)]).astype(float)
        machine = train_machine(kernel @ root, sign, counts)
        weights = np.zeros(RADIX**3, np.float32)
        weights[used] = (root @ machine[:-1]) @ landmarks
    return weights


def fit_texts(texts: list[str], y: np.ndarray) -> ToxicityModel:
    """A machine trained on two thirds of the texts and calibrated on the rest.

    Toxic texts weigh as in the sample, where they are more frequent than in the corpus: of texts on the border rather too many are called toxic.
    """
    half = np.zeros(len(y), bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[1::3]] = True
    model = ToxicityModel(fit_weights([t for t, h in zip(texts, half, strict=True) if not h], y[~half]))
    worst = model.worst(pa.array([t for t, h in zip(texts, half, strict=True) if h], pa.string()))
    model.calibration = fit_logistic(np.c_[worst, np.ones(len(worst))], y[half])
    return model


def fit(docs: DataFrame, labels: DataFrame, train, per_class: int = PER_CLASS) -> ToxicityModel:
    rows = labelled_sample(docs, labels, "toxic", train, per_class, TRAIN_CHARS)
    y = np.array([r.y for r in rows], float)
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return ToxicityModel(constant=float(y.mean()) if len(y) else 0.5)
    return fit_texts([r.text for r in rows], y)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; labels of held-out rows are not learnt from."""
    model = fit(docs, labels, crc_mod("doc_id", 5) != 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one weight for each of RADIX^3 subsequences

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(b.column("text")), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

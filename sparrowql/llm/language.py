"""Language identification by a linear-chain conditional random field.

Words (runs of letters, those over ``LONGEST`` letters in parts of that length) of
a text form a chain; labels are the languages of the training documents, however
many. A word's features are its affixes, character trigrams and
itself (the lexicon), hashed into ``BUCKETS`` rows of weights (fewer where there are
so many labels that the weights would pass ``WEIGHTS`` cells); transitions
between the labels of neighbouring words are learned too. Training sequences
are spliced from pieces of several documents, so that they switch language as
code-switched text does. Forward-backward gives each word's label
probabilities; a document's language has the largest sum of them, weighted by
letters, and its score is that share; of equal ones the first by name is taken.

The model is fitted on the driver on a bounded sample (about ``DOCS_A_LANGUAGE``
distinct pieces of ``PIECE`` characters a language, from a hash of id and text); every word of
every text is labelled. Matrices hold ``CELLS`` words times labels at most; a longer chain
goes block by block, with forward values kept at the blocks' starts alone.
Cases: a null text, or one without a letter, is
``und`` with score 0, as is every text where there is nothing to learn from;
null languages aren't learned from; repeated rows and null ids are judged like
any other, and no id weighs more than its texts; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowql.llm.shared import slices, trimmed, with_fields

#: Bounds of the training sample.
DOCS_A_LANGUAGE, PIECE = 800, 500
BUCKETS, WEIGHTS = 1 << 16, 1 << 25
#: Letters of a position of a chain at most, so that long runs without spaces are several.
LONGEST = 32
EPOCHS, SEQUENCES, PIECE_WORDS, RATE, DECAY = 4, 64, (6, 20), 0.3, 1e-5
#: Words times labels whose emissions a task keeps, and cells (words or features times labels) of a matrix.
CACHE_CELLS, CELLS = 1_600_000, 6_000_000
UNKNOWN = "und"

_TOKEN = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}+")


def letters(text: str) -> list[str]:
    """Runs of letters, in lower case, in parts of LONGEST at most."""
    found = _TOKEN.findall(text)
    if not all(map(str.isalpha, found)):  # \w knows numerals that are neither digit nor letter
        found = _LETTERS.findall(text)
    if max(map(len, found), default=0) > LONGEST:
        found = [w[k : k + LONGEST] for w in found for k in range(0, len(w), LONGEST)]
    return [w.lower() for w in found]


def buckets_of(n_labels: int) -> int:
    """Rows of weights: a power of two."""
    return min(BUCKETS, max(1 << 10, 1 << (WEIGHTS // max(1, n_labels)).bit_length() - 1))


def features(word: str, buckets: int = BUCKETS) -> list[int]:
    crc, mask = zlib.crc32, buckets - 1
    names = [b"w" + word.encode()]
    names += [b"p" + word[:k].encode() for k in (1, 2, 3) if len(word) >= k]
    names += [b"s" + word[-k:].encode() for k in (1, 2, 3) if len(word) >= k]
    wide = f"^{word}$"
    names += [wide[i : i + 3].encode() for i in range(len(wide) - 2)]
    return [crc(n) & mask for n in names]


class Features:
    """Feature lists of words, flat."""

    def __init__(self, words: list[str], buckets: int):
        lists = [features(w, buckets) for w in words]
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.flat = np.fromiter((f for x in lists for f in x), np.int64, int(self.counts.sum()))
        self.starts = np.cumsum(self.counts) - self.counts

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.counts), weights.shape[1]), np.float32)
        most = max(1, CELLS // max(1, weights.shape[1]))
        at = 0
        while at < len(self.counts):  # as many words as CELLS allows, and one at least
            end = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + most, side="right")) - 1)
            end = len(self.counts) if self.flat.size - self.starts[at] <= most else end
            first, last = self.starts[at], self.starts[end - 1] + self.counts[end - 1]
            out[at:end] = np.add.reduceat(weights[self.flat[first:last]], self.starts[at:end] - first, axis=0)
            at = end
        return out


def forward_backward(e: np.ndarray, moves: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (steps, chains, labels) and summed pair marginals (labels, labels).

    ``e``: exp(emissions), (steps, chains, labels); ``moves``: exp(transitions).
    Chains are sorted by length, the longest first; ``active[t]`` chains have a
    step t. Every step is scaled, so nothing underflows.
    """
    steps, _, labels = e.shape
    ahead = np.empty_like(e)
    a = e[0] / e[0].sum(1, keepdims=True)
    ahead[0] = a
    for t in range(1, steps):
        n = active[t]
        a = (a[:n] @ moves) * e[t, :n]
        a /= a.sum(1, keepdims=True)
        ahead[t, :n] = a
    pairs = np.zeros((labels, labels))
    b = np.ones_like(e[0])
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        later = b[:n] * e[t + 1, :n]
        whole = ((ahead[t, :n] @ moves) * later).sum(1, keepdims=True)
        pairs += moves * ((ahead[t, :n] / whole).T @ later)
        b[:n] = later @ moves.T
        b[:n] /= b[:n].sum(1, keepdims=True)
        ahead[t, :n] *= b[:n]
    ahead /= np.maximum(ahead.sum(2, keepdims=True), 1e-30)
    return ahead, pairs


def marginals(e: np.ndarray, moves: np.ndarray, active: np.ndarray) -> np.ndarray:
    """As forward_backward, without the pairs."""
    steps = len(e)
    ahead = np.empty_like(e)
    a = e[0] / e[0].sum(1, keepdims=True)
    ahead[0] = a
    for t in range(1, steps):
        n = active[t]
        a = (a[:n] @ moves) * e[t, :n]
        a /= a.sum(1, keepdims=True)
        ahead[t, :n] = a
    b, back = np.ones_like(e[0]), np.ascontiguousarray(moves.T)
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        later = (b[:n] * e[t + 1, :n]) @ back
        later /= later.sum(1, keepdims=True)
        b[:n] = later
        ahead[t, :n] *= later
    ahead /= np.maximum(ahead.sum(2, keepdims=True), 1e-30)
    return ahead


def long_mass(e: np.ndarray, rows: np.ndarray, sizes: np.ndarray, moves: np.ndarray, block: int) -> np.ndarray:
    """The marginals of one chain (``rows`` of exp(emissions) ``e``) summed with weights ``sizes``, block by block."""
    starts, heads, a = range(0, len(rows), block), [], None

    def ahead(start: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        here = np.maximum(e[rows[start : start + block]], 1e-20)
        out = np.empty_like(here)
        for t, x in enumerate(here):
            a = x if a is None else (a @ moves) * x
            a = a / a.sum()
            out[t] = a
        return here, out

    for start in starts:
        heads.append(a)
        a = ahead(start, a)[1][-1]
    b, mass = np.ones(e.shape[1], np.float32), np.zeros(e.shape[1])
    for start, head in zip(reversed(starts), reversed(heads), strict=True):
        here, before = ahead(start, head)
        for t in range(len(here) - 1, -1, -1):
            m = before[t] * b
            mass += m * (sizes[start + t] / max(m.sum(), 1e-30))
            b = moves @ (here[t] * b)
            b = b / b.sum()
    return mass


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves
        self.index: dict[str, int] = {}
        self.emissions = np.zeros((0, len(labels)), np.float32)

    def __getstate__(self):
        return self.labels, self.weights, self.moves

    def __setstate__(self, state):
        self.__init__(*state)

    def _rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        new = list({w for t in texts for w in t if w not in self.index})
        if (len(self.index) + len(new)) * len(self.labels) > CACHE_CELLS:
            self.index, self.emissions = {}, self.emissions[:0]
            new = list({w for t in texts for w in t})
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        made = Features(new, len(self.weights)).emissions(self.weights)
        made = np.exp(made - made.max(1, keepdims=True)) if len(made) else made
        self.emissions = np.concatenate([self.emissions, made.astype(np.float32)])
        return [np.fromiter(map(self.index.__getitem__, t), np.int64, len(t)) for t in texts]

    def word_labels(self, rows: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """(chains, lengths, marginals) of groups of chains, which are given as rows of emissions."""
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: -len(rows[i]))
        at = 0
        while at < len(order):
            steps = len(rows[order[at]])
            group = order[at : at + max(1, CELLS // (steps * len(self.labels)))]
            at += len(group)
            lengths = np.array([len(rows[i]) for i in group])
            x = np.zeros((len(group), steps), np.int64)
            x[np.arange(steps) < lengths[:, None]] = np.concatenate([rows[i] for i in group])
            active = np.searchsorted(-lengths, -np.arange(steps), side="left")
            e = np.maximum(self.emissions[x.T], 1e-20)
            m = marginals(e, self._moves(), active)
            m[np.arange(steps)[:, None] >= lengths] = 0
            yield group, lengths, m

    def _moves(self) -> np.ndarray:
        return np.exp(self.moves - self.moves.max()).astype(np.float32)

    def masses(self, tokens: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """Each chain's marginals summed by letters."""
        rows = self._rows(tokens)
        sizes = [np.fromiter(map(len, t), np.float32, len(t)) for t in tokens]
        for i, r in enumerate(rows):
            if len(r) * len(self.labels) > CELLS:
                yield i, long_mass(self.emissions, r, sizes[i], self._moves(), max(1, CELLS // (2 * len(self.labels))))
                rows[i] = r[:0]
        for group, lengths, m in self.word_labels(rows):
            size = np.zeros(m.shape[:2], np.float32)
            for k, i in enumerate(group):
                size[: lengths[k], k] = sizes[i]
            yield from zip(group, np.einsum("tnl,tn->nl", m, size, dtype=np.float64), strict=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        tokens = [letters(t) if t else [] for t in texts]
        found, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return found, score
        for i, mass in self.masses(tokens):
            best = int(mass.argmax())
            found[i], score[i] = self.labels[best], min(1.0, float(mass[best] / mass.sum()))
        return found, score


def fit(pieces: list[tuple[str, str]], seed: int = 5) -> Model:
    """A model from (language, text) pieces, by AdaGrad on spliced sequences."""
    labels = sorted({lang for lang, _ in pieces})
    n = len(labels)
    rng = np.random.default_rng(seed)
    by_label = [[w for w in (letters(t) for lang, t in pieces if lang == label) if w] for label in labels]
    weights, moves = np.zeros((buckets_of(n), n), np.float32), np.zeros((n, n))
    model = Model(labels, weights, moves)
    usable = [k for k in range(n) if by_label[k]]
    if not usable:
        return Model([], weights[:, :0], moves[:0, :0])
    vocabulary = sorted({w for docs in by_label for d in docs for w in d})
    number = {w: i for i, w in enumerate(vocabulary)}
    feats = Features(vocabulary, len(weights))
    coded = [[np.array([number[w] for w in d]) for d in docs] for docs in by_label]
    total = sum(len(d) for docs in coded for d in docs)
    steps = 3 * PIECE_WORDS[1]
    square_w, square_m = np.full(weights.shape, 1e-6, np.float32), np.full(moves.shape, 1e-6)
    for _ in range(max(20, min(600, EPOCHS * total // (SEQUENCES * steps // 2)))):
        chains = []
        for _ in range(SEQUENCES):
            words, gold = [], []
            for _ in range(int(rng.integers(1, 4))):
                k = usable[int(rng.integers(len(usable)))]
                d = coded[k][int(rng.integers(len(coded[k])))]
                size = int(rng.integers(*PIECE_WORDS))
                start = int(rng.integers(max(1, len(d) - size + 1)))
                words.append(d[start : start + size])
                gold.append(np.full(len(words[-1]), k))
            chains.append((np.concatenate(words), np.concatenate(gold)))
        chains.sort(key=lambda c: -len(c[0]))
        lengths = np.array([len(c[0]) for c in chains])
        t_max = int(lengths[0])
        valid = np.arange(t_max)[:, None] < lengths
        x, y = np.zeros((t_max, len(chains)), np.int64), np.zeros((t_max, len(chains)), np.int64)
        for c, (w, g) in enumerate(chains):
            x[: len(w), c], y[: len(w), c] = w, g
        words, inverse = np.unique(x[valid], return_inverse=True)
        counts = feats.counts[words]
        flat = feats.flat[np.repeat(feats.starts[words] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        begin = np.cumsum(counts) - counts
        scores = np.add.reduceat(weights[flat], begin, axis=0)
        e = np.ones((t_max, len(chains), n))
        at = scores[inverse]
        e[valid] = np.maximum(np.exp(at - at.max(1, keepdims=True)), 1e-30)
        active = np.searchsorted(-lengths, -np.arange(t_max), side="left")
        m, pairs = forward_backward(e, np.exp(moves - moves.max()), active)
        slope = -m[valid]
        slope[np.arange(len(slope)), y[valid]] += 1
        by_word = np.zeros((len(words), n))
        np.add.at(by_word, inverse, slope)
        touched, place = np.unique(flat, return_inverse=True)
        g = np.zeros((len(touched), n), np.float32)
        np.add.at(g, place, np.repeat(by_word, counts, axis=0).astype(np.float32))
        g = g / SEQUENCES - DECAY * weights[touched]
        square_w[touched] += g * g
        weights[touched] += RATE * g / np.sqrt(square_w[touched])
        both = valid[1:]
        seen = np.zeros((n, n))
        np.add.at(seen, (y[:-1][both], y[1:][both]), 1)
        g = (seen - pairs) / SEQUENCES
        square_m += g * g
        moves += RATE * g / np.sqrt(square_m)
    return model


def remainder(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def training_pieces(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Bounded: at most about DOCS_A_LANGUAGE distinct pieces of PIECE characters a language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (remainder(F.col(id_col)) != 2))
    usable = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("place"))
    unit = 1 << 30
    share = F.least(F.lit(unit), F.floor(F.lit(unit * DOCS_A_LANGUAGE) / F.count(F.lit(1)))).cast("long")
    shares = usable.groupBy(F.col("lang").alias("of")).agg(share.alias("share"))  # a row a language
    sample = usable.join(F.broadcast(shares), (F.col("lang") == F.col("of")) & (F.pmod("place", F.lit(unit)) < F.col("share")))
    start = 1 + F.pmod(F.xxhash64("place"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1)
    pieces = sample.select("lang", F.substring(F.col("text"), start.cast("int"), F.lit(PIECE)).alias("piece")).distinct()
    return sorted((r.lang, r.piece) for r in pieces.collect())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``lang_pred`` and ``score`` of each row."""
    wanted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(remainder(F.col(id_col)) == 2, F.lit(False)).alias("held"))
    schema = with_fields(docs.select(id_col).schema, held_out="boolean", lang_pred="string", score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 12_000_000):
                found, score = model.predict(part.column("text").to_pylist())
                columns = [part.column("id"), part.column("held"), pa.array(found, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return wanted.mapInArrow(trimmed(run), schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fits on the documents that aren't held out, then labels all."""
    return predict(docs, fit(training_pieces(docs, id_col, text_col, lang_col)), id_col, text_col)

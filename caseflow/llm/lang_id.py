"""Language identification of code-switched text by a linear-chain conditional random field over words.

Every word of a text is labelled. Its features are affixes, character n-grams and a lexicon entry (the word
itself, hashed as all features are: a word that training never met has a weight of nothing there, unless it shares a row); label-to-label transitions are learned with them. Forward-backward gives each
word's label marginals; a document's score for a language is the mean marginal of that label over its words with a letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import keep_one, table, text_slices, tidy

UNKNOWN = "und"
#: Bounds of the training sample: documents of each language, and words taken from each of them.
TRAIN_DOCS = 250
TRAIN_WORDS = 300
#: Features are hashed into a table of 2**TABLE_BITS rows of label weights.
TABLE_BITS = 18
#: Words whose numbers are kept, and bytes of text that are labelled at a time.
_MAX_CACHE = 120_000
_SLICE = 1 << 20
#: A word is familiar if training met more than this part of its features.
FAMILIAR = 0.7
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _hash(x: np.ndarray, kind: int) -> np.ndarray:
    x = (x + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature rows, word of each, whether a word has a letter) of lower-case words.

    A word is taken from its first to its last letter, between marks for its ends. Its features are all character
    2-grams and 3-grams, which with the marks include affixes of one and two letters, the first and last three letters, and the word itself.
    """
    none = np.zeros(0, np.int64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return none, none, np.zeros(len(words), bool)
    owner = np.repeat(np.arange(len(words)), lens)
    at = np.flatnonzero(_letters()[codes])
    lettered = np.zeros(len(words), bool)
    lettered[owner[at]] = True
    which = np.flatnonzero(lettered)
    if not len(which):
        return none, none, lettered
    first, last = np.full(len(words), len(codes)), np.full(len(words), -1)
    np.minimum.at(first, owner[at], at)
    np.maximum.at(last, owner[at], at)
    first, size = first[which], last[which] - first[which] + 1
    # cores with an end mark on either side, one after the other
    starts = np.cumsum(size + 2) - (size + 2)
    own = np.repeat(which, size + 2)
    place = np.arange(len(own)) - np.repeat(starts, size + 2)
    inner = (place > 0) & (place <= np.repeat(size, size + 2))
    c = np.where(place == 0, 1, 2).astype(np.uint64)
    c[inner] = codes[(np.repeat(first, size + 2) + place - 1)[inner]]
    two = c[:-1] << np.uint64(21) | c[1:]
    three = two[:-1] << np.uint64(21) | c[2:]
    same2, same3 = own[:-1] == own[1:], own[:-2] == own[2:]
    long = size >= 3
    four = lambda i: three[i] ^ (c[i + 3] << np.uint64(43))
    whole = np.add.reduceat(_hash(c + place.astype(np.uint64) * np.uint64(0x1000003), 9), starts)
    parts = [(_hash(two, 2)[same2], own[:-1][same2]), (_hash(three, 3)[same3], own[:-2][same3]), (_hash(four(starts[long]), 4), which[long]), (_hash(four((starts + size - 2)[long]), 5), which[long]), (_hash(whole, 6), which)]
    rows = np.concatenate([p for p, _ in parts]) >> np.uint64(64 - TABLE_BITS)
    return rows.astype(np.int64), np.concatenate([o for _, o in parts]), lettered


def _words(text: str | None, limit: int | None = None) -> list[str]:
    return text.lower().split()[:limit] if text else []


class Crf:
    """Weights of a trained field: a row of label weights per hashed feature, transitions, start weights; and which features training met."""

    def __init__(self, labels: list[str], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, met: np.ndarray | None = None):
        self.labels, self.weights, self.trans, self.start = labels, weights, trans, start
        self.met = np.zeros(len(weights), bool) if met is None else met
        self._familiar = np.zeros(1024, bool)
        self._of: dict[str, int] = {}
        self._emit = np.zeros((1024, len(labels)))
        self._letters = np.zeros(1024, bool)

    def __getstate__(self):
        return (self.labels, self.weights, self.trans, self.start, self.met)

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Numbers of distinct words in the table of label weights, which grows with new words and starts afresh when large."""
        of = self._of
        new = [w for w in words if w not in of]
        if len(of) + len(new) > _MAX_CACHE:
            of.clear()
            new = words
        if (top := len(of) + len(new)) > len(self._emit):
            size = max(top, 2 * len(self._emit))
            self._emit = np.concatenate((self._emit, np.zeros((size - len(self._emit), len(self.labels)))))
            self._letters = np.concatenate((self._letters, np.zeros(size - len(self._letters), bool)))
            self._familiar = np.concatenate((self._familiar, np.zeros(size - len(self._familiar), bool)))
        if new:
            lo = len(of)
            of.update(zip(new, range(lo, top), strict=True))
            rows, owner, self._letters[lo:top] = word_features(new)
            self._familiar[lo:top] = np.bincount(owner, self.met[rows], minlength=len(new)) > FAMILIAR * np.maximum(1, np.bincount(owner, minlength=len(new)))
            for k in range(len(self.labels)):
                self._emit[lo:top, k] = np.bincount(owner, self.weights[rows, k], minlength=len(new))
        return np.fromiter(map(of.__getitem__, words), np.int64, len(words))

    def marginals(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Label marginals of each chain of word numbers, by forward-backward over all chains at once."""
        order = sorted(range(len(chains)), key=lambda i: -len(chains[i]))
        lens = np.array([len(chains[i]) for i in order])
        out: list = [None] * len(chains)
        offsets = np.concatenate(([0], np.cumsum(lens)))
        emit = self._emit[np.concatenate([chains[i] for i in order])] if lens.sum() else np.zeros((0, len(self.labels)))
        pots = np.exp(emit - emit.max(axis=1, keepdims=True)) if len(emit) else emit
        t, s = np.exp(self.trans), np.exp(self.start)
        alpha, beta = np.empty_like(pots), np.empty_like(pots)
        steps = int(lens[0]) if len(lens) else 0
        live = np.searchsorted(-lens, -np.arange(steps), side="left")  # chains longer than the step
        for k in range(steps):
            at = offsets[: live[k]] + k
            a = pots[at] * (s if k == 0 else alpha[at - 1] @ t)
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        for k in range(steps - 1, -1, -1):
            at = offsets[: live[k]] + k
            b = np.ones((len(at), len(self.labels)))
            if k + 1 < steps and (n := live[k + 1]):
                nxt = at[:n] + 1
                b[:n] = (beta[nxt] * pots[nxt]) @ t.T
                b[:n] /= b[:n].sum(axis=1, keepdims=True)
            beta[at] = b
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        for j, i in enumerate(order):
            out[i] = gamma[offsets[j] : offsets[j + 1]]
        return out

    def label_texts(self, texts: pa.Array | list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; texts without a letter are ``und`` with score 0."""
        return [x[:2] for x in self.judge_texts(texts)]

    def judge_texts(self, texts: pa.Array | list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, familiar) of each text; familiar is the share of its words with a letter whose features are mostly such as training met, whatever the languages.

        Texts of like length are labelled together, so that a step of forward-backward has many chains; distinct words are looked up once.
        """
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out: list = [(UNKNOWN, 0.0, 0.0)] * len(texts)
        sizes = pc.binary_length(texts).to_numpy()
        order = np.argsort(sizes, kind="stable")
        for a, z in text_slices(sizes[order].tolist(), _SLICE):
            words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.utf8_lower(texts.take(pa.array(order[a:z])))))
            known = words.flatten().dictionary_encode()
            numbers = self.emissions(known.dictionary.to_pylist())[known.indices.to_numpy()]
            chains = np.split(numbers, words.offsets.to_numpy()[1:-1])
            for k, (chain, g) in enumerate(zip(chains, self.marginals(chains), strict=True)):
                lettered = self._letters[chain]
                if lettered.any():
                    mean = g[lettered].mean(axis=0)
                    best = int(mean.argmax())
                    out[order[a + k]] = (self.labels[best], float(min(1.0, mean[best])), float(self._familiar[chain][lettered].mean()))
        return out


def fit(samples: list[tuple[str, str]], epochs: int = 4, rate: float = 0.5, seed: int = 7, l2: float = 1e-6, words: int = TRAIN_WORDS) -> Crf:
    """Train on (text, language) pairs. Chains join short segments of different texts, so that switches are seen.

    A sample with one language gives a field with one label; an empty sample gives one that answers ``und`` only.
    """
    labels = sorted({lang for _, lang in samples})
    if not labels:
        return Crf([UNKNOWN], np.zeros((1 << TABLE_BITS, 1)), np.zeros((1, 1)), np.zeros(1))
    rng = np.random.default_rng(seed)
    segments = []
    for text, lang in samples:
        tokens, at = _words(text, words), 0
        while at < len(tokens):
            n = int(rng.integers(4, 40))
            segments.append((tokens[at : at + n], labels.index(lang)))
            at += n
    n, met = len(labels), np.zeros(1 << TABLE_BITS, bool)
    weights, trans, start = np.zeros((1 << TABLE_BITS, n)), np.zeros((n, n)), np.zeros(n)
    sq_w, sq_t, sq_s = (np.full(x.shape, 1e-2) for x in (weights, trans, start))
    for _ in range(epochs):
        perm = rng.permutation(len(segments))
        chains, at = [], 0
        while at < len(perm):
            k = int(rng.choice((1, 2, 3, 4)))
            chains.append([segments[i] for i in perm[at : at + k]])
            at += k
        for lo in range(0, len(chains), 64):
            batch = chains[lo : lo + 64]
            tokens = [w for c in batch for ws, _ in c for w in ws]
            gold = [np.concatenate([np.full(len(ws), y) for ws, y in c]) for c in batch]
            flat, owner, _ = word_features(tokens)
            emit = np.stack([np.bincount(owner, weights[flat, k], minlength=len(tokens)) for k in range(n)], axis=1)
            lens = [len(g) for g in gold]
            g_emit, g_trans, g_start = _gradient(emit, lens, gold, trans, start)
            g_emit /= len(batch)
            used, inverse = np.unique(flat, return_inverse=True)
            met[used] = True
            gw = np.stack([np.bincount(inverse, g_emit[owner, k], minlength=len(used)) for k in range(n)], axis=1)
            gw -= l2 * weights[used]
            sq_w[used] += gw * gw
            weights[used] += rate * gw / np.sqrt(sq_w[used])
            for x, sq, g in ((trans, sq_t, g_trans / len(batch)), (start, sq_s, g_start / len(batch))):
                sq += g * g
                x += rate * 0.2 * g / np.sqrt(sq)
    return Crf(labels, weights.astype(np.float32), trans, start, met)


def _gradient(emit, lens, gold, trans, start):
    """Observed minus expected counts of labels, transitions and starts."""
    n = emit.shape[1]
    width = max(lens)
    pots = np.zeros((len(lens), width, n))
    live = np.arange(width)[None, :] < np.array(lens)[:, None]
    pots[live] = np.exp(emit - emit.max(axis=1, keepdims=True))
    t = np.exp(trans - trans.max())
    alpha, beta = np.zeros_like(pots), np.ones_like(pots)
    for k in range(width):
        a = pots[:, k] * (np.exp(start) if k == 0 else alpha[:, k - 1] @ t)
        alpha[:, k] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
    for k in range(width - 2, -1, -1):
        b = (beta[:, k + 1] * pots[:, k + 1]) @ t.T
        b /= np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
        beta[:, k] = np.where(live[:, k + 1][:, None], b, 1.0)
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
    y = np.concatenate(gold)
    observed = np.zeros_like(emit)
    observed[np.arange(len(y)), y] = 1
    pair = alpha[:, :-1, :, None] * t[None, None] * (pots * beta)[:, 1:, None, :]
    pair /= np.maximum(pair.sum(axis=(2, 3), keepdims=True), 1e-300)
    expected = pair[live[:, 1:]].sum(axis=0) if width > 1 else np.zeros((n, n))
    seen = np.zeros((n, n))
    first = np.zeros(n)
    for g in gold:
        np.add.at(seen, (g[:-1], g[1:]), 1)
        first[g[0]] += 1
    return observed - gamma[live], seen - expected, first - gamma[:, 0].sum(axis=0)


def held_out(doc_id="doc_id"):
    """The fold that training never sees; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, docs_per_language: int = TRAIN_DOCS, words: int = TRAIN_WORDS) -> Crf:
    """Fit on at most ``docs_per_language`` labelled documents a language outside the held-out fold, chosen by a hash of their
    ids, and the first ``words`` words of each: a bounded sample that alone reaches the driver."""
    fold = docs.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "doc_id")
    ids = fold.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    # a language's smallest hashes lie under a threshold that its own count gives, with room to spare, so few rows of it meet in one task
    share = F.least(F.lit(1.0), F.lit(8.0 * (docs_per_language + 32)) / F.col("size"))
    few = ids.join(ids.groupBy("lang").agg(F.count("*").alias("size")), "lang")
    ids = few.filter(F.col("h").cast("double") / F.lit(2.0**64) + 0.5 <= share).withColumn("n", F.row_number().over(order))
    # first the ids alone, then the texts of these: the tasks' candidates would else be whole texts
    chosen = ids.filter(F.col("n") <= docs_per_language).select("lang", "doc_id").collect()
    if not chosen:
        return fit([])
    picked = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], "lang string, doc_id long")
    text = F.substring_index(F.regexp_replace("text", r"\s+", " "), " ", words)
    rows = fold.join(F.broadcast(picked), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min(text).alias("t")).collect()
    samples = [(r.t, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.doc_id))]
    return fit(samples, words=words)


def with_language(spark: SparkSession, docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with lang_pred, score and familiar, from the whole of column text alone."""
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("familiar", DoubleType())])

    def run(batches):
        # a copy with word tables of its own, which go with the task
        model = Crf(*sent.value.__getstate__())
        keep_one("languages", dict)
        for b in tidy(batches):
            found = model.judge_texts(b.column(at))
            new = [pa.array([x[0] for x in found], pa.string()), *(pa.array([x[k] for x in found], pa.float64()) for k in (1, 2))]
            yield pa.record_batch([*b.columns, *new], names=[*b.schema.names, "lang_pred", "score", "familiar"])

    return docs.mapInArrow(run, schema)


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Texts that are null or have no letter are ``und`` with score 0. Equal texts have equal predictions. Rows with a null doc_id or lang are labelled but
    not learned from; with nothing to learn from, all is ``und``. Empty tables give no rows; columns other than doc_id, text and lang are not read.
    """
    out = with_language(spark, docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLE_SQL: dict[str, str] = {}

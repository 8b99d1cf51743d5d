"""Language of words in code-switched text by a linear-chain conditional random field.

A word's features are its byte prefixes and suffixes, byte trigrams, its identity (all hashed) and the
languages whose lexicon has it; transitions and the first label's weights are learned with them by
gradient ascent on the log-likelihood. Training sequences are spliced from runs of words of documents of
known language, so that labels switch inside them. Forward-backward gives every word's label
probabilities; a document's are their mean, and its language is the largest.

The model is fitted on the driver from a bounded sample of labelled rows (``SAMPLE_DOCS`` documents of
each label, drawn row by row so that copies of a text can't fill a label's places, and ``SAMPLE_CHARS``
characters of each); all labels of the training rows are learned, and whole texts are scored, in
place, without a shuffle. Null text, text without letters, or no labelled rows at all: ``und``, score 0.
Ties go to the label that sorts first. Repeated rows and null ids are scored like others; an empty
table gives no rows. A kept column that has the name of an output gets an underscore at its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, VariantType

from .common import SLICE_BYTES, col, kept_names, passed_schema, slices, words_of, worker

SAMPLE_DOCS, SAMPLE_CHARS = 700, 3_000
#: Characters of text times labels that are scored at once.
SLICE_LABELS = 16 << 20
#: Distinct words of a slice whose features are looked up at once.
WORDS = 1 << 14
#: Training sequences, their length, steps of ascent, hashed feature rows.
SEQUENCES, LENGTH, STEPS, ROWS = 2_400, 48, 50, 1 << 17
UND = "und"


def _features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature rows of all words, one after another, and where each word's begin."""
    words = words.cast(pa.large_string())
    n = len(words)
    off = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1]
    raw = np.frombuffer(words.buffers()[2], np.uint8)[off[0] : off[-1]] if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = np.diff(off)
    # every word between a start and an end byte
    at = off[:-1] - off[0] + 2 * np.arange(n)
    text = np.zeros(len(raw) + 2 * n, np.uint32)
    inner = np.ones(len(text), bool)
    inner[at], inner[at + size + 1] = False, False
    text[at], text[at + size + 1], text[inner] = 1, 2, raw
    word = np.repeat(np.arange(n), size)
    p = np.arange(len(raw)) + 2 * word
    mul = np.uint32(0x9E3779B1)
    keys, owner = [(text[p] | text[p + 1] << np.uint32(8) | text[p + 2] << np.uint32(16)) * mul], [word]
    total = np.zeros(n, np.uint32)
    for i in range(1, 5):
        has = np.flatnonzero(size >= i)
        head, tail = np.full(len(has), 3 * i, np.uint32), np.full(len(has), 3 * i + 1, np.uint32)
        for j in range(i):
            head = (head ^ text[at[has] + 1 + j]) * np.uint32(0x85EBCA6B)
            tail = (tail ^ text[at[has] + size[has] - j]) * np.uint32(0xC2B2AE35)
        keys += [head * mul, tail * mul]
        owner += [has, has]
    # identity: a polynomial over the bytes
    weight = text[p + 1] * ((np.uint32(2 * 0x01000193) * (p - at[word]).astype(np.uint32) + np.uint32(1)) * mul)
    np.add.at(total, word, weight ^ (weight >> np.uint32(15)))
    keys.append((total ^ size.astype(np.uint32)) * mul)
    owner.append(np.arange(n))
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    keys = (keys ^ (keys >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((keys >> np.uint32(12)) & np.uint32(ROWS - 1)).astype(np.int32)[order], np.searchsorted(owner[order], np.arange(n))


class Model:
    """labels; weights (ROWS, labels); lexicon words and their rows of ``lex``; transitions; first."""

    def __init__(self, labels: list[str], lexicon: pa.Array, lexicon_row: np.ndarray):
        k = len(labels)
        self.labels, self.lexicon, self.lexicon_row = labels, lexicon.cast(pa.large_string()), lexicon_row
        self.w = np.zeros((ROWS, k), np.float32)
        self.lex = np.zeros((int(lexicon_row.max(initial=0)) + 1, k), np.float32)
        self.trans, self.first = np.zeros((k, k), np.float32), np.zeros(k, np.float32)

    def rows(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = pc.fill_null(pc.index_in(words.cast(pa.large_string()), self.lexicon), -1)
        found = np.asarray(found)
        return *_features(words), np.where(found >= 0, self.lexicon_row[found], 0) if len(self.lexicon) else np.zeros(len(words), np.int64)

    def emit(self, feats: np.ndarray, begin: np.ndarray, lex: np.ndarray) -> np.ndarray:
        """exp of the words' label scores, scaled to at most 1."""
        e = np.add.reduceat(self.w[feats], begin, axis=0) + self.lex[lex] if len(begin) else np.zeros((0, len(self.labels)), np.float32)
        return np.exp(e - e.max(1, keepdims=True, initial=-np.inf)) + np.float32(1e-12)

    def emit_words(self, words: pa.Array) -> np.ndarray:
        """``emit`` of words, whose features, some fifty times their bytes, are never all there."""
        return np.concatenate([self.emit(*self.rows(words.slice(a, WORDS))) for a in range(0, max(1, len(words)), WORDS)])


def forward_backward(emit: np.ndarray, codes: np.ndarray, off: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word of sequences ``off`` over ``codes``, and the summed transition probabilities.

    Sequences run side by side, longest first; each step is one product over those that are still going.
    """
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    begin, size = off[:-1][order], size[order]
    k = len(first)
    alpha = np.empty((len(codes), k), np.float32)
    steps = int(size[0]) if len(size) else 0
    going = np.searchsorted(-size, -np.arange(steps), side="left")
    t_exp, f_exp = np.exp(trans), np.exp(first)
    a = None
    for t in range(steps):
        at = begin[: going[t]] + t
        a = (f_exp if t == 0 else a[: len(at)] @ t_exp) * emit[codes[at]]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    pairs = np.zeros((k, k))
    b = np.ones((0, k), np.float32)
    for t in range(steps - 1, -1, -1):
        at = begin[: going[t]] + t
        if len(b) < len(at):
            b = np.concatenate([b, np.ones((len(at) - len(b), k), np.float32)])
        p = alpha[at] * b
        z = p.sum(1, keepdims=True)
        later = emit[codes[at]] * b
        alpha[at] = p / z
        if t:
            prev = begin[: going[t]] + t - 1
            message = later @ t_exp.T
            u, v = alpha[prev], later
            norm = np.maximum((u * message).sum(1, keepdims=True), 1e-30)
            pairs += (u / norm).T @ v * t_exp
            b = message / message.sum(1, keepdims=True)
    return alpha, pairs


def fit(texts: list[str], langs: list[str]) -> Model | None:
    """Train on texts of one language each."""
    labels = sorted(set(langs))
    if not labels:
        return None
    k, rng = len(labels), np.random.default_rng(5)
    words, off = words_of(pa.array(texts, pa.string()))
    coded = words.dictionary_encode()
    names, codes = coded.dictionary, np.asarray(coded.indices)
    y_doc = np.array([labels.index(x) for x in langs])
    counts = np.zeros((len(names), k))
    np.add.at(counts, (codes, np.repeat(y_doc, np.diff(off))), 1)
    # a language's lexicon: words seen at least three times in it; a row of weights for each set of languages
    known = np.flatnonzero((counts >= 3).any(1))
    sets: dict[bytes, int] = {}
    row = np.array([sets.setdefault(m.tobytes(), len(sets) + 1) for m in counts[known] >= 3], np.int64)
    model = Model(labels, names.take(pa.array(known)), row)
    by = [np.flatnonzero((y_doc == j) & (np.diff(off) > 0)) for j in range(k)]
    if not all(len(x) for x in by):
        by = [x if len(x) else np.flatnonzero(np.diff(off) > 0) for x in by]
    if not len(words):
        return model
    x, y = np.empty((SEQUENCES, LENGTH), np.int64), np.empty((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        t, label = 0, int(rng.integers(k))
        while t < LENGTH:
            run = min(LENGTH - t, 4 + int(rng.geometric(1 / 24)))
            d = int(rng.choice(by[label]))
            n = off[d + 1] - off[d]
            a = off[d] + int(rng.integers(max(1, n - run + 1)))
            run = min(run, int(off[d + 1] - a))
            x[s, t : t + run], y[s, t : t + run] = codes[a : a + run], label
            t, label = t + run, int(rng.integers(k))
    used, x = np.unique(x.ravel(), return_inverse=True)
    y = y.ravel()
    feats, begin, lex = model.rows(names.take(pa.array(used)))
    owner = np.repeat(np.arange(len(used)), np.diff(np.append(begin, len(feats))))
    want = np.zeros((k, k))
    np.add.at(want, (y.reshape(SEQUENCES, -1)[:, :-1].ravel(), y.reshape(SEQUENCES, -1)[:, 1:].ravel()), 1)
    seq = np.arange(SEQUENCES + 1) * LENGTH
    hot = np.eye(k, dtype=np.float32)[y]
    params = [model.w, model.lex, model.trans, model.first]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        post, pairs = forward_backward(model.emit(feats, begin, lex), x, seq, model.trans, model.first)
        err = hot - post
        by_word = np.stack([np.bincount(x, err[:, j], len(used)) for j in range(k)], 1)
        grads = [
            np.stack([np.bincount(feats, by_word[owner, j], ROWS) for j in range(k)], 1) - 0.5 * model.w,
            np.stack([np.bincount(lex, by_word[:, j], len(model.lex)) for j in range(k)], 1) - 0.5 * model.lex,
            want - pairs - 0.5 * model.trans,
            err[seq[:-1]].sum(0) - 0.5 * model.first,
        ]
        for p, g, mm, vv in zip(params, grads, m, v, strict=True):
            mm += 0.1 * (g - mm)
            vv += 0.01 * (g**2 - vv)
            p += (0.1 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-3)).astype(np.float32)
    return model


def score_texts(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: language, mean probability, words, switches of label between words."""
    n, k = len(texts), len(model.labels)
    words, off = words_of(texts)
    coded = words.dictionary_encode()
    codes, size = np.asarray(coded.indices), np.diff(off)
    post, _ = forward_backward(model.emit_words(coded.dictionary), codes, off, model.trans, model.first)
    mean = np.zeros((n, k))
    full = np.flatnonzero(size)
    if len(full):
        mean[full] = np.add.reduceat(post, off[:-1][full], axis=0, dtype=np.float64) / size[full, None]
    label = post.argmax(1) if k else np.zeros(0, int)
    turn = np.append(0, np.cumsum(np.append(0, label[1:] != label[:-1]))) if len(label) else np.zeros(1, int)
    inside = np.maximum(turn[off[1:]] - turn[np.minimum(off[:-1] + 1, off[1:])], 0)
    lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False)) & (size > 0)
    best = mean.argmax(1) if n else np.zeros(0, int)
    value = np.where(lettered, np.clip(mean[np.arange(n), best], 0, 1), 0.0)
    return [model.labels[b] if ok else UND for b, ok in zip(best, lettered, strict=True)], value, size, inside


def sample(docs: DataFrame, learn: Column, text_col: str, lang_col: str) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts, rows chosen by hashes of whole rows and cut at places that hashes of the texts give."""
    whole = F.xxhash64(*[col(c) for c in docs.columns if not isinstance(docs.schema[c].dataType, (MapType, VariantType))], F.lit(29))
    rows = docs.where(learn).select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"), (F.pmod(whole, F.lit(1_000_003)) / F.lit(1_000_003.0)).alias("u")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = sorted(tuple(r) for r in rows.groupBy("lang").count().collect())  # the labels that the model holds
    if not counts:
        return [], []
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(2.0 * SAMPLE_DOCS / n))])
    rows = rows.where(F.col("u") < share[F.col("lang")])
    start = F.greatest(F.lit(1), (F.pmod(F.xxhash64("text", F.lit(31)), F.lit(1_000_003)) / F.lit(1_000_003.0) * (F.length("text") - SAMPLE_CHARS)).cast("int"))
    rows = rows.select("lang", "u", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "text"))
    got = rows.withColumn("r", rank).where(F.col("r") <= SAMPLE_DOCS).orderBy("lang", "r").collect()
    return [r["text"] for r in got], [r["lang"] for r in got]


def _scored(docs: DataFrame, learn: Column, keep: list[str], text_col: str, lang_col: str) -> DataFrame:
    """Columns _0, _1, ... for those of ``keep``, and _lang, _score, _words, _switches. A kept text goes through Python once."""
    model = fit(*sample(docs, learn, text_col, lang_col))
    passed = [f"_{i}" for i in range(len(keep))]
    own = passed[keep.index(text_col)] if text_col in keep and docs.schema[text_col].dataType == StringType() else "text"
    rows = docs.select(*[col(c).alias(p) for c, p in zip(keep, passed, strict=True)], *([col(text_col).cast("string").alias("text")] if own == "text" else []))
    schema = passed_schema(docs, keep, "_lang string, _score double, _words long, _switches long")
    most = max(1 << 18, min(SLICE_BYTES // 2, SLICE_LABELS // max(1, len(model.labels) if model else 1)))

    @worker
    def score(batches):
        for batch in batches:
            for piece in slices(batch, own, most):
                texts = piece.column(own).cast(pa.large_string())
                n = len(texts)
                lang, value, words, turns = score_texts(model, texts) if model else ([UND] * n, np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64))
                yield pa.RecordBatch.from_arrays([*[piece.column(p) for p in passed], pa.array(lang, pa.string()), pa.array(value, pa.float64()), pa.array(words, pa.int64()), pa.array(turns, pa.int64())], names=[*passed, "_lang", "_score", "_words", "_switches"])

    return rows.mapInArrow(score, schema)


OUTPUTS = ["lang_pred", "score", "n_words", "n_switches"]


def identify(docs: DataFrame, learn: Column, keep: list[str], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns ``keep`` with lang_pred, score, n_words, n_switches of each row, learned from rows with ``learn``."""
    out = _scored(docs, learn, keep, text_col, lang_col)
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept_names(keep, OUTPUTS))], *[F.col(a).alias(b) for a, b in zip(("_lang", "_score", "_words", "_switches"), OUTPUTS, strict=True)])


def keep_clear(docs: DataFrame, learn: Column, least: float, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more; those without letters go."""
    out = _scored(docs, learn, docs.columns, text_col, lang_col).where((F.col("_lang") != UND) & (F.col("_score") >= least))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

"""Whole-document log-likelihoods by a gated recurrent language model, in numpy.

Counts of all training tokens are made over the whole corpus. The most frequent words (``SHORT``) are
predicted one by one through a class-factored softmax: first the class, then the word in it. Less
frequent words up to ``HEAD`` form classes by frequency band, all others and unknown words a last class;
inside those a word's share follows its corpus count, unknown words sharing what absolute discounting
takes off the last class. So the probabilities of all words, the end and one unknown word sum to one.

The network (a GRU) is trained by truncated backpropagation on all training texts, each whole. It starts on
the driver from a bounded sample (``SAMPLE_DOCS`` rows, at most ``SAMPLE_CHARS`` characters of each); from
there every task goes on over the texts of its partition, and the tasks' weights are averaged by their tokens
in pieces of ``PIECE`` numbers, so the driver gets one set of weights however many tasks there are. Scoring runs all documents of a slice side
by side in windows of ``WINDOW`` steps; the state is carried from window to window, so a document is
scored as a whole at any length. Words of the head are looked up in a table of bounded size that each
task holds; the rest meet their counts in a join, which has no frequent keys.

Null text counts as empty: one end token. Without training documents every score equals the base.
Repeated rows and null ids are scored row by row; an empty table gives no rows. A kept column that has
the name of an output gets an underscore at its end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, kept_names, most_frequent, one_thread, packed_array, passed_schema, slices, summed, words_of, worker

SHORT, CLASSES, HEAD, BANDS = 4_096, 64, 131_072, 8
HIDDEN, WINDOW, SAMPLE_DOCS, SAMPLE_CHARS = 32, 64, 1_000, 4_000
LANES, BPTT, RATE, PIECE = 96, 24, 0.01, 4_096
#: Lanes of tasks at most, so that a slice of texts makes so many steps at least, and the share of the rate that they go on with.
WIDE, LEAST, LATER = 512, 32, 0.3
#: States that meet the classes at once, so that their logits stay in a core's cache.
BLOCK = 1_024
END = ""  # no word is empty


class Vocabulary:
    """Words of the head by rank, the end first; a class and a place in it (or a fixed share) for each."""

    def __init__(self, words: list[str], counts: list[int], end_count: int, n: int, v: int, ones: int, twos: int, tail_n: int, tail_v: int):
        self.words, self.n, self.v = words, n, v
        self.counts = np.array([end_count, *counts], np.float64)
        k = len(self.counts)
        short = min(SHORT, k)
        mass = np.cumsum(self.counts[:short]) - self.counts[:short] / 2
        cls = np.minimum((mass / max(mass[-1], 1) * CLASSES).astype(int), CLASSES - 1)
        _, cls = np.unique(cls, return_inverse=True)
        self.n_short_classes = int(cls.max()) + 1
        rest = np.cumsum(self.counts[short:])
        band = np.minimum((rest / max(rest[-1], 1) * BANDS).astype(int), BANDS - 1) if k > short else np.zeros(0, int)
        self.cls = np.concatenate([cls, self.n_short_classes + band, [self.n_short_classes + BANDS]])
        self.n_classes = self.n_short_classes + BANDS + 1
        self.short = short
        starts = np.searchsorted(cls, np.arange(self.n_short_classes + 1))
        self.starts = starts
        self.place = np.arange(short) - starts[cls]
        # log10 of the share inside a band; the unit of the last class is in the join
        total = np.bincount(band, self.counts[short:], BANDS) if k > short else np.ones(BANDS)
        self.share = np.concatenate([np.zeros(short), np.log10(self.counts[short:] / total[band]) if k > short else np.zeros(0), [0.0]])
        self.inputs = np.concatenate([np.arange(short), short + band, [short + BANDS]])
        self.n_inputs = short + BANDS + 1
        self.z = n + 0.1 * (v + 1)
        self.base = np.log10((self.counts + 0.1) / self.z)
        d = ones / (ones + 2 * twos) if ones else 0.5
        self.discount, self.tail_n = min(max(d, 0.1), 0.9), tail_n
        self.unknown = max(self.discount * tail_v, 1e-3) if tail_n else 1.0

    def rows(self, words: pa.Array) -> np.ndarray:
        """Row of each word, the last for words outside the head."""
        at = pc.index_in(words.cast(pa.large_string()), pa.array(self.words, pa.large_string()))
        return np.asarray(pc.add(pc.fill_null(at, len(self.words)), 1)).astype(np.int64)


def _bounded(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether no logit of rows ``w`` and biases ``b`` leaves the range of exp in 32 bits, as a state's entries are within -1 and 1."""
    return bool((np.abs(w).sum(1) + np.abs(b)).max(initial=0) < 60)


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray, bounded: bool) -> np.ndarray:
    """Of outputs with rows ``w``; less their largest in a row where exp could overflow."""
    out = h @ w.T
    out += b
    if not bounded:
        out -= out.max(1, keepdims=True)
    return out


def _shares(logits: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    np.exp(logits, out=logits)
    logits *= np.reciprocal(logits @ np.ones(logits.shape[1], np.float32))[:, None]
    return logits


class Gru:
    def __init__(self, voc: Vocabulary, seed: int = 1):
        rng, h = np.random.default_rng(seed), HIDDEN
        f = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        cls_mass = np.bincount(voc.cls[:-1], voc.counts, voc.n_classes) + max(voc.tail_n, 1) * (np.arange(voc.n_classes) == voc.n_classes - 1) + 1.0
        word_bias = np.log(voc.counts[: voc.short] + 0.5).astype(np.float32)
        self.p = {
            "emb": f(voc.n_inputs, h), "wx": f(h, 3 * h), "bx": np.zeros(3 * h, np.float32), "uh": f(h, 3 * h),
            "wc": f(h, voc.n_classes), "bc": np.log(cls_mass / cls_mass.sum()).astype(np.float32), "ww": f(voc.short, h), "bw": word_bias,
        }

    def gates(self) -> tuple[np.ndarray, ...]:
        """wx, bx and uh, those of the two gates with their signs turned, as their sigmoids take exp(-x)."""
        turn = np.repeat(np.array([-1, -1, 1], np.float32), HIDDEN)
        return self.p["wx"] * turn, self.p["bx"] * turn, self.p["uh"] * turn

    @staticmethod
    def step(gx: np.ndarray, h: np.ndarray, uh: np.ndarray, new: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """One step of the gates, weights as in ``gates``: new state, and what backpropagation needs. exp may overflow to a closed gate."""
        n = HIDDEN
        gh = h @ uh
        rz = gh[:, : 2 * n] + gx[:, : 2 * n]
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z = rz[:, :n], rz[:, n:]
        c = gh[:, 2 * n :] * r
        c += gx[:, 2 * n :]
        np.tanh(c, out=c)
        new = np.subtract(h, c, out=new)
        new *= z
        new += c
        return new, r, z, c, gh[:, 2 * n :]

    def train(self, voc: Vocabulary, docs: list[tuple[np.ndarray, bool]]) -> None:
        """docs: (rows of a text's tokens, whether the first follows the document's start)."""
        if not docs:
            return
        tokens = np.concatenate([d for d, _ in docs])
        before = np.concatenate([np.append(0 if s else len(voc.words) + 1, d[:-1]) for d, s in docs])
        reset = np.concatenate([np.arange(len(d)) == 0 for d, _ in docs])
        self.ascend(voc, tokens, before, reset, {})

    def ascend(self, voc: Vocabulary, tokens: np.ndarray, before: np.ndarray, reset: np.ndarray, state: dict, later: bool = False) -> None:
        """Steps over all tokens. ``state``: the moments and steps so far; ``later``: at the constant rate of tasks."""
        lanes = max(1, min(WIDE, len(tokens) // (LEAST * BPTT)) if later else min(LANES, len(tokens) // BPTT))
        length = -(-len(tokens) // lanes)
        if not length:
            return
        cut = lambda x, fill: np.append(x, np.full(lanes * length - len(x), fill, x.dtype)).reshape(lanes, length)
        x, y, keep = cut(voc.inputs[before].astype(np.int32), 0), cut(tokens, -1), 1 - cut(reset, True).astype(np.float32)
        if not state:
            state.update(m={k: np.zeros_like(q) for k, q in self.p.items()}, v={k: np.zeros_like(q) for k, q in self.p.items()}, steps=0)
        m, v, done = state["m"], state["v"], state["steps"]
        n, p = HIDDEN, self.p
        h, words = np.zeros((lanes, n), np.float32), voc.n_short_classes
        total = -(-length // BPTT)
        for i, a in enumerate(range(0, length, BPTT)):
            b = min(length, a + BPTT)
            xs, target = np.ascontiguousarray(x[:, a:b].T).reshape(-1), np.ascontiguousarray(y[:, a:b].T).reshape(-1)
            wx, bx, uh = self.gates()
            table = p["emb"] @ wx + bx
            fed = np.empty((len(xs), 2 * n), np.float32)  # input and state before, of each place
            fed[:, :n] = p["emb"].take(xs, 0)
            flat, past, trace = np.empty((len(xs), n), np.float32), fed[:, n:], []
            with np.errstate(over="ignore"):
                for t in range(b - a):
                    now = slice(t * lanes, (t + 1) * lanes)
                    gx = table.take(xs[now], 0)
                    h = np.multiply(h, keep[:, a + t, None], out=past[now])
                    h, *rest = self.step(gx, h, uh, flat[now])
                    trace.append(rest)
            g, dh = {"wc": np.zeros_like(p["wc"]), "bc": np.zeros_like(p["bc"])}, np.empty_like(flat)
            cls, wc, filling = voc.cls[target], np.ascontiguousarray(p["wc"].T), np.flatnonzero(target < 0)
            bounded = _bounded(wc, p["bc"])
            for s in range(0, len(flat), BLOCK):
                part = slice(s, s + BLOCK)
                prob = _shares(_logits(flat[part], wc, p["bc"], bounded))
                prob[np.arange(len(prob)), cls[part]] -= 1
                prob[filling[np.searchsorted(filling, s) : np.searchsorted(filling, s + BLOCK)] - s] = 0  # what fills up the lanes
                np.matmul(prob, wc, out=dh[part])
                g["wc"] += flat[part].T @ prob
                g["bc"] += np.ones(len(prob), np.float32) @ prob
            # words of each class side by side
            g["ww"], g["bw"] = np.zeros_like(p["ww"]), np.zeros_like(p["bw"])
            own = np.where((target >= 0) & (target < voc.short), cls, words).astype(np.int16)
            order = np.argsort(own, kind="stable")
            cuts = np.searchsorted(own[order], np.arange(words + 1))
            order = order[: cuts[words]]
            sorted_h, place, back = flat.take(order, 0), target[order], np.zeros((len(order), n), np.float32)
            bounded = _bounded(p["ww"], p["bw"])
            for c in range(words):
                at, of = slice(cuts[c], cuts[c + 1]), slice(voc.starts[c], voc.starts[c + 1])
                if at.stop > at.start and of.stop - of.start > 1:
                    w = _shares(_logits(sorted_h[at], p["ww"][of], p["bw"][of], bounded))
                    w[np.arange(len(w)), place[at] - of.start] -= 1
                    np.matmul(w.T, sorted_h[at], out=g["ww"][of])
                    np.matmul(np.ones(len(w), np.float32), w, out=g["bw"][of])
                    np.matmul(w, p["ww"][of], out=back[at])
            dh[order] += back
            # of c, r, z and the state's part of c: the first three go to the input, the last three to the state
            d4, carry = np.empty((len(flat), 4 * n), np.float32), np.zeros((lanes, n), np.float32)
            uh_t = np.concatenate([p["uh"][:, : 2 * n].T, p["uh"][:, 2 * n :].T])
            for t in range(b - a - 1, -1, -1):
                now = slice(t * lanes, (t + 1) * lanes)
                d = dh[now]
                d += carry
                r, z, c, ghc = trace[t]
                out, rest = d4[now], 1 - z
                dz = past[now] - c
                dz *= z
                dz *= rest
                np.multiply(dz, d, out=out[:, 2 * n : 3 * n])
                rest *= d
                c *= c
                np.subtract(1, c, out=c)
                c *= rest
                out[:, :n] = c
                np.multiply(c, r, out=out[:, 3 * n :])
                c *= ghc
                np.subtract(1, r, out=rest)
                rest *= r
                np.multiply(c, rest, out=out[:, n : 2 * n])
                carry = out[:, n:] @ uh_t
                d *= z
                carry += d
                carry *= keep[:, a + t, None]
            wide, both = d4[:, : 3 * n], fed.T @ d4
            g["wx"], g["bx"], g["uh"] = np.roll(both[:n, : 3 * n], -n, 1), np.roll(np.ones(len(wide), np.float32) @ wide, -n), both[n:, n:].copy()
            used = xs.astype(np.uint16)
            order = np.argsort(used, kind="stable")
            rows, first = np.unique(used[order], return_index=True)
            g["emb"] = np.zeros_like(p["emb"])
            g["emb"][rows] = np.add.reduceat((wide @ np.roll(p["wx"], n, -1).T).take(order, 0), first)
            scale = 1 / max(1, np.count_nonzero(target >= 0))
            norm = np.sqrt(sum(float(q.ravel() @ q.ravel()) for q in g.values())) * scale
            scale *= min(1.0, 1.0 / max(norm, 1e-12))
            rate = RATE * LATER if later else RATE * (1 - 0.9 * i / total)
            i += done
            for k, q in g.items():
                q *= scale
                m[k] += 0.1 * (q - m[k])
                v[k] += 0.005 * (q * q - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(v[k] / (1 - 0.995 ** (i + 1))) + 1e-6)
        state["steps"] = done + total

    def score(self, voc: Vocabulary, tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
        """log10 probability of each token of documents ``off`` over rows ``tokens``; a last class's share is left out."""
        out = voc.share[tokens].copy()
        wx, bx, uh = self.gates()
        table = self.p["emb"] @ wx + bx
        inputs = voc.inputs[tokens].astype(np.int32)
        size = np.diff(off)
        order = np.argsort(-size, kind="stable")
        begin, size = off[:-1][order], size[order]
        steps = int(size[0]) if len(size) else 0
        going = np.searchsorted(-size, -np.arange(steps), side="left")
        h = np.zeros((len(size), HIDDEN), np.float32)
        first = voc.inputs[0]
        for a in range(0, steps, WINDOW):
            b = min(a + WINDOW, steps)
            cuts = np.append(0, np.cumsum(going[a:b]))
            states, places = np.empty((cuts[-1], HIDDEN), np.float32), np.empty(cuts[-1], np.int64)
            with np.errstate(over="ignore"):
                for t in range(a, b):
                    now = slice(cuts[t - a], cuts[t - a + 1])
                    at = np.add(begin[: going[t]], t, out=places[now])
                    gx = table[np.full(len(at), first)] if t == 0 else table.take(inputs.take(at - 1), 0)
                    h = self.step(gx, h[: len(at)], uh, states[now])[0]
            self._window(voc, states, tokens, places, out)
        return out

    def _window(self, voc: Vocabulary, h: np.ndarray, tokens: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
        p, log10e, words = self.p, 1 / np.log(10), voc.n_short_classes
        wc, in_class, in_words = np.ascontiguousarray(p["wc"].T), _bounded(p["wc"].T, p["bc"]), _bounded(p["ww"], p["bw"])
        for s in range(0, len(at), 16_384):
            hs, place = h[s : s + 16_384], at[s : s + 16_384]
            target = tokens[place]
            cls = voc.cls[target]
            lp = np.concatenate([_log_prob(_logits(hs[i : i + BLOCK], wc, p["bc"], in_class), cls[i : i + BLOCK]) for i in range(0, len(hs), BLOCK)])
            key = np.minimum(cls, words).astype(np.int16)
            order = np.argsort(key, kind="stable")
            cuts = np.searchsorted(key[order], np.arange(words + 1))
            order = order[: cuts[words]]
            sorted_h, word, more = hs.take(order, 0), target[order], np.zeros(len(order))
            for c in range(words):
                rows, of = slice(cuts[c], cuts[c + 1]), slice(voc.starts[c], voc.starts[c + 1])
                if rows.stop > rows.start and of.stop - of.start > 1:
                    more[rows] = _log_prob(_logits(sorted_h[rows], p["ww"][of], p["bw"][of], in_words), word[rows] - of.start)
            lp[order] += more
            out[place] += lp * log10e


def _log_prob(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = logits[np.arange(len(at)), at].astype(np.float64)
    np.exp(logits, out=logits)
    return own - np.log(logits @ np.ones(logits.shape[1], np.float32))


def count_tokens(rows: DataFrame) -> DataFrame:
    """Columns token, c of column text, the end as the empty token; each task adds up its slices first."""

    @worker
    def count(batches):
        for batch in batches:
            for piece in slices(batch, most=3 << 20):
                words, _ = words_of(piece.column("text"))
                got = words.value_counts()
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([got.field("values").cast(pa.string()), pa.array([END])]), pa.concat_arrays([got.field("counts").cast(pa.int64()), pa.array([piece.num_rows], pa.int64())])], names=["token", "c"])

    return rows.select("text").mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def fit(rows: DataFrame, voc_b, start: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Weights after all texts of ``rows``: those of the tasks, each begun at ``start``, averaged by their tokens."""
    start_b = rows.sparkSession.sparkContext.broadcast(start)

    @worker
    def learn(batches):
        voc = voc_b.value
        net = Gru.__new__(Gru)
        net.p = {k: q.copy() for k, q in start_b.value.items()}
        state, seen = {}, 0
        for batch in batches:
            for piece in slices(batch, most=4 << 20):
                words, off = words_of(piece.column("text"))
                coded = words.dictionary_encode()
                ids = np.insert(voc.rows(coded.dictionary)[np.asarray(coded.indices)], off[1:], 0)
                first = np.zeros(len(ids), bool)
                first[off[:-1] + np.arange(len(off) - 1)] = True
                net.ascend(voc, ids, np.where(first, 0, np.append(0, ids[:-1])), first, state, later=True)
                seen += len(ids)
        if seen:
            flat = np.concatenate([*[q.ravel() for q in net.p.values()], [1.0]]).astype(np.float64) * seen
            cut = [flat[a : a + PIECE] for a in range(0, len(flat), PIECE)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int32()), pa.array([task] * len(cut), pa.int64()), pa.array([len(x) for x in cut], pa.int32()), pa.array([packed_array(x.astype("<f4")) for x in cut], pa.binary())], names=["at", "task", "n", "part"])

    got = summed(rows.select("text").mapInArrow(learn, "at int, task long, n int, part binary"), "<f4", "<f8")  # one set of weights
    if not got:
        return start
    flat, at, out = np.concatenate([got[i] for i in sorted(got)]), 0, {}
    for k, q in start.items():
        out[k], at = (flat[at : at + q.size] / flat[-1]).astype(np.float32).reshape(q.shape), at + q.size
    return out


def _sample(rows: DataFrame, voc: Vocabulary) -> list[tuple[np.ndarray, bool]]:
    """Where training starts: rows chosen by a hash of the whole row, so that copies of a text are drawn one by one."""
    total = rows.count()
    u = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "learn"], F.lit(3)), F.lit(1_000_003))
    start = F.when(u % 2 == 0, F.lit(1)).otherwise(F.greatest(F.lit(1), (F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0) * (F.length("text") - SAMPLE_CHARS)).cast("int")))
    few = rows.where(u < int(1_000_003 * min(1.0, 2.0 * SAMPLE_DOCS / max(total, 1)))) if total > SAMPLE_DOCS else rows
    got = few.select(F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text"), start.alias("start"), (F.length("text") < start + SAMPLE_CHARS).alias("whole"), u.alias("u")).orderBy("u", "text").limit(SAMPLE_DOCS).collect()
    out = []
    for r in got:
        words, _ = words_of(pa.array([r["text"]], pa.string()))
        ids = voc.rows(words)
        ids = ids[1:] if r["start"] > 1 else ids
        ids = np.append(ids, 0) if r["whole"] else ids[:-1]
        if len(ids):
            out.append((ids, r["start"] == 1))
    return out


OUTPUTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def log_likelihoods(docs: DataFrame, learn: Column, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with n_tokens, n_known, train_tokens, base_score, score of each row."""
    scratch = Scratch(docs.sparkSession, "lm")
    rows = docs.select(*[col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = scratch.cut(count_tokens(rows.where("learn")))
    n, v, ones, twos, end = counts.agg(F.sum("c"), F.count("c"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2), F.max(F.when(F.col("token") == END, F.col("c")))).first()
    frequent = most_frequent(counts.where(f"token <> '{END}' AND c > 1"), "token", "c", HEAD)
    head = sorted(frequent.collect(), key=lambda r: (-r["c"], r["token"]))  # at most HEAD rows
    n, end = n or 0, end or 0
    head_n = sum(r["c"] for r in head)
    voc = Vocabulary([r["token"] for r in head], [r["c"] for r in head], end, n, v, ones, twos, n - end - head_n, v - (end > 0) - len(head))
    gru = Gru(voc)
    voc_b = docs.sparkSession.sparkContext.broadcast(voc)
    if n:
        one_thread()
        gru.train(voc, _sample(rows.where("learn"), voc))
        gru.p = fit(rows.where("learn"), voc_b, gru.p)
    passed = [f"_{i}" for i in range(len(keep))]
    schema = passed_schema(docs, keep, "row long, n_tokens long, known long, base double, model double, tail array<string>, times array<int>")
    params_b = docs.sparkSession.sparkContext.broadcast(gru.p)

    @worker
    def score(batches):
        voc = voc_b.value
        net = Gru.__new__(Gru)
        net.p = params_b.value
        row = TaskContext.get().partitionId() << 33
        unknown = len(voc.words) + 1
        base = np.append(voc.base, 0.0)
        for batch in batches:
            for piece in slices(batch, most=4 << 20):
                words, off = words_of(piece.column("text"))
                coded = words.dictionary_encode()
                of_word = voc.rows(coded.dictionary)
                codes = np.asarray(coded.indices)
                ids = of_word[codes]
                # an end after each text
                k = len(off) - 1
                ids_end = np.insert(ids, off[1:], 0)
                off_end = off + np.arange(k + 1)
                lp = net.score(voc, ids_end, off_end)
                add = lambda x, o: np.diff(np.append(0.0, np.cumsum(x))[o])
                # words outside the head, each once a text with its number
                out = np.flatnonzero(ids == unknown)
                doc = np.searchsorted(off, out, side="right") - 1
                pair, times = np.unique(doc * (len(of_word) + 1) + codes[out], return_counts=True)
                tail_off = np.searchsorted(pair, np.arange(k + 1) * (len(of_word) + 1))
                tail = pa.ListArray.from_arrays(pa.array(tail_off, pa.int32()), coded.dictionary.take(pa.array(pair % (len(of_word) + 1))).cast(pa.string()))
                numbers = pa.ListArray.from_arrays(pa.array(tail_off, pa.int32()), pa.array(times, pa.int32()))
                known = add(ids_end != unknown, off_end).astype(np.int64) - (voc.counts[0] == 0)
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in passed], pa.array(row + np.arange(k), pa.int64()), pa.array(np.diff(off_end), pa.int64()), pa.array(known, pa.int64()), pa.array(add(base[ids_end], off_end)), pa.array(add(lp, off_end)), tail, numbers], names=[*passed, "row", "n_tokens", "known", "base", "model", "tail", "times"])
                row += k

    scored = scratch.cut(rows.drop("learn").mapInArrow(score, schema))
    words = scored.select("row", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("row", F.col("t.tail").alias("token"), F.col("t.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    share = F.log10(F.when(c > 0, F.greatest(c - voc.discount, F.lit(0.1)) / max(voc.tail_n, 1)).otherwise(F.lit(voc.unknown / max(voc.tail_n, 1))))
    met = words.join(counts, "token", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.col("times") * F.log10((c + 0.1) / voc.z)).alias("tail_base"),
        F.sum(F.col("times") * share).alias("tail_model"),
    )
    out = scored.drop("tail", "times").join(met, "row", "left").na.fill(0, ["tail_known", "tail_base", "tail_model"])
    base = F.col("base") + F.col("tail_base")
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept_names(keep, OUTPUTS))], "n_tokens", (F.col("known") + F.col("tail_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + F.col("tail_model") if n else base).alias("score"))

"""Scores for abusive, hateful or sexual content: a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.runtime import written

WORDS, TRIGRAMS, LETTERS = 1 << 15, 1 << 13, 18
WIDTH, HIDDEN, ATTEND = 20, 12, 8
#: Words of a window, and words before and after it that its states take in at least (where the text has them).
WINDOW, HALO = 24, 8
#: Words whose states are computed in one run of the network, which starts ``HALO`` words before them.
SEGMENT = 88
#: Words between the starts of the windows that the fit may learn from; scoring takes the window at every word.
FIT_STRIDE = 8
#: Slices in which the weights of shards are averaged.
PARTS = 16
#: Distinct words whose projections a worker keeps; the store is emptied when full, which changes nothing but time.
KEPT = 150_000

#: Signs written for letters.
SIGNS = str.maketrans("013457@$€ßàáâäãåçèéêëìíîïñòóôöõùúûüýÿœæ", "oieastasesaaaaaaceeeeiiiinooooouuuuyyoa")
LINE_END = re.compile(r"[-=¬­]\s*\n\s*")
HIDDEN_SIGNS = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u00ac|]")
SPACED = re.compile(r"(?<!\S)\w\s\w\s\w\s(?:\w\s)*\w(?!\w)")
LONG_WORD = re.compile(rf"\S{{{LETTERS + 1},}}")
RUNS = re.compile(r"(\w)\1{2,}")
INNER = re.compile(r"[^\w*]+|_+")
MASKS = re.compile(r"\*+")


def tokens(text: str | None) -> list[str]:
    """Raw words of a text: words broken at line ends are joined, and so are words spelt with spaces.

    Words of more than ``LETTERS`` letters are given in pieces that overlap by half, so every letter of any text is
    read, also of one without spaces.
    """
    if not text:
        return []
    text = HIDDEN_SIGNS.sub("", LINE_END.sub("", text))
    text = SPACED.sub(lambda m: "".join(m[0].split()), text)
    return LONG_WORD.sub(_pieces, text).split()


def _pieces(found: re.Match) -> str:
    plain = normal(found[0])
    if len(plain) <= LETTERS:
        return found[0]
    return " ".join([plain[at : at + LETTERS] for at in range(0, len(plain) - LETTERS // 2, LETTERS // 2)])


def normal(word: str) -> str:
    """A raw word in one spelling: lower case, signs as letters, no inner punctuation, no letter three times."""
    word = word.lower()
    if INNER.sub("", word).isdigit():
        return "0"
    return RUNS.sub(r"\1", MASKS.sub("*", INNER.sub("", word.translate(SIGNS))))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of normal words, the word bucket and the buckets of their letter trigrams (0 is padding)."""
    ids = np.fromiter((zlib.crc32(w.encode()) % (WORDS - 1) + 1 if w else 0 for w in words), np.int64, len(words))
    width = max([LETTERS, *map(len, words)]) + 2
    flat = np.frombuffer("".join([f"^{w}$".ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(len(words), width).astype(np.int64)
    grams = (flat[:, :-2] * 1_000_003 + flat[:, 1:-1] * 10_007 + flat[:, 2:] * 101) % (TRIGRAMS - 1) + 1
    grams[flat[:, 2:] == 0] = 0
    return ids, grams


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, end to end."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def starts(lengths: np.ndarray, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts laid end to end: place of each one's first word, and its text.

    A window holds ``WINDOW`` words; a shorter text is one window. The last one ends with the text.
    """
    counts = np.where(lengths > 0, np.maximum(0, -(-(lengths - WINDOW) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), counts)
    at = np.minimum(_ramp(counts) * stride, np.maximum(0, lengths[doc] - WINDOW))
    return at + (np.cumsum(lengths) - lengths)[doc], doc


def around(first: np.ndarray, low: np.ndarray, high: np.ndarray, before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from ``before`` words before each first one to ``after`` words on, and which lie in [low, high)."""
    at = first[:, None] + np.arange(-before, after)[None, :]
    real = (at >= low[:, None]) & (at < high[:, None])
    return np.where(real, at, 0), real


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {"word": rng.normal(0, 0.05, (WORDS, WIDTH)), "gram": rng.normal(0, 0.05, (TRIGRAMS, WIDTH))}
    for d in "fb":
        p |= {f"x{d}": rng.normal(0, WIDTH**-0.5, (WIDTH, 3 * HIDDEN)), f"u{d}": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN)}
    p |= {"aw": rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)), "ab": np.zeros(ATTEND), "av": rng.normal(0, 0.3, ATTEND), "ow": rng.normal(0, 0.3, 2 * HIDDEN), "ob": np.array([-2.0])}
    p["word"][0] = p["gram"][0] = 0
    return {k: v.astype(np.float32) for k, v in p.items()}


def _gru(a: np.ndarray, u: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) of a gated recurrent layer over projected inputs (T, B, 3H), and what its gradient needs.

    Padding leaves the state as it is.
    """
    steps, batch, h3 = a.shape
    h3 //= 3
    h, out, saved = np.zeros((batch, h3), np.float32), np.empty((steps, batch, h3), np.float32), []
    for t in range(steps):
        r = h @ u
        zr = _sigmoid(a[t, :, : 2 * h3] + r[:, : 2 * h3])
        z, g = zr[:, :h3], zr[:, h3:]
        n = np.tanh(a[t, :, 2 * h3 :] + g * r[:, 2 * h3 :])
        m = real[t][:, None]
        saved.append((h, z, g, n, r[:, 2 * h3 :], m))
        out[t] = h = np.where(m, n + z * (h - n), h)
    return out, saved


def _states(inputs: list[np.ndarray], weights: list[np.ndarray], real: np.ndarray) -> np.ndarray:
    """The same states without gradients: each gate has arrays of its own, so all steps run over whole rows of memory."""
    steps, batch, width = inputs[0].shape
    h, out, whole = np.zeros((batch, width), np.float32), np.empty((steps, batch, width), np.float32), real.all(axis=1)
    for t in range(steps):
        z, g = h @ weights[0], h @ weights[1]
        for gate, a in ((z, inputs[0]), (g, inputs[1])):
            gate += a[t]
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
        n = h @ weights[2]
        n *= g
        n += inputs[2][t]
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= z
        new += n
        if not whole[t]:
            np.copyto(new, h, where=~real[t][:, None])
        h = new
    return out


def _gru_back(dout: np.ndarray, u: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, h3 = dout.shape
    da, du, dh = np.zeros((steps, batch, 3 * h3), np.float32), np.zeros_like(u), np.zeros((batch, h3), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, g, n, rn, m = saved[t]
        dh = dh + dout[t]
        d = np.where(m, dh, 0)
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dg = dn * rn * g * (1 - g)
        dr = np.concatenate([dz, dg, dn * g], axis=1)
        da[t] = np.concatenate([dz, dg, dn], axis=1)
        du += h.T @ dr
        dh = np.where(m, d * z + dr @ u.T, dh)
    return da, du


def _forward(p: dict, af: np.ndarray, ab: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Logits of windows with the words around them.

    ``real`` (HALO + WINDOW + HALO, B); af, ab: inputs (HALO + WINDOW, B, 3H) projected for each direction, in the
    order of the text, of the words up to the end of the window and of those from its start. Attention pools the
    states of the window's own words.
    """
    n = af.shape[0]
    hf, sf = _gru(af, p["uf"], real[:n])
    hb, sb = _gru(ab[::-1], p["ub"], real[::-1][:n])
    h = np.concatenate([hf[HALO:], hb[::-1][: n - HALO]], axis=2)
    own = real[HALO : n]
    k = np.tanh(h @ p["aw"] + p["ab"])
    e = np.where(own, k @ p["av"], np.float32(-30))
    e = np.exp(e - e.max(axis=0))
    att = e / e.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", att, h)
    return pooled @ p["ow"] + p["ob"][0], (h, k, att, pooled, sf, sb)


def _back(p: dict, dlogit: np.ndarray, kept: tuple) -> tuple[dict, np.ndarray, np.ndarray]:
    h, k, att, pooled, sf, sb = kept
    half, padding = h.shape[2] // 2, np.zeros((HALO, h.shape[1], h.shape[2] // 2), h.dtype)
    grads = {"ow": pooled.T @ dlogit, "ob": np.array([dlogit.sum()])}
    dpool = dlogit[:, None] * p["ow"]
    datt = np.einsum("bh,tbh->tb", dpool, h)
    dh = att[:, :, None] * dpool[None]
    de = att * (datt - (att * datt).sum(axis=0))
    dk = de[:, :, None] * p["av"] * (1 - k * k)
    grads |= {"av": np.einsum("tb,tba->a", de, k), "ab": dk.sum(axis=(0, 1)), "aw": np.einsum("tbh,tba->ha", h, dk)}
    dh = dh + dk @ p["aw"].T
    daf, grads["uf"] = _gru_back(np.concatenate([padding, dh[:, :, :half]]), p["uf"], sf)
    dab, grads["ub"] = _gru_back(np.concatenate([padding, dh[::-1, :, half:]]), p["ub"], sb)
    return grads, daf, dab[::-1]


def _sum_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return ids[first], np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """Adagrad over batches of windows; embeddings are updated where they were touched."""

    def __init__(self, p: dict, rate: float):
        self.p, self.rate = p, rate
        self.squares = {k: np.full(v.shape, 1e-3, np.float32) for k, v in p.items()}

    def step(self, wid: np.ndarray, gid: np.ndarray, index: np.ndarray, real: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """wid, gid: features of the distinct words; index (B, HALO + WINDOW + HALO): words of the windows and around them."""
        p, n = self.p, HALO + WINDOW
        used, place = np.unique(index[real], return_inverse=True)
        x = p["word"][wid[used]] + p["gram"][gid[used]].sum(axis=1)
        at = np.zeros(index.shape, np.int64)
        at[real] = place
        at, mask = at.T, real.T
        logit, kept = _forward(p, (x @ p["xf"] + p["bf"])[at[:n]], (x @ p["xb"] + p["bb"])[at[-n:]], mask)
        dlogit = ((_sigmoid(logit) - y) * weight / max(1.0, weight.sum())).astype(np.float32)
        grads, daf, dab = _back(p, dlogit, kept)
        sums = {}
        for d, da, part in (("f", daf, slice(None, n)), ("b", dab, slice(-n, None))):
            rows, flat = np.zeros((len(used), da.shape[2]), np.float32), mask[part].ravel()
            ids, total = _sum_rows(at[part].ravel()[flat], da.reshape(-1, da.shape[2])[flat])
            rows[ids] = total
            sums[d] = rows
            grads[f"x{d}"], grads[f"b{d}"] = x.T @ rows, rows.sum(axis=0)
        dx = sums["f"] @ p["xf"].T + sums["b"] @ p["xb"].T
        for name, ids, rows in (("word", wid[used], dx), ("gram", gid[used].ravel(), np.repeat(dx, gid.shape[1], axis=0))):
            ids, rows = _sum_rows(ids, rows)
            if ids[0] == 0:
                ids, rows = ids[1:], rows[1:]
            self.squares[name][ids] += rows * rows
            p[name][ids] -= self.rate * rows / np.sqrt(self.squares[name][ids])
        for name, g in grads.items():
            self.squares[name] += g * g
            p[name] -= (self.rate / 2) * g / np.sqrt(self.squares[name])


def packed(p: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{k: v.astype(np.float16) if k in ("word", "gram") else v for k, v in p.items()})
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k].astype(np.float32) for k in z.files}


class Scorer:
    """Scores of all windows of texts.

    The network runs once over each text, in segments that start and end ``HALO`` words outside of the words they
    are for; the attention of each word and its share of the logit are kept, and the pooling over each window is a
    quotient of two sums over its words. So a window costs two sums, however far it overlaps with others.
    """

    def __init__(self, p: dict):
        self.p, self.place = p, {}
        self.proj = np.zeros((6, 1024, HIDDEN), np.float32)
        self.gates = [[np.ascontiguousarray(p[u][:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3)] for u in ("uf", "ub")]

    def learn(self, words: list[str]) -> None:
        """Projected inputs of words are kept by raw word, an array per gate and direction."""
        if len(self.place) + len(words) > KEPT:
            self.place.clear()
        start, p = len(self.place), self.p
        while self.proj.shape[1] < start + len(words):
            self.proj = np.concatenate([self.proj, np.zeros_like(self.proj)], axis=1)
        for i in range(0, len(words), 8192):
            some = words[i : i + 8192]
            wid, gid = features([normal(w) for w in some])
            x = p["word"][wid] + p["gram"][gid].sum(axis=1)
            both = np.concatenate([x @ p["xf"] + p["bf"], x @ p["xb"] + p["bb"]], axis=1)
            self.proj[:, start + i : start + i + len(some)] = both.reshape(len(some), 6, HIDDEN).transpose(1, 0, 2)
        self.place.update(zip(words, range(start, start + len(words))))

    def _of_words(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts laid end to end, given as places of words: the attention of each word, and its logit."""
        counts = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(lengths)), counts)
        low = (np.cumsum(lengths) - lengths)[doc]
        high, first = low + lengths[doc], low + _ramp(counts) * SEGMENT
        p, att, own = self.p, np.empty(len(words)), np.empty(len(words))
        order = np.argsort((first - low < HALO) | (high - first < SEGMENT + HALO), kind="stable")  # inner ones need no mask
        for i in range(0, len(order), 1024):
            f, lo, hi = first[order[i : i + 1024]], low[order[i : i + 1024]], high[order[i : i + 1024]]
            at, real = (x.T for x in around(f, lo, hi, HALO, SEGMENT))
            hf = _states([g.take(words[at], axis=0, mode="clip") for g in self.proj[:3]], self.gates[0], real)[HALO:]
            after, there = (x.T[::-1] for x in around(f, lo, hi, 0, SEGMENT + HALO))
            hb = _states([g.take(words[after], axis=0, mode="clip") for g in self.proj[3:]], self.gates[1], there)[HALO:][::-1]
            real = real[HALO:]
            e = np.tanh(hf @ p["aw"][:HIDDEN] + hb @ p["aw"][HIDDEN:] + p["ab"]) @ p["av"]
            places = at[HALO:][real]
            att[places] = e[real]
            own[places] = (hf @ p["ow"][:HIDDEN] + hb @ p["ow"][HIDDEN:])[real]
        return np.exp(att), own

    def logits(self, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The logit of the window that starts at each word; -inf where none does."""
        att, own = self._of_words(words, lengths)
        gap = np.arange(len(words)) + np.repeat(np.arange(len(lengths)) * WINDOW, lengths)  # room after each text

        def summed(x: np.ndarray) -> np.ndarray:
            room = np.zeros(len(words) + WINDOW * len(lengths))
            room[gap] = x
            total = np.zeros(len(room) - WINDOW + 1)
            for k in range(WINDOW):
                total += room[k : k + len(total)]
            return total[gap[begin]]

        begin, _ = starts(lengths)
        out = np.full(len(words), -np.inf)
        out[begin] = summed(att * own) / summed(att) + self.p["ob"][0]
        return out

    def places(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words of texts, laid end to end, and the lengths of the texts."""
        distinct = set().union(*lists)
        new = list(distinct.difference(self.place))
        if new:
            kept = len(self.place)
            self.learn(new)
            if len(self.place) < kept + len(new):  # emptied: what these texts share with earlier ones is new again
                self.learn(list(distinct.difference(self.place)))
        lengths = np.array([len(x) for x in lists])
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), np.int64, int(lengths.sum())), lengths

    def score(self, texts: list[str | None]) -> np.ndarray:
        """The highest window score of each text; 0 for null, empty and blank ones."""
        result, lists, begin = np.zeros(len(texts)), [], 0

        def flush() -> None:
            words, lengths = self.places(lists)
            full = np.flatnonzero(lengths)
            if len(full):
                best = np.maximum.reduceat(self.logits(words, lengths), (np.cumsum(lengths) - lengths)[full])
                result[begin + full] = _sigmoid(best)

        held = 0
        for n, text in enumerate(texts):
            lists.append(tokens(text))
            held += len(lists[-1])
            if held > 150_000 or n == len(texts) - 1:
                flush()
                lists, begin, held = [], n + 1, 0
        return result


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [[normal(w) for w in tokens(t)] for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], ["doc_id", "label", "words"])


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [sorted({zlib.crc32(w.encode()) % (WORDS - 1) + 1 for w in words if w}) for words in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["label", "ids"])


def _odds(sample: DataFrame) -> np.ndarray:
    """Log odds of each word bucket between positive and other documents; at most ``WORDS`` rows come to the driver."""
    seen = sample.select("label", "words").mapInArrow(_buckets_of, "label int, ids array<int>")
    counts = seen.select("label", F.explode("ids").alias("id")).groupBy("id").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    totals = sample.agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).first()
    odds, pos_all, neg_all = np.zeros(WORDS), float(totals.pos or 0), float((totals.n or 0) - (totals.pos or 0))
    for r in counts:
        odds[r.id] = np.log((r.pos + 0.3) / (pos_all + 1)) - np.log((r.n - r.pos + 0.3) / (neg_all + 1))
    return odds


def _train_shard(model: bytes, odds: np.ndarray, steps: int, rate: float, first: bool, seed: int):
    """One shard of labelled documents, for some steps from the common model: ``part, weights, n`` of what it came to."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")  # the order in which rows arrive must not matter
        p, rng = unpacked(model), np.random.default_rng(seed + int(key[0]))
        labels = t.column("label").to_numpy()
        lists = t.column("words").to_pylist()
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*lists)))}
        wid, gid = features(list(vocabulary)) if vocabulary else (np.zeros(1, int), np.zeros((1, 1), int))
        lengths = np.array([len(x) for x in lists])
        flat = np.array([vocabulary[w] for x in lists for w in x], np.int64)
        begin, doc = starts(lengths, FIT_STRIDE)
        if len(doc):
            low = (np.cumsum(lengths) - lengths)[doc]
            at, real = around(begin, low, low + lengths[doc], HALO, WINDOW + HALO)
            index = flat[at]
            positive = labels[doc] == 1
            if first:  # nothing learnt yet: windows by the words that speak most for the label
                own = slice(HALO, HALO + WINDOW)
                belief = np.maximum(np.sort(np.where(real[:, own], odds[wid[index[:, own]]], -9), axis=1)[:, -3:], 0).sum(axis=1)
            else:
                scorer = Scorer(p)
                belief = scorer.logits(*scorer.places(lists))[begin]
            best = np.full(len(lists), -np.inf)
            np.maximum.at(best, doc, belief)
            is_best = belief == best[doc]
            y = positive & (is_best if first else (belief > 0.5) | (is_best & (best[doc] > -3)))
            doubtful = np.zeros(len(lists), bool) if first else (labels == 0) & (best > 4)  # likely mislabelled
            harmless = np.zeros(len(doc), bool) if first else positive & (belief < -2)  # what the model holds so in a positive document
            negative = np.flatnonzero((~positive & ~doubtful[doc]) | harmless)
            hard = negative[np.argsort(-belief[negative], kind="stable")[: len(negative) // 16]]
            pos = np.flatnonzero(y)
            trainer, done = Trainer(p, rate), 0
            while done < steps and len(negative) + len(pos):
                some = rng.choice(negative, min(len(negative), max(200, len(negative) // 8)), replace=False) if len(negative) else negative
                neg = np.unique(np.concatenate([some, hard]))
                rows = rng.permutation(np.concatenate([neg, np.repeat(pos, 3)]))
                share = max(1.0, min(8.0, 0.25 * len(neg) / max(1, 3 * len(pos))))
                for i in range(0, len(rows), 192):
                    r = rows[i : i + 192]
                    trainer.step(wid, gid, index[r], real[r], y[r].astype(np.float32), np.where(y[r], share, 1.0).astype(np.float32))
                    done += 1
        weights = np.array_split(_laid(p), PARTS)
        n = pa.array([len(lists)] * PARTS, pa.int64())
        return pa.table({"shard": pa.array([int(key[0])] * PARTS, pa.int32()), "part": pa.array(range(PARTS), pa.int32()), "weights": pa.array([w.tobytes() for w in weights], pa.binary()), "n": n})

    return run


def _laid(p: dict) -> np.ndarray:
    """All parameters in one array; :func:`_parted` takes them apart again."""
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _parted(flat: np.ndarray) -> dict[str, np.ndarray]:
    shapes = {k: v.shape for k, v in initial(0).items()}
    ends = np.cumsum([int(np.prod(shapes[k])) for k in sorted(shapes)])[:-1]
    return {k: v.reshape(shapes[k]) for k, v in zip(sorted(shapes), np.split(flat, ends))}


def _average(key: tuple, t: pa.Table) -> pa.Table:
    """One part of the parameters, averaged over the shards by their documents."""
    t = t.sort_by("shard")
    n = t.column("n").to_numpy().astype(np.float64)
    total = sum(np.frombuffer(w, np.float32) * (k / n.sum()) for w, k in zip(t.column("weights").to_pylist(), n))
    return pa.table({"part": pa.array([key[0]], pa.int32()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _score_batches(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(unpacked(model))
        for batch in batches:
            *others, texts = batch.columns
            yield pa.RecordBatch.from_arrays([*others, pa.array(scorer.score(texts.to_pylist()))], [*batch.schema.names[:-1], "score"])

    return run


def score(df: DataFrame, keys: list[str], text: str, model: bytes) -> DataFrame:
    """``keys, score``: the highest score of any window of each text, 0 for null, empty and blank ones."""
    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return df.select(*keys, text).mapInArrow(_score_batches(model), f"{fields}, score double")


def fit(documents: DataFrame, labels: DataFrame, max_docs: int = 4000, rounds: int = 5, steps: int = 80, shard_docs: int = 800, held_out: int = 5, seed: int = 5) -> tuple[bytes, float]:
    """A model and the score from which a document counts as a case, from labels per document.

    The model is fitted on at most ``max_docs`` labelled documents (the lowest hashes of their ids), the only
    bound here; scoring takes all. Labels are of whole documents and not free of errors, so windows are chosen in
    turns: first by the odds of their words, then by the model itself; documents the model contradicts strongly are
    left out of that turn. Shards of ``shard_docs`` documents train in parallel from common weights, ``steps``
    updates a round; the weights are averaged by part on the executors, so one model a round comes to the driver,
    however many shards there are. One document in ``held_out`` is not trained on: the threshold is the one between
    0.3 and 0.9 with the best F1 over those, among equals the nearest to 0.5.

    Documents labelled more than once count by majority, ties as positive; null labels, and labels without a
    document or text, teach nothing. Without any positive label the threshold is above all scores. Results do not
    depend on how the rows are partitioned.
    """
    spark = documents.sparkSession
    voted = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    few = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    joined = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(few, "doc_id").select("doc_id", "label", "text")
    sample = written(joined.mapInArrow(_words_of, "doc_id long, label int, words array<string>"), "labelled", pos=F.sum("label"))
    p = initial(seed)
    n, n_pos = sample.seen["rows"], sample.seen["pos"] or 0
    if not n_pos:
        return packed(p), 2.0
    kept_out = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(held_out)) == 0
    train_on = sample.df.where(~kept_out)
    odds = _odds(train_on)
    shards = max(1, -(-n * (held_out - 1) // held_out // shard_docs))
    sharded = train_on.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    for r in range(rounds):
        train = _train_shard(packed(p), odds, steps, 0.12 if r < rounds - 2 else 0.06, r == 0, seed + 100 * r)
        trained = sharded.groupBy("shard").applyInArrow(train, "shard int, part int, weights binary, n long")
        parts = trained.groupBy("part").applyInArrow(_average, "part int, weights binary").collect()  # together one model
        if parts:
            p = _parted(np.concatenate([np.frombuffer(x.weights, np.float32) for x in sorted(parts)]).copy())
    model = packed(p)
    scored = sample.df.where(kept_out).select("label", F.array_join("words", " ").alias("text"))
    graded = score(scored, ["label"], "text", model).groupBy(F.round("score", 2).alias("s")).agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).collect()  # at most 101 rows
    sample.drop()
    held_pos, f1 = sum(x.pos for x in graded), {}
    for cut in (c / 20 for c in range(6, 19)):
        hits, flagged = sum(x.pos for x in graded if x.s >= cut), sum(x.n for x in graded if x.s >= cut)
        f1[cut] = 2 * hits / max(1, flagged + held_pos)
    return model, max(f1, key=lambda c: (round(f1[c], 9), -abs(c - 0.5)))

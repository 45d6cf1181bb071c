"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A document's bytes are read in both directions, in windows that overlap, so that a position's state has bytes before and
after it, across words and lines, wherever it stands. Every position gets a distribution of languages; the document's is
the mean over all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Units of a direction; bytes of a window, and those of them at each end that only lead up to the others.
UNITS, WINDOW, LEAD = 8, 256, 16
#: Training: documents of each language, windows of each, bytes of such a window, rounds, windows of a step.
DOCUMENTS, WINDOWS, LENGTH, EPOCHS, BATCH = 300, 8, 96, 4, 128
#: Windows that are read side by side.
STEP = 1024
UND = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiGru:
    """Parameters of both directions: x (byte -> gate inputs), u (state -> gate inputs), b (candidate's state bias); w, c: states -> languages."""

    def __init__(self, classes: int, units: int = UNITS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.units = units
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": rng.normal(0, 0.3, (256, 3 * units)), f"u{d}": rng.normal(0, units**-0.5, (units, 3 * units)), f"b{d}": np.zeros(units)}
        self.p |= {"w": rng.normal(0, units**-0.5, (2 * units, classes)), "c": np.zeros(classes)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _scan(self, inputs: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States after each step. inputs: (steps, words, 3 units); mask: (steps, words, 1)."""
        n, u, b = self.units, self.p[f"u{d}"], self.p[f"b{d}"]
        h, states, saved = np.zeros((inputs.shape[1], n), np.float32), np.empty((*inputs.shape[:2], n), np.float32), []
        for t, x in enumerate(inputs):
            a = h @ u
            gates = _sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = a[:, 2 * n :] + b
            new = np.tanh(x[:, 2 * n :] + r * c)
            if keep:
                saved.append((h, z, r, c, new))
            h = h + mask[t] * (1 - z) * (new - h)
            states[t] = h
        return states, saved

    def _scan_back(self, grads: np.ndarray, mask: np.ndarray, saved: list, d: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of inputs, u and b from those of the states."""
        n, u = self.units, self.p[f"u{d}"]
        to_inputs, to_u, to_b = np.empty((*grads.shape[:2], 3 * n), np.float32), np.zeros_like(u), np.zeros(n, np.float32)
        later = np.zeros(grads.shape[1:], np.float32)
        for t in range(len(grads) - 1, -1, -1):
            h, z, r, c, new = saved[t]
            later = later + grads[t]
            own = later * mask[t]
            to_new = own * (1 - z) * (1 - new * new)
            to_z, to_r, to_c = own * (h - new) * z * (1 - z), to_new * c * r * (1 - r), to_new * r
            to_a = np.concatenate([to_z, to_r, to_c], 1)
            to_inputs[t] = np.concatenate([to_z, to_r, to_new], 1)
            to_u += h.T @ to_a
            to_b += to_c.sum(0)
            later = later * (1 - mask[t]) + own * z + to_a @ u.T
        return to_inputs, to_u, to_b

    @staticmethod
    def _laid(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes (steps, words), the same of each word from its end, mask."""
        lengths = np.array(list(map(len, words)), np.int64)
        steps = int(lengths.max(initial=1))
        grid = np.zeros((len(words), steps), np.uint8)
        grid[np.arange(steps) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        place = np.arange(steps)
        turned = np.take_along_axis(grid, np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place), 1)
        return grid.T, turned.T, (place[:, None] < lengths[None, :])[:, :, None].astype(np.float32)

    @staticmethod
    def _turn(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Steps of each word in the other order; its own inverse."""
        lengths, place = mask.sum(0)[:, 0].astype(np.int64), np.arange(len(states))[:, None]
        return np.take_along_axis(states, np.where(place < lengths, lengths - 1 - place, place)[:, :, None], 0)

    def positions(self, words: list[bytes], keep: bool = False):
        """Distributions (steps, words, languages) and mask."""
        ahead, behind, mask = self._laid(words)
        f, saved_f = self._scan(self.p["xf"][ahead], mask, "f", keep)
        b, saved_b = self._scan(self.p["xb"][behind], mask, "b", keep)
        both = np.concatenate([f, self._turn(b, mask)], 2)
        scores = both @ self.p["w"] + self.p["c"]
        scores = np.exp(scores - scores.max(2, keepdims=True))
        return scores / scores.sum(2, keepdims=True), mask, (ahead, behind, saved_f, saved_b, both)

    def gradients(self, words: list[bytes], labels: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Of the mean cross entropy over all positions; and that."""
        probs, mask, (ahead, behind, saved_f, saved_b, both) = self.positions(words, True)
        total, column = mask.sum(), np.arange(len(words))
        loss = -float((np.log(probs[:, column, labels] + 1e-9) * mask[:, :, 0]).sum() / total)
        to_scores = probs * mask / total
        to_scores[:, column, labels] -= mask[:, :, 0] / total
        n = self.units
        flat, out = to_scores.reshape(-1, to_scores.shape[2]), {}
        out["w"], out["c"] = both.reshape(-1, 2 * n).T @ flat, flat.sum(0)
        to_both = to_scores @ self.p["w"].T
        for d, grads, saved, bytes_ in (("f", to_both[:, :, :n], saved_f, ahead), ("b", self._turn(to_both[:, :, n:], mask), saved_b, behind)):
            to_inputs, out[f"u{d}"], out[f"b{d}"] = self._scan_back(grads, mask, saved, d)
            hot = np.zeros((256, bytes_.size), np.float32)
            hot[bytes_.ravel(), np.arange(bytes_.size)] = 1
            out[f"x{d}"] = hot @ to_inputs.reshape(-1, 3 * n)
        return out, loss

    def fit(self, words: list[bytes], labels: np.ndarray, *, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.01, seed: int = 7) -> None:
        """Adam; words of like length share a step."""
        rng = np.random.default_rng(seed)
        m, v, step = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2)), None, 0
        m, v = m
        sizes = np.array(list(map(len, words)))
        for epoch in range(epochs):
            order = np.lexsort((rng.random(len(words)), sizes))
            steps = [order[a : a + batch] for a in range(0, len(order), batch)]
            rng.shuffle(starts := np.arange(len(steps)))
            for i in starts:
                some, step = steps[i], step + 1
                grads, _ = self.gradients([words[j] for j in some], labels[some])
                now = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


class Reader:
    """A network made ready for reading: weights of both directions side by side, gates apart from the candidate, gates' inputs halved for the tangent."""

    def __init__(self, network: BiGru):
        n, p = network.units, network.p
        both = lambda name, part, scale: np.stack([p[f"{name}{d}"][:, part] for d in "fb"]) * np.float32(scale)
        gates, new = slice(0, 2 * n), slice(2 * n, None)
        self.units = n
        self.x_gates, self.x_new = both("x", gates, 0.5).reshape(512, -1), both("x", new, 1).reshape(512, -1)
        self.u_gates, self.u_new = both("u", gates, 0.5), both("u", new, 1)
        self.b = np.stack([p["bf"], p["bb"]])[:, None, :]
        self.w, self.c = p["w"].reshape(2, n, -1), p["c"]

    def positions(self, grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Distributions (windows, steps, languages). grid: (windows, steps) of bytes; what is beyond a window's length counts for nothing."""
        n, (windows, steps) = self.units, grid.shape
        place = np.arange(steps)
        turn = np.where(place < lengths[:, None], lengths[:, None] - 1 - place, place)
        rows = np.empty((steps, 2, windows), np.int64)  # the second direction's bytes have rows of their own
        rows[:, 0], rows[:, 1] = grid.T, np.take_along_axis(grid, turn, 1).T
        rows[:, 1] += 256
        h, states = np.zeros((2, windows, n), np.float32), np.empty((steps, 2, windows, n), np.float32)
        gates, x_gates = np.empty((2, 2, windows, 2 * n), np.float32)
        new, x_new = np.empty((2, 2, windows, n), np.float32)
        keep, reset = gates[:, :, :n], gates[:, :, n:]
        for t in range(steps):
            np.matmul(h, self.u_gates, out=gates)
            gates += np.take(self.x_gates, rows[t], axis=0, out=x_gates, mode="clip")
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.matmul(h, self.u_new, out=new)
            new += self.b
            new *= reset
            new += np.take(self.x_new, rows[t], axis=0, out=x_new, mode="clip")
            np.tanh(new, out=new)
            h -= new
            h *= keep
            h += new
            states[t] = h
        ahead, behind = (states[:, d].transpose(1, 0, 2) @ self.w[d] for d in (0, 1))
        scores = ahead + np.take_along_axis(behind, turn[:, :, None], 1) + self.c
        scores -= scores.max(2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(2, keepdims=True)
        return scores


def spans(sizes: np.ndarray, window: int = WINDOW, lead: int = LEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts of these sizes: text, first byte, length, and the own bytes of each, which share out the text."""
    step = window - 2 * lead
    counts = -(-sizes // step)
    text = np.repeat(np.arange(len(sizes)), counts)
    own = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * step
    first, end = np.maximum(own - lead, 0), np.minimum(own + step + lead, sizes[text])
    return text, first, end - first, own - first, np.minimum(own + step, sizes[text]) - first


class Labeller:
    """A trained network and its languages."""

    def __init__(self, network: BiGru | None, languages: list[str]):
        self.network, self.languages = network, languages
        self.reader = Reader(network) if network else None

    def __getstate__(self):
        return self.network, self.languages

    def __setstate__(self, state):
        self.__init__(*state)

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """The mean distribution of each text's positions."""
        sizes = np.array(list(map(len, texts)), np.int64)
        flat, begins = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
        text, first, lengths, low, high = spans(sizes)
        total = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(lengths, kind="stable")  # windows of like length share a step
        for a in range(0, len(order), STEP):
            some = order[a : a + STEP]
            place = np.arange(int(lengths[some].max()))
            at = (begins[text[some]] + first[some])[:, None] + place
            probs = self.reader.positions(flat[np.minimum(at, len(flat) - 1)], lengths[some])
            own = (place >= low[some][:, None]) & (place < high[some][:, None])
            np.add.at(total, text[some], (probs * own[:, :, None]).sum(1, dtype=np.float64))
        return total / np.maximum(sizes, 1)[:, None]

    def label(self, texts: list[bytes]) -> list[tuple[str, float]]:
        known = [self.network is not None and has_letter(x) for x in texts]
        found = iter(self.shares([x for x, k in zip(texts, known) if k]) if any(known) else ())
        out = []
        for k in known:
            share = next(found) if k else None
            out.append((self.languages[int(share.argmax())], min(1.0, float(share.max()))) if k else (UND, 0.0))
        return out


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text) or regex.search(r"\p{L}", text.decode("utf-8", "replace")))


def held_out():
    """Whether crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, *, documents: int = DOCUMENTS, windows: int = WINDOWS, seed: int = 7) -> Labeller:
    """A network of the rows that aren't held out and have text and lang.

    Of each language `documents` rows are taken, those of the least hashes, and `windows` windows of bytes from anywhere
    in each whole text. The driver gets the windows of about twice as many rows, whatever the table's size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where((F.octet_length("text") > 0) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = rows.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return Labeller(None, [])
    bounds = F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], min((1 << 63) - 1, ((1 << 63) - 1) * 2 * documents // r["count"]))))
    hashed = rows.withColumn("hash", F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 1))
    drawn = hashed.where(F.col("hash") <= F.try_element_at(bounds, F.col("lang")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, text in zip(batch.column("hash").to_pylist(), common.as_bytes(batch.column("text"))):
                rng = np.random.default_rng((seed, key))
                starts = rng.integers(0, max(1, len(text) - LENGTH + 1), windows if len(text) > LENGTH else 1)
                out.append([text[i : i + LENGTH] for i in starts.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("lang"), pa.array(out, pa.list_(pa.binary()))], ["hash", "lang", "windows"])

    found = sorted(drawn.select("hash", "lang", "text").mapInArrow(some, "hash long, lang string, windows array<binary>").collect(), key=lambda r: (r["lang"], r["hash"], r["windows"]))
    by_language = {r["lang"]: [] for r in counts}
    for r in found:
        by_language[r["lang"]].append([bytes(w) for w in r["windows"]])
    by_language = {x: [w for some_ in taken[:documents] for w in some_] for x, taken in by_language.items() if taken}
    languages = sorted(by_language)
    if not languages:
        return Labeller(None, [])
    rng, most = np.random.default_rng(seed), max(map(len, by_language.values()))
    # As many windows of each language: no language is likelier than another beforehand.
    picked = [by_language[x] + [by_language[x][i] for i in rng.integers(len(by_language[x]), size=most - len(by_language[x]))] for x in languages]
    network = BiGru(len(languages), seed=seed)
    network.fit([w for x in picked for w in x], np.repeat(np.arange(len(languages)), most), seed=seed)
    return Labeller(network, languages)


def identify(docs: DataFrame, labeller: Labeller | None = None, **settings) -> DataFrame:
    """docs, all columns, and lang_pred and score (the mean share of positions, 0 to 1).

    docs: doc_id, text, lang; clashing columns of the same names are replaced. Null text, text without a letter, and all
    texts where nothing could be learned are `und`, with score 0. Repeated rows stay; an empty table gives no rows.
    """
    labeller = labeller or train(docs, **settings)
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(names).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.as_bytes(batch.column("text"))
            for a, b in common.slices([len(x) for x in texts]):
                found, scores = zip(*labeller.label(texts[a:b]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.select(names).mapInArrow(run, schema)

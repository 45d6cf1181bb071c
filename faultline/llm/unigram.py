"""Token counts under a unigram model: forward scores in a trie of distinct pre-tokens, once for each shared prefix.

A trie node stands for a prefix. Its forward score is the best of (score at an ancestor) + (score of the piece from there
to the node), and its count is that segmentation's number of pieces. A pre-token's count is read off at its last node.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, lattice

#: Marks the start of a word in the pieces.
MARK = "▁"
#: What a byte costs where no piece covers a character; each byte is a token.
BYTE_SCORE = -30.0
#: What `sample_words` looks at: documents, drawn by a hash of their id, distinct pre-tokens of these, drawn by a hash, and characters of one.
DOCUMENTS, SAMPLE, LONGEST = 2_000, 20_000, 48
#: Rounds of expectation and maximisation, and how many pieces Zipf's law counts for beside those that are seen.
ROUNDS, PRIOR = 4, 10_000.0
#: Trie nodes that a worker keeps.
NODES = 800_000


def read_pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with the log probability that Zipf's law gives their place in it.

    The file's own scores are merge places, not probabilities; `learn` fits probabilities to a corpus, from these on.
    Control, unknown and byte pieces are left out.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (i + 1) for i in range(len(words))))
    return {w: -math.log(i + 1) - total for i, w in reversed(list(enumerate(words)))}


def expected(words: dict[str, int], pieces: dict[str, float], longest: int) -> tuple[dict[str, float], float]:
    """How often each piece is expected in the words (with their numbers) under the model, and the words' log likelihood.

    Forward and backward sums over all segmentations. Words that no pieces cover tell nothing.
    """
    weights = {w: math.exp(x) for w, x in pieces.items()}
    counts, likelihood = dict.fromkeys(pieces, 0.0), 0.0
    for word, n in words.items():
        size = len(word)
        forward, edges = [1.0] + [0.0] * size, []
        for end in range(1, size + 1):
            for start in range(max(0, end - longest), end):
                if forward[start] and (own := weights.get(word[start:end])) is not None:
                    forward[end] += forward[start] * own
                    edges.append((start, end, own))
        if not forward[size]:
            continue
        likelihood += n * math.log(forward[size])
        backward = [0.0] * size + [1.0]
        for start, end, own in reversed(edges):
            backward[start] += own * backward[end]
        for start, end, own in edges:
            if backward[end]:
                counts[word[start:end]] += n * forward[start] * own * backward[end] / forward[size]
    return counts, likelihood


def fit(words: dict[str, int], pieces: dict[str, float], rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[dict[str, float], list[float]]:
    """Log probabilities of the pieces after so many rounds, and before each the log likelihood of the words and of the prior, which rises."""
    first = {w: math.exp(x) for w, x in pieces.items()}
    longest, told = max(map(len, pieces), default=1), []
    for _ in range(rounds):
        counts, likelihood = expected(words, pieces, longest)
        told.append(likelihood + prior * sum(p * pieces[w] for w, p in first.items()))
        total = sum(counts.values()) + prior
        pieces = {w: math.log((counts[w] + prior * p) / total) for w, p in first.items()}
    return pieces, told


def sample_words(docs: DataFrame, documents: int = DOCUMENTS, most: int = SAMPLE) -> dict[str, int]:
    """Marked pre-tokens of a bounded sample of documents, with their numbers there, for trials of `fit`; `learn` takes all: at most `most`, of LONGEST characters at most."""
    share = min(1.0, 8 * documents / max(1, docs.count()))  # a first draw, by another hash, so that what tasks send on is bounded by the sample
    drawn = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)))
    ids = drawn.select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(documents)
    words = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.explode(F.split("text", "[\\x20\\x09-\\x0D]+")).alias("w")).where((F.length("w") > 0) & (F.length("w") < LONGEST))
    rows = words.groupBy("w").count().orderBy(F.md5("w")).limit(most)
    return {MARK + r["w"]: r["count"] for r in rows.collect()}


def words_of(docs: DataFrame) -> DataFrame:
    """w and n: every distinct pre-token of docs (text) and how often it occurs, in parts that are sorted."""
    words = docs.select(F.explode(F.split(F.col("text").cast("string"), "[\\x20\\x09-\\x0D]+")).alias("w")).where(F.length("w") > 0)
    return words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("w")


def _expected(words: DataFrame, model_path: str, logs: np.ndarray) -> np.ndarray:
    """How often each piece of the file is expected in all words: a vector of a task, added up by piece."""
    given = words.sparkSession.sparkContext.broadcast(logs)  # as many as the file has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = common.held(("lattice", model_path), lambda: lattice.Reversed(list(read_pieces(model_path))))
        logs, counts, some, n = given.value, np.zeros(len(trie.pieces)), [], []
        weights = trie.weights(logs)
        for batch in batches:
            some += [MARK + w for w in batch.column("w").to_pylist()]
            n += batch.column("n").to_pylist()
            if len(some) >= lattice.CHUNK:
                trie.add(some, np.array(n, float), logs, weights, counts)
                some, n = [], []
        trie.add(some, np.array(n, float), logs, weights, counts)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(counts[found])], ["piece", "n"])

    rows = words.mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()  # a row a piece at most
    counts = np.zeros(len(logs))
    counts[rows.column("piece").to_numpy()] = rows.column("n").to_numpy()
    given.destroy()
    return counts


def learn(docs: DataFrame, model_path: str, rounds: int = ROUNDS, prior: float = PRIOR) -> dict[str, float]:
    """Pieces of a file with log probabilities that are fitted to all pre-tokens of docs (text), as `fit` fits them to words at hand.

    The distinct pre-tokens are written once; each round adds up their expected counts in the cluster. What the driver
    holds is a number a piece. Tasks may add up in another order, so logarithms are rounded.
    """
    pieces = read_pieces(model_path)
    first = np.exp(np.array(list(pieces.values())))
    logs = np.log(first)
    words = common.written(words_of(docs), "words")
    for _ in range(rounds):
        counts = _expected(words, model_path, logs)
        logs = np.round(np.log((counts + prior * first) / (counts.sum() + prior)), 9)
    common.discard(words)
    return dict(zip(pieces, logs.tolist()))


class PrefixTrie:
    """Nodes are numbers; 0 is the empty prefix. Ties between segmentations go to the longer last piece."""

    def __init__(self, pieces: dict[str, float], most: int = NODES):
        self.pieces, self.longest, self.most = pieces, max(map(len, pieces), default=1), most
        # Ends of pieces with the score of those that are pieces themselves: what is no end of a piece isn't lengthened.
        self.ends: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(len(p))}
        self.ends.update(pieces)
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score: list[float] = [0.0]
        self.count: list[int] = [0]
        self.terminal: dict[bytes, int] = {}

    def insert(self, word: str) -> int:
        """Number of tokens of the word."""
        child, score, count, ends, node, path = self.child, self.score, self.count, self.ends, 0, [0]
        for depth, letter in enumerate(word, 1):
            down = child.get((node, letter))
            if down is None:
                n = len(letter.encode("utf-8", "replace"))
                best, tokens = score[node] + n * BYTE_SCORE, count[node] + n
                for length in range(1, min(depth, self.longest) + 1):
                    own = ends.get(word[depth - length : depth], False)
                    if own is False:
                        break
                    if own is not None:
                        above = path[depth - length]
                        if score[above] + own >= best:
                            best, tokens = score[above] + own, count[above] + 1
                down = child[node, letter] = len(score)
                score.append(best)
                count.append(tokens)
            node = down
            path.append(node)
        return count[node]


def _trie(path: str, key: str = "", pieces: dict[str, float] | None = None) -> PrefixTrie:
    """One to a worker, whatever the number of its tasks. key tells sets of pieces apart."""
    return common.held(("unigram", path, key), lambda: PrefixTrie(read_pieces(path) if pieces is None else pieces))


def token_counts(docs: DataFrame, model_path: str, *, pieces: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_distinct (pre-tokens), n_tokens and most_tokens (of one pre-token) of every whole text.

    docs: doc_id, text; other columns are left aside. Pre-tokens are the runs between ASCII white space, with a mark
    before each. pieces: log probabilities, as `learn` gives; those of read_pieces by default. Null or empty text has zero
    of everything. Repeated rows stay; an empty table gives no rows.
    """
    key = uuid.uuid4().hex if pieces is not None else ""
    given = docs.sparkSession.sparkContext.broadcast(pieces)  # as many as the file has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(model_path, key, given.value)
        for batch in batches:
            texts, keys = common.as_bytes(batch.column("text")), batch.column("doc_id")
            for a, b in common.slices([len(x) for x in texts]):
                if len(trie.score) > trie.most:
                    trie.clear()
                words = [x.split() for x in texts[a:b]]
                known = trie.terminal
                for word in sorted(w for w in set().union(*words) if w not in known):
                    known[word] = trie.insert(MARK + word.decode("utf-8", "replace"))
                counts = [list(map(known.__getitem__, x)) for x in words]
                columns = [list(map(len, words)), [len(set(x)) for x in words], list(map(sum, counts)), [max(x, default=0) for x in counts]]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_pretokens", "n_distinct", "n_tokens", "most_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_pretokens long, n_distinct long, n_tokens long, most_tokens long")

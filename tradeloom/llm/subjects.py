"""Subject areas of documents by an anchored non-negative factorisation of the document-term matrix.

Texts are read into sentences of words; words are hashed into a fixed number of columns, so a component is a vector of bounded size whatever the
corpus. There is a component for each subject and a few for the language around them. A bounded sample of labelled documents seeds the components;
then alternating multiplicative updates over all documents refine them: given the components each document's mixture, given the mixtures the
components, with the words that the sample ties to a subject kept as its anchors.

A text may name a subject only to deny it, or use its words in an idiom. Which wordings do that is learned from the same labelled documents: a
logistic model over the words and pairs of words of a sentence tells whether readers who met such a sentence named the subject of its words. A
document's mixture is taken over the words of the sentences that pass; it tells the document's subjects directly. Nothing is counted
over documents to decide what is left out, so a text gets the same subjects however often it was copied.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeloom.llm.tokens import spread
from tradeloom.session import checkpointed

#: Columns of the matrix, a bound on the size of every component.
COLUMNS = 1 << 18
#: Components for the language around the subjects.
AROUND = 3
#: Words of documents that are worked on at a time; a longer text is worked on alone.
WORDS_AT_ONCE = 400_000
_TAG, _BREAK, _END = re.compile(r"<[^<>]{1,300}>|&[a-z]{2,8};"), re.compile(r"(?<=\w)-\s*\n\s*(?=[a-zà-ÿ])"), re.compile(r"(?<=[.!?)])[\"'”]?\s+|\n\s*\n|\t+")
_WORD = re.compile(r"[^\W\d_]{3,}")


@lru_cache(maxsize=200_000)
def column(word: str) -> int:
    return zlib.crc32(word.encode()) % COLUMNS


def repaired(text: str) -> str:
    """Undoes UTF-8 that was read as another encoding, where that succeeds."""
    if "Ã" in text or "â€" in text:
        for code in ("cp1252", "latin-1"):
            try:
                return text.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return re.sub(r"[ÃÂ][\x80-\xbf\xa0-\xff]", lambda m: m.group().encode("latin-1", "ignore").decode("utf-8", "ignore"), text)
    return text


def read(text: str | None) -> list[list[int]]:
    """The columns of the words of each sentence that has any."""
    if not text or not text.strip():
        return []
    text = _BREAK.sub("", _TAG.sub(" ", repaired(text)))
    head, _, rest = text.lstrip().partition("\n")
    parts = [head, rest] if len(head) < 90 and not head.rstrip().endswith((".", ",")) else [text]
    found = (_WORD.findall(s.lower()) for part in parts for s in _END.split(part))
    return [[column(w) for w in ws] for ws in found if ws]


@dataclass
class Words:
    """The words of n documents: their document (ascending), column and sentence, and the distinct (document, column) with their counts."""

    n: int
    rows: np.ndarray
    cols: np.ndarray
    sent: np.ndarray
    sentences: int

    def __post_init__(self):
        keys, self.at, self.counts = np.unique(self.rows * COLUMNS + self.cols, return_inverse=True, return_counts=True)
        self.urows, self.ucols = keys // COLUMNS, keys % COLUMNS

    def only(self, sentences: np.ndarray) -> Words:
        """The words of some of the sentences (a mask)."""
        m = sentences[self.sent]
        return self if m.all() else Words(self.n, self.rows[m], self.cols[m], self.sent[m], self.sentences)

    @staticmethod
    def of(sizes: pa.ListArray, cols: pa.ListArray) -> Words:
        whole = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        length = cols.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        s = whole(sizes)
        return Words(len(cols), np.repeat(np.arange(len(cols)), length), whole(cols), np.repeat(np.arange(len(s)), s), len(s))


def portions(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """A batch with columns sizes and cols in portions of a bounded number of words, or of one document."""
    total = np.cumsum(b.column(b.schema.get_field_index("cols")).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        stop = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + WORDS_AT_ONCE, "right")), at + 1)
        part = b.slice(at, stop - at)
        yield part, Words.of(*(part.column(part.schema.get_field_index(c)) for c in ("sizes", "cols")))
        at = stop


def mixtures(words: Words, h: np.ndarray, allowed: np.ndarray | None = None, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the components in each document (words each accounts for), and the shares of each distinct (document, column).

    h: columns x components. Multiplicative updates that lower the Kullback-Leibler divergence. allowed masks components per document.
    """
    k = h.shape[1]
    w = np.ones((words.n, k), np.float32) if allowed is None else allowed.astype(np.float32)
    if not len(words.urows):
        return np.zeros((words.n, k), np.float32), np.zeros((0, k), np.float32)
    hc, counts = h[words.ucols] + np.float32(1e-12), words.counts[:, None].astype(np.float32)
    have, starts = np.unique(words.urows, return_index=True)
    for _ in range(rounds):
        share = w[words.urows] * hc
        share /= share.sum(1, keepdims=True) + np.float32(1e-30)
        w = np.zeros((words.n, k), np.float32)
        w[have] = np.add.reduceat(share * counts, starts, axis=0)
    return w, share


def summed(words: Words, share: np.ndarray) -> np.ndarray:
    """Columns x components: the shares of all documents together."""
    return np.stack([np.bincount(words.ucols, share[:, j] * words.counts, minlength=COLUMNS) for j in range(share.shape[1])], 1)


def seed(words: Words, labels: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Components from labelled documents (labels: documents x subjects, 0 or 1) and, per column and component, whether it may hold the word.

    A word is tied to the subject that most of its documents' labels name, and to the language around where they are spread over subjects; words
    too rare in the sample to tell may go anywhere. With the ties, alternating updates over the sample give the first components.
    """
    n, k = labels.shape
    part = labels / np.maximum(labels.sum(1, keepdims=True), 1)
    seen = np.bincount(words.ucols, minlength=COLUMNS).astype(np.float32)
    named = np.stack([np.bincount(words.ucols, part[words.urows, j], minlength=COLUMNS) for j in range(k)], 1)
    tie = named / (seen + 0.5)[:, None]
    best, top = tie.argmax(1), tie.max(1)
    may = np.ones((COLUMNS, k + AROUND), bool)
    mine, spread_out = (top > 0.55) & (seen >= 3), (top < 0.45) & (seen >= 8)
    may[mine], may[np.flatnonzero(mine), best[mine]] = False, True
    may[spread_out, :k] = False
    rng = np.random.default_rng(7)
    around = np.tile(seen[:, None] * 0.2, (1, AROUND)) * rng.uniform(0.5, 1.5, (COLUMNS, AROUND))
    h = np.concatenate([named**2 / (seen + 1)[:, None], around], 1).astype(np.float32) * may
    h /= h.sum(0).clip(1e-9)
    allowed = np.concatenate([labels + 0.02, np.ones((n, AROUND))], 1)
    for _ in range(rounds if len(words.cols) else 0):
        h = anchored(h, summed(words, mixtures(words, h, allowed, 6)[1]), may)
    return h, may


def anchored(h: np.ndarray, sums: np.ndarray, may: np.ndarray, prior: float = 0.05) -> np.ndarray:
    """Components from the summed shares of all documents, a trace of the former ones kept; words stay where they are tied."""
    new = (sums + prior * h * sums.sum(0)) * may
    return (new / new.sum(0).clip(1e-9)).astype(np.float32)


def told(sums: np.ndarray, may: np.ndarray, least: float = 0.4) -> np.ndarray:
    """The ties after a round over all documents: a word of which no subject holds a good part among the subjects goes to the language around."""
    k = may.shape[1] - AROUND
    of = sums[:, :k]
    flat = (of.max(1) < least * of.sum(1)) & (may.sum(1) > 1)
    may = may.copy()
    may[flat, :k] = False
    return may


@dataclass
class Wording:
    """Tells sentences that deal with the matter of their words from those that deny or only borrow it, by words that are no anchors and by pairs of words."""

    anchors: np.ndarray
    weights: np.ndarray
    bias: float = 2.0

    @staticmethod
    def features(words: Words, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        free, pair = ~anchors[words.cols], words.sent[1:] == words.sent[:-1]
        both = COLUMNS + (words.cols[:-1][pair] * 40503 + words.cols[1:][pair] * 9973) % COLUMNS
        return np.concatenate([words.sent[free], words.sent[:-1][pair]]), np.concatenate([words.cols[free], both])

    def asserts(self, words: Words) -> np.ndarray:
        """Per sentence whether what it says counts."""
        sent, feature = self.features(words, self.anchors)
        return self.bias + np.bincount(sent, self.weights[feature], minlength=words.sentences) > 0

    @staticmethod
    def learned(words: Words, labels: np.ndarray, h: np.ndarray, anchors: np.ndarray, rounds: int = 300, ridge: float = 0.3, least: int = 3) -> Wording:
        """From labelled documents: the sentences with a word that is mostly a subject's, and whether the document's labels name the subject.

        Logistic regression with a ridge, by gradient steps over the whole sample; features met in fewer than `least` such sentences play no part.
        """
        k = labels.shape[1]
        out = Wording(anchors, np.zeros(2 * COLUMNS))
        if not len(words.cols):
            return out
        share = mixtures(words, h)[1][words.at][:, :k]
        top = np.zeros((words.sentences, k), np.float32)
        np.maximum.at(top, words.sent, share)
        owner = np.zeros(words.sentences, np.int64)
        owner[words.sent] = words.rows
        about = top >= 0.5
        known = about.any(1) & (labels.sum(1) > 0)[owner]
        right = (labels[owner] * about).sum(1) / np.maximum(about.sum(1), 1)
        sent, feature = Wording.features(words, anchors)
        sent, feature = sent[known[sent]], feature[known[sent]]
        often = np.bincount(feature, minlength=2 * COLUMNS) >= least
        sent, feature = sent[often[feature]], feature[often[feature]]
        place, feature = np.unique(feature, return_inverse=True)
        w, squares, squared, bias = np.zeros(len(place)), np.full(len(place), 1e-8), 1e-8, out.bias
        for _ in range(rounds if known.any() else 0):
            z = bias + np.bincount(sent, w[feature], minlength=words.sentences)
            miss = np.where(known, 1 / (1 + np.exp(-z)) - right, 0)
            slope = np.bincount(feature, miss[sent], minlength=len(place)) + ridge * w
            squares, squared = squares + slope**2, squared + miss.sum() ** 2
            w, bias = w - 0.3 * slope / np.sqrt(squares), bias - 0.3 * miss.sum() / np.sqrt(squared)
        out.weights[place], out.bias = w, float(bias)
        return out


def started(words: Words, labels: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, Wording]:
    """First components, ties and wordings from labelled documents, by turns: words that are only denied or borrowed tie to nothing."""
    h, may = seed(words, labels)
    wording = Wording.learned(words, labels, h, may.sum(1) == 1)
    for _ in range(rounds):
        h, may = seed(words.only(wording.asserts(words)), labels)
        wording = Wording.learned(words, labels, h, may.sum(1) == 1)
    return h, may, wording


def read_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sizes, cols): words per sentence and the columns of the words in order; checkpointed, so that texts are read once."""
    kinds = pa.schema([("doc_id", pa.int64()), ("sizes", pa.list_(pa.int32())), ("cols", pa.list_(pa.int32()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                each = [read(t) for t in part.column(1).to_pylist()]
                arrays = [[len(s) for s in ts] for ts in each], [[c for s in ts for c in s] for ts in each]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(a, type=f.type) for a, f in zip(arrays, list(kinds)[1:])]], schema=kinds)

    plain = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return checkpointed(plain.mapInArrow(batches, "doc_id long, sizes array<int>, cols array<int>"))


def labelled_documents(parsed: DataFrame, labels: DataFrame, subjects: Sequence[str], sample: int = 20_000, words: int = 5_000_000) -> tuple[Words, np.ndarray]:
    """The words of labelled documents, and documents x subjects with 1 where a label names the subject.

    sample bounds the label rows taken from labels (doc_id, subject), those of the smallest hash of doc_id, and words what is brought of them, in the same order.
    """
    some = labels.where(F.col("subject").isin(*subjects) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("l__"), "subject").distinct()
    some = some.orderBy(F.xxhash64("l__"), "l__", "subject").limit(sample).groupBy("l__").agg(F.collect_set("subject").alias("named"))
    known = parsed.join(some, F.col("doc_id") == F.col("l__")).select(F.xxhash64("l__").alias("k"), "doc_id", F.size("cols").alias("n"), "sizes", "cols", "named")
    place, docs, flags = {s: i for i, s in enumerate(subjects)}, [], []
    left = words
    for r in known.orderBy("k", "doc_id").toLocalIterator():
        left -= r["n"]
        if left < 0:
            break
        docs.append(tuple(np.array(r[c], np.int32) for c in ("sizes", "cols")))
        flags.append([float(s in r["named"]) for s in place])
    sizes, cols = (pa.array([d[i] for d in docs], pa.list_(pa.int32())) for i in (0, 1))
    return Words.of(sizes, cols), np.array(flags, np.float32).reshape(len(docs), len(place))


def fit(parsed: DataFrame, words: Words, labels: np.ndarray, rounds: int = 2) -> tuple[np.ndarray, Wording]:
    """Components from labelled documents and all documents, and the wordings that assert.

    The labelled ones seed the components; the rounds that follow run over every document: a task sums the shares of its documents, and what is
    gathered is at most a row for each column of the matrix.
    """
    h, may, wording = started(words, labels)
    sc, k = parsed.sparkSession.sparkContext, h.shape[1]
    for _ in range(rounds):
        shared = sc.broadcast((h, wording))

        def sums(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (h, wording), total = shared.value, np.zeros((COLUMNS, k))
            for b in it:
                for _, part in portions(b):
                    part = part.only(wording.asserts(part))
                    total += summed(part, mixtures(part, h)[1])
            at = np.flatnonzero(total.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *[pa.array(total[at, j]) for j in range(k)]], names=["col", *[f"s{j}" for j in range(k)]])

        got = parsed.select("sizes", "cols").mapInArrow(sums, "col int, " + ", ".join(f"s{j} double" for j in range(k)))
        got = got.groupBy("col").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(k)]).toArrow()  # a row for each column at most
        total = np.zeros((COLUMNS, k))
        total[got.column("col").to_numpy()] = np.stack([got.column(f"s{j}").to_numpy() for j in range(k)], 1)
        may = told(total, may)
        h = anchored(h, total, may)
        shared.unpersist()
    return h, wording


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, sample: int = 20_000, rounds: int = 2, least: float = 1.5, share: float = 0.12) -> DataFrame:
    """(doc_id, subject, words, share) for each subject that a document deals with.

    words is the weight of the subject's component in the document's mixture, in words, over the sentences that assert something, and share that
    weight over the weights of all subjects. A document deals with the subjects of at least `least` words and `share`. Null, empty and blank texts, and texts without a subject, give no row; the
    language does not matter; repeated documents are judged alike, and a text alike however often it is repeated. Without labels no component is told from
    another and there are no rows.
    """
    names = sorted({r[0] for r in areas.select("subject").where("subject IS NOT NULL").collect()})  # a small fixed table
    schema = "doc_id long, subject string, words double, share double"
    if not names:
        return documents.sparkSession.createDataFrame([], schema)
    parsed = read_corpus(documents)
    words, named = labelled_documents(parsed, labels, names, sample)
    if not len(named):
        return documents.sparkSession.createDataFrame([], schema)
    shared, k = parsed.sparkSession.sparkContext.broadcast(fit(parsed, words, named, rounds)), len(names)

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, wording = shared.value
        for b in it:
            for part, words in portions(b):
                weight = mixtures(words.only(wording.asserts(words)), h)[0][:, :k].astype(float)
                of = weight / np.maximum(weight.sum(1, keepdims=True), 1e-9)
                i, j = np.nonzero((weight >= least) & (of >= share))
                ids = part.column(part.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False)
                columns = [pa.array(ids[i], pa.int64()), pa.array([names[x] for x in j], pa.string()), pa.array(weight[i, j]), pa.array(of[i, j])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "subject", "words", "share"])

    return parsed.where("doc_id IS NOT NULL").mapInArrow(judge, schema)

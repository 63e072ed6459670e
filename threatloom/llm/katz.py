"""Language-model scores by Katz backoff over word trigrams, bigrams and unigrams.

log10 P(w | h) = log10(d(c) * c / n(h)) for an n-gram seen c times in training, else log10(alpha(h)) plus
log10 P(w | h') where h' is h without its first word; d are the Good-Turing discounts of the order, n(h) counts
h as a history, and alpha(h) shares exactly what the discounts leave among words not seen after h.
Unigrams are discounted likewise; what is left there is the probability of the one class of unknown
words. So the probabilities after any history sum to 1. Begin marks, which are no tokens, stand before a
text; its end is a token.

Texts are cut into blocks, written to the shared folder as local word numbers. Tables of counts are
partitioned by ranges of 64-bit hashes, one for each order and one for the histories of each order above
the first: a block asks, for its distinct words, pairs, triples and histories, with its own counts of them;
the partition adds them up and answers in the same order. So an n-gram of any frequency costs one entry a
block, no count passes through the driver (which sees counts of counts alone), and scoring is the
evaluation of a block with its answers. What a backoff weight rests on is answered only where a block has an
n-gram that was never seen. The backoff sums of a history are whole numbers (counts by
discount class), so they don't depend on the order of addition. ``fit`` keeps the tables, ``score`` answers
from kept tables; ``katz_scores`` does both at once. Blocks and partitions grow as the square root of the
input (``block_size``), so the rows that are exchanged grow as the input.

Defined results: null and empty texts are the end token alone; texts of any length are read whole; null ids are
the text ``null`` for the split; repeated rows count and score as often as they stand; without training tokens every
token is unknown and has probability 1; extra columns are never read; an empty table gives an empty one. If counts
of counts are too thin for Good-Turing (a discount outside (0, 1)), fewer counts are discounted, and if
that doesn't help either, discounts are (r - 0.5) / r. If
nothing is left for words unseen after a history, its count is one larger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import block_size, crc_of_id, filesystem, materialize, partitions, shared_dir, small_batches

#: Tokens of a block, at least, and entries of an exchanged row, on average.
BLOCK = 3 << 18
ROW = 128
#: Counts up to this one are discounted.
CUTOFF = 5
#: Columns of histories: how often, n-grams by count, lower counts above CUTOFF, and by count.
HISTORY = 2 + 2 * CUTOFF
END = np.uint64(0xE17D)
#: Histories of the first token: no word, and no two words.
BEGIN, BEGIN_2 = np.uint64(0xBE61), np.uint64(0xBE62)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
#: Bits of the hashes of pairs and triples: 56 of 64, as each bit is sent around.
KEPT_BITS = ~np.uint64(0xFF)


# blocks -------------------------------------------------------------------------------------------


@dataclass
class Grams:
    """The distinct n-grams of a block, in the order of their hashes."""

    hashes: np.ndarray
    number: np.ndarray  # of each token's n-gram
    history: np.ndarray  # numbers of histories
    word: np.ndarray  # and of words

    def counts(self, of_token: np.ndarray) -> np.ndarray:
        return np.bincount(self.number, of_token, len(self.hashes)).astype(np.int64)


@dataclass
class Block:
    ids: np.ndarray  # document ids
    null: np.ndarray  # of ids
    size: np.ndarray  # tokens of each document, the end included
    train: np.ndarray  # of each document
    token: np.ndarray  # numbers of words in ``words``
    words: np.ndarray  # sorted hashes

    def of_token(self, per_document: np.ndarray) -> np.ndarray:
        return np.repeat(per_document, self.size)

    def _after(self, number: np.ndarray, begin: int) -> np.ndarray:
        """Of each token the number of what stands before it, ``begin`` before the first of a document."""
        out = np.r_[begin, number[:-1]].astype(np.int64)
        out[np.cumsum(self.size)[:-1]] = begin
        return out

    def _grams(self, history: np.ndarray, history_hashes: np.ndarray) -> Grams:
        hashes = textops.mix(textops.mix(history_hashes)[history] * _GRAM + self.words[self.token]) & KEPT_BITS
        order = np.argsort(hashes)
        new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        one = order[new]  # a token of each
        return Grams(hashes[one], number, history[one], self.token[one].astype(np.int64))

    @cached_property
    def before(self) -> np.ndarray:
        return self._after(self.token, len(self.words))

    @cached_property
    def pairs(self) -> Grams:
        return self._grams(self.before, self.histories(2))

    @cached_property
    def before_2(self) -> np.ndarray:
        return self._after(self.pairs.number, len(self.pairs.hashes))

    @cached_property
    def triples(self) -> Grams:
        return self._grams(self.before_2, self.histories(3))

    def histories(self, order: int) -> np.ndarray:
        """Hashes of the histories of n-grams of this order; the begin comes after all others."""
        return np.r_[self.words, BEGIN] if order == 2 else np.r_[self.pairs.hashes, BEGIN_2]


def write_blocks(docs: DataFrame, folder: str, tokens: int) -> DataFrame:
    """Blocks of documents (doc_id, train, text) as files; (block) of each."""
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches):
        from pyspark import TaskContext

        task, (fs, root) = TaskContext.get(), filesystem(folder)
        held, n, turn = [], 0, 0

        def flush():
            nonlocal held, n, turn
            ids, null, size, train, hashes = (np.concatenate(x) for x in zip(*held))
            words, token = np.unique(hashes, return_inverse=True)
            name = f"block-{task.partitionId():06d}-{task.taskAttemptId()}-{turn}"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(textops.pack(ids, null, size.astype(np.int32), train, token.astype(np.uint32), words))
            held, n, turn = [], 0, turn + 1
            return pa.RecordBatch.from_pydict({"block": [name]})

        for batch in batches:
            ids, train = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            null, ids = np.asarray(ids.is_null()).astype(np.uint8), ids.fill_null(0).to_numpy()
            for at, data, offsets in textops.slices(batch.column(2)):
                words = textops.Words(data, offsets, lower=True)
                to = at + len(offsets) - 1
                held.append((ids[at:to], null[at:to], words.counts + 1, train[at:to], np.insert(words.hashes(), words.first[1:], END)))
                n += len(words) + to - at
                if n >= tokens:
                    yield flush()
        if held:
            yield flush()

    return materialize(docs.select("doc_id", "train", "text").mapInArrow(run, "block string"), "katz-blocks")


def read_block(folder: str, name: str) -> Block:
    fs, root = filesystem(folder)
    with fs.open_input_file(f"{root}/{name}") as f:
        return Block(*textops.unpack(f.readall()))


# counting -----------------------------------------------------------------------------------------

_QUESTION = "bucket int, block string, data binary"


def _small(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def _questions(block: str, hashes: np.ndarray, columns: list[np.ndarray], buckets: int):
    columns = [_small(c) for c in columns]
    rows = [(k, block, textops.pack(hashes[a:b], *(c[a:b] for c in columns))) for k, a, b in textops.bucket_cuts(hashes, buckets)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary()))], names=["bucket", "block", "data"])


def _answers(questions: DataFrame, name: str, keep: bool, opens: np.ndarray | None = None) -> DataFrame:
    """Sums of the asked columns over all blocks, in the order of each question, and a row without a
    block of counts of counts (distinct with a count, their sum, how many have 1, 2, ...) of the first
    column. N-grams have one column, and their answer a second one that marks the one block that stands for the
    hash. Histories (``opens``: whether a count up to CUTOFF is discounted) have HISTORY columns and a mark of those
    whose backoff weight is asked for: the answer is the first column, whether anything is left for other words, and
    of the marked ones the other columns. With ``keep``, a row of the block "" has the table: distinct hashes that have
    a count, and their sums. Questions of the block "" are such tables; they get no answer."""
    wide = opens is not None

    def run(table: pa.Table) -> pa.Table:
        blocks, data = table.column("block").to_pylist(), [textops.unpack(x) for x in table.column("data").to_pylist()]
        bucket = table.column("bucket")[0].as_py()
        hashes = np.concatenate([d[0] for d in data])
        order = np.argsort(hashes, kind="stable")
        new = np.r_[True, hashes[order][1:] != hashes[order][:-1]]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        number = np.empty(len(order), np.int64)
        number[order] = group
        column = lambda k: np.concatenate([d[k] for d in data]).astype(np.int64)[order]
        sums = [_small(np.add.reduceat(column(k), at)) for k in range(1, 1 + (HISTORY if wide else 1))]
        if wide:
            second = np.add.reduce([x > 0 for x, o in zip(sums[1 : 1 + CUTOFF], opens) if o]) if opens.any() else np.zeros(len(at), np.int64)
            second = (second > 0).astype(np.uint8)[number]
        else:
            has = np.flatnonzero(column(1) > 0)
            second = np.zeros(len(order), np.uint8)
            if len(has):
                second[order[has[np.r_[True, group[has][1:] != group[has][:-1]]]]] = 1
        rows, end = [], 0
        for block, d in zip(blocks, data):
            start, end = end, end + len(d[0])
            if block:
                own = number[start:end]
                more = [x[own[d[1 + HISTORY] > 0]] for x in sums[1:]] if wide else []
                rows.append((block, textops.pack(sums[0][own], second[start:end], *more)))
        counts = sums[0][sums[0] > 0].astype(np.int64)
        rows.append((None, np.array([len(counts), counts.sum(), *[(counts == r).sum() for r in range(1, CUTOFF + 2)]], "<i8").tobytes()))
        if keep:
            known = np.flatnonzero(sums[0] > 0)
            rows.append(("", textops.pack(hashes[order][at][known], *(x[known] for x in sums))))
        block, packed = zip(*rows)
        return pa.table({"block": pa.array(block, pa.string()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "data": pa.array(packed, pa.binary())})

    return materialize(questions.groupBy("bucket").applyInArrow(run, "block string, bucket int, data binary"), name)


def _statistics(answers: DataFrame) -> list[int]:
    """Distinct, total and counts of counts, summed over the partitions of a table."""
    size = CUTOFF + 3

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()) for t in total], names=[f"s{i}" for i in range(size)])

    rows = answers.where("block IS NULL").select("data").mapInArrow(run, ", ".join(f"s{i} long" for i in range(size)))
    found = rows.agg(*[F.sum(f"s{i}") for i in range(size)]).first()
    return [int(x or 0) for x in found]


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d(0..CUTOFF) of Katz: Good-Turing estimates made to leave counts above a cutoff as they are; the
    cutoff is the largest one up to CUTOFF for which all of them are proper."""
    n = np.r_[0, counts_of_counts].astype(np.float64)
    for cutoff in range(CUTOFF, 0, -1):
        r = np.arange(1, cutoff + 1)
        if (n[1 : cutoff + 2] > 0).all() and (common := (cutoff + 1) * n[cutoff + 1] / n[1]) < 1:
            d = ((r + 1) * n[r + 1] / (n[r] * r) - common) / (1 - common)
            if ((d > 0) & (d < 1)).all():
                return np.r_[1.0, d, np.ones(CUTOFF - cutoff)]
    r = np.arange(1, CUTOFF + 1)
    return np.r_[1.0, (r - 0.5) / r]


def _discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(c <= CUTOFF, d[np.minimum(c, CUTOFF)], 1.0) * c


@dataclass
class Model:
    """What all blocks share: totals and discounts of the three orders."""

    total: int
    distinct: int
    discount: list[np.ndarray]  # of orders 1, 2, 3
    left: float  # probability of unknown words

    @classmethod
    def of(cls, statistics: list[list[int]]) -> Model:
        d = [discounts(np.array(s[2:])) for s in statistics]
        (distinct, total, *counts), r = statistics[0], np.arange(1, CUTOFF + 1)
        left = float(((1 - d[0][1:]) * r * counts[:CUTOFF]).sum())
        return cls(total, distinct, d, left / total if left > 0 else 1 / (total + 1))

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        n = self.total + 1 if self.left == 1 / (self.total + 1) else self.total
        return np.where(c > 0, _discounted(c, self.discount[0]) / n, self.left)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def opens(self, order: int) -> np.ndarray:
        """Whether a count up to CUTOFF leaves something for other words."""
        return self.discount[order - 1][1:] < 1

    def _left(self, order: int, sums: list[np.ndarray]) -> np.ndarray:
        return sum((1 - self.discount[order - 1][r]) * r * sums[r].astype(np.float64) for r in range(1, CUTOFF + 1))

    def alpha(self, order: int, sums: list[np.ndarray], lower: np.ndarray | None = None) -> np.ndarray:
        """Backoff weights of histories: from n and their n-grams by count up to CUTOFF, then the lower order's
        counts of the words seen after them, the sum of those above CUTOFF and the numbers by smaller count;
        ``lower`` has its denominators."""
        left = self._left(order, sums)
        left, over = np.where(left > 0, left, 1.0), np.where(left > 0, sums[0], sums[0] + 1.0)
        large, small = sums[1 + CUTOFF], sums[2 + CUTOFF :]
        if lower is None:
            seen = large * (self.word_probability(np.array([CUTOFF + 1]))[0] / (CUTOFF + 1)) + sum(self.word_probability(np.array([r]))[0] * x for r, x in zip(range(1, CUTOFF + 1), small))
        else:
            seen = (large + sum(self.discount[order - 2][r] * r * x for r, x in zip(range(1, CUTOFF + 1), small))) / np.maximum(1, lower)
        return np.where(sums[0] > 0, left / over / np.maximum(1e-12, 1 - seen), 1.0)


def _gathered(answers: list[DataFrame]) -> DataFrame:
    """A row a block with its answers: one a level and bucket."""
    rows = None
    for level, a in enumerate(answers):
        own = a.where("block <> ''").select("block", F.struct(F.lit(level).alias("level"), "bucket", "data").alias("answer"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("block").agg(F.collect_list("answer").alias("answers"))


def _columns_of(answers: list[dict], level: int) -> list[np.ndarray]:
    parts = [textops.unpack(a["data"]) for a in sorted((a for a in answers if a["level"] == level), key=lambda a: a["bucket"])]
    return [np.concatenate([p[k] for p in parts]) for k in range(len(parts[0]))]


def _history_columns(block: Block, order: int, grams: Grams, answer: list[np.ndarray], lower: np.ndarray) -> list[np.ndarray]:
    """What a block tells of its histories: how often they are one in training, and of the n-grams that it
    stands for, how many there are by count, and the counts of their lower order."""
    n, before = len(block.histories(order)), block.before if order == 2 else block.before_2
    mine = answer[1] > 0
    history, c, low = grams.history[mine], answer[0][mine], lower[mine].astype(np.int64)
    counted = lambda keep, weight=None: np.bincount(history[keep], None if weight is None else weight[keep], n).astype(np.int64)
    return [np.bincount(before, block.of_token(block.train), n).astype(np.int64), *[counted(c == r) for r in range(1, CUTOFF + 1)], counted(low > CUTOFF, low.astype(np.float64)), *[counted(low == r) for r in range(1, CUTOFF + 1)]]


def _asked(grams: Grams, counts: np.ndarray, n: int) -> np.ndarray:
    """Which histories stand before an n-gram that was never seen."""
    out = np.zeros(n, bool)
    out[grams.history[counts == 0]] = True
    return out


def _lower_pair(block: Block) -> np.ndarray:
    """Number of the pair that each triple ends with."""
    out = np.empty(len(block.triples.hashes), np.int64)
    out[block.triples.number] = block.pairs.number
    return out


_LEVELS = ("words", "pairs", "histories-2", "triples", "histories-3")


@dataclass
class Tables:
    """A kept model: its totals and discounts, and the tables (bucket, block "", data) of the five levels."""

    model: Model
    buckets: int
    levels: list[DataFrame]


def _run(rows: DataFrame, keep: bool = False, tables: Tables | None = None):
    """(folder of the blocks, answers of the five levels, the model, buckets) for rows (doc_id, train, text); None if there are none."""
    spark = rows.sparkSession
    small_batches(spark)
    folder = shared_dir(spark, "katz")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = write_blocks(rows, folder, block_size(total // 6, BLOCK, ROW))
    n_blocks = blocks.count()
    if not n_blocks:
        return None
    buckets = tables.buckets if tables else max(partitions(spark), n_blocks)
    dealt = blocks.repartitionByRange(min(n_blocks, 4 * partitions(spark)), "block")

    def asked(block, level, answers):
        if level == 0:
            return block.words, [np.bincount(block.token, block.of_token(block.train), len(block.words)).astype(np.int64)]
        if level in (1, 3):
            grams = block.pairs if level == 1 else block.triples
            return grams.hashes, [grams.counts(block.of_token(block.train))]
        low, own = _columns_of(answers, 0), _columns_of(answers, 1)
        if level == 2:
            columns, grams = _history_columns(block, 2, block.pairs, own, low[0][block.pairs.word]), block.pairs
        else:
            columns, grams = _history_columns(block, 3, block.triples, own, low[0][_lower_pair(block)]), block.triples
        hashes = block.histories(2 if level == 2 else 3)
        columns.append(_asked(grams, own[0], len(hashes)))
        order = np.argsort(hashes)
        return hashes[order], [c[order] for c in columns]

    def ask(level: int, given: list[DataFrame], opens: np.ndarray | None = None) -> DataFrame:
        answered = bool(given)

        def run(batches):
            for batch in batches:
                answers = batch.column(1).to_pylist() if answered else [None] * len(batch)
                for name, own in zip(batch.column(0).to_pylist(), answers):
                    yield _questions(name, *asked(read_block(folder, name), level, own), buckets)

        questions = (_gathered(given) if given else dealt).mapInArrow(run, _QUESTION)
        if tables:
            questions = questions.unionByName(tables.levels[level].select("bucket", "block", "data"))
        return _answers(questions, f"katz-{_LEVELS[level]}", keep, opens)

    words, pairs, triples = ask(0, []), ask(1, []), ask(3, [])
    model = tables.model if tables else Model.of([_statistics(x) for x in (words, pairs, triples)])
    histories = [ask(2, [words, pairs], model.opens(2)), ask(4, [pairs, triples], model.opens(3))]
    return folder, [words, pairs, histories[0], triples, histories[1]], model, buckets


def _weights(model: Model, block: Block, order: int, grams: Grams, counts: np.ndarray, answer: list[np.ndarray], lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(denominators, backoff weights, those that are asked for) of a block's histories."""
    hashes = block.histories(order)
    by_hash = np.argsort(hashes)
    n, left = np.empty(len(hashes)), np.empty(len(hashes), bool)
    n[by_hash], left[by_hash] = answer[0], answer[1] > 0
    asked = by_hash[_asked(grams, counts, len(hashes))[by_hash]]
    alpha = np.ones(len(hashes))
    alpha[asked] = model.alpha(order, [n[asked], *answer[2:]], None if lower is None else lower[asked])
    return np.where(left, n, n + 1), alpha


def _evaluated(folder: str, answers: list[DataFrame], model: Model) -> DataFrame:
    def run(batches):
        for batch in batches:
            for name, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                b = read_block(folder, name)
                of_word, of_pair, sums_2, of_triple, sums_3 = (_columns_of(given, level) for level in range(5))
                of_word, c_2, c_3 = (x[0].astype(np.int64) for x in (of_word, of_pair, of_triple))
                with np.errstate(divide="ignore"):
                    one = np.log10(model.word_probability(of_word))
                    over_2, alpha_2 = _weights(model, b, 2, b.pairs, c_2, sums_2)
                    two = np.where(c_2 > 0, np.log10(_discounted(c_2, model.discount[1]) / over_2[b.pairs.history]), np.log10(alpha_2)[b.pairs.history] + one[b.pairs.word])
                    # the history of a triple is a pair, whose last word is the pair's own history
                    over_3, alpha_3 = _weights(model, b, 3, b.triples, c_3, sums_3, over_2[np.r_[b.pairs.word, len(b.words)]])
                    three = np.where(c_3 > 0, np.log10(_discounted(c_3, model.discount[2]) / over_3[b.triples.history]), np.log10(alpha_3)[b.triples.history] + two[_lower_pair(b)])
                first = np.cumsum(b.size) - b.size
                add = lambda x: np.add.reduceat(x, first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.ids, mask=b.null > 0), pa.array(b.size.astype(np.int64)), pa.array(add((of_word > 0)[b.token].astype(np.int64))), pa.array(add(model.base(of_word)[b.token])), pa.array(add(three[b.triples.number]))],
                    names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    return _gathered(answers).mapInArrow(run, _SCORES)


def fit(docs: DataFrame) -> Tables | None:
    """The model of all texts of ``docs``, with its tables kept in the shared folder; None without rows."""
    found = _run(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lit(True).alias("train"), docs["text"].alias("text")), keep=True)
    if not found:
        return None
    _, answers, model, buckets = found
    return Tables(model, buckets, [a.where("block = ''") for a in answers])


def score(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every document by a kept model."""
    found = _run(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.lit(False).alias("train"), docs["text"].alias("text")), tables=tables)
    return _evaluated(*found[:3]) if found else docs.sparkSession.createDataFrame([], _SCORES)


def katz_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document, by the model of
    those that are not held out."""
    held_out = lambda doc_id: F.pmod(crc_of_id(doc_id), F.lit(5)) == 1
    found = _run(docs.select(docs["doc_id"].cast("long").alias("doc_id"), (~held_out(docs["doc_id"])).alias("train"), docs["text"].alias("text")))
    rows = _evaluated(*found[:3]) if found else docs.sparkSession.createDataFrame([], _SCORES)
    return rows.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("train_tokens", F.lit(found[2].total if found else 0).cast("long")).select(*_COLUMNS)


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"
_COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

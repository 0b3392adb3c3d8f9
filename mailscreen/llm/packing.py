"""Best-fit packing of token sequences through a configuration linear program.

The lengths of all pieces make a histogram of at most `capacity` bins, whatever the number of
documents.  Over it, the linear program "fewest sequences that together hold every piece,
each filled by one configuration of lengths" is solved approximately by multiplicative
weights: every length has a price, the best configurations at these prices are found by
exact knapsack dynamic programming, and lengths they hold become cheaper.  The fractional
solution is rounded down, and what is left over is packed best fit, longest first.

The plan (configurations with their multiplicities) is then laid over the pieces: the n-th
piece of a length goes to the place of that length that the plan counts as its n-th.  The
numbering comes from a count per task while tokenising and an offset per task and length,
so pieces are never sorted or gathered, and a length that holds a third of all pieces is
as good as any other.

Tokens are those of the public `word_bpe_49k.json` vocabulary.  A text's words are looked up
in a table of words met before; its contents (and every text the fast path does not
cover) come from the tokenizer itself.

Edge cases: a null or empty text has the closing id 0 only; a document longer than the
capacity is cut into full pieces and a rest; repeated rows are packed as documents of
their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscreen.llm.words import prefix_hash
from mailscreen.session import written

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"

# ---------------------------------------------------------------- tokens

# Code points up to here take the fast path; texts with others go to the tokenizer whole.
_FAST_END = 0x250
_SLOW = frozenset("İ")  # its lower case is two code points
_APOSTROPHE = ord("'")
# Fixed values of the vocabulary's word pattern: endings split off after an apostrophe.
_ENDINGS = ("re", "ve", "ll", "s", "t", "m", "d")
_REMEMBERED = 400_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """Per code point of the fast path: 0 white space, 1 letter, 2 digit (a word by itself), 3 other."""
    kinds = np.full(_FAST_END, 3, dtype=np.uint8)
    for code in range(_FAST_END):
        category = unicodedata.category(chr(code))[0]
        kinds[code] = 1 if category == "L" else 2 if category == "N" else 3
    kinds[[*range(9, 14), 32, 0x85, 0xA0]] = 0
    return kinds


class WordTokenizer:
    """Token ids of texts; words met before are not tokenised again.

    The word table is bounded: it starts anew when it has grown past `_REMEMBERED` words.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32."""
        lowered = [unicodedata.normalize("NFC", t).lower() for t in texts]
        fast = [i for i, t in enumerate(lowered) if self._covered(texts[i], t)]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i, ids in zip(fast, self._by_words([lowered[i] for i in fast])):
            out[i] = ids
        for i in set(range(len(texts))) - set(fast):
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out

    @staticmethod
    def _covered(text: str, lowered: str) -> bool:
        return "<|" not in text and (text.isascii() or (max(lowered) < chr(_FAST_END) and not _SLOW & set(text)))

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le"), dtype=np.uint32)
        if not len(codes):
            return [np.zeros(0, np.uint32)] * len(texts)
        starts, ends = word_spans(codes)
        hashes = prefix_hash(codes, starts, ends)
        distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(distinct, codes, starts[place], ends[place])
        entry = np.searchsorted(self.hashes, distinct)[inverse]
        count = self.count[entry]
        ends_at = np.cumsum(count)
        # Ids of all words in a row: a run from each word's first id.
        source = np.arange(ends_at[-1] if len(ends_at) else 0) + np.repeat(self.first[entry] - (ends_at - count), count)
        ids = self.ids[source]
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        words_before = np.searchsorted(starts, text_ends)
        totals = np.concatenate(([0], ends_at))[words_before]
        return np.split(ids, totals[:-1])

    def _learn(self, distinct: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.hashes) + len(distinct) > _REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return
        words = [codes[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[new], ends[new])]
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
        stops = np.flatnonzero(self.closes[ids]) + 1  # a word's last id closes it
        if len(stops) != len(words):
            raise ValueError("words and their tokens do not agree")
        first = np.concatenate(([0], stops[:-1]))
        self.first = np.insert(self.first, at[new], first + len(self.ids))
        self.count = np.insert(self.count, at[new], stops - first)
        self.hashes = np.insert(self.hashes, at[new], distinct[new])
        self.ids = np.concatenate((self.ids, ids))


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the vocabulary's words: runs of letters, single digits, runs of
    other marks, and the endings split off after an apostrophe that begins a word."""
    kind = _classes()[codes]
    start = kind != 0
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    marks = np.flatnonzero((codes == _APOSTROPHE) & start)
    for i in marks:
        tail = codes[i + 1 : i + 3]
        for ending in _ENDINGS:
            if len(tail) >= len(ending) and all(tail[k] == ord(c) for k, c in enumerate(ending)):
                start[i + 1 : i + 1 + len(ending)] = False
                after = i + 1 + len(ending)
                if after < len(codes) and kind[after] != 0:
                    start[after] = True
                break
    starts = np.flatnonzero(start)
    limits = np.append(starts[1:], len(codes))
    gaps = np.flatnonzero(kind == 0)
    if len(gaps):
        nearest = np.searchsorted(gaps, starts)
        limits = np.minimum(limits, np.append(gaps, len(codes))[nearest])
    return starts, limits


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenized_pieces(docs: DataFrame, capacity: int, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task, and its number among
    the task's pieces of that length (`nth`, from 0)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"
    names = [c.split()[0] for c in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        tokenizer = _tokenizer(path)
        for batch in batches:
            rows: list[tuple] = []
            for ids_of, texts in _slices(batch):
                for key, ids in zip(ids_of, tokenizer.encode(texts)):
                    closed = np.append(ids, np.uint32(0)).astype("<u4")
                    for n, start in enumerate(range(0, len(closed), capacity)):
                        piece = closed[start : start + capacity]
                        rows.append((key, n, start, len(piece), zlib.crc32(piece.tobytes()), task, int(seen[len(piece)])))
                        seen[len(piece)] += 1
            columns = list(zip(*rows)) if rows else [()] * len(names)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(cut, schema)


def _slices(batch: pa.RecordBatch, characters: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    """Rows of a batch in slices of bounded text."""
    ids, texts, size = [], [], 0
    for key, value in zip(batch.column(0), batch.column(1)):
        ids.append(key.as_py())
        texts.append(value.as_py())
        size += len(texts[-1])
        if size >= characters:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


# ---------------------------------------------------------------- the plan


class Knapsack:
    """Values of the best fillings of every room up to the capacity, at given prices.

    An unbounded knapsack by dynamic programming; pieces of a length may repeat.
    """

    def __init__(self, prices: np.ndarray, lengths: np.ndarray, capacity: int) -> None:
        self.lengths = lengths
        self.value = np.zeros(capacity + 1)
        self.choice = np.full(capacity + 1, -1)
        fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right")
        for room in range(1, capacity + 1):
            self.value[room] = self.value[room - 1]
            if fit := fitting[room]:
                sums = self.value[room - lengths[:fit]] + prices[:fit]
                k = int(sums.argmax())
                if sums[k] > self.value[room]:
                    self.value[room], self.choice[room] = sums[k], k

    def filling(self, room: int) -> Counter:
        """Indexes of the lengths in the best filling of a room."""
        found: Counter = Counter()
        while room > 0:
            if (k := int(self.choice[room])) < 0:
                room -= 1
            else:
                found[k] += 1
                room -= int(self.lengths[k])
        return found


def solve_configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, rate: float, slack: float, eta: float) -> tuple[dict[tuple, float], float]:
    """Configurations ((index of length, copies), ...) with how often each is used (fractional),
    and a lower bound on the sequences that any packing needs.

    Multiplicative weights on the covering constraints "held >= counts": a length's price is
    its weight per piece, and the weight falls by exp(-eta x share of the demand just covered),
    so lengths that lag behind grow dear.  One knapsack prices a whole round: for every length
    it gives the best configuration that contains it; all within `slack` of the best one are
    used, as far as the round covers no more than `rate` of any length's demand.  Prices at which
    no configuration is worth more than 1 are a dual solution: what all pieces are worth
    then is the bound.
    """
    held, weight = np.zeros(len(lengths)), np.zeros(len(lengths))  # weight: logarithms
    used: dict[tuple, float] = {}
    bound = float((counts * lengths).sum() / capacity)
    for _ in range(rounds):
        open_ = np.flatnonzero(held < counts)
        if not len(open_):
            break
        prices = np.exp(weight - weight.max()) / counts
        knapsack = Knapsack(prices, lengths, capacity)
        bound = max(bound, float((prices * counts).sum() / knapsack.value[capacity]))
        containing = prices[open_] + knapsack.value[capacity - lengths[open_]]
        gained = np.zeros(len(lengths))
        for k in open_[containing >= (1 - slack) * containing.max()]:
            config = knapsack.filling(capacity - int(lengths[k]))
            config[int(k)] += 1
            step = min((rate * counts[i] - gained[i]) / n for i, n in config.items())
            if step <= 0:
                continue
            key = tuple(sorted(config.items()))
            used[key] = used.get(key, 0.0) + step
            for i, n in config.items():
                gained[i] += step * n
        held += gained
        weight -= eta * gained / counts
    return used, bound


def plan_packing(
    histogram: dict[int, int],
    capacity: int = CAPACITY,
    rounds: int = 150,
    rate: float = 0.1,
    slack: float = 0.05,
    eta: float = 20.0,
    scales: tuple[float, ...] = (1.0, 0.9, 0.5, 0.0),
) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(Sequences as (lengths in order, how many such sequences), lower bound on their number).

    The fractional solution is rounded down at several scales, the rest packed best fit, and
    the smallest outcome taken.  Where lengths are rare all fractions round to nothing, and
    at scale 0 nothing is taken from the solution: then the packing is best fit alone.
    """
    pieces = {n: c for n, c in histogram.items() if c > 0}
    full = pieces.pop(capacity, 0)
    whole = [((capacity,), full)] if full else []
    if not pieces:
        return whole, full
    lengths = np.array(sorted(pieces))
    counts = np.array([pieces[n] for n in sorted(pieces)], dtype=float)
    solution, bound = solve_configurations(lengths, counts, capacity, rounds, rate, slack, eta)
    plans = [rounded(solution, scale, lengths, pieces, capacity) for scale in scales]
    best = min(plans, key=lambda p: sum(p.values()))
    return whole + sorted(best.items()), full + math.ceil(bound - 1e-6)


def rounded(solution: dict[tuple, float], scale: float, lengths: np.ndarray, pieces: dict[int, int], capacity: int) -> Counter:
    """Whole sequences from a fractional solution, and best fit for what is left."""
    left, plan = dict(pieces), Counter()

    def room(config: tuple) -> int:
        return capacity - sum(int(lengths[k]) * n for k, n in config)

    # Fullest first, and never more of a length than there is.
    for config in sorted(solution, key=lambda c: (room(c), c)):
        times = min([int(scale * solution[config]), *(left[int(lengths[k])] // n for k, n in config)])
        if times > 0:
            plan[tuple(int(lengths[k]) for k, n in reversed(config) for _ in range(n))] += times
            for k, n in config:
                left[int(lengths[k])] -= n * times
    plan.update(best_fit({n: c for n, c in left.items() if c}, capacity))
    return plan


def best_fit(left: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, over a histogram: a sequence takes the longest piece that still fits."""
    plan: Counter = Counter()
    left = dict(left)
    keys = sorted(left)
    while keys:
        room, config = capacity, []
        while (i := bisect_right(keys, room)) > 0:
            n = keys[i - 1]
            take = min(left[n], room // n)
            config += [n] * take
            room -= n * take
            left[n] -= take
            if not left[n]:
                keys.pop(i - 1)
            elif take == 0:
                break
            if not room:
                break
        times = 1 + (min(left.get(n, 0) // config.count(n) for n in set(config)) if config else 0)
        for n in set(config):
            left[n] -= (times - 1) * config.count(n)
            if not left[n] and n in keys:
                keys.remove(n)
        plan[tuple(config)] += times
    return plan


class Places:
    """For every length, the sequence and offset of its n-th piece under a plan."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        sequences = 0
        filled: Counter = Counter()
        for config, times in plan:
            offset = 0
            for n, copies in sorted(Counter(config).items(), reverse=True):
                runs.setdefault(n, []).append((filled[n], sequences, copies, offset))
                filled[n] += copies * times
                offset += copies * n
            sequences += times
        self.sequences = sequences
        self.runs = {n: np.array(r, dtype=np.int64).T for n, r in runs.items()}

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            first, base, copies, shift = self.runs[int(n)]
            k = np.searchsorted(first, number[own], "right") - 1
            within = number[own] - first[k]
            sequence[own] = base[k] + within // copies[k]
            offset[own] = shift[k] + within % copies[k] * n
        return sequence, offset


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    pieces = written(tokenized_pieces(docs, capacity, path, doc_id, text), "pieces")
    by_task = written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan_packing(histogram, capacity)[0]))
    before = by_task.selectExpr("task", "length", "coalesce(sum(n) OVER (PARTITION BY length ORDER BY task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before")
    numbered = pieces.join(before, ["task", "length"]).withColumn("number", F.col("before") + F.col("nth"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sequence, offset = places.value.of(pdf["length"].to_numpy(), pdf.pop("number").to_numpy())
            yield pdf.assign(sequence_id=sequence, offset=offset)

    rows = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return rows.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

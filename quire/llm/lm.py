"""Language-model scores by a weighted backoff automaton over smoothed bigrams (operator 7).

States are the last word; arcs are bigrams with their smoothed log-probability; a state's failure
arc leads to the unigram state at the cost of the state's backoff weight. One left-to-right pass
carries the state and adds up log10-probabilities.

Unigrams: absolute discounting with D = n1 / (n1 + 2 n2); what it frees goes to one class of unknown
words, so the V + 1 outcomes sum to 1. Bigrams: P(w | u) = L c(u, w) / c(u) + (1 - L) P1(w), where
1 - L is the Good-Turing share of once-seen bigrams among contexts of like count. All training text
is counted: nothing is cut off.

How it is spread: documents form blocks of about BLOCK tokens, written once in local word numbers.
Each block sends its distinct keys with its own counts to hash buckets, a bucket adds them up over
blocks, and sends back totals that differ from the block's own; so each block holds the slice of the
automaton that its documents can reach. No table of all n-grams is ever in one place. Word and
bigram keys are 64-bit hashes, whole: of n different keys, n * n / 2 ** 65 pairs are expected to share one.

Cases: a null or empty text is its end token alone; a null doc_id is in training; without training
rows all outcomes are one unknown class; repeated rows count and are scored each; an empty table
gives an empty one; a very long document is a block by itself; other columns are not carried."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, crc_mod, dropped, table, written

BLOCK = 600_000
#: Keys that a bucket of counts aims at.
BUCKET_KEYS = 1_000_000
BINS = 64
END, START = b"\x00end", b"\x00start"


def word_hash(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), "<u8", len(words))


def pair_hash(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = u * np.uint64(0x9E3779B97F4A7C15) + (w ^ (w >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(31))


def pack_ints(x: np.ndarray) -> bytes:
    """Integers from 0 as compressed byte planes."""
    import zstandard

    u = np.ascontiguousarray(x).astype("<u8").view("u1").reshape(-1, 8)
    n = max(1, int(np.flatnonzero(np.r_[True, u.any(axis=0)]).max()))
    return bytes([n]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(u[:, :n].T).tobytes())


def unpack_ints(raw: bytes, dtype: str = "<i8") -> np.ndarray:
    import zstandard

    n = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), "u1").reshape(n, -1)
    out = np.zeros((planes.shape[1], 8), "u1")
    out[:, :n] = planes.T
    return out.view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned integers by their differences."""
    return pack_ints(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(raw, "<u8"), dtype=np.uint64)


def blocks(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(block, docs array<string>, held array<boolean>, lengths array<int>, words int, vocab binary, ids binary).

    vocab: the hashes of the block's words, ascending; ids: positions in vocab, document after document, each with its end token."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        number: dict[bytes, int] = {}
        ids, lengths, names, held, n = [], [], [], [], 0

        def out() -> pd.DataFrame:
            h = word_hash(list(number))
            order = np.argsort(h)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            row = {"block": [first + made], "docs": [names], "held": [held], "lengths": [lengths], "words": [len(h)], "vocab": [pack_sorted(h[order])], "ids": [pack_ints(place[np.concatenate(ids)])]}
            return pd.DataFrame(row)

        for pdf in batches:
            for d, t, x in zip(pdf["d"].array, pdf["t"].array, pdf["held"].array, strict=True):
                words = (t if isinstance(t, str) else "").encode("utf-8", "replace").lower().split()
                words.append(END)
                ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                lengths.append(len(words))
                names.append(d if isinstance(d, str) else None)
                held.append(bool(x))
                n += len(words)
                if n >= block:
                    yield out()
                    made += 1
                    number, ids, lengths, names, held, n = {}, [], [], [], [], 0
        if lengths:
            yield out()

    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))
    return rows.mapInPandas(run, "block long, docs array<string>, held array<boolean>, lengths array<int>, words int, vocab binary, ids binary")


def _training(held: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return ~np.repeat(np.asarray(held, bool), lengths)


def _before(ids: np.ndarray, lengths: np.ndarray, start: int) -> np.ndarray:
    """The state before each token: the word before it, `start` at a document's first."""
    before = np.r_[start, ids[:-1]]
    before[np.cumsum(lengths) - lengths] = start
    return before


def _message(block: int, keys: np.ndarray, bits: int, *more: np.ndarray) -> list[tuple]:
    """Sorted keys of a block cut into buckets by their upper bits; the bucket implies these."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(keys) else np.zeros(1, int)
    rest = (keys << np.uint64(bits)) >> np.uint64(bits)
    return [(int(bucket[s]), block, pack_sorted(rest[s:e]), *(pack_ints(m[s:e]) for m in more)) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def unigram_messages(found: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lengths = np.asarray(r.lengths, np.int64)
                n = np.bincount(unpack_ints(r.ids)[_training(r.held, lengths)], minlength=r.words)
                yield pd.DataFrame(_message(r.block, unpack_sorted(r.vocab), bits, n), columns=["bucket", "block", "keys", "n"])

    return found.select("block", "held", "lengths", "words", "vocab", "ids").mapInPandas(run, "bucket long, block long, keys binary, n binary")


def _joined(pdf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own counts, number of each key's distinct value, where messages begin and end, totals by number)."""
    keys = [unpack_sorted(k) for k in pdf["keys"]]
    n = np.concatenate([unpack_ints(x) for x in pdf["n"]])
    cuts = np.r_[0, np.cumsum([len(k) for k in keys])]
    distinct, number = np.unique(np.concatenate(keys), return_inverse=True)
    return n, number, cuts, np.bincount(number, weights=n, minlength=len(distinct)).astype(np.int64)


def unigram_totals(messages: DataFrame) -> DataFrame:
    """(block, bucket, total array<long>) in the message's order; and with block -1 the bucket's (tokens, words, n1, n2)."""

    def run(pdf):
        import pandas as pd

        _, number, cuts, total = _joined(pdf)
        answer = total[number]
        rows = [(pdf["block"].iloc[k], pdf["bucket"].iloc[0], answer[s:e]) for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        rows.append((-1, pdf["bucket"].iloc[0], np.array([total.sum(), (total > 0).sum(), (total == 1).sum(), (total == 2).sum()])))
        return pd.DataFrame(rows, columns=["block", "bucket", "total"])

    return messages.groupBy("bucket").applyInPandas(run, "block long, bucket long, total array<long>")


def bin_of(c: np.ndarray) -> np.ndarray:
    """0 for a count of 0, else 1 + the whole part of its binary logarithm."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1).astype(float))[1], 0)


class Slice:
    """A block's distinct bigrams, ascending by key, and where each of its tokens is among them."""

    def __init__(self, r, train_docs: int):
        self.lengths = np.asarray(r.lengths, np.int64)
        ids, v = unpack_ints(r.ids), r.words
        before = _before(ids, self.lengths, v)
        self.word, self.state = ids, before
        self.train = _training(r.held, self.lengths)
        self.count = np.r_[np.asarray(r.counts, np.int64), train_docs]  # of words, and of the start state
        codes, inverse = np.unique(before * v + ids, return_inverse=True)
        u, w = codes // v, codes % v
        h = np.r_[unpack_sorted(r.vocab), word_hash([START])]
        key = pair_hash(h[u], h[w])
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.key, self.u, self.w, self.arc = key[order], u[order], w[order], place[inverse]
        self.n = np.bincount(self.arc[self.train], minlength=len(codes))


def bigram_messages(found: DataFrame, bits: int, train_docs: int) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                s = Slice(r, train_docs)
                yield pd.DataFrame(_message(r.block, s.key, bits, s.n, bin_of(s.count[s.u])), columns=["bucket", "block", "keys", "n", "bins"])

    return found.select("block", "held", "lengths", "words", "vocab", "ids", "counts").mapInPandas(run, "bucket long, block long, keys binary, n binary, bins binary")


def bigram_totals(messages: DataFrame) -> DataFrame:
    """(block, bucket, size, at, total): positions and totals that differ from the block's own counts.

    With block -1: the bucket's training bigrams and once-seen bigrams by bin of their context's count."""

    def run(pdf):
        import pandas as pd

        n, number, cuts, total = _joined(pdf)
        bins = np.concatenate([unpack_ints(b) for b in pdf["bins"]])
        once = (n == 1) & (total[number] == 1)
        rows = []
        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            own = total[number[s:e]]
            other = np.flatnonzero(own != n[s:e])
            rows.append((pdf["block"].iloc[k], pdf["bucket"].iloc[0], e - s, pack_sorted(other.astype(np.uint64)), pack_ints(own[other])))
        stat = np.r_[np.bincount(bins, weights=n, minlength=BINS)[:BINS], np.bincount(bins[once], minlength=BINS)[:BINS]]
        rows.append((-1, pdf["bucket"].iloc[0], 0, b"", pack_ints(stat.astype(np.int64))))
        return pd.DataFrame(rows, columns=["block", "bucket", "size", "at", "total"])

    return messages.groupBy("bucket").applyInPandas(run, "block long, bucket long, size int, at binary, total binary")


class Automaton:
    """Weighted backoff automaton. States 0 .. V - 1 are words, V is the start; arcs lie by (state, word).

    arc: log10-weight of each known arc, NaN where there is none; fail: log10-weight of each state's
    failure arc; word: log10-weights from the unigram state."""

    def __init__(self, arc: np.ndarray, fail: np.ndarray, word: np.ndarray):
        self.arc, self.fail, self.word = arc, fail, word

    def traverse(self, arcs: np.ndarray, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Each token's weight, where arcs[i] is the arc from states[i] (the carried state) by words[i]."""
        direct = self.arc[arcs]
        return np.where(np.isnan(direct), self.fail[states] + self.word[words], direct)


def smoothed(s: Slice, total: np.ndarray, n: int, v: int, n1: int, n2: int, weight: np.ndarray) -> Automaton:
    """The block's slice of the automaton; total: bigram counts; weight: L by bin."""
    d = n1 / (n1 + 2 * n2) if n1 else 0.5
    c = s.count[:-1]
    if n:
        p1 = np.where(c > 0, (c - d) / n, d * v / n)
    else:
        p1 = np.ones(len(c))
    share = np.where(s.count > 0, weight[bin_of(s.count)], 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        arc = np.where(total > 0, np.log10(share[s.u] * total / s.count[s.u] + (1 - share[s.u]) * p1[s.w]), np.nan)
    return Automaton(arc, np.log10(1 - share), np.log10(p1))


def score(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of docs.

    held_out: true for rows that aren't learned from. base_score: add-one unigrams."""
    found = bucketed(blocks(docs, held_out, doc_id=doc_id, text=text, block=block), "block")
    size = found.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("t"), F.coalesce(F.sum(F.size(F.filter("held", lambda h: ~h))), F.lit(0)).alias("d")).first()
    bits = max(4, int(np.ceil(np.log2(max(size.t / BUCKET_KEYS, 1)))))
    uni = written(unigram_totals(unigram_messages(found, bits)), "unigrams")
    u = uni.where("block = -1").agg(*[F.coalesce(F.sum(F.get("total", F.lit(i))), F.lit(0)).alias(k) for i, k in enumerate(("n", "v", "n1", "n2"))]).first()
    counts = uni.where("block >= 0").groupBy(F.col("block").alias("b")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "total"))), lambda x: x["total"])).alias("counts"))
    found2 = bucketed(found.join(counts, F.col("block") == F.col("b")).drop("b"), "block")
    dropped(found)
    dropped(uni)
    bi = written(bigram_totals(bigram_messages(found2, bits, size.d)), "bigrams")

    def bins(batches: Iterator) -> Iterator:
        import pandas as pd

        stat = np.zeros(2 * BINS, np.int64)
        for pdf in batches:
            for raw in pdf["total"]:
                stat += unpack_ints(raw)
        yield pd.DataFrame({"k": np.arange(2 * BINS), "x": stat})

    stat = np.zeros(2 * BINS)
    for r in bi.where("block = -1").select("total").mapInPandas(bins, "k int, x long").groupBy("k").agg(F.sum("x").alias("x")).collect():  # 128 rows
        stat[r.k] = r.x
    weight = np.clip(1 - stat[BINS:] / np.maximum(stat[:BINS], 1), 0, 0.999)
    answers = bi.where("block >= 0").groupBy(F.col("block").alias("b")).agg(F.sort_array(F.collect_list(F.struct("bucket", "size", "at", "total"))).alias("a"))
    pick = lambda name: F.transform("a", lambda x: x[name])
    ready = found2.join(answers, F.col("block") == F.col("b")).select("docs", "held", "lengths", "words", "vocab", "ids", "counts", pick("size").alias("sizes"), pick("at").alias("at"), pick("total").alias("total"))
    n, v, n1, n2, train_docs = u.n, u.v, u.n1, u.n2, size.d

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                s = Slice(r, train_docs)
                total = s.n.copy()
                before = 0
                for size, at, one in zip(r.sizes, r.at, r.total, strict=True):
                    total[unpack_sorted(at).astype(np.int64) + before] = unpack_ints(one)
                    before += size
                w = smoothed(s, total, n, v, n1, n2, weight).traverse(s.arc, s.state, s.word)
                c = s.count[s.word]
                starts = np.cumsum(s.lengths) - s.lengths
                add = lambda x: np.add.reduceat(x, starts)
                yield pd.DataFrame({"d": np.asarray(r.docs, object), "held_out": np.asarray(r.held, bool), "n_tokens": s.lengths, "n_known": add((c > 0).astype(np.int64)), "base_score": add(np.log10((c + 1) / (n + v + 1))), "score": add(w)})

    out = ready.mapInPandas(run, "d string, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("d").cast("long").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op7_backoff_automaton(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) == 2)

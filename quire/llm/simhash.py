"""SimHash near-dedup by the generalised pigeonhole principle (operator 1).

Texts get 64-bit SimHash fingerprints of word shingles. To find all fingerprints within TAU bits,
the 64 bits are dealt to m parts, correlated bits together. If thresholds t_i (-1: part unused) sum
to TAU - m + 1, any two fingerprints within TAU agree within t_i bits on some part i. Each fingerprint
chooses its own thresholds by dynamic programming over estimated candidate counts (histograms of
blocks of bits, convolved) plus the number of probes, then probes all part values within them;
every fingerprint is indexed by its own part values. All that meet in a bucket are verified.

Distinct fingerprints only are compared, so exact copies meet once. Bucket members are linked by a
spanning forest, never by all pairs, and a large bucket is split into chunks, each pair of chunks a
task's group of its own. m follows the number of distinct fingerprints; every m is exact.

deduplicate(similar=...) links texts by their sets of shingles: each set has WIDE fingerprints, and two sets are
candidates if one of these differs in at most RADIUS bits (found by the same parts, thresholds and probes) and all
together in at most TOTAL; candidates whose sets have that Jaccard similarity link. A pair of similarity 0.8 is about
10 bits apart in 64, so one fingerprint would miss a third of such pairs at worst; four miss about one in a hundred. Sets are
compared in blocks by size, as similar sets are of like sizes: a set goes to blocks in proportion to its size class / BLOCK,
the limit of this path; within a block work follows the probes. Candidates leave as spanning forests, and within their
components exact similarities are taken until a member is reached.

Cases: a null or wordless text has fingerprint zero and is linked like any other; a very long text is hashed in slices, whole; fewer words than a
shingle form one; null doc_ids keep their row (a component of only such has a null id); repeated rows
share a component; an empty table gives an empty one; other columns are kept by deduplicate()."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, as_objects, components, dropped, forget, fresh, merge, table, written

TAU, BITS, SHINGLE, SEED = 3, 64, 3, 42
#: Rows of a bucket beyond which it is split into chunks.
CHUNK = 4096
#: Up to so many split buckets their sizes are broadcast; beyond, joined by a shuffle.
BROADCAST_BUCKETS = 50_000
#: Fingerprints of a set, bits that one of them may differ in, and all of them together.
WIDE, RADIUS, TOTAL = 4, 10, 64
#: Sets of a block, and members of a candidate component beyond which it is split into chunks.
BLOCK, SET_CHUNK = 1 << 16, 512


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint; bit b is set if it is in over half the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    count = np.zeros(BITS, np.int64)
    for at in range(0, n, 50_000):  # a very long text in slices
        part = words[at : at + 50_000 + shingle - 1]
        size = max(1, len(part) - shingle + 1)
        if len(words) < shingle:
            h = np.array([xxh64_intdigest(b" ".join(part), seed)], "<u8")
        else:
            h = np.fromiter((xxh64_intdigest(b" ".join(s), seed) for s in zip(*(part[k:] for k in range(shingle)))), "<u8", size)
        count += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp), one row for each row of docs."""

    def run(batches: Iterator) -> Iterator:
        forget()
        for pdf in batches:
            pdf["fp"] = [fingerprint(t if isinstance(t, str) else None, shingle) for t in pdf["t"].array]
            yield as_objects(pdf[["d", "text_hash", "fp"]])

    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    return rows.mapInPandas(run, "d string, text_hash long, fp long").select(F.col("d").cast("long").alias("doc_id"), "text_hash", "fp")


def bit_matrix(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little")


def together(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits; each partition sends one matrix."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        m = np.zeros((BITS, BITS))
        for pdf in batches:
            b = bit_matrix(pdf["fp"].to_numpy()).astype(np.float32)
            m += b.T @ b
        yield pd.DataFrame({"ij": np.arange(BITS * BITS), "n": m.ravel().astype(np.int64)})

    rows = fps.select("fp").mapInPandas(run, "ij int, n long").groupBy("ij").agg(F.sum("n").alias("n")).collect()  # 4096 rows
    m = np.zeros(BITS * BITS)
    for r in rows:
        m[r.ij] = r.n
    return m.reshape(BITS, BITS)


def parts_of(m_together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, as even in size as they can be; each grows by the bit most correlated with it."""
    p = np.diag(m_together) / max(n, 1)
    cov = m_together / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(group) < size:
            group.append(max(sorted(free - set(group)), key=lambda b: corr[b, group].sum()))
        free -= set(group)
        out.append(sorted(group))
    return out


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    u, v = fp.astype(np.int64), np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        v |= ((u >> b) & 1) << k
    return v


def blocks_of(parts: list[list[int]]) -> list[list[list[int]]]:
    """Each part in blocks of at most 8 bits, which histograms cover."""
    return [[p[i : i + 8] for i in range(0, len(p), 8)] for p in parts]


def histograms(fps: DataFrame, parts: list[list[int]], tau: int) -> list[list[np.ndarray]]:
    """For each block: [value, d] the share of fingerprints whose block differs from value in d bits, d to tau."""
    flat = [b for p in blocks_of(parts) for b in p]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        h = np.zeros((len(flat), 256), np.int64)
        for pdf in batches:
            for k, bits in enumerate(flat):
                h[k] += np.bincount(part_values(pdf["fp"].to_numpy(), bits), minlength=256)
        yield pd.DataFrame({"kv": np.arange(h.size), "n": h.ravel()})

    h = np.zeros(len(flat) * 256)
    for r in fps.select("fp").mapInPandas(run, "kv int, n long").groupBy("kv").agg(F.sum("n").alias("n")).collect():  # 256 rows for each block
        h[r.kv] = r.n
    v = np.arange(256)
    apart = np.bitwise_count(v[:, None] ^ v[None, :])
    near = [(apart == d).astype(float) for d in range(tau + 1)]
    out, at = [], 0
    for p in blocks_of(parts):
        row = []
        for _ in p:
            own = h[at * 256 : at * 256 + 256]
            row.append(np.stack([m @ own for m in near], axis=1) / max(own.sum(), 1))
            at += 1
        out.append(row)
    return out


def ball(width: int, t: int) -> int:
    from math import comb

    return sum(comb(width, k) for k in range(t + 1))


def masks(width: int, t: int) -> np.ndarray:
    """All values of `width` bits with exactly t bits set."""
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for c in combinations(range(width), t)], np.int64)


def thresholds(fp: np.ndarray, parts: list[list[int]], hist: list[list[np.ndarray]], n: int, tau: int) -> np.ndarray:
    """[row, part] thresholds of least estimated cost among those that sum to tau - m + 1.

    Dynamic programming over tau + 1 units, of which part i gets t_i + 1."""
    units = tau + 1
    best = np.full((len(fp), units + 1), np.inf)
    best[:, 0] = 0
    choices = []
    for bits, row in zip(blocks_of(parts), hist, strict=True):
        width = sum(map(len, bits))
        dist = np.zeros((len(fp), units))
        dist[:, 0] = 1
        for own, h in zip(bits, row, strict=True):
            p = h[part_values(fp, own)]
            dist = np.stack([sum(dist[:, a] * p[:, d - a] for a in range(d + 1)) for d in range(units)], axis=1)
        within = np.cumsum(dist, axis=1) * n
        cost = np.concatenate([np.zeros((len(fp), 1)), within + np.array([ball(width, t) for t in range(units)])], axis=1)
        nxt, choice = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
        for s in range(units + 1):
            for u in range(s + 1):
                c = best[:, s - u] + cost[:, u]
                less = c < nxt[:, s]
                nxt[less, s], choice[less, s] = c[less], u
        best = nxt
        choices.append(choice)
    out, left = np.zeros((len(fp), len(parts)), np.int8), np.full(len(fp), units)
    for i in range(len(parts) - 1, -1, -1):
        u = choices[i][np.arange(len(fp)), left]
        out[:, i] = u - 1
        left = left - u
    return out


def parts_for(n: int, tau: int = TAU, fewest: int | None = None) -> int:
    """The number of parts of least cost (probes and candidates) for n evenly spread fingerprints."""

    def cost(m: int) -> float:
        spare, width = tau - m + 1, BITS // m
        t = [spare // m + (i < spare % m) for i in range(m)]
        return sum(ball(width, x) * (1 + n / 2.0**width) for x in t)

    return min(range(fewest or max(1, (tau + 1) // 2), tau + 2), key=cost)


def entries(fps: DataFrame, parts: list[list[int]], hist: list[list[np.ndarray]], n: int, tau: int = TAU) -> DataFrame:
    """(bucket, fp): where each fingerprint is indexed and where it probes."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                fp = pdf["fp"].to_numpy()[at : at + 4096]
                t = thresholds(fp, parts, hist, n, tau)
                for i, bits in enumerate(parts):
                    v, top = part_values(fp, bits), np.int64(i) << 58
                    yield pd.DataFrame({"bucket": v | top, "fp": fp})
                    for d in range(1, tau + 1):
                        own = t[:, i] >= d
                        if own.any():
                            m = masks(len(bits), d)
                            for k in range(0, int(own.sum()), max(1, 200_000 // len(m))):
                                part = np.flatnonzero(own)[k : k + max(1, 200_000 // len(m))]
                                yield pd.DataFrame({"bucket": (v[part][:, None] ^ m[None, :]).ravel() | top, "fp": np.repeat(fp[part], len(m))})

    return fps.select("fp").mapInPandas(run, "bucket long, fp long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; a view without a sign, as numpy counts the bits of a negative number's size."""
    return np.bitwise_count((a ^ b).view("u8"))


def forest(f: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among fingerprints f: each is compared until it is reached."""
    a, b = [], []
    rest = np.unique(f)
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root])
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for k in range(0, len(front), 256):
                still = np.flatnonzero(~hit)
                hit[still] = (differing(front[k : k + 256, None], rest[None, still]) <= tau).any(axis=0)
            front, rest = rest[hit], rest[~hit]
            a.append(np.full(len(front), root))
            b.append(front)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_of_groups(groups: np.ndarray, fp: np.ndarray, tau: int, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (for larger groups: a spanning forest of them) within runs of equal group."""
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, len(groups)])
    a, b = [], []
    end = np.repeat(starts + sizes, sizes)
    n_after = np.where(np.repeat(sizes, sizes) <= small, end - np.arange(len(fp)) - 1, 0)
    i = np.repeat(np.arange(len(fp)), n_after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n_after) - n_after, n_after)
    near = (differing(fp[i], fp[j]) <= tau) & (fp[i] != fp[j])
    a.append(fp[i[near]])
    b.append(fp[j[near]])
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        x, y = forest(fp[s : s + n], tau)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def bucket_links(found: DataFrame, tau: int = TAU, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links of (bucket, fp) entries that meet in a bucket, enough of them for the components."""
    sizes = written(found.groupBy("bucket").count().where(F.col("count") > chunk).select(F.col("bucket").alias("big"), F.ceil(F.col("count") / chunk).alias("k")), "big-buckets")
    n_big = sizes.count()
    if n_big:
        keyed = found.join(F.broadcast(sizes) if n_big <= BROADCAST_BUCKETS else sizes, found.bucket == sizes.big, "left")
        own = F.pmod(F.xxhash64("fp"), F.col("k"))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.least(own, j) * F.lit(1 << 31) + F.greatest(own, j))
        keyed = keyed.select("bucket", F.explode(F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("pair"), "fp")
    else:
        keyed = found.withColumn("pair", F.lit(0).cast("long"))

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        g, f = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
        for pdf in _with_end(batches):
            if pdf is not None:
                g = np.concatenate([g, pdf[["bucket", "pair"]].to_numpy(np.int64)])
                f = np.concatenate([f, pdf["fp"].to_numpy(np.int64)])
            if not len(f):
                continue
            change = np.flatnonzero((g[1:] != g[:-1]).any(axis=1)) + 1
            ready = len(f) if pdf is None else (change[-1] if len(change) else 0)
            if ready:
                number = np.r_[0, np.cumsum((g[1:ready] != g[: ready - 1]).any(axis=1))]
                x, y = links_of_groups(number, f[:ready], tau)
                yield pd.DataFrame({"a": x, "b": y})
                g, f = g[ready:], f[ready:]

    dealt = keyed.repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    return dealt.select("bucket", "pair", "fp").mapInPandas(run, "a long, b long")


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_components(fps: DataFrame, *, tau: int = TAU, chunk: int = CHUNK) -> DataFrame:
    """(node, root) of all fingerprints that link to another; fps: distinct fingerprints (fp), read several times."""
    n = fps.count()
    parts = parts_of(together(fps), n, parts_for(n, tau))
    found = written(entries(fps, parts, histograms(fps, parts, tau), n, tau), "entries")
    out = components(bucket_links(found, tau, chunk))
    dropped(found)
    return out


def word_hashes() -> Memo:
    from xxhash import xxh64_intdigest

    return Memo(lambda w: xxh64_intdigest(w, SEED), 100_000)


def hashed_shingles(text: str | None, shingle: int, memo: Memo) -> np.ndarray:
    """The text's set of shingles as sorted 64-bit hashes; fewer words than a shingle form one. memo: hashes of words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w, size = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), min(shingle, len(words))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - size + 1 + k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((h ^ (h >> np.uint64(32))).view(np.int64))


def set_number(x: np.ndarray) -> int:
    """A hash of the set; zero if it is empty."""
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(x.tobytes(), SEED)], np.uint64).view(np.int64)[0]) if len(x) else 0


def set_fingerprints(x: np.ndarray) -> np.ndarray:
    """WIDE signed 64-bit fingerprints of a set of shingles, each of its own hashes."""
    count = np.zeros((WIDE, BITS), np.int64)
    for at in range(0, len(x), 50_000):  # a very long text in slices
        h = x[at : at + 50_000].view(np.uint64)
        for k in range(WIDE):
            g = (h + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x5851F42D * k)
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            count[k] += np.unpackbits((g ^ (g >> np.uint64(32))).view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits(count * 2 > len(x), axis=1, bitorder="little").view("<i8").ravel()


def set_rows(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp, size, wide), one row for each row of docs.

    fp is the number of its set of shingles, size that set's size, wide its fingerprints."""

    def run(batches: Iterator) -> Iterator:
        forget()
        memo = word_hashes()
        for pdf in batches:
            sets = [hashed_shingles(t if isinstance(t, str) else None, shingle, memo) for t in pdf["t"].array]
            pdf["fp"], pdf["size"], pdf["wide"] = [set_number(x) for x in sets], [len(x) for x in sets], [set_fingerprints(x) for x in sets]
            yield as_objects(pdf[["d", "text_hash", "fp", "size", "wide"]])

    rows = docs.select(F.col(doc_id).cast("string").alias("d"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("t"))
    found = rows.mapInPandas(run, "d string, text_hash long, fp long, size long, wide array<long>")
    return found.select(F.col("d").cast("long").alias("doc_id"), "text_hash", "fp", "size", "wide")


def size_class(size, similar: float):
    """Sets of that similarity are of one class or of two next to each other."""
    return F.floor(F.log(size) / F.lit(float(np.log(1 / similar) + 1e-9))).cast("int")


def blocks_by_size(sets: DataFrame, similar: float, chunk: int) -> DataFrame:
    """sets with (c, d, i, j): a row's blocks. Chunk i of size class c meets chunk j of class c + d, d 0 or 1."""
    classed = sets.withColumn("c", size_class("size", similar))
    n = classed.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("k"))  # classes grow with the logarithm of a text's length
    below, above = n.select((F.col("c") + 1).alias("c"), F.col("k").alias("k0")), n.select((F.col("c") - 1).alias("c"), F.col("k").alias("k2"))
    sizes = n.join(below, "c", "left").join(above, "c", "left")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")

    def upto(k: str):
        return F.when(F.coalesce(F.col(k), F.lit(0)) > 0, F.sequence(F.lit(0), F.col(k) - 1)).otherwise(F.array().cast("array<int>"))

    def block(c, d: int, i, j):
        return F.struct(c.alias("c"), F.lit(d).alias("d"), i.alias("i"), j.alias("j"))

    c = F.col("c")
    places = F.concat(
        F.transform(upto("k"), lambda x: block(c, 0, F.least(own, x), F.greatest(own, x))),
        F.transform(upto("k2"), lambda x: block(c, 1, own, x)),
        F.transform(upto("k0"), lambda x: block(c - 1, 1, x, own)),
    )
    dealt = classed.join(F.broadcast(sizes), "c").select("fp", "size", "wide", "c", F.explode(places).alias("at"))
    return dealt.select("at.c", "at.d", "at.i", "at.j", "fp", "size", "wide", (F.col("c") != F.col("at.c")).alias("upper"))


def expanded(lo: np.ndarray, n: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(owner, position) of the runs lo[x] .. lo[x] + n[x] - 1, in slices of about `most`."""
    upto = np.cumsum(n)
    at = 0
    while at < len(n):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        own = np.repeat(np.arange(at, end), n[at:end])
        yield own, np.arange(len(own)) - np.repeat(np.cumsum(n[at:end]) - n[at:end], n[at:end]) + lo[own]
        at = end


def wide_links(wide: np.ndarray, size: np.ndarray, upper: np.ndarray, plans: list, *, n: int, tau: int, total: int, similar: float) -> np.ndarray:
    """Label of each row of a block (its component's least row): links of rows, or between the two sides of upper.

    Rows link if one of their fingerprints differs in at most tau bits, all together in at most total, and their
    sizes allow the similarity. plans: (parts, histograms) of each fingerprint."""
    label, both = np.arange(len(size)), bool(upper.any())
    ask = np.flatnonzero(~upper) if both else label
    have = np.flatnonzero(upper) if both else label
    if len(ask) > len(have):
        ask, have = have, ask
    for k, (parts, hist) in enumerate(plans):
        t = thresholds(wide[ask, k], parts, hist, n, tau)
        for p, bits in enumerate(parts):
            q, x = part_values(wide[ask, k], bits), part_values(wide[have, k], bits)
            order = np.argsort(x, kind="stable")
            starts = np.searchsorted(x[order], np.arange((1 << len(bits)) + 1))
            for d in range(min(int(t[:, p].max()), len(bits)) + 1):
                rows, m = np.flatnonzero(t[:, p] >= d), masks(len(bits), d)
                step = max(1, 2_000_000 // len(m))
                for s in range(0, len(rows), step):
                    probe = (q[rows[s : s + step], None] ^ m[None, :]).ravel()
                    met = starts[probe + 1] - starts[probe]
                    hit = np.flatnonzero(met)
                    for own, at in expanded(starts[probe[hit]], met[hit]):
                        a, b = ask[rows[s + hit[own] // len(m)]], have[order[at]]
                        new = label[a] != label[b]
                        a, b = a[new], b[new]
                        near = differing(wide[a, k], wide[b, k]) <= tau
                        a, b = a[near], b[near]
                        apart = sum(differing(wide[a, z], wide[b, z]).astype(int) for z in range(wide.shape[1]))
                        fits = (apart <= total) & (np.minimum(size[a], size[b]) >= similar * np.maximum(size[a], size[b]) - 1e-9)
                        if fits.any():
                            label = merge(label, a[fits], b[fits])
    return label


def wide_candidates(sets: DataFrame, *, similar: float, tau: int, total: int, chunk: int) -> DataFrame:
    """(node, root): components of the links by fingerprints; sets: (fp, size, wide) of distinct sets."""
    sets = sets.where("size > 0")
    n = sets.count()
    plans = []
    for k in range(WIDE):
        one = sets.select(F.get("wide", F.lit(k)).alias("fp"))
        parts = parts_of(together(one), n, parts_for(min(n, 2 * chunk), tau, fewest=2))
        plans.append((parts, histograms(one, parts, tau)))

    def run(pdf):
        import pandas as pd

        fp, label = pdf["fp"].to_numpy(), wide_links(np.stack(pdf["wide"]), pdf["size"].to_numpy(), pdf["upper"].to_numpy(), plans, n=min(n, 2 * chunk), tau=tau, total=total, similar=similar)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": fp[label[other]], "b": fp[other]})

    return components(blocks_by_size(sets, similar, chunk).groupBy("c", "d", "i", "j").applyInPandas(run, "a long, b long"))


def forest_by(near, size: np.ndarray, similar: float) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among sets of these sizes: each is compared until it is reached.

    near(i, others) says which of others link to i."""
    a, b = [], []
    rest = np.arange(len(size))
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            i = front.pop()
            able = rest[(size[rest] >= similar * size[i] - 1e-9) & (size[i] >= similar * size[rest] - 1e-9)]
            hit = able[near(i, able)] if len(able) else able
            if len(hit):
                a += [i] * len(hit)
                b += hit.tolist()
                front += hit.tolist()
                rest = np.setdiff1d(rest, hit, assume_unique=True)
    return a, b


def set_forest(sets: list[np.ndarray], similar: float) -> tuple[list[int], list[int]]:
    """Of exact links."""
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    has = np.zeros(local.max() + 1, bool)

    def near(i, able):
        own = local[ends[i] - size[i] : ends[i]]
        has[own] = True
        both = np.array([np.count_nonzero(has[local[ends[j] - size[j] : ends[j]]]) for j in able])
        has[own] = False
        return both >= similar * (size[i] + size[able] - both) - 1e-9

    return forest_by(near, size, similar)


def linked_within(docs: DataFrame, sets: DataFrame, maybe: DataFrame, *, similar: float, shingle: int, text: str, chunk: int) -> DataFrame:
    """(node, root): components of the links by exact similarity within those of maybe; sets: (fp, h, size), h the hash of a text that has it."""
    member = maybe.join(sets.select("fp", "h", "size"), F.col("node") == F.col("fp"))
    sizes = maybe.join(sets.select("fp", "size"), F.col("node") == F.col("fp")).groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / chunk, F.sum("size") / (1000.0 * chunk))).alias("k"))
    member = member.join(sizes, "root").select("h", "node", "root", "k")
    texts = docs.select(F.xxhash64(text).alias("th"), F.col(text).alias("t")).join(member, F.col("th") == F.col("h")).select("t", "node", "root", "k")

    def whole(batches: Iterator) -> Iterator:
        import pandas as pd

        memo = word_hashes()
        seen: set[int] = set()  # exact copies come to one task
        for pdf in batches:
            out = []
            for t, node, root, k in zip(pdf["t"].array, pdf["node"], pdf["root"], pdf["k"], strict=True):
                if node not in seen:
                    seen.add(node)
                    out.append((node, root, k, hashed_shingles(t, shingle, memo).tobytes()))
            yield pd.DataFrame(out, columns=["node", "root", "k", "x"]).astype({"node": "int64", "root": "int64", "k": "int64"})

    def linked(batches: Iterator) -> Iterator:
        import pandas as pd

        group: dict[int, np.ndarray] = {}
        last = None

        def edges():
            nodes = list(group)
            a, b = set_forest(list(group.values()), similar)
            return pd.DataFrame({"a": np.array([nodes[i] for i in a], np.int64), "b": np.array([nodes[i] for i in b], np.int64)})

        for pdf in batches:
            out = []
            for root, i, j, node, x in zip(pdf["root"], pdf["i"], pdf["j"], pdf["node"], pdf["x"], strict=True):
                if (root, i, j) != last:
                    if len(group) > 1:
                        out.append(edges())
                    group, last = {}, (root, i, j)
                group[node] = np.frombuffer(x, np.int64)
            if out:
                yield pd.concat(out)
        if len(group) > 1:
            yield edges()

    own = F.pmod(F.xxhash64("node"), F.col("k"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = texts.mapInPandas(whole, "node long, root long, k long, x binary").select("root", F.explode(pairs).alias("pair"), "node", "x").select("root", "pair.i", "pair.j", "node", "x")
    return components(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInPandas(linked, "a long, b long"))


def similar_components(docs: DataFrame, sets: DataFrame, *, similar: float, shingle: int, text: str = "text", radius: int = RADIUS, total: int = TOTAL, block: int = BLOCK, chunk: int = SET_CHUNK) -> DataFrame:
    """(node, root) of all sets that link to another; sets: (fp, h, size, wide) of the distinct sets of docs."""
    maybe = written(wide_candidates(sets, similar=similar, tau=radius, total=total, chunk=block), "candidates")
    return linked_within(docs, sets, maybe, similar=similar, shingle=shingle, text=text, chunk=chunk)


def dedup_groups(docs: DataFrame, *, tau: int = TAU, chunk: int = CHUNK, similar: float | None = None, **columns) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): root is the component's fingerprint, component_id its smallest doc_id.

    With similar, links are by fingerprints of shingle sets and that Jaccard similarity of these, and fp is the number of a set."""
    rows = written(set_rows(docs, **columns) if similar else fingerprints(docs, **columns), "fingerprints")
    of_set = [F.min("text_hash").alias("h"), F.any_value("size").alias("size"), F.any_value("wide").alias("wide")] if similar else []
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), *of_set), "distinct-fp")
    if similar:
        comp = similar_components(docs, fps, similar=similar, shingle=columns.get("shingle", SHINGLE), text=columns.get("text", "text"))
    else:
        comp = near_components(fps, tau=tau, chunk=chunk)
    rooted = fps.join(comp, fps.fp == comp.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "root", "component_id"), "named")
    dropped(fps)
    return rows.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, of which one of each component stays: that of the smallest doc_id (nulls last).

    Of several rows with that doc_id, one text stays; of rows that repeat it exactly, any one."""
    c_hash, k_id, k_hash, k_n = fresh(docs, "text_hash", "keep_id", "keep_hash", "keep_n")
    groups = dedup_groups(docs, doc_id=doc_id, text=text, **options)
    per = groups.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    first = per.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("m"))
    keep = written(first.select(F.col("m.doc_id").alias(k_id), F.col("m.text_hash").alias(k_hash), F.col("m.n").alias(k_n)), "kept")
    hashed = docs.withColumn(c_hash, F.xxhash64(text))
    met = hashed.join(keep, (hashed[c_hash] == keep[k_hash]) & hashed[doc_id].eqNullSafe(keep[k_id]))
    once = met.where(F.col(k_n) == 1).select(*docs.columns)
    again = met.where(F.col(k_n) > 1).dropDuplicates([doc_id, c_hash]).select(*docs.columns)
    return once.unionByName(again)


def op1_simhash_components(spark, sf_dir):
    g = dedup_groups(table(spark, sf_dir, "documents"))
    return g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

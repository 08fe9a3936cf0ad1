"""The pipeline's stages against plain Python on small tables, awkward rows among them."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from quire.llm import mixing, pii, simhash, toxicity
from quire.llm.tokens import tokenizer_path

from .test_text_ops import BASE, SCHEMA, brute_simhash

ROWS = (
    [(i, BASE + f"number {i} " * 3, "en", "a", 10) for i in range(12)]
    + [(20 + i, f"Different words {i} of another kind, with {i} jo.smith{i}@mail.example.com and +1 (386) 555-37{i:02d}", "en", "b", 10) for i in range(12)]
    + [(40 + i, BASE + "you idiot, you moron and scum " + f"{i} " * 5, "en", "a", 10) for i in range(8)]
    + [(60, None, None, None, None), (61, "", "en", "b", 0), (62, "x", "de", "c", 1), (None, "no id", "en", "c", 5), (63, BASE * 400, "en", "a", 9)]
    + [(64, "twice the same row here", "en", "c", 23)] * 2
)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(12)] + [(40 + i, 0, 1) for i in range(8)] + [(None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def rows_of(df):
    return Counter(tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in df.collect())


def test_each_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "simhash", "pii", "mixing", "packing"]

    clean = stage["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert rows_of(clean) == Counter(r for r in ROWS if not any(w in (r[1] or "") for w in toxicity.INSULTS))

    one = stage["simhash"](spark, clean, sf_dir)
    have = list(rows_of(clean).elements())
    _, comp = brute_simhash(have)
    groups = defaultdict(list)
    for r, c in zip(have, comp, strict=True):
        groups[c].append(r)
    left = rows_of(one)
    assert sum(left.values()) == len(groups)
    for g in groups.values():
        first = min((r[0] for r in g if r[0] is not None), default=None)
        assert sum(left[r] for r in set(g)) == 1 and all(r[0] == first for r in set(g) if left[r])

    safe = stage["pii"](spark, one, sf_dir)
    want = Counter()
    for r, n in left.items():
        text = pii.rewritten(r[1], pii.KEY, {})[0]
        want[(r[0], text, r[2], r[3], None if r[4] is None else len(text))] += n
    assert rows_of(safe) == want

    mixed = stage["mixing"](spark, safe, sf_dir)
    size = Counter()
    for r, n in want.items():
        size[r[3]] += n * len(r[1] or "")
    share = {s: round(v**mixing.TEMPERATURE, 6) if v else 0 for s, v in size.items()}
    copies = Counter()
    for r, n in want.items():
        rate = round(share[r[3]] / sum(share.values()) * sum(size.values()) / size[r[3]], 9) if size[r[3]] else 0
        u = int(hashlib.md5(f"{mixing.SEED}|{'' if r[0] is None else r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = 0, math.exp(-rate)
        term = c
        while c <= u and k < 400:
            k += 1
            term *= rate / k
            c += term
        copies[r] += n * k
    assert rows_of(mixed) == +copies

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = stage["packing"](spark, mixed, sf_dir).collect()
    n = sum(k * (len(tok.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r, k in copies.items())
    covered = np.zeros(n, int)
    for p in pieces:
        at = p.sequence_id * 4096 + p.offset
        covered[at : at + p.length] += 1
    assert (covered == 1).all()


def test_run(spark, sf_dir, tmp_path):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("chunk", [512, 3])
def test_near_copies_by_five_words(spark, sf_dir, monkeypatch, chunk):
    monkeypatch.setitem(simhash.similar_components.__kwdefaults__, "chunk", chunk)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        words = list(rng.choice(vocabulary, int(rng.integers(60, 200))))
        for k in range(6):  # copies with some words changed
            copy = list(words)
            for at in rng.choice(len(copy), k, replace=False):
                copy[at] = f"other{rng.integers(1000)}"
            texts.append(" ".join(copy))
    texts += ["", None, " ", "a b", "A  b", "a b c d e f", texts[0].upper()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    memo = simhash.word_hashes()
    prints = [simhash.set_fingerprints(simhash.hashed_shingles(t, 5, memo)).tolist() for t in texts]

    def met(i, j):
        apart = [((x ^ y) % 2**64).bit_count() for x, y in zip(prints[i], prints[j], strict=True)]
        return sets[i] == sets[j] or (min(apart) <= simhash.RADIUS and sum(apart) <= simhash.TOTAL)

    want, linked, all_ = list(range(len(texts))), 0, 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            all_ += near(a, b)
            if near(a, b) and met(i, j):
                linked += 1
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert linked >= 0.98 * all_  # few pairs of that similarity are farther apart
    far = [(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and a != b and near(a, b) and (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3]
    assert len(far) > 20  # which the query's three bits miss
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    kept = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))

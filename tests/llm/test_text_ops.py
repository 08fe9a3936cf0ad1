"""Operators on texts against plain Python over a small table with awkward rows."""

import math
import os
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import lm, mixing, packing, simhash, token_files, toxicity
from quire.llm.common import components, crc_mod, scratch
from quire.llm.tokens import WordEncoder, tokenizer_path

BASE = "the quick brown fox jumps over the lazy dog and then it sleeps in the warm sun all day long "
ROWS = (
    [(i, BASE + w, "en", "a", 1) for i, w in enumerate(["", "today", "today now", "x y z w"])]
    + [(10, None, None, None, None), (11, "", "en", "b", 0), (12, " \n\t ", "en", "b", 3), (13, "one", "en", "b", 3), (14, "One two", "en", "b", 7)]
    + [(None, "no id here at all", "en", "c", 5), (15, BASE * 3000, "en", "a", 9), (16, "ÀÉ İ ß 日本 don't I'LL <|endoftext|>x \x1c y", "xx", "c", 9)]
    + [(17, "Ein Satz mit Wörtern", "de", "a", 4)] * 2
    + [(20 + i, BASE + "you are an idiot and scum " * (i % 2) + f"tail {i}", "en", "a", 4) for i in range(30)]
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """With columns named like the operators' own."""
    for c in ("fp", "text_hash", "score", "rate", "copy_no", "mix_key", "n", "root", "ids", "part", "k", "block", "d", "t"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def test_word_encoder_equals_whole_texts():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path(), words=8, stems=8)
    assert enc.by_words
    for _, text, *_ in ROWS:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids
    other = WordEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert not other.by_words  # white space counts there: whole texts
    for text in ("Two  words, and\n more.", "", "Ünïcode déjà vu"):
        assert np.frombuffer(other.encode(text), "<u4").tolist() == other.tok.encode(text, add_special_tokens=False).ids


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3), (300, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[200] == got[300] != got[0] and len(got) == 44
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_simhash(rows):
    from xxhash import xxh64_intdigest

    out = []
    for d, text, *_ in rows:
        w = (text or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxh64_intdigest(s, 42) for s in sh]
        fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
        out.append((d, fp))
    comp = list(range(len(out)))
    for i, (_, a) in enumerate(out):
        for j, (_, b) in enumerate(out[:i]):
            if (a ^ b).bit_count() <= 3 and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    ids = {}
    for (d, _), c in zip(out, comp, strict=True):
        ids[c] = min([x for x in (ids.get(c), d) if x is not None], default=None)
    return [(d, f"{fp:016x}", ids[c]) for (d, fp), c in zip(out, comp, strict=True)], comp


def test_simhash_components_and_deduplicate(docs, empty):
    for chunk in (4096, 2):
        g = simhash.dedup_groups(docs, chunk=chunk)
        got = g.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
        want, comp = brute_simhash(ROWS)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    wide = clashing(docs)
    kept = simhash.deduplicate(wide)
    assert kept.columns == wide.columns and kept.count() == len(set(comp))
    assert simhash.dedup_groups(empty).count() == 0 and simhash.deduplicate(empty).count() == 0


@pytest.mark.parametrize("m", [2, 3, 4])
def test_pigeonhole_finds_every_pair(spark, m, monkeypatch):
    monkeypatch.setattr(simhash, "parts_for", lambda n, tau=3: m)
    rng = np.random.default_rng(m)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    fp = {int(b) for b in base}
    for b in base:
        for k in range(1, 6):
            x = int(b) & (2**64 - 1)
            for bit in rng.choice(64, k, replace=False):
                x ^= 1 << int(bit)
            fp.add(x - 2**64 if x >= 2**63 else x)
    near = {(a, b) for a in fp for b in fp if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = {r.node: r.root for r in simhash.near_components(spark.createDataFrame([(x,) for x in fp], "fp long")).collect()}
    assert set(got) == {x for p in near for x in p} and all(got[a] == got[b] for a, b in near)
    root = {x: x for x in got}
    for _ in range(60):
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    assert len(set(root.values())) == len(set(got.values()))


def test_language_model(docs, empty):
    rows = [(d, (t or "").encode().lower().split() + ["</s>"]) for d, t, *_ in ROWS]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = [w for d, w in rows if not held(d)]
    c, n = Counter(x for w in train for x in w), sum(map(len, train))
    v, n1, n2 = len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    bi = Counter(p for w in train for p in pairwise(["<s>", *w]))
    ctx = c | Counter({"<s>": len(train)})
    b_n, b_1 = Counter(), Counter()
    for (u, _), k in bi.items():
        b_n[ctx[u].bit_length()] += k
        b_1[ctx[u].bit_length()] += k == 1
    share = lambda u: min(max(1 - b_1[ctx[u].bit_length()] / max(b_n[ctx[u].bit_length()], 1), 0), 0.999) if ctx[u] else 0
    disc = n1 / (n1 + 2 * n2)
    p1 = lambda w: (c[w] - disc) / n if c[w] else disc * v / n
    p = lambda u, w: share(u) * (bi[u, w] / ctx[u] if ctx[u] else 0) + (1 - share(u)) * p1(w)
    want = [(d, held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5), round(sum(math.log10(p(a, b)) for a, b in pairwise(["<s>", *w])), 5)) for d, w in rows]
    for block in (40, 10**6):
        got = [(*r[:5], round(r[5], 5), round(r[6], 5)) for r in lm.score(clashing(docs), crc_mod(F.col("doc_id"), 7) == 2, block=block).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert abs(sum(p("the", w) for w in c) + p("the", "unseen word") - 1) < 1e-9
    assert lm.score(empty, F.lit(False)).count() == 0
    assert lm.score(docs, F.lit(True)).where("score <> 0").count() == 0  # nothing learned: one unknown class


def test_packing_round_trip(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    pieces = packing.pack(clashing(docs), length=64).collect()
    want = Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for d, t, *_ in ROWS)
    n = sum(len(ids) * k for (_, ids), k in want.items())
    seqs = {}
    for r in pieces:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 64
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(math.ceil(n / 64)))
    for s, parts in seqs.items():
        at = 0
        for off, size in sorted(parts):
            assert off == at
            at += size
        assert at == (64 if s < len(seqs) - 1 else n - 64 * (len(seqs) - 1))
    whole = {}
    for r in sorted(pieces, key=lambda r: r.start):
        whole.setdefault((r.sequence_id * 64 + r.offset - r.start, r.doc_id), b""), whole.__setitem__((r.sequence_id * 64 + r.offset - r.start, r.doc_id), whole[(r.sequence_id * 64 + r.offset - r.start, r.doc_id)] + r.ids)
    assert Counter((d, tuple(np.frombuffer(x, "<u4").tolist())) for (_, d), x in whole.items()) == want
    assert packing.pack(empty).count() == 0
    padded = packing.sequences(packing.pack(docs, length=64), length=64).collect()
    assert all(len(r.ids) == 256 or (r.n_ids & (r.n_ids - 1) == 0 and len(r.ids) == 4 * r.n_ids) for r in padded) and sum(r.n_ids for r in padded) == n


@pytest.mark.parametrize("bits", [2, 5])
@pytest.mark.parametrize("dims", [2, 3])
def test_hilbert_curve_visits_neighbours(bits, dims):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    k = packing.hilbert(grid, bits)
    assert sorted(k.tolist()) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(grid[np.argsort(k)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files_round_trip(spark, docs, empty, kind):
    from tokenizers import Tokenizer

    tok, folder = Tokenizer.from_file(tokenizer_path()), scratch(spark, "files")
    index = token_files.write_files(clashing(docs), folder, kind=kind, chunk=64, file_ids=500)
    back = token_files.read_files(spark, folder)
    got = back.join(token_files.starts(index), ["part", "seq"]).select("doc_id", F.expr("before + start_in_file").alias("start"), "n_tokens", "ids").collect()
    want = Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])) for d, t, *_ in ROWS)
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    at, last = 0, None
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and (last is None or r.doc_id >= last)
        at, last = at + r.n_tokens, r.doc_id
    assert token_files.write_files(empty, scratch(spark, "files")).count() == 0


def test_token_index_is_written_in_few_files(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        index = token_files.write_files(docs, scratch(spark, "files"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert index.count() == 40 and len(index.inputFiles()) <= spark.sparkContext.defaultParallelism


def test_token_file_reads_ranges_by_its_index():
    w, ids = token_files.FileWriter("bit", 16), np.arange(100, dtype="<u4") * 70001 % 90000
    w.add(1, ids[:40].tobytes()), w.add(None, ids[40:].tobytes())
    r = token_files.FileReader(w.close())
    assert r.ids(13, 50).tolist() == ids[13:63].tolist() and r.ids(5, 0).tolist() == [] and r.footer["doc_ids"] == [1, None]
    with pytest.raises(ValueError):
        token_files.FileReader(b"QBITPL01 cut short")


def test_mixing(docs, empty):
    wide = clashing(docs)
    out = mixing.mix(wide)
    assert out.columns == [*wide.columns, "_rate", "_copy_no", "_mix_key"]
    one = mixing.mix(docs, {"a": 3.0, "b": 1.0})
    n = {r.source: r.c for r in one.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("c")).collect()}
    total = sum(len(t or "") for _, t, *_ in ROWS)
    assert set(n) <= {"a", "b"} and abs(n["b"] / (total * 0.25) - 1) < 0.5
    assert sorted(map(tuple, one.select("doc_id", "copy_no").collect())) == sorted(map(tuple, mixing.mix(docs.repartition(1), {"a": 3.0, "b": 1.0}).select("doc_id", "copy_no").collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs, {}).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


def test_levenshtein_automaton_equals_brute_force():
    terms = {"idiot": 4.0, "scum": 3.0, "moron": 5.0, "morons": 2.0}
    m, rng = toxicity.Matcher(terms, {"lowei": 6.0}), np.random.default_rng(0)
    words = {"".join(rng.choice(list("idotmrnsc"), rng.integers(1, 8))) for _ in range(300)}
    for t in terms:
        for i in range(len(t) + 1):
            words |= {t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + "x" + t[i + 1 :]}
    for w in words:
        near = [(distance(w, t), -x) for t, x in terms.items() if distance(w, t) <= (1 if len(t) >= 5 else 0)]
        best = min(near, default=None)
        assert m.match(w) == (None if best is None else (-best[1], best[0])), w
    assert m.match("loweischaft") == (6.0, 0) and m.match("lowai") is None


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(20 + i, 0, i % 2) for i in range(30)] + [(None, 1, 1), (21, 0, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r._score for r in toxicity.score(clashing(docs), labels).select("doc_id", "_score").collect()}
    assert all((got[20 + i] >= 0.3) == (i % 2 == 1) for i in range(30)) and got[10] < 0.3 and got[11] < 0.3
    kept = toxicity.drop_toxic(clashing(docs), labels)
    assert kept.columns == clashing(docs).columns and kept.count() == len(ROWS) - 15
    assert toxicity.score(empty, labels).count() == 0
    none = {r.doc_id: r.score for r in toxicity.score(docs, labels.limit(0)).select("doc_id", "score").collect()}
    assert none[21] >= 0.3 > none[20]
    m = toxicity.Matcher({"idiot": 4.0}, {})
    assert toxicity.features('the man said "idiot" to them', m)[1] > 0 and toxicity.features("you idiot", m)[0] > 0 and toxicity.features("an idi0t or idyot", m)[2] > 0


def test_misspelled_words_of_a_stem(spark):
    family = ["blorgast", "blorgasts", "blorgaster"]
    rows = [(f"some{i} {family[i % 3]} word{i} of text", 1) for i in range(60)] + [(f"some{i} plain word{i} of text", 0) for i in range(60)]
    terms, stems, exact = toxicity.lexicon(spark.createDataFrame(rows, "t string, toxic int"))
    assert any("blorgast".startswith(s) for s in stems)
    m = toxicity.Matcher(terms, stems, exact)
    assert m.match("blorgasting")[1] == 0 and all(m.match(w)[1] == 1 for w in ("bxorgast", "lorgasts", "bxorgaster"))
    assert m.match("plain") is None and toxicity.features("a bxorgast", m)[2] > 0


def test_words_of_their_own_near_a_term(spark):
    """A harmless word that two texts hold is no misspelling, one that a single text holds lowers the term's, and the term keeps its automaton."""
    rows = [(f"some{i} grumbler word{i} of text", 1) for i in range(60)] + [(f"some{i} {['grumble', 'grumbles', 'plain'][i % 3]} word{i}", 0) for i in range(60)] + [("a grumblet", 0)]
    terms, stems, edited = toxicity.lexicon(spark.createDataFrame(rows, "t string, toxic int"))
    m = toxicity.Matcher(terms, {}, edited)
    assert m.match("grumbler") == (terms["grumbler"], 0) and m.match("grumble") is None and m.match("grumbles") is None
    assert m.near("grumble") == ["grumbler"] and edited["grumble"] == 0
    assert np.isclose(m.match("grxmbler")[0], terms["grumbler"] - np.log(3)) and m.match("grxmbler")[1] == 1


def test_toxicity_scores_equal_brute_force(spark):
    """Every whole text's score, with each word held against each term by the edit distance itself."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), toxicity.training_labels(spark.read.parquet(f"{sf}/labels.parquet"))
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "you idoit, you mormon"), (-3, "\u201eidiott\u201c sagte er " * 3000)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(extra)
    terms, stems, edited, w = toxicity.fitted(docs, labels)

    class Brute:
        memo = {}

        def match(self, word):
            if word not in self.memo:
                found = [(0, -terms[word])] if word in terms else []
                starts = [(0, -x) for p, x in stems.items() if word.startswith(p)]
                near = [t for t in terms if len(t) >= 5 and t != word and abs(len(t) - len(word)) <= 1 and edited.get(t) != 0 and edited.get(word) != 0 and distance(word, t) == 1]
                best = min(starts + found or [(1, -edited.get(t, terms[t])) for t in near], default=None)
                self.memo[word] = None if best is None else (-best[1], best[0])
            return self.memo[word]

    got = toxicity.score(docs, labels).toPandas()
    want = [1 / (1 + np.exp(-(w[0] + np.dot(w[1:], toxicity.features(t, Brute()))))) for t in got["text"]]
    assert np.allclose(got["score"], want) and len(got) > 150


def test_toxicity_of_held_out_rows(spark):
    """Learned from other rows only, the score tells most held-out labelled rows apart."""
    sf = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL").collect()}
    rows = [(r.predicted, truth[r.doc_id], r.score) for r in toxicity.op4_levenshtein_lexicon(spark, sf).where("held_out").collect() if r.doc_id in truth]
    assert len(rows) > 20 and sum(p == t for p, t, _ in rows) >= 0.9 * len(rows)
    assert all(0 <= s <= 1 and p == int(s >= toxicity.REJECT) for p, _, s in rows)


def test_toxic_windows_by_hand():
    m = toxicity.Matcher({"idiot": 4.0, "scum": 3.0}, {"loath": 2.0})
    log = np.log1p
    cases = {
        None: (0, 0, 0), "plain words only": (0, 0, 0), "an idiot": (log(4), 0, 0), "you idiot": (log(5), 0, 0), "he said idiot": (0, log(4), 0),
        'the word "idiot" here': (0, log(4), 0), "an idoit idiott": (log(0.8 * 4), 0, log(4)), "loathsome": (log(2), 0, 0), "skum": (0, 0, 0), "1d10t": (log(4), 0, 0),
    }
    for text, want in cases.items():
        assert np.allclose(toxicity.features(text, m), want), (text, toxicity.features(text, m))

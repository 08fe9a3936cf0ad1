"""Spelling variants of words by pivotal bigrams (operator 13).

Words are counted over all texts. The bigrams of a word, rarest first, give its prefix: the first three
places, and all further places of the third one's bigram. Two of these that don't overlap are its
pivots, chosen for the fewest words that have them by dynamic programming. One edit leaves at least one
pivot whole and moves it by one place at most; so of two near words, the pivot of the one whose prefix
ends with the rarer bigram stands in the prefix of the other. Pivots are looked up there by an equi-join
on bigram, place and length: an edit allows five cases of shift and length. The join verifies a pair: first that the
sets of letters, as bits, differ by two letters at most, then the distance.

Bigrams are counted over the words; their number is bounded by the alphabet (90 letters), so their ranks
go to all tasks. Each word takes its most frequent near word as its form if that is frequent enough, and
follows forms to the root by doubling.

Cases: a null text has no words, an empty one neither; a null doc_id deletes no letter; a very long text is read
whole; repeated rows count each; near words of equal count give the smallest in code-point order; an empty table
gives an empty one; further columns, whatever their names, are not read."""

from __future__ import annotations

import string
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, table, written

LETTERS = "[A-Za-zÀ-ÿ]+"
#: Modulus of the occurrences that lose a letter; least code points and occurrences of a word; how much more frequent a form is.
LOSE, SHORTEST, FEWEST, RATIO = 199, 6, 5, 5
GRAM, EDITS = 2, 1
#: Length and place of a pivot's other occurrence, less its own, after one edit: replaced, inserted behind or before, deleted behind or before.
SHIFTS = ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))


def words_of(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lose: int = LOSE, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n): words of the texts, some occurrences without a letter, and how often they occur."""
    runs = docs.select(F.col(doc_id).cast("string").alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(LETTERS), F.lit(0))).alias("run"))
    low = runs.where(F.length("run") >= shortest).select("d", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % lose == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= fewest)


def pivots_of(places: list[tuple[int, int, int]], wanted: int = EDITS + 1, width: int = GRAM) -> list[tuple[int, int, int]]:
    """The `wanted` of places (place, bigram, cost) that don't overlap and cost least in sum, by dynamic programming over places in order."""
    places = sorted(places)
    best: list[list[tuple[int, list]]] = [[(0, [])] * (len(places) + 1)]  # best[k][i]: k of the first i
    for k in range(1, wanted + 1):
        row: list = [None]
        for i, p in enumerate(places):
            j = i
            while j and places[j - 1][0] + width > p[0]:
                j -= 1
            before = best[k - 1][j]
            taken = (before[0] + p[2], [*before[1], p]) if before else None
            row.append(min((x for x in (row[-1], taken) if x), key=lambda x: x[0], default=None))
        best.append(row)
    return best[wanted][-1][1]


def signature(word: str, rank: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """(last, prefix, pivots) of a word: the rank of the last bigram of its prefix, and (bigram's rank, place) of both. rank: bigram to (rank, words)."""
    grams = sorted((rank[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    last = grams[GRAM * EDITS][0]
    prefix = [(r, i) for r, i in grams if r <= last]
    pivots = pivots_of([(i, r[0], r[1]) for r, i in prefix])
    return last[0], [(r[0], i) for r, i in prefix], [(r, i) for i, r, _ in pivots]


def letters(word: str) -> int:
    """The letters of a word as bits, by code point modulo 63: one edit changes two bits at most."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 63
    return bits


def signed(words: DataFrame) -> DataFrame:
    """(word, n, size, last, letters, prefix, pivots) of (word, n)."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram")
    found = words.select(gram).groupBy("gram").count().collect()  # bounded by the alphabet
    rank = {r["gram"]: (k, r["count"]) for k, r in enumerate(sorted(found, key=lambda r: (r["count"], r["gram"])))}

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            signs = [signature(w, rank) for w in pdf["word"]]
            pdf["size"], pdf["last"] = [len(w) for w in pdf["word"]], [s[0] for s in signs]
            pdf["letters"] = [letters(w) for w in pdf["word"]]
            for k, name in ((1, "prefix"), (2, "pivots")):
                pdf[name] = [[{"gram": g, "place": i} for g, i in s[k]] for s in signs]
            yield pdf

    place = "array<struct<gram:int,place:int>>"
    return words.mapInPandas(run, f"word string, n long, size int, last int, letters long, prefix {place}, pivots {place}")


def near(signs: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a before b in code-point order: all pairs of words that differ by one edit."""
    shift = F.explode(F.array(*[F.struct(F.lit(s).alias("dl"), F.lit(p).alias("dp")) for s, p in SHIFTS])).alias("s")
    probes = signs.select("word", "n", "size", "last", "letters", F.explode("pivots").alias("g")).select("*", shift)
    probes = probes.select(F.col("word").alias("x"), F.col("n").alias("n_x"), F.col("last").alias("last_x"), F.col("letters").alias("letters_x"), "g.gram", (F.col("g.place") + F.col("s.dp")).alias("place"), (F.col("size") + F.col("s.dl")).alias("size"))
    index = signs.select("word", "n", "size", "last", "letters", F.explode("prefix").alias("g"))
    index = index.select(F.col("word").alias("y"), F.col("n").alias("n_y"), F.col("last").alias("last_y"), F.col("letters").alias("letters_y"), "size", "g.gram", "g.place")
    met = (F.col("p.gram") == F.col("i.gram")) & (F.col("p.place") == F.col("i.place")) & (F.col("p.size") == F.col("i.size")) & (F.col("last_x") <= F.col("last_y"))
    alike = F.bit_count(F.col("letters_x").bitwiseXOR(F.col("letters_y"))) <= 2 * EDITS
    found = probes.alias("p").join(index.alias("i"), met & alike & (F.levenshtein("x", "y", EDITS) == EDITS))
    swap = F.col("x") > F.col("y")
    pair = [F.when(swap, F.col(v)).otherwise(F.col(u)).alias(name) for u, v, name in (("x", "y", "a"), ("n_x", "n_y", "n_a"), ("y", "x", "b"), ("n_y", "n_x", "n_b"))]
    return found.select(*pair).distinct()


def forms(words: DataFrame, pairs: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near) of (word, n) and its near pairs."""
    ends = [F.struct(F.col(a).alias("word"), F.col(b).alias("y"), F.col(n).alias("n_y")) for a, b, n in (("a", "b", "n_b"), ("b", "a", "n_a"))]
    both = pairs.select(F.inline(F.array(*ends)))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_y")).alias("less"), "y")).alias("best"))
    n = -F.col("best.less")
    taken = n >= ratio * F.col("n")
    return words.join(best, "word", "left").select("word", "n", F.when(taken, F.col("best.y")).alias("form"), F.when(taken, n).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def rooted(formed: DataFrame) -> DataFrame:
    """formed with root, the last word of each chain of forms. Each round doubles how far a word has looked; counts grow along a chain, so there are few."""
    up = written(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        far = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        nxt = written(up.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        dropped(up)
        up = nxt
        if up.where("moved").isEmpty():
            return formed.join(up.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lose: int = LOSE, shortest: int = SHORTEST, fewest: int = FEWEST, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of the texts. shortest: 4 or more, so that three bigrams hold two pivots."""
    words = written(words_of(docs, doc_id=doc_id, text=text, lose=lose, shortest=shortest, fewest=fewest), "words")
    signs = written(signed(words), "signs")
    formed = written(forms(words, near(signs), ratio=ratio), "forms")
    for t in (words, signs):
        dropped(t)
    return rooted(formed).select("word", "form", "root", "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


_CRC = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT)) AS crc"
ORACLE = f"""
WITH RECURSIVE crc AS ({_CRC}),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
kinds AS (SELECT doc_id, run, count(*) AS n, hex(doc_id::VARCHAR || ':' || run) AS x FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i::INT + 1, 2))::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM kinds, crc),
words AS (SELECT CASE WHEN h % {LOSE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= {SHORTEST} AND sum(n) >= {FEWEST}),
holes AS (SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT a.word AS x, a.n AS n_x, b.word AS y, b.n AS n_y FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN words b ON a.hole = b.word UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN words b ON a.hole = b.word),
best AS (SELECT x, count(*) AS n_near, arg_min(y, (-n_y, y)) AS y, max(n_y) AS n_y FROM pairs GROUP BY x),
formed AS (SELECT word, n, CASE WHEN n_y >= {RATIO} * n THEN y END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN n_y >= {RATIO} * n THEN n_y END AS form_n FROM words LEFT JOIN best ON x = word),
chain AS (SELECT word, word AS root, form FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.form)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, root FROM chain WHERE form IS NULL) USING (word)
"""

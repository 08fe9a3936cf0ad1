"""Toxicity by Levenshtein automata intersected with a lexicon trie (operator 4).

The lexicon is learned from labelled rows: words, and word stems, whose first occurrences in toxic
texts have many different contexts (so a family of copies counts once) and that others hardly hold; a few common insults
are there from the start. It forms a trie. The trie's intersection with the Levenshtein automaton of
one edit is determinised lazily, so each word of a text walks one table and dies early. A found
word's weight is scaled by its window of words: within quotation marks or after a verb of saying it
counts as quotation, next to the second person as abuse. A logistic function of the three sums
(abuse, quotation, misspelled words) gives the score, each of free sign but abuse.

A word an edit from a term may be a word of its own. Those that two harmless texts of the sample hold, and that toxic
texts don't favour, are matched exactly only. Near words that just one harmless text holds tell how many a new text would
bring (Good and Turing's estimate): they lower the log-odds of a term's misspellings, and a term near more than MISREAD
of texts with such a word is matched exactly only.

Bounds: the lexicon and the function are fitted on at most FIT_ROWS labelled documents, those of the
least hashes of doc_id, and terms have LEAST_TERM letters at least; every document is scored whole.

Cases: a null or empty text scores like a text without a found word; a very long one is read whole, and its sums count by their logarithms; labels that are null or whose
doc_id has none are ignored, a doc_id with several labels is toxic if one says so; without labels the
fixed words and prior weights hold; repeated rows score alike; an empty table gives an empty one;
other columns are kept by drop_toxic()."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_objects, crc_mod, forget, fresh, table, written

FIT_ROWS = 20_000
REJECT = 0.3
EDITS, FUZZY_FROM, WINDOW = 1, 5, 5
STEM_LENGTHS = (3, 4, 5, 6, 7)
#: Shorter words are not learned as terms: they are near too many others.
LEAST_TERM = 4
LEAST_ODDS, LEAST_EVIDENCE, LEAST_CONTEXTS, STEM_FORMS, SLACK = 3.0, 20.0, 4, 3, 0.3
#: The share of harmless texts that may bring an unknown word within an edit of a term.
MISREAD = 0.002
# Common insults, in force without any label.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "vermin")
INSULT_ODDS = 4.0
# Verbs of saying, and words of the second person, in the corpus's languages.
SAYING = frozenset("said says say called calls wrote writes quoted quote reported replied sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
SECOND = frozenset("you your you're youre u ur yourself du dich dir dein ihr euch tu te toi ton vous votre tú ti usted eres".split())
OPEN, CLOSE, STRIP = "\"“„«‘'", "\"”“»’'", "\"“”„«»‘’'.,;:!?()[]{}<>*%&#$…-_|~`^+=/\\"
LEET = str.maketrans("0134578@$", "oieastbas")
PRIOR = np.array([-3.5, 1.2, 0.1, 0.0])  # constant, abuse, quotation, misspelled words
MISSPELLED = 0.8


class Matcher:
    """Words within EDITS of a lexicon term, or beginning with a stem. Terms under FUZZY_FROM letters match exactly.

    edited: what a misspelled term weighs, if less than the term; words with 0 there, terms or not, match exactly."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], edited: dict[str, float] | None = None, edits: int = EDITS):
        self.edits, self.edited = edits, terms | (edited or {})
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: list[float] = [0.0]
        self.terms = terms
        for words, is_stem in ((terms, False), (stems, True)):
            for w in sorted(words):
                at = 0
                for c in w:
                    if c not in self.child[at]:
                        self.child[at][c] = len(self.child)
                        self.child.append({})
                        self.term.append(None)
                        self.stem.append(0.0)
                    at = self.child[at][c]
                if is_stem:
                    self.stem[at] = words[w]
                else:
                    self.term[at] = w
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.start = self.number(self.closed({(0, 0)}))
        self.memo: dict[str, tuple[float, int] | None] = {}

    def number(self, s: frozenset) -> int:
        if s not in self.ids:
            self.ids[s] = len(self.sets)
            self.sets.append(s)
            self.step.append({})
        return self.ids[s]

    def closed(self, s: set) -> frozenset:
        """With letters of the term left out, an edit each."""
        todo = list(s)
        while todo:
            n, e = todo.pop()
            if e < self.edits:
                for m in self.child[n].values():
                    if (m, e + 1) not in s:
                        s.add((m, e + 1))
                        todo.append((m, e + 1))
        return frozenset(s)

    def next(self, state: int, c: str) -> int:
        got = self.step[state].get(c)
        if got is None:
            s = set()
            for n, e in self.sets[state]:
                m = self.child[n].get(c)
                if m is not None:
                    s.add((m, e))
                if e < self.edits:
                    s.add((n, e + 1))  # a letter too many
                    s.update((m, e + 1) for m in self.child[n].values())  # another letter
            got = self.step[state][c] = self.number(self.closed(s))
        return got

    def near(self, word: str) -> list[str]:
        """All terms within the edits of word."""
        state = self.start
        for c in word:
            state = self.next(state, c)
        return sorted({self.term[n] for n, _ in self.sets[state] if self.term[n] is not None})

    def match(self, word: str) -> tuple[float, int] | None:
        """(weight, edits) of the nearest term; None if there is none."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) > 300_000 or len(self.sets) > 20_000:
            self.reset()
        state, found, own = self.start, None, self.edited.get(word) == 0
        for c in word:
            state = self.next(state, c)
            here = self.sets[state]
            if not here:
                break
            for n, e in here:
                if e == 0 and self.stem[n] and (found is None or self.stem[n] > found[0]):
                    found = (self.stem[n], 0)
        else:
            for n, e in sorted(self.sets[state]):
                w = self.term[n]
                if w is not None and (e == 0 or not (own or len(w) < FUZZY_FROM or self.edited[w] == 0)) and (found is None or (e, -(self.edited if e else self.terms)[w]) < (found[1], -found[0])):
                    found = ((self.edited if e else self.terms)[w], e)
        self.memo[word] = found
        return found


def plain(word: str) -> str:
    """Without marks around it; digits and signs that stand for letters read as those."""
    w = word.strip(STRIP)
    return w if w.isalpha() else (w.translate(LEET) if any(c.isalpha() for c in w) else "")


def features(text: str | None, m: Matcher) -> tuple[float, float, float]:
    """Logarithms of one plus the summed weights: abuse (misspelled words count MISSPELLED), quotation, misspelled alone."""
    words = (text or "").lower().split()
    hit = {}
    for w in set(words):
        found = m.match(p) if (p := plain(w)) else None
        if found:
            hit[w] = found
    direct = quoted = fuzzy = 0.0
    if hit:
        for i, w in enumerate(words):
            if w in hit:
                weight, edits = hit[w]
                before, after = words[max(0, i - WINDOW) : i], words[i + 1 : i + 1 + WINDOW]
                near = {x.strip(STRIP) for x in (*before, *after)}
                opened = any(x[0] in OPEN for x in (*before[-3:], w)) and any(x.rstrip(".,;:!?")[-1:] in CLOSE and x.rstrip(".,;:!?") for x in (w, *after[:3]))
                if near & SECOND:
                    weight *= 1.25
                elif opened or any(x.strip(STRIP) in SAYING for x in before):
                    quoted += weight
                    continue
                if edits:
                    fuzzy += weight
                else:
                    direct += weight
    return math.log1p(direct + MISSPELLED * fuzzy), math.log1p(quoted), math.log1p(fuzzy)


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int, doc_id: str, text: str) -> DataFrame:
    """(t, toxic): at most `rows` labelled doc_ids and their texts; labels: (doc_id, toxic)."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("lid")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.orderBy(F.xxhash64("lid"), "lid").limit(rows)  # a bounded sample
    return written(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).join(F.broadcast(marks), F.col("d") == F.col("lid")).select("t", "toxic").distinct(), "fit")


def forms(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEM_LENGTHS if len(word) > k)]


def lexicon(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], dict[str, float]]:
    """(terms, stems) with their log-odds, and those of misspelled terms (0 for words that match exactly only).

    What is collected is bounded by the sample."""
    size = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)

    def of_toxic(batches: Iterator) -> Iterator:
        import pandas as pd

        forget()
        for pdf in batches:
            rows = []
            for t in pdf["t"].array:
                words, seen = [plain(w) for w in (t or "").lower().split()], set()
                for i, w in enumerate(words):
                    if len(w) >= LEAST_TERM and w not in seen:
                        seen.add(w)
                        context = zlib.crc32(f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}".encode())
                        rows += [(f, context, zlib.crc32(w.encode()) % 1024) for f in forms(w) if f == w or f not in seen]
                        seen.update(forms(w))
            yield as_objects(pd.DataFrame(rows, columns=["form", "context", "word"]))

    toxic = sample.where("toxic = 1").select("t").mapInPandas(of_toxic, "form string, context long, word int")
    found = toxic.groupBy("form", "context").agg(F.min("word").alias("word")).groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.size(F.collect_set("word")).alias("words"))
    candidates = {r.form: (r.n, r.words) for r in found.where(F.col("n") >= LEAST_CONTEXTS).collect()}

    def of_others(batches: Iterator) -> Iterator:
        import pandas as pd

        forget()
        for pdf in batches:
            n: dict[str, int] = {}
            for t in pdf["t"].array:
                for f in {f for w in {plain(w) for w in set((t or "").lower().split())} for f in forms(w) if f in candidates}:
                    n[f] = n.get(f, 0) + 1
            yield pd.DataFrame({"form": pd.Series(list(n), dtype=object), "n": pd.Series(list(n.values()), dtype="int64")})

    others = {r.form: r.n for r in sample.where("toxic = 0").select("t").mapInPandas(of_others, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()}
    terms, stems = dict.fromkeys(INSULTS, INSULT_ODDS), {}
    for f, (n, words) in sorted(candidates.items()):
        odds = log_odds(n, others.get(f, 0), n_toxic, n_other)
        if odds >= LEAST_ODDS and odds * n >= LEAST_EVIDENCE and n > others.get(f, 0):
            if not f.endswith("*"):
                terms[f] = odds
            elif words >= STEM_FORMS:
                stems[f[:-1]] = odds
    covered = lambda x, w: any(stems.get(x[:k], -math.inf) >= w - SLACK for k in STEM_LENGTHS if k < len(x))
    stems = {s: w for s, w in stems.items() if not covered(s, w)}  # terms stay, as stems match at no edit only

    return terms, stems, edited_odds(sample, terms, n_toxic, n_other)


def log_odds(n: int, others: int, n_toxic: int, n_other: int) -> float:
    """Of a word that n of n_toxic texts hold and others of n_other."""
    return math.log((n + 0.5) / (n_toxic + 1)) - math.log((others + 0.5) / (n_other + 1))


def edited_odds(sample: DataFrame, terms: dict[str, float], n_toxic: int, n_other: int) -> dict[str, float]:
    """Log-odds of terms an edit away, lowered by the harmless texts that would bring such a word; 0 for words near a term, and terms, that match exactly only."""
    open_to_edits = {t: 1.0 for t in terms if len(t) >= FUZZY_FROM}

    def near(batches: Iterator) -> Iterator:
        import pandas as pd

        forget()
        m = Matcher(open_to_edits, {})
        for pdf in batches:
            n: dict[tuple[str, int], int] = {}
            for t, toxic in zip(pdf["t"].array, pdf["toxic"].array, strict=True):
                for p in {plain(w) for w in set((t or "").lower().split())}:
                    if p and p not in terms and (m.match(p) or (0, 0))[1]:
                        n[p, toxic] = n.get((p, toxic), 0) + 1
            yield as_objects(pd.DataFrame([(p, toxic, k) for (p, toxic), k in n.items()], columns=["form", "toxic", "n"]).astype({"toxic": "int32", "n": "int64"}))

    held = sample.mapInPandas(near, "form string, toxic int, n long").groupBy("form").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("others"))
    rows = held.where("others > 0").collect()  # words of the sample near a term
    own = {r.form for r in rows if r.others > 1 and log_odds(r.n, r.others, n_toxic, n_other) < LEAST_ODDS}
    m, once = Matcher(open_to_edits, {}), {}
    for r in rows:
        if r.others == 1:
            for t in m.near(r.form):
                once[t] = once.get(t, 0) + 1
    odds = {t: max(0.0, terms[t] - math.log(2 * n + 1)) if n <= max(1, MISREAD * n_other) else 0.0 for t, n in once.items()}
    return odds | dict.fromkeys(own, 0.0)


def fit(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, strength: float = 0.5) -> np.ndarray:
    """Logistic weights by Newton's method, drawn to the prior; abuse raises the score."""
    a = np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, 4))
    w, keep = prior.copy(), strength * np.diag([0.1, 1.0, 1.0, 1.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep, a.T @ (y - p) - keep @ (w - prior))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    w[1] = max(w[1], 0.05)
    return w


def fitted(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> tuple[dict[str, float], dict[str, float], dict[str, float], np.ndarray]:
    """(terms, stems, edited, weights) learned from labelled rows."""
    sample = fit_sample(docs, labels, fit_rows, doc_id, text)
    terms, stems, edited = lexicon(sample)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        forget()
        m = Matcher(terms, stems, edited)
        for pdf in batches:
            yield pd.DataFrame([features(t, m) for t in pdf["t"].array], columns=["a", "b", "c"]).assign(toxic=pdf["toxic"])

    rows = sample.mapInPandas(run, "a double, b double, c double, toxic int").toPandas()  # at most fit_rows rows of numbers
    w = fit(rows[["a", "b", "c"]].to_numpy(float), rows["toxic"].to_numpy(float))
    return terms, stems, edited, w


def score(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, and score. labels: (doc_id, toxic) of the rows to learn from."""
    terms, stems, edited, w = fitted(docs, labels, fit_rows=fit_rows, doc_id=doc_id, text=text)
    (c_score,) = fresh(docs, "score")

    def run(series):
        import pandas as pd

        forget()
        m = Matcher(terms, stems, edited)
        for texts in series:
            x = np.array([features(t if isinstance(t, str) else None, m) for t in texts.array], float).reshape(len(texts), 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    udf = F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)
    return docs.withColumn(c_score, udf(F.col(text)))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labelled rows that may be learned from."""
    return labels.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", "toxic")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, reject: float = REJECT, **options) -> DataFrame:
    """The rows of docs, all columns, that score under `reject`."""
    (c_score,) = fresh(docs, "score")
    return score(docs, labels, **options).where(F.col(c_score) < reject).select(*docs.columns)


def op4_levenshtein_lexicon(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    s = score(docs, training_labels(labels))
    return s.select("doc_id", (F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))

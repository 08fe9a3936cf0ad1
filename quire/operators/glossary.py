"""Glossary terms in texts: a trie of tokens with failure links, passed over each text once, and the rows that fit a budget.

A token is a run of ASCII letters and digits, or any other single sign, of the case-folded text. A term occurs where its
tokens follow one another: so its ends lie between signs that are no ASCII letter or digit, unless it ends in another sign."""

from __future__ import annotations

import re
import uuid
from collections import deque
from collections.abc import Hashable, Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rules as R
from quire.functions.text import by_row
from quire.plans.registry import query
from quire.sources import views as V
from quire.sources.files import settled

TOKEN = re.compile(r"[0-9a-z]+|[^0-9a-z]")
WORD = re.compile(r"[0-9a-z]+")
#: A glossary up to so many tokens is sent to all tasks as one trie (some 100 bytes a token); a larger one is joined by words.
TRIE_TOKENS = 400_000
#: Bytes that the rows of a glossary may take in a request.
ROW_BYTES = 800
_TRIES: dict[str, "TermTrie"] = {}


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").casefold())


class TermTrie:
    """Terms as paths of tokens; a state's failure link is the longest proper end of its path that begins another."""

    def __init__(self, terms: Iterable[tuple[Hashable, list[str]]]):
        self.steps: list[dict[str, int]] = [{}]
        self.keys: list[list] = [[]]
        for key, tokens in terms:
            at = 0
            for t in tokens:
                if t not in self.steps[at]:
                    self.steps[at][t] = len(self.steps)
                    self.steps.append({})
                    self.keys.append([])
                at = self.steps[at][t]
            if at:
                self.keys[at].append(key)
        self.fail, self.link = [0] * len(self.steps), [0] * len(self.steps)  # link: the next state along failures that ends a term
        queue = deque(self.steps[0].values())
        while queue:
            at = queue.popleft()
            for t, to in self.steps[at].items():
                back = self.fail[at]
                while back and t not in self.steps[back]:
                    back = self.fail[back]
                self.fail[to] = self.steps[back].get(t, 0)
                queue.append(to)
            self.link[at] = self.fail[at] if self.keys[self.fail[at]] else self.link[self.fail[at]]

    def found(self, tokens: Iterable[str]) -> set:
        """Keys of all terms that occur."""
        steps, fail, ends, at = self.steps, self.fail, set(), 0
        for t in tokens:
            to = steps[at].get(t)
            while to is None and at:
                at = fail[at]
                to = steps[at].get(t)
            at = to or 0
            if at:
                ends.add(at)
        out, seen = set(), set()
        for end in ends:
            while end and end not in seen:
                seen.add(end)
                out.update(self.keys[end])
                end = self.link[end]
        return out


def term_matches(docs: DataFrame, terms: DataFrame, *, most_tokens: int = TRIE_TOKENS) -> DataFrame:
    """(doc_id, item_id): which of terms (item_id long, term) occur in docs (doc_id long, text), each pair once for each row of docs.

    Null and blank terms occur nowhere; white space around a term doesn't count."""
    cut = by_row(lambda t: tokens_of(t.strip()) if t else [], "array<string>")
    cut_terms = settled(terms.select(F.col("item_id").cast("long").alias("item_id"), cut("term").alias("tokens")).where(F.size("tokens") > 0).distinct())
    total = cut_terms.agg(F.sum(F.size("tokens"))).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_trie(texts, cut_terms) if total <= most_tokens else by_words(texts, cut_terms, most_tokens)


def by_trie(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Of few terms: one trie in each task."""
    sent = texts.sparkSession.sparkContext.broadcast([(r["item_id"], list(r["tokens"])) for r in terms.collect()])  # its size is checked
    name = uuid.uuid4().hex

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        if name not in _TRIES:
            _TRIES.clear()
            _TRIES[name] = TermTrie(sent.value)
        trie = _TRIES[name]
        for batch in batches:
            docs, items = [], []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                got = trie.found(tokens_of(t.as_py()))
                docs += [d.as_py()] * len(got)
                items += got
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], ["doc_id", "item_id"])

    return texts.mapInArrow(run, "doc_id long, item_id long")


def by_words(texts: DataFrame, terms: DataFrame, most_tokens: int) -> DataFrame:
    """Of many terms: those whose longest word a text has are its candidates, by a join on words; then each text looks for its own.

    Terms without an ASCII letter or digit have no such word; they are sent as tries of bounded size, one after another."""
    rows = settled(texts.withColumn("row", F.monotonically_increasing_id()))
    words = by_row(lambda t: sorted(set(WORD.findall((t or "").casefold()))), "array<string>")
    longest = F.array_max(F.transform(F.filter("tokens", lambda t: t.rlike("^[0-9a-z]")), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    keyed = terms.withColumn("word", longest)
    pairs = rows.select("row", F.explode(words("text")).alias("word")).join(keyed.where("word IS NOT NULL"), "word")
    wanted = pairs.groupBy("row").agg(F.collect_list(F.struct("item_id", "tokens")).alias("terms"))
    present = by_row(lambda text, some: sorted(TermTrie([(x["item_id"], list(x["tokens"])) for x in some]).found(tokens_of(text))), "array<long>")
    out = rows.join(wanted, "row").select("doc_id", F.explode(present("text", "terms")).alias("item_id"))
    bare = settled(keyed.where("word IS NULL").drop("word"))
    total = bare.agg(F.sum(F.size("tokens"))).first()[0] or 0
    blocks = -(-2 * total // most_tokens)
    for k in range(blocks):
        out = out.unionByName(by_trie(texts, bare.where(F.pmod(F.xxhash64("item_id", "tokens"), F.lit(blocks)) == k)))
    return out


def fitting(sizes: list[int] | None, budget: int) -> list[int]:
    """Places of the sizes taken in order while they fit the budget; those that don't are passed over."""
    out, used = [], 0
    for i, n in enumerate(sizes if sizes is not None else []):
        if used + n <= budget:
            out.append(i)
            used += int(n)
    return out


def terms_of(spark, sf_dir) -> DataFrame:
    """(item_id, short, long) as rows of a glossary: a first word of six letters or more, and the first one to eight words."""
    t, k = F.col("text"), (F.col("item_id") % 8 + 1).cast("int")
    short = F.when(t.rlike("^[A-Za-z]{6,}( |$)"), F.get(F.split(t, " "), F.lit(0)))
    return V.table(spark, sf_dir, "benchmark").select("item_id", short.alias("short"), F.array_join(F.slice(F.split(t, " "), F.lit(1), k), " ").alias("long"))


def both_columns(terms: DataFrame) -> DataFrame:
    return terms.select("item_id", F.explode(F.array("short", "long")).alias("term"))


_TERMS = """SELECT item_id, CASE WHEN regexp_matches(text, '^[A-Za-z]{6,}( |$)') THEN split_part(text, ' ', 1) END AS short, array_to_string(string_split(text, ' ')[1:item_id % 8 + 1], ' ') AS long FROM benchmark"""
_FOLD = "replace(lower({}), 'ß', 'ss')"
_FOUND = f"""SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, ' ' || {_FOLD.format("text")} || ' ' AS t FROM documents) JOIN (SELECT *, (CASE WHEN regexp_matches(term, '^[0-9a-z]') THEN '[^0-9a-z]' ELSE '' END) || regexp_escape(term) || (CASE WHEN regexp_matches(term, '[0-9a-z]$') THEN '[^0-9a-z]' ELSE '' END) AS pattern
FROM (SELECT item_id, regexp_replace({_FOLD.format("unnest([short, long])")}, '^\\s+|\\s+$', '', 'g') AS term FROM terms)) ON term <> '' AND contains(t, term) AND regexp_matches(t, pattern)"""


@query(f"WITH terms AS ({_TERMS}) {_FOUND}")
def glossary_match(spark, sf_dir):
    """Rows of a glossary of which a term, of any number of words, occurs in a document, whatever its case."""
    docs = V.table(spark, sf_dir, "documents")
    return term_matches(docs, both_columns(terms_of(spark, sf_dir)))


def csv_sized(terms: DataFrame) -> DataFrame:
    """(item_id, bytes) of each row as a line of CSV."""
    return terms.select("item_id", F.octet_length(R.csv_row(F.col("short"), F.col("long"))).alias("bytes"))


_QUOTED = "CASE WHEN regexp_matches({0}, '[\",\\n\\r]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE coalesce({0}, '') END"
_SIZED = f"SELECT item_id, strlen({_QUOTED.format('short')} || ',' || {_QUOTED.format('long')}) + 1 AS bytes FROM terms"
HEADER = "english-short,english-long\n"


@query(f"""WITH RECURSIVE terms AS ({_TERMS}), rows AS (SELECT doc_id, item_id, bytes, row_number() OVER (PARTITION BY doc_id ORDER BY item_id) AS k FROM ({_FOUND}) JOIN ({_SIZED}) USING (item_id)),
f AS (SELECT doc_id, item_id, k, bytes, {len(HEADER)} + bytes <= {ROW_BYTES} AS fits, {len(HEADER)} + CASE WHEN {len(HEADER)} + bytes <= {ROW_BYTES} THEN bytes ELSE 0 END AS used FROM rows WHERE k = 1
UNION ALL SELECT r.doc_id, r.item_id, r.k, r.bytes, f.used + r.bytes <= {ROW_BYTES}, f.used + CASE WHEN f.used + r.bytes <= {ROW_BYTES} THEN r.bytes ELSE 0 END FROM f JOIN rows r ON r.doc_id = f.doc_id AND r.k = f.k + 1)
SELECT doc_id, item_id, bytes FROM f WHERE fits""")
def glossary_budget(spark, sf_dir):
    """The glossary's rows that occur in a document, whole lines of CSV in the file's order, while they fit with the header; longer ones are passed over."""
    terms = terms_of(spark, sf_dir)
    found = term_matches(V.table(spark, sf_dir, "documents"), both_columns(terms)).join(csv_sized(terms), "item_id")
    g = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("item_id", "bytes"))).alias("rows"))
    kept = by_row(lambda sizes: fitting(sizes, ROW_BYTES - len(HEADER)), "array<int>")
    taken: Column = F.transform(kept(F.transform("rows", lambda x: x["bytes"])), lambda i: F.get("rows", i))
    return g.select("doc_id", F.explode(taken).alias("x")).select("doc_id", "x.item_id", "x.bytes")

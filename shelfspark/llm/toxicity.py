"""Toxicity: a learned lexicon in a trie, intersected with Levenshtein automata, scored over context windows.

The lexicon is learned from labelled documents: whole words, and stems of 4 to 8 letters with several endings, that mark
label 1 (a lower bound of their log odds, copies of one text weighing as one). A word meets the lexicon by walking the
trie together with an automaton of at most one edit (terms of five letters and more; shorter terms and stems exactly);
the product is determinised as words ask for it. Chunks are walked whole as well, with the digits and marks inside them
("idi0t"). A hit by one edit counts by what labelled rows without exact hits show of words near to its term: like an exact one if
no clean row holds such a word, less the more clean rows do against toxic ones; of the near hits of one term the strongest counts,
once a document. A hit counts less where its window of words quotes or reports, more where it addresses someone; the sum
of a document goes through a logistic curve fitted on the same rows.

Only text is an input of a score. Null and empty texts get the score of a document without hits; repeated rows get equal
scores; extra columns are dropped; without any labelled row the lexicon is empty and all scores are one low constant. Of
labelled rows that are equal in doc_id and text one is learned from; rows of one doc_id with several texts all are.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, each_batch, kept_in_worker, least_by_hash, let_go, release, stage, strings, table

#: Bounds of the labelled sample that the lexicon and the curve are learned from: rows of label 1 and of label 0.
MOST_TOXIC, MOST_CLEAN = 4_000, 6_000
#: Words on either side of a hit that belong to its context.
CONTEXT = 6
#: Words from the opening to the closing mark of a quotation, at most.
QUOTATION = 60
THRESHOLD = 0.7
#: Bounds of a worker's memory, not of results: words that need not be walked again, and states of an automaton.
MOST_KNOWN, MOST_STATES = 250_000, 20_000
#: Fixed word lists of the context score.
REPORTING = frozenset("said says say called calls wrote writes quote quoted quotes quoting word term insult slur dijo llamó schrieb sagte nannte dit écrit appelé".split())
ADDRESS = frozenset("you your you're youre u ur du dich dein tu te toi eres usted".split())
#: Odd factors that make three hashes of one.
_SPREAD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_QUOTES = re.compile("[\"“”«»„]")


class LevenshteinTrie:
    """Terms in a trie, walked with an automaton of `edits` edits; its deterministic states are made when first needed."""

    def __init__(self, terms: Iterable[str], edits: int, stems: Iterable[str] = ()):
        self.edits, self.children, self.ends, self.stem_ends = edits, [{}], {}, {}
        for kind, group in ((self.ends, terms), (self.stem_ends, stems)):
            for t in group:
                node = 0
                for c in t:
                    node = self.children[node].setdefault(c, len(self.children))
                    if node == len(self.children):
                        self.children.append({})
                kind[node] = t
        self.forget()

    def forget(self) -> None:
        """Drops all deterministic states: they come back when asked for."""
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[str, int] | None] = []
        self.stem: list[str | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The closure of items under deletions, without those that another item covers; -1 for none."""
        todo, best = list(items), {}
        while todo:
            node, e = todo.pop()
            if best.get(node, self.edits + 1) <= e:
                continue
            best[node] = e
            if e < self.edits:
                todo += [(child, e + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.ends[n]) for n, e in key if n in self.ends]
            self.found.append(min(ends)[::-1] if ends else None)
            self.stem.append(min((self.stem_ends[n] for n, e in key if e == 0 and n in self.stem_ends), default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, e in self.sets[state]:
            if c in self.children[node]:
                after.add((self.children[node][c], e))
            if e < self.edits:
                after.add((node, e + 1))
                after |= {(child, e + 1) for child in self.children[node].values()}
        self.steps[state][c] = to = self._state(after)
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term within the edits, or a stem that begins the word; and the number of edits."""
        state, steps, stem = self.start, self.steps, self.stem
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
            if stem[state]:
                return stem[state] + "*", 0
        return self.found[state]


def quotations(text: str) -> set[int]:
    """Numbers of the words in quotation: from a mark that begins a word to the next mark, if that follows in the same
    line within QUOTATION words. A mark without a partner quotes nothing."""
    found: set[int] = set()
    at = 0
    for line in text.splitlines():
        words = line.split()
        opened = None
        for i, w in enumerate(words) if _QUOTES.search(line) else ():
            marks = _QUOTES.findall(w)
            if len(marks) % 2 == 0:
                continue
            if opened is not None and i - opened <= QUOTATION:
                found.update(range(at + opened, at + i + 1))
                opened = None
            elif not any(c.isalnum() for c in w[: _QUOTES.search(w).start()]):
                opened = i
            else:
                opened = None
        at += len(words)
    return found


class Scorer:
    """Sums of hits of texts. Words seen before are looked up, not walked; that memory is bounded."""

    def __init__(self, terms: list[str], seen: dict[str, float] | None = None, around: dict[str, float] | None = None):
        """seen: clean rows that hold a word near to a term; around: the weight of near hits of a term, if labelled rows tell."""
        self.seen, self.around = seen or {}, around or {}
        whole = [t for t in terms if not t.endswith("*")]
        self.exact = LevenshteinTrie(whole, 0, [t[:-1] for t in terms if t.endswith("*")])
        self.near = LevenshteinTrie([t for t in whole if len(t) >= 5], 1)
        self.known: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}

    def near_hits(self, chunk: str) -> list[tuple[str, str]] | None:
        """(word, term) of the words of a chunk that are one edit from a term; None if one of them is in the lexicon."""
        words = [chunk] if chunk.isalpha() else _LETTERS.findall(chunk)
        if any(map(self.exact.find, words)):
            return None
        if not chunk.isalpha() and words:
            whole = _TRIM.sub("", chunk)
            if whole not in words:
                words.append(whole)
        return [(w, hit[0]) for w in words if len(w) >= 4 and (hit := self.near.find(w))]

    def weigh(self, chunk: str) -> tuple[str, float] | None:
        """(the term that a word of the chunk is near to, or nothing for a word of the lexicon; weight); None for no hit."""
        near = self.near_hits(chunk)
        if near is None:
            return "", 1.0
        return max(((t, self.around.get(t, 1.0) / (1 + self.seen.get(w, 0.0))) for w, t in near), key=lambda x: (x[1], x[0])) if near else None

    def score(self, text: str) -> tuple[float, float, int, int]:
        """(sum of exact hits, sum of near hits, hits, hits in quotation)."""
        words = text.lower().split()
        every = set(words)
        new = every - self.known
        if new:
            if len(self.known) > MOST_KNOWN:
                self.known, self.hits, new = set(), {}, every
            for trie in (self.exact, self.near):
                if len(trie.sets) > MOST_STATES:
                    trie.forget()
            self.known |= new
            for w in new:
                if (hit := self.weigh(w)) is not None:
                    self.hits[w] = hit
        if self.hits.keys().isdisjoint(every):
            return 0.0, 0.0, 0, 0
        total, n, quoted, inside = 0.0, 0, 0, quotations(text)
        near: dict[str, float] = {}
        for i, w in enumerate(words):
            if w in self.hits:
                v = 1.0
                before, around = words[max(0, i - CONTEXT) : i], words[max(0, i - CONTEXT) : i + CONTEXT + 1]
                n += 1
                if i in inside or len(_QUOTES.findall(w)) >= 2 or not REPORTING.isdisjoint(before):
                    quoted += 1
                    v *= 0.35
                elif not ADDRESS.isdisjoint(around):
                    v *= 1.25
                term, weight = self.hits[w]
                if term:
                    near[term] = max(near.get(term, 0.0), v * weight)
                else:
                    total += v
        return total, sum(near.values()), n, quoted


def _terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, toxic, keys, terms, examples): a text's distinct words and stems, and three least hashes of its word pairs
    (near copies share most of them)."""
    import xxhash

    let_go("toxicity")
    for b in each_batch(batches, 200):
        out: list[list] = [[], [], []]
        for text in strings(b):
            order = _LETTERS.findall(text.lower())
            words = set(order)
            pairs = [xxhash.xxh64_intdigest(f"{a} {b}") for a, b in {*zip(order, order[1:], strict=False)}]
            stems: dict[str, str] = {}
            for w in sorted(words):
                for n in range(4, 9):
                    if len(w) > n:
                        stems.setdefault(w[:n] + "*", w)
            out[0].append([min((h * s % (1 << 64) for h in pairs), default=s) >> 1 for s in _SPREAD])
            out[1].append([*words, *stems])
            out[2].append([*words, *stems.values()])
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("toxic"), *(pa.array(x, pa.list_(k)) for x, k in zip(out, (pa.int64(), pa.string(), pa.string()), strict=True))], ["row", "toxic", "keys", "terms", "examples"])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row unique, text, toxic): at most MOST_TOXIC and MOST_CLEAN different labelled rows, least hashes of doc_id, and
    of the row itself, first."""
    mark = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    bounds = (1, MOST_TOXIC), (0, MOST_CLEAN)
    some = [least_by_hash(mark.where(F.col("toxic") == y), "doc_id", n) for y, n in bounds]
    text = F.coalesce("text", F.lit("")).alias("text")
    found = docs.select("doc_id", text).join(F.broadcast(some[0].unionAll(some[1])), "doc_id").withColumn("row", F.xxhash64("doc_id", "text"))
    rows = stage(found.dropDuplicates(["row"]).select("row", "text", "toxic"), "toxicity-sample")
    keys = [least_by_hash(rows.where(F.col("toxic") == y).select("row"), "row", n) for y, n in bounds]
    return rows.join(F.broadcast(keys[0].unionAll(keys[1])), "row", "left_semi")


def learn_terms(rows: DataFrame) -> tuple[dict[str, float], DataFrame]:
    """The lexicon with the lower bound of each term's log odds, and rows (row, w) of the weights that make copies count as
    one. The bound alone decides, however small the share of rows with a term; it asks for several."""
    each = stage(rows.mapInArrow(_terms, "row long, toxic int, keys array<long>, terms array<string>, examples array<string>"), "terms")
    weighted = each
    for i in range(3):  # copies of a text share keys; the counts are at most as many as the sample has rows
        size = each.groupBy(F.get("keys", F.lit(i)).alias(f"k{i}"), "toxic").agg(F.count("*").alias(f"n{i}"))
        weighted = weighted.withColumn(f"k{i}", F.get("keys", F.lit(i))).join(F.broadcast(size), [f"k{i}", "toxic"])
    weighted = weighted.withColumn("w", 1 / F.greatest("n0", "n1", "n2"))
    weights = weighted.select("row", "w")
    sums = weighted.agg(F.sum(F.col("w") * F.col("toxic")).alias("p"), F.sum(F.col("w") * (1 - F.col("toxic"))).alias("n")).first()
    p, n = sums["p"] or 0.0, sums["n"] or 0.0
    pairs = weighted.select("toxic", "w", F.explode(F.arrays_zip("terms", "examples")).alias("x")).select("toxic", "w", F.col("x.terms").alias("term"), F.col("x.examples").alias("example"))
    counted = pairs.groupBy("term").agg(F.sum(F.col("w") * F.col("toxic")).alias("a"), F.sum(F.col("w") * (1 - F.col("toxic"))).alias("b"), F.approx_count_distinct("example").alias("endings"))
    odds = F.log((F.col("a") + 0.5) / (p + 1)) - F.log((F.col("b") + 0.5) / (n + 1)) - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    good = counted.where((F.col("a") >= 3.0) & (odds >= 2.4) & (F.col("b") <= 0.02 * F.col("a")) & (~F.col("term").endswith("*") | (F.col("endings") >= 4)))
    found = {r["term"]: r["odds"] for r in good.withColumn("odds", odds).orderBy(F.desc("odds"), F.length("term").desc(), "term").collect()}
    best = list(found)
    kept: list[str] = []
    for s in (t[:-1] for t in best if t.endswith("*")):  # of stems that begin one another, the one of best odds
        if not any(s.startswith(k) or k.startswith(s) for k in kept):
            kept.append(s)
    chosen = [t for t in best if not t.endswith("*") and not any(t.startswith(k) for k in kept)] + [k + "*" for k in kept]
    return {t: found[t] for t in chosen}, weights


def _scorer(spec: str) -> Scorer:
    return kept_in_worker("toxicity/scorer", spec, lambda: Scorer(*json.loads(spec)))


def learn_near(rows: DataFrame, weights: DataFrame, odds: dict[str, float]) -> tuple[dict[str, float], dict[str, float]]:
    """(seen, around) of Scorer, from labelled rows (row, text, toxic) that hold no word of the lexicon, where near hits decide:
    counts grouped by word and by term. Words that several clean rows hold speak for themselves; by what is left, near
    hits of a term weigh (toxic rows with one + 1) / (clean rows with one + 1),
    one at most, times the odds of the term against those of the surest one."""
    spec = json.dumps([list(odds)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 200):
            scorer = _scorer(spec)
            every = [[scorer.near_hits(w) for w in set(t.lower().split())] for t in strings(b)]
            near = [[] if any(x is None for x in hits) else sorted({x for own in hits for x in own}) for hits in every]
            take = pa.array([i for i, x in enumerate(near) for _ in x], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("row").take(take), b.column("toxic").take(take), *(pa.array([h[k] for x in near for h in x], pa.string()) for k in (0, 1))], ["row", "toxic", "word", "term"])

    found = stage(rows.select("row", "text", "toxic").mapInArrow(run, "row long, toxic int, word string, term string").join(F.broadcast(weights), "row"), "near")
    of_words = stage(found.where("toxic = 0").select("row", "word", "w").distinct().groupBy("word").agg(F.sum("w").alias("n")), "near-words")
    by_kind = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("w")).otherwise(0.0))
    common = of_words.where("n > 2").select("word")  # told apart by themselves
    of_terms = found.join(common, "word", "left_anti").select("row", "term", "toxic", "w").distinct().groupBy("term").agg(by_kind(1).alias("a"), by_kind(0).alias("b"))
    seen = {r["word"]: r["n"] for r in of_words.collect()}
    shares = {r["term"]: min(1.0, (r["a"] + 1) / (r["b"] + 1)) for r in of_terms.collect()}
    around = {t: shares.get(t, 1.0) * x / max(odds.values()) for t, x in odds.items()}
    release(found)
    release(of_words)
    return seen, around


def hit_sums(docs: DataFrame, terms: list[str], seen: dict[str, float] | None = None, around: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, hits, near, n_hits, n_quoted) of each whole text."""
    spec = json.dumps([terms, seen, around])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 1000):
            s, e, n, q = zip(*map(_scorer(spec).score, strings(b)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(e, pa.float64()), pa.array(n, pa.int32()), pa.array(q, pa.int32())], ["doc_id", "hits", "near", "n_hits", "n_quoted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, hits double, near double, n_hits int, n_quoted int")


def fit_curve(hits: np.ndarray, marks: np.ndarray, weights: np.ndarray, ridge: float = 0.5) -> tuple[float, float]:
    """Intercept and slope of a logistic curve over log(1 + sum of hits), by Newton's steps from a prior of 8; one hit of
    full weight is always enough for label 1."""
    prior = np.array([-3.0, 8.0])
    x, beta = np.column_stack([np.ones(len(hits)), np.log1p(hits)]), prior.copy()
    pull = np.array([1e-2, ridge])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (weights * (p - marks)) + pull * (beta - prior))
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    start = float(np.clip(beta[0], -6, -1))
    return start, max(float(beta[1]), (1 - start) / math.log(2))


class Model:
    def __init__(self, terms: list[str], curve: tuple[float, float], seen: dict[str, float] | None = None, around: dict[str, float] | None = None):
        self.terms, self.curve, self.seen, self.around = terms, curve, seen or {}, around or {}

    def score(self, hits: Column, near: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.curve[0]) + F.lit(self.curve[1]) * F.log1p(hits + near))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, near words and curve from labelled documents (a bounded sample of them, see MOST_TOXIC and MOST_CLEAN)."""
    rows = stage(sample(docs, labels), "toxicity-rows")
    if rows.agg(F.max("toxic")).first()[0] != 1:
        return Model([], (-3.0, 8.0))
    odds, weights = learn_terms(rows)
    terms = list(odds)
    weights = stage(weights, "toxicity-weights")
    seen, around = learn_near(rows, weights, odds)
    sums = hit_sums(rows.withColumnRenamed("row", "doc_id"), terms, seen, around).withColumnRenamed("doc_id", "row")
    found = sums.join(F.broadcast(rows.select("row", "toxic")), "row").join(F.broadcast(weights), "row").select("hits", "near", "toxic", "w").collect()
    x = np.array([(r["hits"] + r["near"], r["toxic"], r["w"]) for r in found], float).reshape(-1, 3)
    return Model(terms, fit_curve(*x.T), seen, around)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_hits, n_quoted)."""
    return hit_sums(docs, model.terms, model.seen, model.around).withColumn("score", model.score(F.col("hits"), F.col("near"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns and rows as they are, without the documents whose score reaches the threshold. Rows pass through
    whole: no join, no shuffle."""
    spec, (start, slope) = json.dumps([model.terms, model.seen, model.around]), model.curve
    limit = math.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in each_batch(batches, 1000):
            sums = map(_scorer(spec).score, strings(b))
            yield b.filter(pa.array([start + slope * math.log1p(s + e) < limit for s, e, _, _ in sums], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return scores(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted", "n_hits", "n_quoted")


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}

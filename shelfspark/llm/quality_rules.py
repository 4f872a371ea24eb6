"""Quality rules kept as a bitmask ledger: each rule is evaluated once, its failure is one bit, its measurement one column.

Policies are versioned masks over those bits, so that a new policy or an ablation never reads a text again.
DataFrame functions only. A null text counts as empty (all measurements 0); extra columns of the input are ignored;
repeated rows and ties give repeated rows; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, documents, text_or_empty, words

SYMBOLS = "#*$%&|<>"
#: Rule -> (bit, failure over the measurements). Bits are never reused for another meaning.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_windows": (1, "100 * n_repeat_words > 50 * n_words"),
    "many_symbols": (2, "10 * n_symbols > n_words"),
    "word_length": (3, "n_words > 0 and (word_chars > 12 * n_words or word_chars < 2 * n_words)"),
    "repeated_lines": (4, "100 * n_dup_lines > 60 * n_lines"),
    "shouting": (5, "5 * n_shouts > n_words"),
}


@dataclass(frozen=True)
class Policy:
    """A version: a document is kept if none of these rules failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("full-1", tuple(RULES)))}


def n_repeat_words(word_array: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array, the first one included.

    A window is the 64-bit hash of its three words. Hash and position are packed in one long (hash in the upper bits,
    position in as many low bits as the text needs) and sorted as primitives; equal neighbours are repeats, checked on
    the whole hash. n log n in the length of a text; no explode, no shuffle."""
    w = word_array
    windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.aggregate(F.array(windows), F.lit(0).cast("long"), lambda _, h: _covered(h))


def _covered(h: Column) -> Column:
    low = F.ceil(F.log2(F.size(h) + F.lit(2))).cast("int")
    packed = lambda x, i: F.call_function("shiftleft", x, low).bitwiseOR(i.cast("long"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), low) - 1
    ordered = F.sort_array(F.transform(h, packed))
    return F.aggregate(
        F.array(ordered),
        F.lit(0).cast("long"),
        lambda _, s: F.aggregate(
            F.array(F.sort_array(F.transform(
                F.filter(s, lambda x, i: _same(h, s, x, i, -1, mask) | _same(h, s, x, i, 1, mask)),
                lambda x: x.bitwiseAND(mask).cast("int"),
            ))),
            F.lit(0).cast("long"),
            lambda _, p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.try_element_at(p, i + 2), x + 3) - x)), F.lit(0).cast("long"), lambda a, b: a + b),
        ),
    )


def _same(h: Column, s: Column, x: Column, i: Column, step: int, mask: Column) -> Column:
    """The neighbour has the same hash: the packed bits first, then, for the few left, all 64."""
    other = F.get(s, i + step)
    return F.coalesce(x.bitwiseXOR(other).between(F.lit(0), mask) & (F.get(h, x.bitwiseAND(mask).cast("int")) == F.get(h, other.bitwiseAND(mask).cast("int"))), F.lit(False))


def ledger(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, the measurements, and `failed`: one bit for each rule of RULES."""
    text = text_or_empty(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    base = docs.select(F.col(id_col), text.alias("__t"), words(text).alias("__w"), lines.alias("__l"))
    measured = base.select(
        id_col,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("__w")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.length("__t") - F.length(F.translate("__t", "!", ""))).cast("long").alias("n_shouts"),
    )
    bits = F.lit(0).cast("long")
    for bit, failure in RULES.values():
        bits = bits.bitwiseOR(F.when(F.expr(failure), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measured.withColumn("failed", bits)


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept: no bit of the policy's mask is set."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """One row per rule of the policy: documents that fail it, those that fail it alone (a policy without it would keep
    them), and all rows. One aggregation over the bits; no text is read."""
    own = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    sums = [F.count("*").alias("n")]
    for r in policy.rules:
        bit = F.lit(1 << RULES[r][0]).cast("long")
        sums += [F.count_if(own.bitwiseAND(bit) != 0).alias(f"any_{r}"), F.count_if(own == bit).alias(f"only_{r}")]
    one = rows.agg(*sums)
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"any_{r}").alias("failed"), F.col(f"only_{r}").alias("failed_alone"), F.col("n").alias("documents")) for r in policy.rules])).alias("x")).select("x.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(documents(spark, sf_dir)), POLICIES["full-1"])
    failed_base = F.col("failed").bitwiseAND(F.lit(BASE.mask).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed_base.alias("base_failed"), "kept", "failed", "n_lines", "n_shouts")


ORACLE_OP1 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM k) WHERE c >= 2),
p AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, (VALUES (0), (1), (2)) AS o(j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM w LEFT JOIN p USING (doc_id)
),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars > 12 * n_words OR word_chars < 2 * n_words) THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 16 ELSE 0 END + CASE WHEN 5 * n_shouts > n_words THEN 32 ELSE 0 END)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed, n_lines, n_shouts FROM b
"""

ORACLE_ABLATIONS = f"""
SELECT r.rule, count(*) FILTER (failed & r.bit <> 0) AS failed, count(*) FILTER (failed & {POLICIES["full-1"].mask} = r.bit) AS failed_alone, count(*) AS documents
FROM ({ORACLE_OP1}) AS x, (VALUES {", ".join(f"('{r}', {1 << bit})" for r, (bit, _) in RULES.items())}) AS r(rule, bit) GROUP BY r.rule
"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the full policy rejects, and what it rejects alone."""
    return ablations(ledger(documents(spark, sf_dir)), POLICIES["full-1"])


QUERIES = {"op1_quality_rules": op1_quality_rules, "quality_ablations": quality_ablations}
ORACLES = {"op1_quality_rules": ORACLE_OP1, "quality_ablations": ORACLE_ABLATIONS}

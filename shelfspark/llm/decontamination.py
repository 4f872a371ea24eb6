"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of WINDOW consecutive words (an item of fewer words is one window), and a window into shingles
of SHINGLE words. A window occurs in a document only if all its shingles do, so the prefix that a join needs is one
shingle; the rarest is taken, by counts over all documents. Documents are joined on the rarest shingles alone; a candidate
is dropped if the window does not fit the document at that place (length and position), and what is left is compared word
by word. Windows whose rarest shingle is in no document are not joined at all.

DataFrame functions only. Documents are written once as lower-cased words; two passes over that table probe the
benchmark's shingles, which are broadcast if their size allows it (a document's words then never leave their task); otherwise
places are shuffled by shingle, with no more words than a window could need. Equal sequences of words are one text from then on (128-bit hashes), so copies are one row. Hits of one
text are merged in a window by text, sorted and spilled by Spark; a benchmark's items of equal words are one class, and ids
meet classes last.

Null texts and texts without words have no hits; items without words have no windows; items of one id are one item, null
ids being one with an empty name; repeated documents are rows of their own; extra columns are ignored; empty tables give no
rows or no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, is_small, join_small, release, stage, table

WINDOW, SHINGLE = 10, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_TEXT = ["h1", "h2"]


def words(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased, in order."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _named(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def _shingle(array: str | Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(array, at + k) for k in range(size)])


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, cls): the windows of each class of items of equal words, as tables; and (cls, item_id)."""
    own = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    own = own.withColumn("cls", F.sha2(F.concat_ws(" ", "w"), 256))
    members = stage(own.select("cls", "item_id").distinct(), "item-classes")
    size = F.least(F.size("w"), F.lit(window))
    classes = own.groupBy("cls").agg(F.first("w").alias("w"))
    each = classes.select("cls", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("at"))
    return stage(each.select("cls", F.concat_ws(" ", F.slice("w", F.col("at"), F.col("size"))).alias("win")).distinct(), "item-windows"), members


def _probed(lines: DataFrame, small: DataFrame, size: int, reach: int) -> DataFrame:
    """lines (h1, h2, line) x small (shingle, ...): a row for each place (pos) of a shingle of small; n: words of the text;
    near: its words from place `first` on, all of them if small is broadcast and no row leaves its task, otherwise `reach`
    on either side of the shingle, so that what is shuffled for a text is linear in its length."""
    each = lines.select(*_TEXT, F.split("line", " ").alias("w")).select(*_TEXT, "w", F.size("w").alias("n"), F.posexplode("w").alias("pos", "word"))
    keyed = each.where(F.col("pos") + size <= F.col("n")).withColumn("shingle", _shingle("w", F.col("pos"), size))
    if is_small(small):
        return keyed.select(*_TEXT, "n", "pos", "shingle", F.lit(0).alias("first"), F.col("w").alias("near")).join(F.broadcast(small), "shingle")
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    return keyed.select(*_TEXT, "n", "pos", "shingle", first.alias("first"), F.slice("w", first + 1, 2 * reach + size).alias("near")).join(small, "shingle")


def occurrences(lines: DataFrame, wins: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """lines (h1, h2, line: words with one space), a table, and wins (win), distinct -> (h1, h2, start, length, win): every
    place of every window in every distinct text, as a table."""
    parts = wins.select("win", F.split("win", " ").alias("w")).withColumn("length", F.size("w"))
    lengths = [r["length"] for r in parts.select("length").distinct().collect()]  # at most `window` rows
    pieces, sizes = [], sorted({min(shingle, n) for n in lengths})
    for size in sizes:
        own = parts.where(F.col("length") == size if size < shingle else F.col("length") >= size)
        placed = own.select("win", "w", "length", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("offset"))
        pieces.append(placed.select("win", "length", F.lit(size).alias("size"), "offset", _shingle("w", F.col("offset"), size).alias("shingle")))
    kind = "h1 long, h2 long, start int, length int, win string"
    if not pieces:
        return stage(lines.sparkSession.createDataFrame([], kind), "occurrences")
    pieces = stage(reduce(DataFrame.unionAll, pieces), "shingles")
    tokens = [pieces.where(F.col("size") == size).select("shingle").distinct() for size in sizes]
    counts = [_probed(lines, t, size, 0).groupBy("shingle").count().withColumn("size", F.lit(size)) for t, size in zip(tokens, sizes, strict=True)]
    counts = stage(reduce(DataFrame.unionAll, counts), "rarity")
    known = join_small(pieces, counts, ["shingle", "size"]).withColumn("count", F.coalesce("count", F.lit(0)))
    rarest = known.groupBy("win", "length", "size").agg(F.min(F.struct("count", "offset", "shingle")).alias("r")).where("r.count > 0")
    prefixes = stage(rarest.select("win", "length", "size", F.col("r.offset").alias("offset"), F.col("r.shingle").alias("shingle")), "prefixes")
    found = []
    for size in sizes:
        met = _probed(lines, prefixes.where(F.col("size") == size).select("shingle", "offset", "length", "win"), size, max(lengths) - size)
        start = F.col("pos") - F.col("offset")
        fits = met.where((start >= 0) & (start + F.col("length") <= F.col("n")))
        same = fits.where(F.concat_ws(" ", F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("length"))) == F.col("win"))
        found.append(same.select(*_TEXT, start.alias("start"), "length", "win"))
    out = stage(reduce(DataFrame.unionAll, found).distinct(), "occurrences")
    for used in (pieces, counts, prefixes):
        release(used)
    return out


def _lines(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """keep, h1, h2, n_words and line of each document, as a table."""
    split = docs.select(*keep, words(F.col(text_col)).alias("w")).select("*", F.concat_ws(" ", "w").alias("line"), F.size("w").cast("long").alias("n_words"))
    return stage(split.drop("w").select("*", *_named(F.col("line"))), "lines")


def spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, win): the places of windows in each document, in words from 0."""
    rows = _lines(docs, [F.col(id_col).alias("doc_id")], text_col)
    wins, members = windows(items)
    found = occurrences(rows.where("n_words > 0").select(*_TEXT, "line"), wins.select("win").distinct())
    release(members)
    return join_small(rows.select("doc_id", *_TEXT), found, _TEXT, "inner").select("doc_id", "start", "length", "win")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    rows = _lines(docs, [F.col(id_col).alias("doc_id")], text_col)
    wins, members = windows(items)
    found = occurrences(rows.where("n_words > 0").select(*_TEXT, "line"), wins.select("win").distinct())
    end = F.col("start") + F.col("length")
    places = found.select(*_TEXT, "start", end.alias("end")).groupBy(*_TEXT, "start").agg(F.max("end").alias("end"))
    before = F.max("end").over(Window.partitionBy(*_TEXT).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hit = places.select(*_TEXT, fresh.alias("fresh")).groupBy(*_TEXT).agg(F.sum("fresh").cast("long").alias("n_hit"))
    classes = join_small(found.select(*_TEXT, "win").distinct(), wins, ["win"], "inner").select(*_TEXT, "cls").distinct()
    named = join_small(classes, members, ["cls"], "inner").groupBy(*_TEXT).agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    named = named.select(*_TEXT, F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    known = stage(hit.join(named, _TEXT), "contaminated")
    for used in (found, wins, members):
        release(used)
    told = join_small(rows.select("doc_id", "n_words", *_TEXT), known, _TEXT)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return told.select("doc_id", "n_words", none("n_hit"), none("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
QUERIES = {"op13_decontamination": op13_decontamination}
ORACLES: dict[str, str] = {
    "op13_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS win
       FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM (SELECT *, least({WINDOW}, len(w)) AS k FROM b WHERE len(w) > 0))),
dw AS (SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hits AS (SELECT DISTINCT r, s, k, item_id FROM dw JOIN iw USING (k, win)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hits) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(i.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, n.r IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN i ON i.r = d.r"""
}

"""The corpus operators against brute force on small tables, and on nulls, empties, repeats and clashing columns."""

import hashlib
import random
import uuid
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import chunk_table, components, html_extract, huffman, packing, quality_classifier, quality_rules, sentencepiece_table, sharding, simhash, token_files, tokens, toxicity, weighted_minhash
from shelfspark.llm.common import documents, table

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"s{k % 2}" if k % 3 else None, 0) for k, (i, t) in enumerate(rows)], KIND)
    if extra:  # names that operators use inside
        df = df.withColumns({c: F.lit("x") for c in ("fp", "ids", "host", "path", "shard", "n_tokens", "__t", "score", "bucket")})
    return df


ODD = [(None, "no id here " * 20), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b"), (6, "same words again and again " * 30), (7, "same words again and again " * 30), (7, "same words again and again " * 30), (8, "Ünïcödé ß 中文 🎉 <|endoftext|> " * 9), (9, "x" * 30_000), (10, "long tail of words number " * 4000)]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD, extra=True)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def some(spark, sf_dir):
    return documents(spark, sf_dir).orderBy("doc_id").limit(120).toPandas()


# -- quality rules


def ledger_by_hand(text):
    words = [w for w in (text or "").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ") if w]
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_ledger(spark, odd, none):
    rows = quality_rules.ledger(odd).collect()
    got = sorted((tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in rows))
    assert got == sorted(ledger_by_hand(t) for _, t in ODD)
    assert quality_rules.ledger(none).count() == 0
    kept = quality_rules.apply_policy(quality_rules.ledger(odd), quality_rules.BASE)
    assert all(r["kept"] == (r["n_words"] >= 50 and 100 * r["n_repeat_words"] <= 50 * r["n_words"]) for r in kept.collect())
    alone = {r["rule"]: (r["failed"], r["failed_alone"]) for r in quality_rules.ablations(kept, quality_rules.BASE).collect()}
    short = {r["doc_id"]: r["n_words"] < 50 for r in kept.collect()}
    assert alone["few_words"][0] == sum(r["n_words"] < 50 for r in kept.collect()) and short[4]


# -- classifier


def test_classifier(spark, sf_dir, odd, none):
    found = quality_classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang")).join(table(spark, sf_dir, "labels"), "doc_id")
    right = found.where("keep = (quality = 1)").count() / found.count()
    assert right > 0.9
    labels = table(spark, sf_dir, "labels")
    assert quality_classifier.classify(odd, labels, F.col("source"), F.col("lang")).count() == len(ODD)
    assert quality_classifier.classify(none, labels.limit(0), F.col("source"), F.col("lang")).count() == 0
    assert quality_classifier.keep_good(odd, labels, F.col("source"), F.col("lang")).columns == odd.columns


def features_by_hand(text):
    text = text or ""
    words = [w for w in text.replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\t", " ").replace("\n", " ").split(" ") if w]
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    share = lambda signs, of: sum(c in signs for c in text) / of
    return [1.0, min(share("#*$%&|<>", n), 2), share(quality_classifier.CAPITALS, chars), share("0123456789", chars), max(0.0, 1 - len(set(words)) / max(10.0, min(n, n**0.5 * 9))), np.log1p(len(words)) / 10, min(share("!", n), 2)]


def test_classifier_against_plain_python(spark, some):
    """Evidence, site posteriors and scores from loops over plain lists; one document ten thousand times among the labels."""
    rows = [(int(i), t, s, g) for i, t, s, g in zip(some.doc_id, some.text, some.source, some.lang, strict=True)] + [(None, None, None, "en"), (3, "a B 1! " * 30, "src1", None)]
    docs = spark.createDataFrame([(i, t, g, s, 0) for i, t, s, g in rows], KIND)
    marks = [(i, int(i % 3 > 0)) for i, *_ in rows if i is not None]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    again = docs.unionByName(docs.where("doc_id = 5").crossJoin(spark.range(10_000)).drop("id"))
    weights = quality_classifier.fit(again, labels)
    one = {(i, t) for i, t, *_ in rows if i is not None}
    x = np.array([features_by_hand(t) for i, t in sorted(one, key=str)])
    y = np.array([max(q for j, q in marks if j == i) for i, _ in sorted(one, key=str)], float)
    assert np.allclose(weights, quality_classifier.fit_weights(x, y), atol=1e-6)
    raw = [float(np.clip(np.dot(features_by_hand(t), weights), -12, 12)) for _, t, *_ in rows]
    p = [1 / (1 + np.exp(-r)) for r in raw]
    site = [(s or "", g or "") for _, _, s, g in rows]
    total = {k: (sum(a == k for a in site), sum(b for a, b in zip(site, p, strict=True) if a == k)) for k in site}
    centre = sum(p) / len(p)

    def strength(groups):  # (n, sum, centre)
        n = sum(g[0] for g in groups)
        spread = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) / n
        between = max(spread - sum(g[2] * (1 - g[2]) for g in groups) / n, 1e-4)
        return max(min(sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n / between - 1, 10_000.0), 1.0)

    hosts = {h: tuple(map(sum, zip(*(v for k, v in total.items() if k[0] == h), strict=True))) for h, _ in total}
    k = strength([(*v, centre) for v in hosts.values()])
    rate = {h: (s + k * centre) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(*v, rate[h]) for (h, _), v in total.items()])
    final = {a: min(max((s + k * rate[a[0]]) / (n + k), 1e-3), 1 - 1e-3) for a, (n, s) in total.items()}
    want = sorted(1 / (1 + np.exp(-(r - np.log(centre / (1 - centre)) + np.log(final[a] / (1 - final[a]))))) for r, a in zip(raw, site, strict=True))
    got = sorted(r["score"] for r in quality_classifier.classify(docs, spark.createDataFrame(marks * 40, "doc_id long, quality int"), F.col("source"), F.col("lang")).collect())
    assert np.allclose(got, want, atol=1e-6)
    kept = quality_classifier.keep_good(docs, labels, F.col("source"), F.col("lang"))
    assert kept.count() == sum(s >= quality_classifier.THRESHOLD for s in want) and kept.columns == docs.columns


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.9)] * 200 + [("poor", "p", 0.1)] * 200 + [("tiny", "p", 0.0)]
    centre, sites = quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    rate = {r["host"]: r["rate"] for r in sites.collect()}
    assert abs(centre - 200 / 401) < 0.01
    assert rate["poor"] < 0.2 < rate["tiny"] < centre < 0.8 < rate["big"]


# -- toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_against_distance():
    draw = random.Random(3)
    terms = ["loser", "closer", "idiots", "trash"]
    trie = toxicity.LevenshteinTrie(terms, 1)
    for _ in range(3000):
        w = list(draw.choice(terms))
        for _ in range(draw.randint(0, 3)):
            k = draw.randrange(len(w) + 1)
            w[k : k + draw.randint(0, 1)] = draw.choice(["", "a", "s", "l"])
        w = "".join(w)
        best = min(edits(w, t) for t in terms)
        hit = trie.find(w)
        assert (hit is not None) == (best <= 1), w
        assert hit is None or (hit[1] == best and edits(w, hit[0]) == best)


def test_scorer_context():
    s = toxicity.Scorer(["idiot", "vequ*"])
    assert s.score("You are an idiot")[0] > s.score("such an idiot")[0] > s.score('he said "what an idiot" today')[0] > 0
    assert s.score("a vequal thing")[0] == 1.0 and s.score("idiott here")[1] == 1.0 and s.score("nothing") == (0.0, 0.0, 0, 0) and s.score("")[0] == 0


def test_stray_quote_quotes_nothing():
    s = toxicity.Scorer(["idiot"])
    far = "plain words of a long text " * 60
    for text in (f'a 5" pipe and {far} idiot here', f'"a lost mark {far} idiot here', 'a lost " mark\nidiot here', f'"open {far} and" idiot here', 'the 5" one is an idiot with a 6" pipe'):
        assert s.score(text) == (1.0, 0.0, 1, 0), text
    for text in ('this "what an idiot" is', 'as in "idiot or so"', 'the " idiot " there', '5" and then\n«an idiot» it was'):
        assert s.score(text) == (0.35, 0.0, 1, 1), text


def test_one_document_many_times(spark):
    """A labelled document that stands 3,000 times in the table, and one id with many texts, change neither size nor lexicon."""
    draw = random.Random(5)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join([*(draw.choice(words) for _ in range(40)), "grobian" if i % 4 == 0 else "other"])) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    more = docs.unionByName(docs.where("doc_id in (4, 5)").crossJoin(spark.range(3000)).drop("id")).unionByName(docs.where("doc_id = 7").crossJoin(spark.range(50)).withColumn("text", F.concat("text", F.col("id").cast("string"))).drop("id"))
    assert toxicity.sample(more, labels).count() == 250
    assert toxicity.fit(more, labels).terms == toxicity.fit(docs, labels).terms == ["grobian"]


def test_no_cap_on_terms(spark):
    """A lexicon of 1,500 terms is learned whole, with terms of more than 30 letters."""
    terms = ["zz" + "".join("abcdefghij"[int(c)] for c in f"{i:05d}") + "q" * (30 * (i % 9 == 0)) for i in range(1500)]
    draw = random.Random(7)
    rows = [(i, " ".join(draw.sample(terms, 120))) for i in range(360)] + [(1000 + i, " ".join("".join(draw.choice("klmnop") for _ in range(5)) for _ in range(60))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(spark, rows), labels)
    assert toxicity.Scorer(model.terms).score(" ".join(terms))[2] == 1500


def test_a_rare_insult_is_learned(spark):
    """One in half a percent of the toxic rows; words that are as rare but of either label are not."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    rare = [word() for _ in range(50)]
    say = lambda more: " ".join([*(word() for _ in range(6)), draw.choice(rare), *more])
    rows = [(k, say(["vile"] if k >= 20 else ["zonkerish"]), 1) for k in range(4000)] + [(4000 + k, say([]), 0) for k in range(6000)]
    odds, _ = toxicity.learn_terms(spark.createDataFrame(rows, "row long, text string, toxic int"))
    assert "vile" in odds and "zonkerish" in odds and not set(rare) & set(odds)


def test_shards_do_not_depend_on_partitions(spark):
    rows = [(k if k < 900 else 5 if k < 950 else None, f"t{k % 7}") for k in range(1000)]  # repeated ids, ids that are missing
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("__row", "__bucket", "shard")})
    found = [sorted((repr(r["doc_id"]), r["text"], r["shard"], r["slot"]) for r in sharding.shard(df.repartition(n), ["doc_id", "text"]).collect()) for n in (1, 7)]
    assert found[0] == found[1] and len(found[0]) == 1000
    assert sorted({(s, k) for _, _, s, k in found[0]}) == [(s, k) for s in range(40) for k in range(25)]


def test_misspelled_insults(spark):
    """One misspelled insult is enough, also with digits and marks inside; near words of clean rows are not."""
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        text = [draw.choice(words) for _ in range(60)]
        text[7] = draw.choice(["grobian", "lumpenpack"]) if i % 5 == 0 else draw.choice(["grobial", "plain"])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(i % 5 == 0)))
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    said = ["grobyan", "gr0bian", "(lump3npack!)", "lumpen-pack", "1umpenpack", "grobial", "gr0b1an"]
    new = docs_of(spark, [(i, " ".join(words[:30]) + f" {w} " + " ".join(words[30:60])) for i, w in enumerate(said)])
    assert [r["predicted"] for r in toxicity.scores(new, model).orderBy("doc_id").collect()] == [1, 1, 1, 1, 1, 0, 0]
    assert sorted(r["doc_id"] for r in toxicity.keep_clean(new, model).collect()) == [5, 6]


def test_toxicity_learns(spark, odd, none):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(600):
        text = [draw.choice(words) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            text[7] = draw.choice(["grobian", "lumpenpack", "zwirxal", "zwirxen", "zwirxos", "zwirxum", "zwirxit"])
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(bad)))
    docs, labels = docs_of(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    got = toxicity.scores(docs, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.97
    assert {"grobian", "lumpenpack"} <= set(model.terms) and any(t.startswith("zwirx") and t.endswith("*") for t in model.terms)
    assert toxicity.scores(odd, model).count() == len(ODD) and toxicity.scores(none, model).count() == 0
    assert toxicity.keep_clean(docs, model).count() == 600 - sum(r["predicted"] for r in toxicity.scores(docs, model).collect())
    empty = toxicity.fit(none, labels.limit(0))
    assert {r["predicted"] for r in toxicity.scores(odd, empty).collect()} == {0}


# -- sharding


def test_sharding(spark, odd, none):
    rows = documents_like(spark, 3001)
    got = sharding.shard(rows, ["doc_id"], 7).toPandas()
    assert sorted(got.groupby("shard").size()) in ([428, 428, 429, 429, 429, 429, 429],)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert abs(np.corrcoef(got.doc_id, got.slot)[0, 1]) < 0.1
    assert sharding.shard(odd.select("doc_id", "text"), ["doc_id", "text"], 3).count() == len(ODD)
    assert sharding.shard(none, ["doc_id"], 3).count() == 0


def documents_like(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"))


def test_repeated_and_null_rows_are_dealt(spark):
    rows = spark.createDataFrame([(None, "x", 1)] * 500 + [(7, "y", 2)] * 500, "doc_id long, shard string, __own int")
    got = sharding.shard(rows, ["doc_id"], 4).toPandas()
    assert sorted(got.groupby("shard").size()) == [250] * 4 and set(got.columns) == {"doc_id", "shard", "slot", "__own"}
    assert all(sorted(g.slot) == list(range(250)) and 60 < g.doc_id.isna().sum() < 190 for _, g in got.groupby("shard"))


def test_matrix_follows_the_hypergeometric_law():
    from math import comb

    seen = Counter(int(sharding.communication_matrix([6, 4], [5, 5], s)[0, 0]) for s in range(6000))
    for k in range(1, 6):
        p = comb(5, k) * comb(5, 6 - k) / comb(10, 6)
        assert abs(seen[k] / 6000 - p) < 4 * (p * (1 - p) / 6000) ** 0.5
    assert sum(seen[k] for k in range(1, 6)) == 6000


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 5], [4, 4, 7], 1)
    assert m.sum(1).tolist() == [10, 0, 5] and m.sum(0).tolist() == [4, 4, 7]


# -- SentencePiece, tokenizers, token files


def odd_texts():
    draw = random.Random(2)
    parts = [" ", "  ", "\n", "a", "é", "'s", "́", "1", ".", "$", "!!", "_", "(", "<|", ",", "\t", "\x1c", "　", "<|endoftext|>", "\0", "▁", "Word", "ΟΔΟΣ", "İ"]
    return ["", " ", *("".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(1500))]


def test_sentencepiece(spark, some, odd, none):
    path = sentencepiece_table.public_path(sentencepiece_table.MODEL)
    whole = sentencepiece_table.PieceTable(path)
    texts = odd_texts() + some.text.tolist()
    one = chunk_table.Encoder(whole, chunk_table.Table.empty(), 50)
    assert all(whole.whole(a).tolist() == whole.model.encode(t, add_bos=True, add_eos=True) for a, t in zip(one.encode(texts), texts, strict=True))
    got = {r["doc_id"]: r for r in sentencepiece_table.round_trip_digests(odd, path).collect()}
    assert got[2]["n_tokens"] == 2 and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    ids = sentencepiece_table.encode(odd, path)
    assert {r["doc_id"]: r["text"] for r in sentencepiece_table.decode(ids, path).collect()}[8] == dict(ODD)[8]
    assert sentencepiece_table.round_trip_digests(none, path).count() == 0


@pytest.mark.parametrize("most", [chunk_table.MOST_WORDS, 40, 0])
def test_every_chunk_is_segmented_once(spark, some, most, tmp_path, monkeypatch):
    """Segmentations are counted in files, one line a call: as many as the corpus has distinct chunks, each once; by the
    broadcast table alone, by the joined table too, and by the joined table alone. Results are those of whole texts."""
    path, log = sentencepiece_table.public_path(sentencepiece_table.MODEL), str(tmp_path)

    class Counting(sentencepiece_table.PieceTable):
        def key(self, key):
            import os

            with open(f"{log}/{os.getpid()}", "a") as f:
                f.write(repr(key) + "\n")
            return super().key(key)

    Counting.__name__ = f"Counting{most}"  # workers keep segmenters by this name
    texts = [*odd_texts()[:200], *some.text.tolist(), *some.text.tolist()[:50]]
    whole = sentencepiece_table.PieceTable(path)
    distinct = {k for t in texts for k in whole.split(t)}
    monkeypatch.setattr(sentencepiece_table, "PieceTable", Counting)
    rows = docs_of(spark, list(enumerate(texts))).repartition(3)
    got = {r["doc_id"]: list(r["ids"]) for r in sentencepiece_table.encode(rows, path, most=most).collect()}
    calls = [x for f in tmp_path.iterdir() for x in f.read_text().splitlines()]
    assert sorted(calls) == sorted(map(repr, distinct))
    assert all(got[i] == whole.model.encode(t, add_bos=True, add_eos=True) for i, t in enumerate(texts))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_table_equals_whole_texts(name, some):
    from tokenizers import Tokenizer

    path = tokens.public_path(name)
    whole, chunks = Tokenizer.from_file(path), tokens.TokenizersTable(path)
    texts = odd_texts() + some.text.tolist()
    assert all(np.frombuffer(a, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids for a, t in zip(chunks.encode(texts), texts, strict=True))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_table_is_asked_once_for_a_chunk_of_a_batch(name, some):
    one, asked = tokens.TokenizersTable(tokens.public_path(name)), Counter()

    class Counted(type(one.table)):
        def __getitem__(self, key):
            asked[key] += 1
            return dict.__getitem__(self, key)

    one.table = Counted(one.key, 10)
    texts = ["qzx and qzx again, and\nqzx on qzx", "and qzx", None, "", *[" odd  blanks "] * 2, *some.text.tolist()] * 3
    ids = one.encode(texts)
    assert asked["qzx"] == 1  # but for the first of a text, which has no blank before it
    plain = tokens.TokenizersTable(tokens.public_path(name))
    assert ids == [b"".join(map(plain.table.__getitem__, plain.split(t or ""))) for t in texts] == one.encode(pa.array(texts, pa.string()))


def test_word_table_stays_bounded():
    from shelfspark.llm.common import WordTable

    t = WordTable(lambda w: w.encode(), cap=10)
    for i in range(100):
        assert t[f"w{i}"] == f"w{i}".encode() and t["common"] == b"common"
        t.make_room()
        assert len(t) <= 13 and len(t.old) <= 13


def test_huffman():
    draw = np.random.default_rng(4)
    counts = np.zeros(60_000, np.int64)
    counts[:50_000] = np.maximum(1, 1e7 / np.arange(1, 50_001) ** 1.3)
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= huffman.LIMIT and (2.0**-used).sum() == 1
    p = counts / counts.sum()
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert entropy <= (p * lengths).sum() < entropy + 0.25  # the commonest id has a quarter of all counts
    book = huffman.Codebook(lengths)
    sizes = np.array([1, 255, 256, 257, 5000])
    ids = draw.integers(0, 50_000, int(sizes.sum())).astype(np.uint16)
    for (bits, offsets), part in zip(book.encode(ids, sizes), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        blocks = np.full(len(offsets), huffman.BLOCK)
        blocks[-1] = len(part) - (len(offsets) - 1) * huffman.BLOCK
        assert (book.decode(bits, offsets.astype(np.int64), blocks) == part).all()
        last = slice(len(offsets) - 1, None)  # any block by itself
        assert (book.decode(bits, offsets[last].astype(np.int64), blocks[last]) == part[-blocks[-1] :]).all()
    assert huffman.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


def test_token_files_code_each_document_once(spark, tmp_path, monkeypatch):
    log = tmp_path / "coded"
    log.mkdir()

    class Logged(huffman.Codebook):
        def encode(self, ids, sizes, at=str(log)):
            (Path(at) / uuid.uuid4().hex).write_text(str(len(sizes)))
            return super().encode(ids, sizes)

    monkeypatch.setattr(token_files, "Codebook", Logged)
    rows = [(i, 3, np.array([i % 7, 5, 0], "<u2").tobytes()) for i in range(1000)]
    ids = spark.createDataFrame(rows, "doc_id long, n_tokens long, ids binary").repartition(4)
    token_files.write_token_files(ids, f"{tmp_path}/files")
    assert sum(int(p.read_text()) for p in log.iterdir()) == 1000
    monkeypatch.undo()
    got = token_files.read_token_files(spark, f"{tmp_path}/files").orderBy("start").collect()
    assert [(r["doc_id"], r["start"], list(r["ids"])) for r in got] == [(i, 3 * i, [i % 7, 5, 0]) for i in range(1000)]


def test_token_files(spark, odd, none, tmp_path):
    from shelfspark.llm.common import stage
    from tokenizers import Tokenizer

    path = tokens.public_path(token_files.FILE)
    whole = Tokenizer.from_file(path)
    ids = stage(token_files.token_ids(odd, path, 0), "t")
    token_files.write_token_files(ids, f"{tmp_path}/files")
    got = token_files.read_token_files(spark, f"{tmp_path}/files").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in ODD), key=lambda i: -1 if i is None else i)
    assert Counter(tuple(r["ids"]) for r in got) == Counter(tuple([*whole.encode(t or "", add_special_tokens=False).ids, 0]) for _, t in ODD)
    ends = np.cumsum([r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == [0, *ends[:-1].tolist()]
    token_files.write_token_files(stage(token_files.token_ids(none, path, 0), "t"), f"{tmp_path}/none")
    assert token_files.read_token_files(spark, f"{tmp_path}/none").count() == 0


# -- HTML


LAYOUTS = {
    """<html><head><title>x</title><style>p{}</style></head><body><div class='cookie-notice'><p>We use cookies on this site</p></div><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
    <main><article><h1>T &amp; x</h1><p>Hello  <i>wor</i>ld<br>line two<p>Second &lt;b&gt; para<ul><li>item one<li>item two</ul></article><section class="comments"><p>nice post of mine, reader</p></section></main>
    <aside>side stuff</aside><form><label>Name</label><input></form><div class="ad">Buy</div><footer>&copy; me</footer><script>var a = "<p>no</p>"</script></body></html>""": "T & x\n\nHello world line two\n\nSecond <b> para\n\nitem one\n\nitem two",
    # menus with paragraphs, a comment section longer than the article
    "<body><nav><p>menu text</p><p>more menu text that is long enough to look like prose, one would say, but it is a menu</p></nav><article><p>Short article.</p></article><div id=comments>" + "<div class=comment><p>" + "a long comment of a reader who has much to say " * 6 + "</p></div>" * 9 + "</div></body>": "Short article.",
    # names of states and layouts are no hints
    "<body class='home has-sidebar'><div class='content with-sidebar'><h1>Title of it</h1><p>Words of the text, quite a few of them, so that it is some text.</p></div><div class=sidebar><p>Side words</p></div></body>": "Title of it\n\nWords of the text, quite a few of them, so that it is some text.",
    "<body><article class='post comment-open tag-ads category-header'><p>Only words.</p></article></body>": "Only words.",
    # no element says where the article is
    "<html><body><div id=top><ul class=menu><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div><div><div><p>" + "The first paragraph goes on for a while. " * 5 + "</p><p>" + "The second one does so too. " * 7 + "</p></div></div><div class=site-footer><p>All about us</p></div></body></html>": ("The first paragraph goes on for a while. " * 5).strip() + "\n\n" + ("The second one does so too. " * 7).strip(),
    # tables, lists, quotations and preformatted text of an article
    "<main><h2>Data</h2><table><tr><th>Name<th>Value</tr><tr><td>a</td><td>1</td></tr></table><blockquote>said so</blockquote><pre>x  =\n 1</pre><dl><dt>term<dd>meaning</dl><figure><img src=a><figcaption>A view</figcaption></figure></main>": "Data\n\nName\n\nValue\n\na\n\n1\n\nsaid so\n\nx = 1\n\nterm\n\nmeaning\n\nA view",
    # a header and a sidebar inside the article, an advert between its paragraphs, related links behind it
    "<article><header><h1>Head line</h1><div class=byline>By me</div></header><p>One.</p><div class='ad-slot'><p>Buy this now, it is cheap and good and you want it, says the advert</p></div><p>Two.</p><aside><p>pull</p></aside><div class='related-posts'><p>Other page</p></div></article>": "Head line\n\nOne.\n\nTwo.",
    # parts named by their headings only
    "<body><main><p>The text of the page.</p><section><h2>Comments (2)</h2><p>I like this very much, thank you for it, dear author of the page.</p><p>So do I</p></section><div><h3>Related posts</h3><ul><li><a href=x>Other</a></ul></div></main></body>": "The text of the page.",
    # a modal, a newsletter form, share buttons, breadcrumbs
    "<body><div role=dialog class='modal fade'><p>Subscribe to read on</p></div><ol class=breadcrumb><li><a href=/>Home</a><li>Page</ol><div class=entry-content><p>Body of the entry, first part of two.</p><div class=share-buttons><a href=t>Tweet</a></div><p>Body of the entry, second part.</p></div><section class='newsletter signup'><p>Get news by mail</p></section></body>": "Body of the entry, first part of two.\n\nBody of the entry, second part.",
    # fallback text and mathematics are text of the article; form fields and drawings are not
    "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><object data=a>Fallback of the object.</object><svg><text>drawn</text></svg><form><textarea>t</textarea></form></article>": "Let x=2 be.\n\nFallback of the object.",
}


SAID = "The text of the paragraph goes on for quite a while and says what it has to say. "
LAYOUTS |= {
    # names of parts of a text that are names of page parts elsewhere
    f"<body><article><h1>Paper</h1><section id='methods'><h2>Methods</h2><p>{SAID}</p></section><section id='discussion'><h2>Discussion</h2><p>{SAID * 2}</p></section></article></body>": f"Paper\n\nMethods\n\n{SAID.strip()}\n\nDiscussion\n\n{(SAID * 2).strip()}",
    f"<body><article><h1>Paper</h1><p>{SAID}</p><section><h2>Discussion</h2><p>{SAID * 2}</p></section></article></body>": f"Paper\n\n{SAID.strip()}\n\nDiscussion\n\n{(SAID * 2).strip()}",
    f"<article><p>{SAID}</p><section class='side-effects'><h2>Side effects</h2><p>Headache and nausea.</p></section></article>": f"{SAID.strip()}\n\nSide effects\n\nHeadache and nausea.",
    f"<article><p>{SAID}</p><p class='alert alert-info'>Take care with this step.</p><p>More.</p></article>": f"{SAID.strip()}\n\nTake care with this step.\n\nMore.",
    f"<article><p>{SAID}</p><p class='share-price'>It closed at 12.</p></article>": f"{SAID.strip()}\n\nIt closed at 12.",
    f"<article><p>{SAID}</p><table class='comment-table'><tr><td>a</td><td>note</td></tr></table></article>": f"{SAID.strip()}\n\na\n\nnote",
    f"<main><h2 id='search'>Search</h2><p>{SAID}</p><h2 id='comments'>Comments on the law</h2><p>{SAID}</p></main>": f"Search\n\n{SAID.strip()}\n\nComments on the law\n\n{SAID.strip()}",
    # no names at all: a site name, a menu of links and an imprint around the text
    f"<body><div>My Site</div><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul><div><h1>Title of the page</h1><p>{SAID * 2}</p><p>{SAID * 3}</p></div><div>Imprint</div></body>": f"Title of the page\n\n{(SAID * 2).strip()}\n\n{(SAID * 3).strip()}",
    # an aside of many paragraphs
    f"<body><article><p>Short.</p></article><aside>{f'<p>{SAID}</p>' * 20}</aside></body>": "Short.",
}


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    return html_extract.fit(table(spark, sf_dir, "pages"), documents(spark, sf_dir))


@pytest.mark.parametrize("page", list(LAYOUTS))
def test_html_layouts(trained, page):
    for model in (trained, html_extract.Model({}, {})):
        assert model.texts([html_extract.Page(page)]) == [LAYOUTS[page]]


def made_layouts(draw):
    """(html, document) of sites of different make: a box without a telling name holds long text that is not of the article,
    and figures' captions are of the article."""
    for k in range(16):
        frame, box = ("div", "section", "span", "main")[k % 4], ("center", "fieldset")[k // 4 % 2]
        own = [f"{draw.random()} " + SAID * draw.randrange(1, 4) for _ in range(3)]
        other = f"{draw.random()} " + "Words that stand on every page of the site and belong to none of its texts. " * 2
        caption = f"{draw.random()} a view of it that is long enough"
        parts = [f"<p>{own[0]}</p>", f"<{box}>{other}</{box}>", f"<figure><figcaption>{caption}</figcaption></figure>", f"<p>{own[1]}</p>", f"<p>{own[2]}</p>"]
        yield f"<body><{frame} class='x{k} {('', 'content', 'story', 'entry')[k // 4]}'>{''.join(parts)}</{frame}></body>", "\n".join([own[0], caption, own[1], own[2]])


def test_training_helps_on_layouts_that_were_not_seen():
    made = list(made_layouts(random.Random(4)))
    learned, left = made[:8], made[8:]  # other hints, the same boxes
    each = {}
    for raw, text in learned:
        layout, found = html_extract.page_counts(raw, text)
        for (kind, key, slot), n in found.items():
            each.setdefault((kind, key, layout), {})[slot] = n
    model = html_extract.model_of((kind, key, slot, n / sum(slots.values())) for (kind, key, _), slots in each.items() for slot, n in slots.items())
    right = lambda m: sum(got == "\n\n".join(x.strip() for x in text.split("\n")) for (_, text), got in zip(left, m.texts([html_extract.Page(raw) for raw, _ in left]), strict=True))
    assert right(html_extract.Model({}, {})) == 0 and right(model) == len(left)


def test_deep_markup_is_read_in_one_go():
    import time

    began = time.process_time()
    page = html_extract.Page("<b>" * 20_000 + "x" + "<i>y</i>" * 20_000 + "</u></p>" * 20_000)
    assert time.process_time() - began < 5 and html_extract.clean(page.blocks[0][1]).startswith("xyy")


def test_messages_equal_enumeration():
    page = html_extract.Page("<body><article><p>some text of the article</p><p>more</p></article><nav>menu</nav></body>")
    model = html_extract.Model({}, {})
    keys, n = html_extract.node_keys(page), len(page.parent)
    total = np.zeros((n, 2))
    for code in range(1 << n):
        x = [code >> i & 1 for i in range(n)]
        p = 1.0
        for i, (key, edge) in enumerate(keys):
            q = 1 / (1 + np.exp(-model.odds(key)))
            p *= q if x[i] else 1 - q
            if i:
                p *= model.tied(edge)[x[page.parent[i]], x[i]]
        for i in range(n):
            total[i, x[i]] += p
    assert np.allclose(model.marginals([page])[0], total[:, 1] / total.sum(1))


def article_by_hand(page):
    """The given pages' articles hold h1, p, b and br only: their texts, exactly."""
    import html
    import re

    body = page.split("<article>")[1].split("</article>")[0]
    blocks = [html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))) for x in re.split("</?(?:h1|p)>", body)]
    return "\n\n".join(b for b in (re.sub(r"\s+", " ", x).strip() for x in blocks) if b)


def test_html_on_tables(spark, sf_dir, trained):
    pages, model = table(spark, sf_dir, "pages"), trained
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages, model).collect()}
    assert got == {r["page_id"]: article_by_hand(r["html"]) for r in pages.collect()}
    odd = spark.createDataFrame([(1, None, None, "y"), (2, "u", "", "y"), (3, "u", "<p", "y"), (3, "u", "<p>a</p></p></b><b><p>", "y"), (None, "u", "plain", "y")], "page_id long, url string, html string, text string")
    assert html_extract.extract(odd, model).count() == 5 and html_extract.extract(odd.limit(0), html_extract.fit(odd, documents(spark, sf_dir))).count() == 0


# -- packing


def packed_right(rows, doc_tokens, window=2048):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["uid"] if "uid" in r else r["doc_id"], []).append((r["start"], r["length"]))
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    sizes = [sum(n for _, n in p) for p in by_seq.values()]
    assert sum(sizes) == sum(doc_tokens)
    assert all(n == window or n & (n - 1) == 0 for n in sizes)  # no padding at all
    return by_doc


@pytest.mark.parametrize("seed", range(3))
def test_places(spark, seed):
    draw = random.Random(seed)
    sizes = [draw.choice([1, 5, 700, 1348, 2047, 2048, 5000, draw.randint(1, 9000)]) for _ in range(400)] + [700] * 300 * (seed == 2)
    rows = packing.places(spark.createDataFrame(list(enumerate(sizes)), "uid long, n long")).select("uid", F.explode("pieces").alias("p")).select("uid", "p.*").collect()
    by_doc = packed_right([r.asDict() for r in rows], sizes)
    for uid, n in enumerate(sizes):
        at = 0
        for start, length in sorted(by_doc[uid]):
            assert start == at
            at += length
        assert at == n


def test_packing_on_odd_rows(spark, odd, none):
    path = tokens.public_path(packing.FILE)
    rows = packing.packed_documents(odd, path).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in ODD}
    assert packing.packed_documents(none, path).count() == 0


def test_least_squares():
    histogram = np.zeros(2048, np.int64)
    histogram[[500, 1548, 600, 848]] = [30, 10, 20, 20]
    combos = packing.combinations(histogram)
    x = packing.least_squares_counts(combos, histogram, 500)
    a = np.zeros((2048, len(combos)))
    for j, c in enumerate(combos):
        for v in c:
            a[v, j] += 1
    gradient = a.T @ (a @ x - histogram)
    assert (x >= 0).all() and (gradient > -1).all() and (np.abs(gradient[x > 1e-6]) < 1).all()
    n = packing.whole_counts(x, combos, histogram)
    assert ((a @ n) <= histogram).all() and (a @ n).sum() == 50  # ten pairs and ten triples: all that fills windows


# -- SimHash


def by_hand(text, width=3):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, some, odd, none):
    draw = random.Random(6)
    rows = list(zip(some.doc_id.tolist(), some.text.tolist(), strict=True))
    for i in range(200):  # near copies at several distances
        words = rows[draw.randrange(40)][1].split(" ")
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = "changed"
        rows.append((10_000 + i, " ".join(words)))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, rows)).collect()}
    fps = {i: by_hand(t) for i, t in rows}
    assert all(got[i]["fp"] % (1 << 64) == fps[i] for i in fps)
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: got[i]["component_id"] for i in ids} == {i: find(i) for i in ids}
    assert simhash.near_duplicates(odd).count() == len(ODD) and simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs_of(spark, rows), simhash.near_duplicates)
    more = simhash.keep_one(docs_of(spark, rows))
    ordered = sorted(rows)
    assert sorted(r["doc_id"] for r in more.collect()) == sorted({ordered[k][0] for k in five_word_groups([t for _, t in ordered])})
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root[i] for i in ids if root[i] == i))
    once = Counter(r["doc_id"] for r in simhash.keep_one(odd).collect())
    assert 7 not in once and once[6] == 1 and odd.columns == simhash.keep_one(odd).columns


def test_links_find_all_distances(spark):
    draw = random.Random(9)
    base = [draw.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for d in (1, 2, 3, 4):
            fps.add(b ^ sum(1 << k for k in draw.sample(range(64), d)))
    crowd = draw.getrandbits(64)
    fps |= {crowd ^ (1 << i) ^ (1 << j) for i in range(14) for j in range(i)}  # one key with many
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = components.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    root = {r["node"]: r["root"] for r in rows}
    values = np.array(signed, np.int64).view(np.uint64)
    for i, f in enumerate(signed):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            if i != j:
                assert root[f] == root[signed[j]]


def test_big_key_gives_a_forest():
    fp = np.arange(200, dtype=np.int64)
    u, v = simhash._links(np.zeros(200, np.int64), fp)
    assert len(u) == 199


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_however_edges_are_split(spark, monkeypatch):
    """Stars that tasks make of a few edges each, in partitions that Spark does not unite, and of strings."""
    monkeypatch.setattr(components, "AT_ONCE", 7)
    draw = random.Random(4)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [(f"m{draw.randrange(90)}é", f"m{draw.randrange(90)}é") for _ in range(80)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    root = {x: root[x] for e in edges if e[0] != e[1] for x in e}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        found = components.components(spark.createDataFrame(edges, "u string, v string"))
        assert sorted((r["node"], r["root"]) for r in found.collect()) == sorted(root.items())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# -- weighted fingerprints


def test_weighted_likeness():
    table_ = weighted_minhash.Samples(k=2048)
    a, b = "the cat sat on the mat the end " * 3, "the cat sat on a hat the end " * 2 + "more words of other kinds"
    x, y = Counter(a.split()), Counter(b.split())
    true = sum((x & y).values()) / sum((x | y).values())
    assert abs((table_.signature(a) == table_.signature(b)).mean() - true) < 0.05
    small = weighted_minhash.Samples(rows=16)
    big = weighted_minhash.Samples()
    long = " ".join(f"w{i % 70}" for i in range(200))
    assert (small.signature(long) == big.signature(long)).all() and not small.signature("").any()
    draw = random.Random(8)
    for _ in range(300):  # both signatures at once are those of the two texts
        text, after = ("".join(draw.choice("ab  \nÉ") for _ in range(draw.randint(0, 40))) for _ in range(2))
        cut = len(text) // 4
        own, edited = small.edited(text, len(text) - cut, after[:cut])
        assert (own == big.signature(text)).all() and (edited == big.signature(text[: len(text) - cut] + after[:cut])).all()


def test_with_next(spark, some, odd, none):
    rows = list(zip(some.doc_id.tolist(), some.text.tolist(), strict=True))
    got = {r["doc_id"]: r for r in weighted_minhash.with_next(docs_of(spark, random.Random(2).sample(rows, len(rows)))).collect()}
    one = weighted_minhash.Samples()
    for k, (i, t) in enumerate(rows):
        cut = len(t) // 4
        edited = t[: len(t) - cut] + rows[(k + 1) % len(rows)][1][:cut]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        own, other, after = (one.signature(x) for x in (t, edited, rows[(k + 1) % len(rows)][1]))
        assert got[i]["fingerprint"] == weighted_minhash.to_hex(own) and got[i]["edited_fingerprint"] == weighted_minhash.to_hex(other)
        assert got[i]["near_edited"] == (own == other).mean() and got[i]["near_next"] == (own == after).mean()
    got = weighted_minhash.with_next(odd).collect()
    assert len(got) == len(ODD)
    same = [r["fingerprint"] for r in got if r["doc_id"] in (6, 7)]
    assert len(set(same)) == 1
    assert weighted_minhash.with_next(none).count() == 0
    assert weighted_minhash.with_next(docs_of(spark, [(5, "only one here")])).first()["near_next"] == 1.0
    both = weighted_minhash.fingerprints(odd.where("doc_id = 6")).withColumn("again", F.col("fingerprint"))
    assert both.select(weighted_minhash.likeness(F.col("fingerprint"), F.col("again"))).first()[0] == 1.0


def test_crc_of_pieces(spark, odd):
    rows = packing.packed_documents(odd.where("doc_id = 10"), tokens.public_path(packing.FILE)).orderBy("start").collect()
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(tokens.public_path(packing.FILE)).encode(dict(ODD)[10], add_special_tokens=False).ids, 1], "<u4")
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)


def five_word_groups(rows):
    """Least index of each group of rows whose texts' five-word shingle sets have a similarity of 0.8 or more."""
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(rows))]


def test_keep_one_finds_all_similar(spark):
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(4)) for _ in range(900)]
    line = " ".join(vocabulary[:9])  # common to most texts
    texts = []
    for _ in range(25):
        words = [draw.choice(vocabulary) for _ in range(draw.choice([3, 60, 150, 400]))]
        for _ in range(6):  # similarities from about 0.6 to 1
            copy = list(words)
            for _ in range(draw.randint(0, max(1, len(words) // 25))):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            texts.append(" ".join(copy) + (f" {line}" if draw.random() < 0.8 else ""))
    groups = five_word_groups(texts)
    assert 25 < len(set(groups)) < len(texts)
    got = simhash.keep_one(docs_of(spark, enumerate(texts))).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(set(groups))


def test_keep_one_by_row(spark):
    """Rows without an id and rows of one id with several texts don't stand for one another."""
    draw = random.Random(12)
    a, b, c, d, e = (" ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(80)) for _ in range(5))
    rows = [(None, c), (None, d), (5, a), (5, b), (3, b), (9, e), (None, e), (9, e), (None, d), (4, None), (None, "")]
    for groups in (simhash.similar_texts, simhash.near_duplicates):
        got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(spark, rows), groups).collect()]
        assert sorted(got, key=str) == sorted([(None, c), (None, d), (5, a), (3, b), (9, e), (4, None)], key=str)


def test_bitmaps_allow_every_similar_pair():
    from shelfspark.llm import shingle_join as sj

    rng = np.random.default_rng(7)
    refused = 0
    for _ in range(400):
        n = int(rng.integers(1, 600))
        whole = np.unique(rng.integers(0, 1 << 64, n + 1, dtype=np.uint64, endpoint=False))
        a, b = (whole[rng.random(len(whole)) < rng.uniform(0.6, 1)] for _ in range(2))
        marks = [sj.bitmap(x).view(np.int64)[None, :] for x in (a, b)]  # signed, as Spark hands them over
        ok = bool(sj._allowed(np.array([len(a)]), marks[0], np.array([len(b)]), marks[1])[0])
        assert ok or not sj.similar(a, b)
        refused += not ok
    assert refused > 50


def test_similar_pairs_of_a_hot_group(spark):
    """Texts that share a passage and lie on both sides of the threshold, more of them than the rounds before the last
    try: the components are those of all pairs."""
    from shelfspark.llm import components, shingle_join as sj

    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.choice(np.arange(20, 60), int(rng.integers(1, 4)), replace=False):
            words[at] = f"x{int(rng.integers(0, 30))}"
        texts.append(" ".join(words))
    texts = sorted(set(texts))
    sets = [sj.shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and sj.similar(sets[i], sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    links = sj.links(df)
    pairs = [(r["u"], r["v"]) for r in links.collect()]
    assert all(u < v and sj.similar(sets[u], sets[v]) for u, v in pairs)
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == root

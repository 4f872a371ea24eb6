"""Conversation repair, Merkle manifest and decontamination against brute force, and on nulls, empties, ties, repeats, long
texts, empty tables and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import conversation_repair as cr
from shelfspark.llm import decontamination as dc
from shelfspark.llm import merkle, order

# -- places


def test_numbered_is_gapless_and_splits_a_hot_key(spark):
    rows = spark.createDataFrame([(k if k % 3 else 7, "x") for k in range(3000)], "k long, v string").repartition(5)
    found = order.numbered(rows, [F.col("k").asc_nulls_first()], "numbers").collect()
    assert sorted(r["at"] for r in found) == list(range(3000))
    assert [r["k"] for r in sorted(found, key=lambda r: r["at"])] == sorted(r["k"] for r in found)


# -- conversation repair

NEXT = {0: 2, 1: 2, 2: 3, 3: 2}


def plainly(rows):
    """rows (turn, role, text) of one conversation after damage, in order -> the report, by a plain search over (cost, audit)."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    steps = [best]
    for (_, role, _), fault in zip(reversed(rows), reversed(faults)):
        later, here = steps[-1], {}
        for s in range(4):
            own = [(later[s][0] + 3, "D" + later[s][1])]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(role[:1], {}).get(s)
                if kept:
                    own.append((extra + later[kept][0], "K" + later[kept][1]))
                own.append((2 + extra + later[NEXT[s]][0], "R" + later[NEXT[s]][1]))
            here[s] = min(own)
        for _ in range(4):
            here = {s: min(here[s], (2 + here[NEXT[s]][0], "I" + here[NEXT[s]][1])) for s in range(4)}
        steps.append(here)
    cost, audit = steps[-1][0]
    state, lines, left = 0, [], iter(rows)
    for op in audit:
        _, role, text = next(left) if op != "I" else (None, "", "")
        if op == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        elif op != "D":
            state = NEXT[state]
            role = {2: "user", 3: "assistant"}[state]
        if op != "D":
            lines.append(f"{role}:{text}")
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged_plainly(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def report(df):
    return {r["conv_id"]: tuple(r[c] for c in (*cr.REPORT, "audit", "repaired_sha256")) for r in df.collect()}


def made(seed, sizes, hot=()):
    draw = random.Random(seed)
    texts = ["", " \t", "Hi.", "Well?", "no end", "Ünï!", "same words.", "tail \n", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    return [(c, t if draw.random() > 0.05 else t + 3, draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.random()}{draw.choice('.!? x')}") for c, n in enumerate(sizes) for t in range(n)]


KIND = "conv_id long, turn long, role string, text string"


def ordered(spark, rows):
    """Conversations in the order that the operator states (ties by role and a hash)."""
    df = spark.createDataFrame(rows, KIND).withColumn("h", F.xxhash64("text"))
    low = lambda x: (x is not None, x)
    convs = {}
    for r in sorted(df.collect(), key=lambda r: (low(r["turn"]), r["role"], r["h"])):
        convs.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    return convs


@pytest.mark.parametrize("chunk", [4096, 7])
def test_repair_equals_plain_search(spark, monkeypatch, chunk):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    rows = made(5, [*range(9), 2, 3, 40, 160])
    rows += [(None, None, "user", "a."), (None, 1, "assistant", "b."), (None, 1, "assistant", "b."), (77, None, None, None)]
    hurt = damaged_plainly(rows)
    wanted = {c: plainly(r) for c, r in ordered(spark, hurt).items()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("at", "chunk", "sign", "entry", "audit", "symbols", "copy", "kind")})
    got = report(cr.repair(cr.damage(df), df.select("conv_id")))
    assert got == {c: wanted.get(c, nothing) for c in {r[0] for r in rows}}
    lines = {}
    for r in cr.repaired(cr.damage(df)).collect():
        lines.setdefault(r["conv_id"], {})[r["position"]] = f"{r['role']}:{r['text']}"
    for c, x in wanted.items():
        assert hashlib.sha256("\n".join(lines.get(c, {})[i] for i in range(len(lines.get(c, {})))).encode()).hexdigest() == x[-1]


def test_repair_of_a_hot_conversation_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK", 16)
    # Roles and cuts that carry a choice over chunk borders: long runs of one role, with kept systems and strangers between.
    runs = ["user"] * 50 + ["assistant"] * 70 + ["tool"] * 33 + ["user", "assistant"] * 40 + ["system"] * 20
    rows = [(1, t, role, f"line {t}.") for t, role in enumerate(runs)] + [(2, 0, "user", "x" * 200_000)]
    got = report(cr.repair(spark.createDataFrame(rows, KIND)))
    assert got == {c: plainly(r) for c, r in ordered(spark, rows).items()}


def test_fix_up_passes_end_for_vectors_that_never_converge(spark):
    parts = [(1, k, k == 5, "b" * 9) for k in range(6)]  # deletes alone carry the vector on unchanged
    chunks = spark.createDataFrame(parts, "conv_id long, chunk long, last boolean, symbols string")
    ends = {r["chunk"]: r["ends"] for r in cr.stitched(chunks).collect()}
    assert all(ends[k] == cr.TERMINAL.tolist() for k in range(6))


def test_repair_of_no_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert cr.repair(cr.damage(none), none.select("conv_id")).count() == 0
    assert cr.repaired(none).count() == 0


def test_repair_query(spark, sf_dir):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    convs = ordered(spark, damaged_plainly(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert report(cr.op11_conversation_repair(spark, sf_dir)) == {c: plainly(convs[c]) if c in convs else nothing for c in {r[0] for r in rows}}


# -- Merkle manifest


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree_plainly(leaves):
    """Levels of a tree of hex digests, leaves first."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def test_addresses_are_a_van_emde_boas_order():
    for depths in range(1, 6):
        at = merkle.addresses(depths)
        assert [len(x) for x in at] == [8**d for d in range(depths)]
        assert sorted(np.concatenate(at).tolist()) == list(range(sum(8**d for d in range(depths))))
    whole, top, below = merkle.addresses(5), merkle.addresses(2), merkle.addresses(3)
    assert [x.tolist() for x in whole[:2]] == [x.tolist() for x in top]
    for s in (0, 1, 63):  # each lower subtree lies in one piece, in its own such order
        for d in range(3):
            assert (whole[2 + d][s * 8**d : (s + 1) * 8**d] == 9 + s * 73 + below[d]).all()


def test_layout_gives_nodes_back():
    for n in (1, 2, 8, 9, 64, 65, 100, 513):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        height = merkle.height_of(n)
        sub = merkle.Subtree(merkle.layout(leaves, height), n, height)
        levels = tree_plainly([x.hex() for x in leaves])
        assert len(levels) == height + 1
        for up, level in enumerate(levels):
            assert [sub.node(height - up, i).decode() for i in range(len(level))] == level


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def merkle_plainly(docs):
    one = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda i, text, lang, source, n: sha("".join(map(one, (i, source, lang, n, text))))
    groups = {}
    for i, text, lang, source, n in docs:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf(i, text, lang, source, n), i, leaf(i, low(text), lang, source, n)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_plainly([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree_plainly([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, own, doc_id, changed) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            now = changed if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else own
            siblings = []
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    run = level[at - at % 8 : at - at % 8 + 8]
                    siblings += [x for j, x in enumerate(run) if j != at % 8]
                    now = sha("".join([*run[: at % 8], now, *run[at % 8 + 1 :]]))
                    at //= 8
            root = top[-1][0]
            out.append((doc_id, own, trees[g][-1][0], root, sha("".join(siblings)), now, now == root))
    return sorted(out, key=repr)


def merkle_rows(spark, monkeypatch, tmp_path, docs):
    path = tmp_path / "documents.parquet"
    spark.createDataFrame(docs, FIELDS).withColumns({c: F.lit("x") for c in ("id", "group", "digest", "tree", "at", "block", "leaf")}).repartition(3).write.parquet(str(path))
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


ODD = [(None, "No id", "en", None, 5), (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (1, "Other", "en", "b", 5), (2, "LONG " * 50_000, "de", "a", 250_000), (3, "Ünï CÖDE", "Zz", "a", 8), (4, "AB", "", "a", 2), (5, None, "en", "a", None)]


@pytest.mark.parametrize("fan_levels", [4, 1])
def test_manifest_equals_plain_tree(spark, monkeypatch, tmp_path, fan_levels):
    monkeypatch.setattr(merkle, "LEVELS", fan_levels)  # 1: subtrees of 8 leaves, so that tiers stand on tiers
    monkeypatch.setattr(merkle, "LEAVES", 8**fan_levels)
    docs = [*ODD, *((i, f"Text {i}", "fr" if i % 3 else "es", "s", i) for i in range(10, 160)), *((1000 + i, "Ab", f"l{i:02}", "s", 2) for i in range(20))]
    assert merkle_rows(spark, monkeypatch, tmp_path, docs) == merkle_plainly(docs)


def test_manifest_of_few_rows(spark, monkeypatch, tmp_path):
    one = [(7, "Alone", "en", "s", 5)]
    assert merkle_rows(spark, monkeypatch, tmp_path / "one", one) == merkle_plainly(one)
    assert merkle_rows(spark, monkeypatch, tmp_path / "none", []) == []


# -- decontamination


def hits_plainly(docs, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    wins = {}
    for i, t in items:
        w = cut(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, met = cut(t), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in wins:
                    hit |= set(range(s, s + k))
                    met |= wins[x]
        out.append((i, len(w), len(hit), len(met), sha(",".join(sorted(met))), bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_equals_plain_search(spark):
    draw = random.Random(3)
    vocabulary = [*(f"w{i}" for i in range(30)), "Ünï", "über", "ß", "É", "5", "x7"]
    say = lambda n: " ".join(draw.choice(vocabulary) + draw.choice(["", ".", ",", "-", "\x00", " "]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([1, 2, 3, 9, 10, 11, 40, 60])]
    items += [(100, items[5][1]), (100, "And more words of one item"), (101, items[5][1].upper()), (None, items[6][1]), (None, "Nothing to find here"), (102, None), (103, " .;"), (104, "common " * 30)]
    docs = [(i, say(draw.randrange(80))) for i in range(40)]
    docs += [(200 + i, say(20) + " " + items[k % 8][1].upper() + "! " + say(k)) for i, k in enumerate(range(24))]
    docs += [(300, " ".join(t for _, t in items if t)), (300, "other text"), (None, items[6][1]), (None, None), (301, ""), (302, "common " * 5000), (303, "common " * 9)] + [(400 + i, items[7][1]) for i in range(50)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("h1", "line", "w", "win", "n_words", "start", "shingle", "count")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("x") for c in ("cls", "w", "win", "size")})
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in dc.contaminated(df, bench).collect()), key=repr)
    assert got == hits_plainly(docs, items)


def test_decontamination_beyond_the_broadcast_bound(spark, monkeypatch):
    from shelfspark.llm import common

    items = [(i, " ".join(f"a{j}" for j in range(i, i + 14))) for i in range(5)] + [(10, "a3 a4"), (11, "a29"), (12, "a0 a1 a2 a3")]
    docs = [(i, " ".join(f"a{j}" for j in range(i, i + 30))) for i in range(30)] + [(40, "a1 " + "b " * 40 + " ".join(f"a{j}" for j in range(4, 14))), (41, "a29"), (42, " ".join(f"a{j}" for j in range(10)))]
    monkeypatch.setattr(common, "is_small", lambda *_: False)
    monkeypatch.setattr(dc, "is_small", lambda *_: False)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == hits_plainly(docs, items)


def test_decontamination_shuffles_no_whole_texts(spark, monkeypatch):
    """Beyond the bound, the words that go with a place are those that a window could need."""
    lines = spark.createDataFrame([(1, 2, " ".join(f"w{i}" for i in range(500)))], "h1 long, h2 long, line string")
    keys = lines.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(497)), lambda k: dc._shingle(F.split("line", " "), k, 3))).alias("shingle"))
    monkeypatch.setattr(dc, "is_small", lambda *_: False)
    rows = dc._probed(lines, keys, 3, 7).collect()
    assert len(rows) == 498 and max(len(r["near"]) for r in rows) == 17
    assert all(r["near"][r["pos"] - r["first"]] == f"w{r['pos']}" and r["first"] == max(0, r["pos"] - 7) for r in rows)


def test_decontamination_spans_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "so one two three four five six seven eight nine ten eleven")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "One two, three four five six seven eight nine ten")], "item_id long, text string")
    assert [(r["doc_id"], r["start"], r["length"]) for r in dc.spans(docs, items).collect()] == [(1, 1, 10)]
    assert dc.contaminated(docs.where("false"), items).count() == 0
    row = dc.contaminated(docs, items.where("false")).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"], row["items_sha256"]) == (12, 0, False, sha(""))


def test_decontamination_is_native(spark, sf_dir):
    plan = dc.op13_decontamination(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

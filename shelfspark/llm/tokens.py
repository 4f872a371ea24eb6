"""Token ids of whole texts by a public tokenizer file, each distinct chunk of a worker encoded once.

A chunk is what lies between two single blanks: no pre-tokenizer or piece of the three vocabularies reaches over such a
place, so ids of a text are the ids of its chunks in order (checked against whole texts in the tests). The table of
chunks is per worker and bounded (see WordTable). Null texts are empty. Ids are kept as little-endian unsigned 16-bit integers (all three vocabularies have fewer than 65,536 ids)."""

from __future__ import annotations

import json
import os
import string
from array import array
from collections.abc import Iterable, Iterator
from operator import attrgetter
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WordTable, each_batch, kept_in_worker

_ID = attrgetter("id")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class BlankSplit:
    """Chunks of a text, cut before each blank that has a character other than white space on both sides.

    Keys of the table are chunks without that blank; the first chunk of a text (no blank before it) and chunks with
    further white space are marked by `\\0 `, which no other key can begin with (a plain key holds no blank)."""

    @staticmethod
    def split(text: str) -> list[str]:
        if not text:
            return []
        parts = text.split(" ")
        if "" not in parts and not _odd_space(text):
            parts[0] = "\0 " + parts[0]
            return parts
        keys, now = [], parts[0]
        for p in parts[1:]:
            if p and not p[0].isspace() and now and not now[-1].isspace():
                keys.append(now)
                now = " " + p
            else:
                now += " " + p
        keys.append(now)
        return ["\0 " + keys[0], *(k[1:] if k[0] == " " and " " not in k[1:] else "\0 " + k for k in keys[1:])]

    @staticmethod
    def text_of(key: str) -> str:
        return key[2:] if key.startswith("\0 ") else " " + key


#: White space beside a blank, or white space other than a blank or a line end.
_ODD = ["\n ", " \n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


def _odd_space(text: str) -> bool:
    return any(c in text for c in _ODD)


#: A text with blanks at its ends or side by side, or with what _odd_space finds.
_ODD_TEXT = r"\A | \z|  |" + "|".join("".join(f"\\x{{{ord(c):x}}}" for c in x) for x in _ODD)


def _python(strings: pa.Array) -> list[str]:
    """Faster than to_pylist() for many short strings."""
    return strings.to_numpy(zero_copy_only=False).tolist()


#: ASCII characters that are neither letters nor digits nor white space: a run of them behind letters is one pre-token.
_STOPS = string.punctuation


#: Distinct chunks, and other runs, of a generation of a worker's tables.
MOST_CHUNKS, MOST_RUNS = 700_000, 150_000


class TokenizersTable(BlankSplit):
    """The tokenizers library as a segmenter of chunks. Most chunks are one run of letters with other marks behind it: the
    pre-tokenizer would cut such a chunk there and nowhere else, so the library's model is asked for these two runs
    alone and each is kept once. All other chunks pass through the whole library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.runs, self.table = Tokenizer.from_file(path), WordTable(self._run, MOST_RUNS), WordTable(self.key, MOST_CHUNKS)
        self.model = self.tokenizer.model
        spec = json.loads(Path(path).read_text())
        self.lower = spec["normalizer"] is not None  # the file that lower-cases and drops white space
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the byte-level alphabet: printable bytes stand for themselves
        other = iter(range(256, 512))
        self.alphabet = {b: b if b in keep else next(other) for b in range(256)}

    def _run(self, run: str) -> bytes:
        """Ids of one pre-token."""
        if run.isascii() and run[0] == " " and run[1:].isalpha():  # only the blank is mapped
            mapped = "\u0120" + run[1:]
        else:
            mapped = run.encode().decode("latin-1").translate(self.alphabet)
        return array("H", map(_ID, self.model.tokenize(mapped))).tobytes()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text. Arrow splits the texts and finds their distinct chunks, so that the table is asked once for each;
        texts with white space beside a blank, or of an odd kind, are split one by one."""
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        get, split = self.table.__getitem__, self.split
        odd = pc.or_(pc.match_substring_regex(texts, _ODD_TEXT), pc.equal(texts, ""))
        plain, others = iter(self._by_distinct(texts.filter(pc.invert(odd)))), iter(_python(texts.filter(odd)))
        out = [b"".join(map(get, split(next(others)))) if o else next(plain) for o in odd.to_numpy(zero_copy_only=False).tolist()]
        self.table.make_room()
        self.runs.make_room()
        return out

    def _by_distinct(self, texts: pa.Array, step: int = 500) -> Iterator[bytes]:
        """Ids of texts whose chunks are what lies between blanks. `step` texts are put together at a time."""
        chunks = pc.split_pattern(texts, " ")
        bounds, coded = chunks.offsets.to_numpy(), chunks.values.dictionary_encode()
        first = _python(chunks.values.take(pa.array(bounds[:-1])))  # no blank before these
        ids = list(map(self.table.__getitem__, [*_python(coded.dictionary), *("\0 " + c for c in first)]))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u2")
        which = coded.indices.to_numpy().astype(np.int64)
        which[bounds[:-1]] = len(ids) - len(first) + np.arange(len(first))
        for a in range(0, len(texts), step):
            cut = bounds[a : a + step + 1]
            now = which[cut[0] : cut[-1]]
            n = sizes[now]
            ends = np.cumsum(n)
            data = flat[np.repeat(starts[now] - (ends - n), n) + np.arange(ends[-1])].tobytes()
            at = (2 * np.concatenate([[0], ends])[cut - cut[0]]).tolist()
            yield from (data[i:j] for i, j in zip(at, at[1:], strict=False))

    def _plain(self, text: str) -> list[str] | None:
        """The pre-tokens of a chunk of the plain form, or None for any other chunk."""
        out: list[str] = []
        lines = text.split("\n")
        for i, line in enumerate(lines):
            core = line.rstrip(_STOPS)
            bare = core[1:] if core[:1] == " " else core
            if self.lower:
                bare = core = bare if bare.islower() and bare.isascii() else bare.lower()
            if not bare.isalpha() or (self.lower and not bare.isascii() and (not is_normalized("NFC", bare) or "\u03c3" in bare or "\u03c2" in bare)):
                return None
            if i and not self.lower:
                out.append("\n")
            out.append(core)
            if len(core) < len(line) and (tail := line[len(line.rstrip(_STOPS)):]):
                out.append(tail)
        return out

    def key(self, key: str) -> bytes:
        """Ids of a chunk by its key: letters with marks behind them at once, others by way of _plain or the library."""
        core = key if key.isalpha() else key.rstrip(_STOPS)
        if core.isalpha() and (not self.lower or core.isascii()):
            if len(core) < len(key):  # letters alone are a chunk too, so each word is asked for once
                return self.table[core] + self.runs[key[len(core):]]
            if not self.lower:
                return self._run(" " + core)
            return self._run(core) if core.islower() else self.table[core.lower()]
        chunk = self.text_of(key)
        plain = self._plain(chunk)
        if plain is None:
            return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u2").tobytes()
        return b"".join(map(self.runs.__getitem__, plain))


def encoded(batches: Iterable[pa.RecordBatch], path: str, rows: int = 4000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the ids of its texts, by one table per Python worker."""
    one = kept_in_worker("tokens/table", path, lambda: TokenizersTable(path))
    for b in each_batch(batches, rows, 6 << 20):
        yield b, one.encode(b.column("text"))
